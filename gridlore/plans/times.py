"""Queries of time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import time as tm
from gridlore.plans.registry import query
from gridlore.views import NOW, now

_NOW = f"TIMESTAMP '{NOW}'"
_L = "timezone('Europe/Nicosia', timezone('UTC', {}))"
_U = "timezone('UTC', timezone('Europe/Nicosia', {}))"
_ISO = lambda c, a: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {a}"
#: A wall clock for each order: of a fourth of them on the day when clocks go back, of a fourth when they go forward.
_WALLS = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN TIMESTAMP '2026-10-25' WHEN 1 THEN TIMESTAMP '2027-03-28' ELSE o_orderdate END + to_minutes((o_orderkey * 7 % 480)::INT) AS w FROM orders"""


def _walls(v):
    day = F.expr("case o_orderkey % 4 when 0 then timestamp'2026-10-25' when 1 then timestamp'2027-03-28' else cast(o_orderdate as timestamp) end")
    return v.table("orders").select(F.col("o_orderkey").alias("k"), (day + tm.minutes((F.col("o_orderkey") * 7 % 480).cast("int"))).alias("w"))


@query("o_dt_local", f"SELECT id, {_ISO(_L.format('starts_at'), 'wall')} FROM v_outages", "v_outages")
def dt_local(v):
    return v.outages.select("id", tm.local(F.col("starts_at")).alias("wall"))


@query("o_dt_toutc", f"WITH c AS ({_WALLS}) SELECT k, {_ISO(_U.format('w'), 'utc')} FROM c")
def dt_toutc(v):
    return _walls(v).select("k", tm.to_utc(F.col("w")).alias("utc"))


@query("o_dt_monthkey", f"SELECT id, strftime({_L.format('starts_at')}, '%Y-%m') AS month FROM v_history", "v_history")
def dt_monthkey(v):
    return v.history.select("id", tm.month_key(F.col("starts_at")).alias("month"))


@query("o_dt_readend", f"SELECT id, {_ISO('coalesce(ends_at, starts_at + INTERVAL 72 HOUR)', 'read_end')} FROM v_outages", "v_outages")
def dt_readend(v):
    return v.outages.select("id", tm.read_end(F.col("starts_at"), F.col("ends_at")).alias("read_end"))


@query("o_dt_hour", f"SELECT id, hour({_L.format('starts_at')})::INT AS hour FROM v_outages", "v_outages")
def dt_hour(v):
    return v.outages.select("id", tm.island_hour(F.col("starts_at")).alias("hour"))


@query("o_dt_daydiff", f"SELECT id, date_diff('day', {_L.format(_NOW)}::DATE, {_L.format('starts_at')}::DATE)::INT AS days FROM v_outages", "v_outages")
def dt_daydiff(v):
    return v.outages.select("id", tm.day_difference(F.col("starts_at"), now()).alias("days"))


@query(
    "o_dt_duration",
    """WITH m AS (SELECT event_id, event_id * 7 % 5000 AS t FROM events), p AS (SELECT event_id, t // 1440 AS d, t % 1440 // 60 AS h, t % 60 AS mi FROM m)
    SELECT event_id, CASE WHEN d > 0 THEN d || ' d' || CASE WHEN h > 0 THEN ' ' || h || ' h' ELSE '' END WHEN h > 0 THEN h || ' h' || CASE WHEN mi > 0 THEN ' ' || mi || ' min' ELSE '' END ELSE mi || ' min' END AS text FROM p""",
)
def dt_duration(v):
    return v.table("events").select("event_id", tm.duration_text((F.col("event_id") * 7 % 5000).cast("double")).alias("text"))


_DAYS = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"


@query(
    "o_dt_weekday",
    f"""WITH e AS (SELECT event_id, ts::DATE AS d, {_DAYS}[event_id % 7 + 1] AS w, {_L.format("ts")}::DATE AS p FROM events)
    SELECT event_id, strftime(CASE WHEN {_DAYS}[isodow(d)] = w THEN d ELSE p + ((list_position({_DAYS}, w) - isodow(p) + 7) % 7)::INT END, '%Y-%m-%d') AS date FROM e""",
)
def dt_weekday(v):
    day = F.element_at(F.array(*map(F.lit, tm._DAY_CODES)), (F.col("event_id") % 7 + 1).cast("int"))
    return v.table("events").select("event_id", tm.schedule_date(F.date_format("ts", "yyyy-MM-dd"), day, F.col("ts").cast("timestamp")).alias("date"))


_CLOCK = "lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0')"


@query(
    "o_dt_restored",
    f"""WITH e AS (SELECT event_id, ts, {_CLOCK} AS c, {_L.format("ts")}::DATE AS d FROM events),
    b AS (SELECT event_id, ts, {_U.format("strptime(strftime(d, '%Y-%m-%d') || ' ' || c, '%Y-%m-%d %H:%M')")} AS t0, {_U.format("strptime(strftime(d - 1, '%Y-%m-%d') || ' ' || c, '%Y-%m-%d %H:%M')")} AS t1 FROM e)
    SELECT event_id, {_ISO("CASE WHEN t0 <= ts AND ts <= t0 + INTERVAL 12 HOUR THEN t0 WHEN t1 <= ts AND ts <= t1 + INTERVAL 12 HOUR THEN t1 ELSE ts END", "at")} FROM b""",
)
def dt_restored(v):
    return v.table("events").select("event_id", tm.restored_at(F.date_format(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"), F.lit(0)), "HH:mm"), F.col("ts").cast("timestamp")).alias("at"))


@query(
    "o_dt_schedule",
    f"""WITH e AS (SELECT event_id, ts, event_id % 5 = 0 AS unstated, event_type = 'error' AS fault, event_id % 2 = 0 AS ongoing, {_U.format(f"strptime(strftime(ts, '%Y-%m-%d') || ' ' || {_CLOCK}, '%Y-%m-%d %H:%M')")} AS s,
      {_U.format("strptime(strftime(ts, '%Y-%m-%d') || ' 09:30', '%Y-%m-%d %H:%M')")} AS e FROM events)
    SELECT event_id, {_ISO("CASE WHEN unstated THEN ts ELSE s END", "starts_at")}, {_ISO("CASE WHEN unstated THEN NULL WHEN e <= s THEN e + INTERVAL 24 HOUR ELSE e END", "ends_at")}, unstated AS inferred FROM e WHERE NOT unstated OR (ongoing AND fault)""",
)
def dt_schedule(v):
    clock = F.format_string("%02d:%02d", (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"))
    entry = F.struct(
        F.when(F.col("event_type") == "error", "fault").otherwise("planned").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("weekday"),
        F.when(F.col("event_id") % 5 != 0, clock).alias("start"), F.lit("09:30").alias("end"), (F.col("event_id") % 2 == 0).alias("ongoing"),
    )
    rows = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("p"), entry.alias("e"))
    return rows.select("event_id", tm.schedule(F.col("e"), F.col("p")).alias("s")).where("s is not null").select("event_id", "s.*")


@query("o_dt_iso", f"SELECT event_id, {_ISO(_U.format(chr(115) + 'trptime(strftime(ts, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') || ' + chr(39) + ' 13:45' + chr(39) + ', ' + chr(39) + '%Y-%m-%d %H:%M' + chr(39) + ')'), 'at')} FROM events")
def dt_iso(v):
    return v.table("events").select("event_id", tm.instant_of(F.date_format("ts", "yyyy-MM-dd"), F.lit("13:45")).alias("at"))


@query("o_dt_valid", "SELECT event_id AS k, try_strptime(d, '%Y-%m-%d') IS NOT NULL AS ok FROM (SELECT event_id, '2026-' || lpad((event_id // 32 % 13)::VARCHAR, 2, '0') || '-' || lpad((event_id % 32)::VARCHAR, 2, '0') AS d FROM events)")
def dt_valid(v):
    date = F.format_string("2026-%02d-%02d", (F.floor(F.col("event_id") / 32) % 13).cast("int"), (F.col("event_id") % 32).cast("int"))
    return v.table("events").select(F.col("event_id").alias("k"), tm.valid_date(date).alias("ok"))


@query("o_dt_pubday", f"SELECT id, strftime({_L.format('published_at')}, '%Y-%m-%d %A') AS day FROM v_outages", "v_outages")
def dt_pubday(v):
    return v.outages.select("id", F.date_format(tm.local(F.col("published_at")), "yyyy-MM-dd EEEE").alias("day"))


@query("o_dt_icsstamp", "SELECT id, strftime(starts_at, '%Y%m%dT%H%M%SZ') AS stamp FROM v_outages", "v_outages")
def dt_icsstamp(v):
    return v.outages.select("id", tm.ics_stamp(F.col("starts_at")).alias("stamp"))


_MONTHS = f"{tm.MONTHS['en']!r}"


@query(
    "o_dt_daylabel",
    f"""WITH l AS (SELECT id, {_L.format("starts_at")} AS t, date_diff('day', {_L.format(_NOW)}::DATE, {_L.format("starts_at")}::DATE) AS n FROM v_outages)
    SELECT id, day(t) || ' ' || {_MONTHS}[month(t)] || ', ' || CASE n WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' WHEN -1 THEN 'Yesterday' ELSE strftime(t, '%A') END AS label FROM l""",
    "v_outages",
)
def dt_daylabel(v):
    return v.outages.select("id", tm.day_label(F.col("starts_at"), now(), "en").alias("label"))


@query(
    "o_agg_failreason",
    """SELECT event_id, CASE WHEN a > 0 AND b > 0 THEN 'no usable time, and no known place names' WHEN b > 0 THEN 'no usable time in the announcement' WHEN a > 0 THEN 'no known place names found'
      ELSE 'nothing usable in the extraction' END AS reason FROM (SELECT event_id, event_id % 2 AS a, user_id % 2 AS b FROM events) WHERE a + b > 0""",
)
def agg_failreason(v):
    from gridlore.operators.resolve import outcome

    e = v.table("events").select("event_id", (F.col("event_id") % 2).alias("a"), (F.col("user_id") % 2).alias("b")).where("a + b > 0")
    none, false = F.lit(None).cast("string"), F.lit(False)
    return e.select("event_id", outcome(none, false, F.col("a") + F.col("b"), F.col("b"), F.col("a"))[1])
