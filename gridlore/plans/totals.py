"""Queries of totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlore.constants import DISTRICT_IDS
from gridlore.functions import time as tm
from gridlore.operators import live
from gridlore.operators import totals as tt
from gridlore.plans.registry import query
from gridlore.views import HISTORY_NOW, NOW, now

_NOW = f"TIMESTAMP '{NOW}'"
_HNOW = f"TIMESTAMP '{HISTORY_NOW}'"
_STATUS = f"""CASE WHEN starts_at <= {_NOW} AND coalesce(ends_at, starts_at + INTERVAL 72 HOUR) > {_NOW} THEN 'active'
  WHEN starts_at > {_NOW} THEN 'upcoming' ELSE 'past' END"""
_LOCAL = "timezone('Europe/Nicosia', timezone('UTC', {}))"
_MONTH = f"strftime({_LOCAL.format('starts_at')}, '%Y-%m')"
_SPINE = f"""spine AS (SELECT strftime(date_trunc('month', {_LOCAL.format(_HNOW)}) - to_months(k), '%Y-%m') AS month FROM range(12) AS t(k))"""


def _monthly(where: str = "true") -> str:
    hours = "floor(coalesce({}, 0) * 10 / 60.0 + 0.5) / 10"
    long = "CASE WHEN epoch(ends_at) > epoch(starts_at) THEN ((epoch(ends_at) - epoch(starts_at)) / 60)::BIGINT END"
    return f"""WITH {_SPINE}, sums AS (SELECT district, {_MONTH} AS month, sum({long}) FILTER (kind <> 'fault') AS p, sum({long}) FILTER (kind = 'fault') AS f,
      count(*) FILTER (kind = 'fault' AND ends_at IS NULL) AS o FROM v_history WHERE {where} GROUP BY 1, 2)
    SELECT d.district, month, {hours.format("p")} AS planned_hours, {hours.format("f")} AS fault_hours, coalesce(o, 0) AS open_faults
    FROM (SELECT DISTINCT district FROM v_history WHERE {where}) d CROSS JOIN spine LEFT JOIN sums USING (district, month)"""


def _history(v):
    return tt.monthly_totals(v.history, now(HISTORY_NOW), "district")


@query("o_agg_monthly", _monthly(), "v_history")
def agg_monthly(v):
    return _history(v)


@query("o_agg_monthly_db", _monthly("starts_at >= TIMESTAMP '1997-07-01 00:00:00'"), "v_history")
def agg_monthly_db(v):
    return tt.monthly_totals(v.history.where(F.col("starts_at") >= tt.stored_month_bound(now(HISTORY_NOW))), now(HISTORY_NOW), "district")


@query("o_agg_monthly_exact", _monthly("starts_at >= TIMESTAMP '1997-06-30 21:00:00'"), "v_history")
def agg_monthly_exact(v):
    return tt.monthly_totals(v.history.where(F.col("starts_at") >= tt.exact_month_bound(now(HISTORY_NOW))), now(HISTORY_NOW), "district")


_TOTALS = f"""WITH m AS ({_monthly("district = 'girne'")}) SELECT round(sum(planned_hours + fault_hours), 1) AS total_hours, greatest(max(planned_hours + fault_hours), 1.0) AS peak,
  (SELECT month FROM m ORDER BY planned_hours + fault_hours DESC, month LIMIT 1) AS peak_month, sum(open_faults)::BIGINT AS open_faults FROM m"""


@query("o_agg_totalhours", _TOTALS, "v_history")
@query("o_agg_peak", _TOTALS, "v_history")
def agg_totalhours(v):
    return tt.total_and_peak(tt.monthly_totals(v.history.where("district = 'girne'"), now(HISTORY_NOW), "district"))


@query(
    "o_dt_spine",
    f"WITH {_SPINE}, d AS (SELECT DISTINCT district FROM v_history), n AS (SELECT district, {_MONTH} AS month, count(*) AS n FROM v_history GROUP BY ALL) SELECT d.district, month, coalesce(n.n, 0) AS n FROM d CROSS JOIN spine LEFT JOIN n USING (district, month)",
    "v_history",
)
def dt_spine(v):
    """Records of each district by month, months without any included."""
    counts = v.history.groupBy("district", F.date_format(tm.local(F.col("starts_at")), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    every = v.history.select("district").distinct().select("district", F.explode(tt.last_months(now(HISTORY_NOW))).alias("month"))
    return every.join(counts, ["district", "month"], "left").select("district", "month", F.coalesce("n", F.lit(0)).alias("n"))


@query("o_mth_bar", f"WITH m AS ({_monthly()}) SELECT district, month, greatest(1, round(planned_hours / greatest(1, max(planned_hours + fault_hours) OVER (PARTITION BY district)) * 100))::INT AS bar FROM m", "v_history")
def mth_bar(v):
    peak = F.greatest(F.lit(1.0), F.max(F.col("planned_hours") + F.col("fault_hours")).over(Window.partitionBy("district")))
    return _history(v).select("district", "month", F.greatest(F.lit(1), F.round(F.col("planned_hours") / peak * 100)).cast("int").alias("bar"))


@query(
    "o_agg_distinct_districts",
    f"SELECT count(DISTINCT district) AS districts, coalesce(bool_or(kind = 'fault'), false) AS fault FROM v_outages WHERE cancelled_at IS NULL AND {_STATUS} = 'active'",
    "v_outages",
)
def agg_distinct_districts(v):
    active = live.with_status(v.outages.where("cancelled_at is null"), now()).where("status = 'active'")
    return active.agg(F.count_distinct("district").alias("districts"), F.coalesce(F.bool_or(F.col("kind") == "fault"), F.lit(False)).alias("fault"))


_STATES = f"""WITH s AS (SELECT *, {_STATUS} AS status FROM v_outages WHERE cancelled_at IS NULL),
  g AS (SELECT district, count(*) FILTER (status = 'active') AS active, bool_or(kind = 'fault') FILTER (status = 'active') AS fault,
    first(kind ORDER BY starts_at, id) FILTER (status = 'active') AS first_kind, min(starts_at) FILTER (status = 'upcoming') AS next_start FROM s GROUP BY 1)
  SELECT d AS district, CASE WHEN active > 0 THEN 'active' WHEN next_start IS NOT NULL THEN 'upcoming' ELSE 'quiet' END AS state, coalesce(active, 0) AS active,
    CASE WHEN active > 0 THEN CASE WHEN fault THEN 'fault' ELSE first_kind END END AS kind,
    strftime(CASE WHEN coalesce(active, 0) = 0 THEN next_start END, '%Y-%m-%dT%H:%M:%SZ') AS next_start
  FROM unnest({list(DISTRICT_IDS)!r}) AS t(d) LEFT JOIN g ON g.district = d"""


@query("o_agg_district_state", _STATES, "v_outages")
def agg_district_state(v):
    return tt.district_states(v.spark, v.outages.where("cancelled_at is null"), now())


@query("o_win_next", f"SELECT district, strftime(starts_at, '%Y-%m-%dT%H:%M:%SZ') AS starts_at, id FROM v_outages WHERE {_STATUS} = 'upcoming' QUALIFY row_number() OVER (PARTITION BY district ORDER BY v_outages.starts_at, id) = 1", "v_outages")
def win_next(v):
    coming = live.with_status(v.outages, now()).where("status = 'upcoming'")
    return coming.groupBy("district").agg(F.min(F.struct("starts_at", "id")).alias("n")).select("district", "n.*")


@query("o_agg_earliest", f"SELECT strftime(coalesce(min(starts_at), {_NOW}), '%Y-%m-%dT%H:%M:%SZ') AS since FROM v_outages WHERE list_contains(area_keys, 'place 7')", "v_outages")
def agg_earliest(v):
    return v.outages.where(F.array_contains("area_keys", "place 7")).agg(F.coalesce(F.min("starts_at"), now()).alias("since"))


@query("o_agg_monthkeys", f"SELECT DISTINCT {_MONTH} AS month FROM v_history", "v_history")
def agg_monthkeys(v):
    return v.history.select(tm.month_key(F.col("starts_at")).alias("month")).distinct()


@query(
    "o_agg_monthgroup",
    f"SELECT {_MONTH} AS month, district, count(*) AS n, array_to_string(list(id ORDER BY starts_at DESC, id)[1:6], '|') AS newest FROM v_history GROUP BY 1, 2",
    "v_history",
)
def agg_monthgroup(v):
    keyed = v.history.select(tm.month_key(F.col("starts_at")).alias("month"), "district", "starts_at", "id")
    order = Window.partitionBy("month", "district").orderBy(F.col("starts_at").desc(), "id")
    ranked = keyed.withColumn("k", F.row_number().over(order))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 6, F.struct("k", "id")))), lambda x: x["id"])
    return ranked.groupBy("month", "district").agg(F.count(F.lit(1)).alias("n"), listed.alias("newest"))


@query("o_agg_bounds", "SELECT strftime(min(starts_at), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(starts_at), '%Y-%m-%dT%H:%M:%SZ') AS last FROM v_outages", "v_outages")
def agg_bounds(v):
    return v.outages.agg(F.min("starts_at").alias("first"), F.max("starts_at").alias("last"))


@query("o_agg_runstats", "SELECT count(*) AS runs, count(*) FILTER (ok) AS ok, sum(created)::BIGINT AS created, sum(queued)::BIGINT AS queued FROM v_runs", "v_runs")
def agg_runstats(v):
    return v.runs.agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("ok"), 1)).alias("ok"), F.sum("created").alias("created"), F.sum("queued").alias("queued"))


@query(
    "o_agg_summary",
    f"""SELECT district, array_to_string(list(kind || ' ' || strftime(starts_at, '%H:%M') ORDER BY starts_at, id), ' · ') AS summary
    FROM v_outages WHERE cancelled_at IS NULL AND {_STATUS} = 'active' GROUP BY 1""",
    "v_outages",
)
def agg_summary(v):
    active = live.with_status(v.outages.where("cancelled_at is null"), now()).where("status = 'active'")
    line = F.concat_ws(" ", "kind", F.date_format("starts_at", "HH:mm"))
    items = F.array_sort(F.collect_list(F.struct("starts_at", "id", line.alias("line"))))
    return active.groupBy("district").agg(F.array_join(F.transform(items, lambda x: x["line"]), " · ").alias("summary"))


@query(
    "o_agg_unknown_names",
    """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)
    SELECT lower(w) AS name, count(*) AS n FROM w WHERE regexp_matches(w, '^[A-Z][a-z]{3}') AND lower(w) NOT IN ('this', 'that', 'with') GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, name LIMIT 200""",
)
def agg_unknown_names(v):
    words = v.table("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    named = words.where(F.col("w").rlike("^[A-Z][a-z]{3}")).select(F.lower("w").alias("name")).where(~F.col("name").isin("this", "that", "with"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "name").limit(200)
