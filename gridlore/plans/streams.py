"""Queries that run streams over events as announcements, and the parse chain they share.

Four events tell of one place and day: a planned interruption, its repeat by another outlet (or its
withdrawal), an open fault, and its repair (or an answer that cannot be read).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.operators import resolve
from gridlore.plans.registry import query
from gridlore.session import shared_folder, written
from gridlore.streaming import ingest, late, seen
from gridlore.streaming.snapshots import Snapshots
from gridlore.constants import DISTRICT_IDS
from gridlore.views import NOW, _at

_NOW = datetime.fromisoformat(NOW)
_ENTRY = """concat('{"outages":[{"kind":"', if(r = 2, 'fault', 'planned'), '","date":"', day, '","start":"', if(r = 2, '22:00', '09:00'), '",',
  if(r = 2, '', '"end":"13:00",'), '"areas":["Place ', q % 40, '"],"cancelled":', r = 1 and q % 3 = 0, ',"ongoing":false,"resolved":', r = 3, if(r = 3, ',"restoredAt":"23:30"', ''), '}]}')"""


def announced(events: DataFrame) -> DataFrame:
    """Announcements of events (event_id), in a batch or a stream."""
    e = events.select("event_id", F.expr("event_id div 4").alias("q"), F.expr("event_id % 4").alias("r"))
    e = e.withColumn("day", F.expr("date_add(date'2000-01-01', cast(q div 40 as int))"))
    url = F.expr("concat('https://www.outlet', r, '.example/n', event_id, '-notice')")
    return e.select(
        url.alias("url"), F.struct(F.expr("concat('Outlet ', r)").alias("name"), url.alias("url"), F.lit("press").alias("kind")).alias("source"),
        F.expr("concat('Notice ', event_id)").alias("title"), F.expr(f"case when r = 3 and q % 4 = 1 then 'unreadable' when r = 3 and q % 4 = 3 then 'silence' else {_ENTRY} end").alias("body"),
        F.expr("cast(date_add(day, 1) as timestamp) + interval 6 hours").alias("published_at"), F.expr("cast(date_add(day, 1) as timestamp) + interval 7 hours").alias("fetched_at"),
    )


def answer(title: str, body: str, day: str) -> str:
    """The extractor: these announcements are answers already."""
    if body == "silence":
        raise ValueError("no answer")
    return body


def _stream(v) -> DataFrame:
    """The events as a stream of files; the pattern also takes a table of many parts."""
    return v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.dir}/events.parquet*")


def _gazetteer(v) -> resolve.Gazetteer:
    return resolve.Gazetteer.of(v.settlements.select("name", "district", F.array().cast("array<string>").alias("aliases"), F.expr("cast(substr(name, 7) as int)").alias("ordinal")))


def _polled(v) -> Snapshots:
    """The tables after a run over what is there."""
    root = shared_folder(v.spark, "poll")
    tables = Snapshots(v.spark, root)
    ingest.follow(announced(_stream(v)), tables, answer, _gazetteer(v), f"{root}/checkpoint", now=_NOW).awaitTermination()
    return tables


_EVENTS = "e AS (SELECT event_id, event_id // 4 AS q, event_id % 4 AS r, 'https://www.outlet' || event_id % 4 || '.example/n' || event_id || '-notice' AS url FROM events)"
_AT = lambda clock: f"strftime(timezone('UTC', timezone('Europe/Nicosia', (day || ' {clock}')::TIMESTAMP)), '%Y-%m-%dT%H:%M:%SZ')"
_TOLD = f"""WITH {_EVENTS}, s AS (SELECT q, 'Place ' || q % 40 AS place, strftime(DATE '2000-01-01' + (q // 40)::INT, '%Y-%m-%d') AS day, bool_or(r = 0) AS planned, bool_or(r = 1) AS again, bool_or(r = 2) AS fault, bool_or(r = 3) AS over
    FROM e GROUP BY q), t AS (SELECT s.*, district FROM s JOIN v_settlements ON name = place)"""


@query(
    "o_stm_order",
    f"""{_TOLD} SELECT place AS areas, district, 'planned' AS kind, {_AT("09:00")} AS starts_at, {_AT("13:00")} AS ends_at, 1 + (again AND q % 3 <> 0)::INT AS n_sources,
      CASE WHEN again AND q % 3 = 0 THEN 'retracted' END AS cancelled_reason FROM t WHERE planned
    UNION ALL SELECT place, district, 'fault', {_AT("22:00")}, CASE WHEN over AND q % 2 = 0 THEN {_AT("23:30")} END, 1, NULL FROM t WHERE fault""",
    "v_settlements",
)
def stm_order(v):
    """Records after a streamed run: stored and merged, then withdrawn, then closed by repairs."""
    return _polled(v).read("outages", ingest.OUTAGES).select("areas", "district", "kind", "starts_at", "ends_at", F.size("sources").alias("n_sources"), "cancelled_reason")


@query(
    "o_stm_poll",
    f"""WITH {_EVENTS} SELECT url, 1 AS attempts, NOT (r = 3 AND q % 2 = 1) AS parsed_ok, CASE WHEN r = 3 AND q % 4 = 1 THEN 'unreadable answer' WHEN r = 3 AND q % 4 = 3 THEN 'no answer' END AS reason FROM e""",
)
def stm_poll(v):
    """What a streamed run remembers of each announcement, and what it queues for review."""
    tables = _polled(v)
    queued = tables.read("queue", ingest.QUEUE).select(F.col("source_url").alias("url"), "reason")
    return tables.read("seen", ingest.SEEN).select("url", "attempts", "parsed_ok").join(queued, "url", "left")


@query(
    "o_stm_partial",
    f"""WITH {_EVENTS} SELECT true AS ok, count(*) FILTER (r IN (0, 2)) AS read, count(*) FILTER (r IN (0, 2)) AS created, 0 AS queued, 'first|third' AS sources, 'second' AS failed FROM e""",
)
def stm_partial(v):
    """The log of a run of three sources, one of which cannot be read."""
    tables = Snapshots(v.spark, shared_folder(v.spark, "partial"))
    of = lambda r: lambda: announced(v.table("events").where(F.col("event_id") % 4 == r))
    missing = lambda: v.spark.read.schema(ingest.ANNOUNCEMENT).parquet(f"{tables.root}/missing")
    ingest.run_sources({"first": of(0), "second": missing, "third": of(2)}, 1, tables, answer, _gazetteer(v), _NOW)
    return tables.read("runs", ingest.RUNS).select("ok", "read", "created", "queued", "sources", "failed")


@query(
    "o_stm_reread",
    """WITH e AS (SELECT 'https://o.example/n' || event_id % 1000 AS url, event_id % 1000 AS k FROM events), n AS (SELECT url, k, count(*) AS n FROM e GROUP BY ALL)
    SELECT url, unnest(range(1, 1 + CASE WHEN k % 4 = 0 THEN least(n, 3) ELSE 1 END)) AS attempt, CASE WHEN k % 4 = 0 THEN 'no answer' END AS error FROM n""",
)
def stm_reread(v):
    """A stream that delivers announcements again and again: read ones are left, failures tried three times."""
    k = F.col("event_id") % 1000
    repeated = _stream(v).select(F.concat(F.lit("https://o.example/n"), k).alias("url"), F.concat(F.lit("Notice "), k).alias("title"), F.when(k % 4 == 0, "silence").otherwise("{}").alias("body"))
    root = shared_folder(v.spark, "reread")
    writer = seen.unread_stream(repeated, extractor=answer).select("url", "attempt", "error").writeStream.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start(f"{root}/read", format="parquet").awaitTermination()
    return v.spark.read.schema("url string, attempt int, error string").parquet(f"{root}/read")


@query(
    "o_stm_backfill",
    f"""{_TOLD} SELECT place AS areas, kind, {_AT("' || clock || '")} AS starts_at, n_sources FROM (SELECT *, 'planned' AS kind, '09:00' AS clock, planned::INT + (again AND q % 3 <> 0)::INT AS n_sources FROM t
      UNION ALL SELECT *, 'fault', '22:00', fault::INT FROM t) WHERE n_sources > 0""",
    "v_settlements",
)
def stm_backfill(v):
    """An archive read at once: records of one event merged, nothing stored."""
    found = ingest.backfill(v.spark, announced(v.table("events")), answer, _gazetteer(v))
    return found.select("areas", "kind", "starts_at", F.size("sources").alias("n_sources"))


@query(
    "o_udtf_parse",
    f"""{_TOLD} SELECT e.url, CASE WHEN r = 3 THEN 'resolution' WHEN r = 1 AND q % 3 = 0 THEN 'retraction' ELSE 'record' END AS role, district, place AS areas,
      CASE WHEN r = 2 THEN {_AT("22:00")} WHEN r < 2 THEN {_AT("09:00")} END AS starts_at, CASE WHEN r < 2 THEN {_AT("13:00")} END AS ends_at,
      CASE WHEN r = 3 THEN {_AT("23:30")} END AS resolved_at FROM e JOIN t USING (q) WHERE NOT (r = 3 AND q % 2 = 1)""",
    "v_settlements",
)
def udtf_parse(v):
    """Announcements into records, withdrawals and repairs."""
    read = written(resolve.extract(announced(v.table("events")), answer), "read")
    parsed = resolve.resolve_announcements(read, _gazetteer(v))
    scheduled = lambda c: F.when(F.col("role") != "resolution", F.col(c)).alias(c)
    return parsed.select("url", "role", "district", "areas", scheduled("starts_at"), scheduled("ends_at"), "resolved_at")


_LISTED = """SELECT event_id, CASE WHEN event_id % 3 = 0 OR user_id % 40 = event_id % 40 THEN 'Place ' || event_id % 40 ELSE 'Place ' || user_id % 40 || '|Place ' || event_id % 40 END AS names FROM events"""


@query("o_udtf_match", _LISTED)
@query("o_str_matchareas", _LISTED)
def str_matchareas(v):
    """Places of lists of names; a third of the lists have a name in two parts."""
    e = v.table("events")
    lists = F.expr("if(event_id % 3 = 0, array('Place', cast(event_id % 40 as string)), array('Place ' || user_id % 40, 'Place ' || event_id % 40))")
    return _gazetteer(v).match_areas(e, lists).select("event_id", F.transform("m", lambda m: m["name"]).alias("names"))


_WORD = "CASE r WHEN 0 THEN town WHEN 1 THEN left(town, 10) || 'x' WHEN 2 THEN town || 'x' ELSE 'Q' || reverse(town) END"


@query(
    "o_str_match",
    f"""WITH n AS (SELECT count(*) AS n FROM part), t AS (SELECT 'T' || substr(md5(p_partkey::VARCHAR), 1, 10) AS town, p_partkey AS k FROM part),
    e AS (SELECT event_id, user_id % 40 AS a, event_id % n AS k, event_id // 7 % 4 AS r FROM events, n), w AS (SELECT DISTINCT k, r, {_WORD} AS word FROM e JOIN t USING (k)),
    h AS (SELECT w.k, r, t.town, 1 - levenshtein(lower(word), lower(t.town))::DOUBLE / greatest(length(word), length(t.town)) AS s FROM w, t WHERE s >= 0.9
      QUALIFY row_number() OVER (PARTITION BY w.k, r ORDER BY s DESC, t.k) = 1)
    SELECT event_id, coalesce(town || '|', '') || 'Place ' || a AS names, coalesce(s < 1, false) AS fuzzy FROM e LEFT JOIN h USING (k, r)""",
)
def str_match(v):
    """Places of sentences, in the order in which they are named, of a gazetteer with a town a part: names as they are,
    with a letter changed, with a letter more, and names of no place."""
    parts, n = v.table("part"), v.table("part").agg(F.count(F.lit(1)).alias("n"))
    towns = parts.select(F.expr("'T' || substr(md5(cast(p_partkey as string)), 1, 10)").alias("town"), "p_partkey")
    known = v.settlements.selectExpr("name", "district", "cast(array() as array<string>) as aliases", "-1L as ordinal").union(towns.selectExpr("town", "'lefke'", "cast(array() as array<string>)", "p_partkey"))
    e = v.table("events").join(F.broadcast(n)).selectExpr("event_id", "user_id % 40 as a", "event_id % n as p_partkey", "event_id div 7 % 4 as r")
    said = e.join(towns, "p_partkey").withColumn("text", F.expr(f"'Works near ' || {_WORD} || ' and in PLACE ' || a || ', not in place 41'"))
    found = resolve.Gazetteer.of(known).match_areas(said, F.array("text"))
    return found.select("event_id", F.array_join(F.transform("m", lambda m: m["name"]), "|").alias("names"), F.exists("m", lambda m: m["fuzzy"]).alias("fuzzy"))


_HOUR = "3600000"


@query(
    "o_stm_late",
    f"""WITH RECURSIVE e AS (SELECT event_id::VARCHAR AS id, ['lefkosa', 'girne', 'gazimagusa', 'guzelyurt', 'iskele', 'lefke'][user_id % 6 + 1] AS district, 'place ' || event_id % 8 AS place_key,
      epoch_ms(date_trunc('minute', ts)) AS w, event_type = 'signup' AS repair, CASE WHEN event_id % 3 = 0 THEN 72 ELSE 6 END * {_HOUR} AS reach FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY district, place_key ORDER BY w, id) AS n FROM e),
    s AS (SELECT DISTINCT district, place_key, 0::BIGINT AS n, []::STRUCT(id VARCHAR, w BIGINT, k BIGINT)[] AS o, []::STRUCT(id VARCHAR, w BIGINT, k BIGINT, e BIGINT)[] AS d FROM e
      UNION ALL SELECT district, place_key, n, CASE WHEN repair THEN [] WHEN hit IS NULL THEN list_append(o, {{'id': id, 'w': w, 'k': 1::BIGINT}})
          ELSE list_transform(o, lambda f, i: CASE WHEN i = hit THEN {{'id': f.id, 'w': f.w, 'k': f.k + 1}} ELSE f END) END,
        list_concat(d, CASE WHEN repair THEN list_transform(o, lambda f: {{'id': f.id, 'w': f.w, 'k': f.k, 'e': w}}) ELSE [] END)
      FROM (SELECT s.district, s.place_key, r.n, r.id, r.w, r.repair, list_filter(s.o, lambda f: r.w - f.w <= 144 * {_HOUR}) AS o,
          list_concat(s.d, list_transform(list_filter(s.o, lambda f: r.w - f.w > 144 * {_HOUR}), lambda f: {{'id': f.id, 'w': f.w, 'k': f.k, 'e': NULL::BIGINT}})) AS d,
          list_position(list_transform(list_filter(s.o, lambda f: r.w - f.w <= 144 * {_HOUR}), lambda f: r.w - f.w <= r.reach), true) AS hit
        FROM s JOIN r ON r.district = s.district AND r.place_key = s.place_key AND r.n = s.n + 1)),
    z AS (SELECT district, place_key, arg_max(list_concat(d, list_transform(o, lambda f: {{'id': f.id, 'w': f.w, 'k': f.k, 'e': NULL::BIGINT}})), n) AS d FROM s GROUP BY ALL),
    f AS (SELECT district, place_key, unnest(d) AS f FROM z)
    SELECT district, place_key, f.id AS id, strftime(make_timestamp(f.w * 1000), '%Y-%m-%dT%H:%M:%SZ') AS starts_at, strftime(make_timestamp(f.e * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ends_at, f.k::INT AS reports FROM f""",
)
def stm_late(v):
    """Faults with their follow-ups and repairs of a stream in which a fifth of the reports comes a day late."""
    own = late.session(v.spark)
    source, to = shared_folder(v.spark, "reports"), shared_folder(v.spark, "late")
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    e = v.table("events").select(
        F.col("event_id").cast("string").alias("id"), _at(DISTRICT_IDS, "user_id % 6").alias("district"), F.expr("'place ' || event_id % 8").alias("place_key"), minute.alias("at"),
        F.expr("event_type = 'signup'").alias("repair"), F.expr("event_id % 3 = 0").alias("continuation"), F.expr("event_id % 5 = 0").alias("late"),
    )
    # Delivered four days at a time, in order; two rows of a far day let all that waits come to its end.
    chunk = F.floor((F.unix_timestamp("at") / 86400 + F.when(F.col("late"), 1).otherwise(0)) / 4)
    e = e.withColumn("chunk", chunk)
    for c in sorted(r["chunk"] for r in e.select("chunk").distinct().collect()):
        e.where(F.col("chunk") == c).drop("late", "chunk").write.mode("append").parquet(source)
    far = v.spark.range(1).select(F.lit("far").alias("id"), F.lit("none").alias("district"), F.lit("none").alias("place_key"), F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit(True).alias("repair"), F.lit(False).alias("continuation"))
    for day in (0, 1):
        far.withColumn("at", F.col("at") + F.make_dt_interval(F.lit(day))).write.mode("append").parquet(source)
    reports = own.readStream.schema("id string, district string, place_key string, at timestamp, repair boolean, continuation boolean").option("maxFilesPerTrigger", 4).parquet(source)
    out = late.follow_ups(reports).writeStream.outputMode("append").option("checkpointLocation", f"{to}/checkpoint")
    out.trigger(availableNow=True).start(f"{to}/faults", format="parquet").awaitTermination()
    return v.spark.read.schema(late.FAULTS).parquet(f"{to}/faults")
