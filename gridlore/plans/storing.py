"""Queries of writes: the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.operators import live, store
from gridlore.plans.events import _SAME
from gridlore.plans.registry import query
from gridlore.session import shared_folder
from gridlore.streaming import ingest
from gridlore.streaming.snapshots import Snapshots
from gridlore.views import NOW, now

_NOW = f"TIMESTAMP '{NOW}'"
_ISO = lambda c, a=None: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {a or c}"
_FACTS = ("id", "kind", "starts_at", "ends_at", "district", "cancelled_at", "cancelled_reason")


def _stored(v):
    return v.outages.select(*_FACTS, F.col("ingested_at").alias("updated_at"), "event_id").where("event_id % 10 < 7").drop("event_id")


def _incoming(v):
    late = F.when(F.col("event_id") % 2 == 0, F.col("ends_at") + F.expr("interval 1 hour")).otherwise(F.col("ends_at"))
    return v.outages.where("event_id % 10 >= 5").withColumn("ends_at", late).select("id", "kind", "starts_at", "ends_at", "district")


@query(
    "o_snk_upsert",
    f"""WITH s AS (SELECT id, kind, starts_at, ends_at, district, cancelled_at, cancelled_reason, ingested_at AS updated_at FROM v_outages WHERE event_id % 10 < 7),
    i AS (SELECT id, kind, starts_at, CASE WHEN event_id % 2 = 0 THEN ends_at + INTERVAL 1 HOUR ELSE ends_at END AS ends_at, district FROM v_outages WHERE event_id % 10 >= 5)
    SELECT coalesce(s.id, i.id) AS id, coalesce(i.kind, s.kind) AS kind, {_ISO("coalesce(i.starts_at, s.starts_at)", "starts_at")}, {_ISO("CASE WHEN i.id IS NOT NULL THEN i.ends_at ELSE s.ends_at END", "ends_at")},
      coalesce(i.district, s.district) AS district, {_ISO("s.cancelled_at", "cancelled_at")}, s.cancelled_reason,
      {_ISO(f"CASE WHEN i.id IS NOT NULL AND (s.id IS NULL OR i.ends_at IS DISTINCT FROM s.ends_at) THEN {_NOW} ELSE s.updated_at END", "updated_at")} FROM s FULL OUTER JOIN i ON s.id = i.id""",
    "v_outages",
)
@query(
    "o_trigger",
    f"""WITH s AS (SELECT id, kind, starts_at, ends_at, district, cancelled_at, cancelled_reason, ingested_at AS updated_at FROM v_outages WHERE event_id % 10 < 7),
    i AS (SELECT id, kind, starts_at, CASE WHEN event_id % 2 = 0 THEN ends_at + INTERVAL 1 HOUR ELSE ends_at END AS ends_at, district FROM v_outages WHERE event_id % 10 >= 5)
    SELECT coalesce(s.id, i.id) AS id, coalesce(i.kind, s.kind) AS kind, {_ISO("coalesce(i.starts_at, s.starts_at)", "starts_at")}, {_ISO("CASE WHEN i.id IS NOT NULL THEN i.ends_at ELSE s.ends_at END", "ends_at")},
      coalesce(i.district, s.district) AS district, {_ISO("s.cancelled_at", "cancelled_at")}, s.cancelled_reason,
      {_ISO(f"CASE WHEN i.id IS NOT NULL AND (s.id IS NULL OR i.ends_at IS DISTINCT FROM s.ends_at) THEN {_NOW} ELSE s.updated_at END", "updated_at")} FROM s FULL OUTER JOIN i ON s.id = i.id""",
    "v_outages",
)
def snk_upsert(v):
    return store.upsert(_stored(v), _incoming(v), now())


@query(
    "o_snk_queue",
    f"""WITH q AS (SELECT md5(url || html) AS fingerprint FROM pages WHERE page_id % 3 = 0), i AS (SELECT url, substr(html, 1, 8000) AS raw FROM pages)
    SELECT DISTINCT md5(url || raw) AS fingerprint, url AS source_url, length(raw) AS n FROM i WHERE md5(url || raw) NOT IN (SELECT fingerprint FROM q)""",
)
@query("o_str_md5", f"""WITH q AS (SELECT md5(url || html) AS fingerprint FROM pages WHERE page_id % 3 = 0), i AS (SELECT url, substr(html, 1, 8000) AS raw FROM pages)
    SELECT DISTINCT md5(url || raw) AS fingerprint, url AS source_url, length(raw) AS n FROM i WHERE md5(url || raw) NOT IN (SELECT fingerprint FROM q)""")
def snk_queue(v):
    pages = v.table("pages")
    queue = pages.where("page_id % 3 = 0").select(tx.review_fingerprint(F.col("url"), F.col("html")).alias("fingerprint"))
    items = pages.select(F.col("url").alias("source_url"), F.col("html").alias("raw_text"), F.lit("no known place names found").alias("reason"))
    return store.enqueue(queue, items.union(items), now()).select("fingerprint", "source_url", F.char_length("raw_text").cast("long").alias("n"))


@query("o_snk_run", f"SELECT {_ISO('started_at')}, ok, created, queued FROM v_runs", "v_runs")
def snk_run(v):
    """The log after its rows were appended by two batches, of which the second was repeated."""
    none = F.array().cast("array<string>")
    rows = v.runs.select(
        F.lit(0).cast("long").alias("batch"), "started_at", "ok", F.lit(0).cast("long").alias("read"), "created", F.lit(0).cast("long").alias("updated"), "queued", none.alias("sources"), none.alias("failed")
    )
    tables, day = Snapshots(v.spark, shared_folder(v.spark, "runs")), F.date_format("started_at", "yyyy-MM")
    odd = F.dayofmonth("started_at") % 2 == 1
    for version, part in ((1, odd), (2, ~odd), (2, ~odd)):
        tables.append("runs", version, rows.where(part), day)
    return tables.read("runs", ingest.RUNS).select("started_at", "ok", "created", "queued")


_HASH = "substr(sha256(title || chr(0) || body), 1, 32)"


@query("o_str_arthash", f"SELECT url, {_HASH} AS hash FROM v_announce", "v_announce")
def str_arthash(v):
    return v.announcements.select("url", tx.article_hash(F.col("title"), F.col("body")).alias("hash"))


@query(
    "o_flt_unread",
    f"SELECT a.url FROM v_announce a LEFT JOIN v_seen s USING (url) WHERE s.url IS NULL OR s.content_hash <> substr(sha256(a.title || chr(0) || a.body), 1, 32) OR (NOT s.parsed_ok AND s.attempts < 3)",
    "v_announce", "v_seen",
)
@query(
    "o_jn_seen",
    f"SELECT a.url FROM v_announce a LEFT JOIN v_seen s USING (url) WHERE s.url IS NULL OR s.content_hash <> substr(sha256(a.title || chr(0) || a.body), 1, 32) OR (NOT s.parsed_ok AND s.attempts < 3)",
    "v_announce", "v_seen",
)
def flt_unread(v):
    return store.unread(v.announcements, v.seen).select("url")


@query(
    "o_snk_seen",
    f"""WITH r AS (SELECT url, {_HASH} AS h, event_id % 4 <> 0 AS ok FROM v_announce)
    SELECT coalesce(s.url, r.url) AS url, coalesce(r.h, s.content_hash) AS content_hash, (CASE WHEN r.url IS NULL THEN s.attempts WHEN s.content_hash IS NOT DISTINCT FROM r.h THEN s.attempts + 1 ELSE 1 END)::INT AS attempts,
      coalesce(r.ok, s.parsed_ok) AS parsed_ok FROM v_seen s FULL OUTER JOIN r ON s.url = r.url""",
    "v_announce", "v_seen",
)
@query(
    "o_stm_seen",
    f"""WITH r AS (SELECT url, {_HASH} AS h, event_id % 4 <> 0 AS ok FROM v_announce)
    SELECT coalesce(s.url, r.url) AS url, coalesce(r.h, s.content_hash) AS content_hash, (CASE WHEN r.url IS NULL THEN s.attempts WHEN s.content_hash IS NOT DISTINCT FROM r.h THEN s.attempts + 1 ELSE 1 END)::INT AS attempts,
      coalesce(r.ok, s.parsed_ok) AS parsed_ok FROM v_seen s FULL OUTER JOIN r ON s.url = r.url""",
    "v_announce", "v_seen",
)
def snk_seen(v):
    read = v.announcements.select("url", tx.article_hash(F.col("title"), F.col("body")).alias("content_hash"), F.expr("event_id % 4 <> 0").alias("ok"), F.col("event_id").alias("ordinal"))
    return store.mark_read(v.seen, read, now()).select("url", "content_hash", "attempts", "parsed_ok")


_RETRACTED = f"""SELECT DISTINCT a.id FROM (SELECT * FROM v_outages WHERE event_id % 10 <> 4) a JOIN (SELECT * FROM v_outages WHERE event_id % 10 = 4) b ON a.id = b.id OR ({_SAME})"""


@query("o_jn_retract", _RETRACTED, "v_outages")
def jn_retract(v):
    return store.retracted_ids(v.outages.where("event_id % 10 <> 4"), v.outages.where("event_id % 10 = 4"))


@query(
    "o_stm_retract",
    f"""WITH hit AS ({_RETRACTED}) SELECT s.id, {_ISO(f"CASE WHEN hit.id IS NOT NULL AND cancelled_at IS NULL THEN {_NOW} ELSE cancelled_at END", "cancelled_at")},
      CASE WHEN hit.id IS NOT NULL AND cancelled_at IS NULL THEN 'retracted' ELSE cancelled_reason END AS cancelled_reason FROM v_outages s LEFT JOIN hit USING (id) WHERE event_id % 10 <> 4""",
    "v_outages",
)
def stm_retract(v):
    return store.retract(v.outages.where("event_id % 10 <> 4"), v.outages.where("event_id % 10 = 4"), now()).select("id", "cancelled_at", "cancelled_reason")


_RESOLVED = """WITH r AS (SELECT district, area_keys, ends_at AS resolved_at, event_id AS ordinal FROM v_outages WHERE event_id % 10 = 5 AND ends_at IS NOT NULL),
  c AS (SELECT o.id, min_by(r.resolved_at, r.ordinal) AS e FROM v_outages o JOIN r ON o.district = r.district AND list_has_any(o.area_keys, r.area_keys)
    AND o.starts_at <= r.resolved_at AND r.resolved_at <= o.starts_at + INTERVAL 144 HOUR WHERE o.event_id % 10 <> 5 AND o.ends_at IS NULL AND o.cancelled_at IS NULL GROUP BY 1)"""


@query("o_jn_resolve", f"{_RESOLVED} SELECT o.id, {_ISO('coalesce(o.ends_at, c.e)', 'ends_at')} FROM v_outages o LEFT JOIN c USING (id) WHERE o.event_id % 10 <> 5", "v_outages")
@query("o_stm_resolve", f"{_RESOLVED} SELECT o.id, {_ISO('coalesce(o.ends_at, c.e)', 'ends_at')} FROM v_outages o LEFT JOIN c USING (id) WHERE o.event_id % 10 <> 5", "v_outages")
def jn_resolve(v):
    ends = v.outages.where("event_id % 10 = 5 and ends_at is not null").select("district", "area_keys", F.col("ends_at").alias("resolved_at"), F.col("event_id").alias("ordinal"))
    return store.resolve(v.outages.where("event_id % 10 <> 5"), ends).select("id", "ends_at")


@query("o_jn_dupdel", "SELECT min(doc_id) AS id, md5(source || text) AS fingerprint FROM documents GROUP BY 2")
@query("o_win_dropolder", "SELECT min(doc_id) AS id, md5(source || text) AS fingerprint FROM documents GROUP BY 2")
def jn_dupdel(v):
    queue = v.table("documents").select(F.col("doc_id").alias("id"), tx.review_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))
    return store.drop_older_duplicates(queue)


@query("o_win_distinct_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def win_distinct_first(v):
    return v.table("documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


_RETIRED = """WITH p AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'ffffffff' || event_id ELSE substr(id, 1, 10) END AS prefix FROM v_outages),
    m AS (SELECT prefix, count(id) AS n, min(id) AS id FROM p LEFT JOIN v_outages ON substr(id, 1, 8) = substr(prefix, 1, 8) AND starts_with(id, prefix) GROUP BY 1)
    SELECT prefix, CASE n WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN id END AS id FROM m"""


@query("o_retire", _RETIRED, "v_outages")
@query("o_jn_anti", _RETIRED, "v_outages")
def retire(v):
    prefixes = v.outages.select(F.expr("if(event_id % 3 = 0, 'ffffffff' || event_id, substr(id, 1, 10))").alias("prefix")).distinct()
    return store.retire(v.outages, prefixes, "bad_data", now())


@query("o_backfill_keys", "SELECT id, array_to_string(list_sort(list_distinct(list_transform(areas, lambda x: lower(x)))), '|') AS area_keys FROM v_outages WHERE event_id % 4 = 0", "v_outages")
def backfill_keys(v):
    old = v.outages.withColumn("area_keys", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("stale"))).otherwise(F.col("area_keys")))
    return store.recompute_keys(old, live.area_keys(F.col("areas")))


_REPARSED = f"""WITH k AS (SELECT *, regexp_replace(regexp_extract(source_url, '^https?://([^/]+)', 1), '^www\\.', '') || '#' || regexp_extract(source_url, '/n([0-9]+)-', 1) AS article FROM v_outages),
  r AS (SELECT *, event_id % 6 <> 0 AS readable, CASE WHEN event_id % 10 = 0 THEN starts_at + INTERVAL 1 DAY ELSE published_at END AS edited_at FROM k WHERE event_id % 2 = 0),
  byid AS (SELECT k.id, bool_or(coalesce(r2.readable, false)) AS readable, bool_or(coalesce(r2.edited_at > k.ingested_at, false)) AS edited_since FROM k
    LEFT JOIN (SELECT article, bool_or(readable) AS readable, max(edited_at) FILTER (readable) AS edited_at FROM r GROUP BY 1) r2 USING (article) GROUP BY 1),
  good AS (SELECT DISTINCT a.id FROM k a JOIN r b ON a.article = b.article AND b.readable AND {_SAME})"""
_AUDITED = f"""{_REPARSED} SELECT id, readable, good.id IS NOT NULL AS supported, edited_since,
  CASE WHEN NOT readable THEN 'unreadable' WHEN good.id IS NOT NULL THEN 'supported' WHEN edited_since THEN 'edited since' ELSE 'unsupported' END AS verdict FROM byid LEFT JOIN good USING (id)"""


def _read_again(v):
    """Every second record's article, read again; every tenth was edited a day later."""
    from gridlore.operators.identity import article_key

    again = v.outages.where("event_id % 2 = 0").withColumn("article_key", article_key(F.col("sources")[0]["url"])).withColumn("readable", F.expr("event_id % 6 <> 0"))
    return again.withColumn("published_at", F.expr("if(event_id % 10 = 0, starts_at + interval 1 day, published_at)"))


@query("o_audit", _AUDITED, "v_outages")
@query("o_agg_audit", _AUDITED, "v_outages")
@query("o_jn_rederive", _AUDITED, "v_outages")
def audit(v):
    return store.audit(v.outages, _read_again(v))


@query(
    "o_backfill_scope",
    f"""{_REPARSED}, w AS (SELECT a.id, bool_or(b.event_id % 4 = 0) AS wide FROM k a JOIN r b ON a.article = b.article AND b.readable AND {_SAME} GROUP BY 1)
    SELECT id, CASE WHEN wide THEN 'district' ELSE 'places' END AS scope FROM k JOIN w USING (id) WHERE event_id % 13 = 0 AND scope <> CASE WHEN wide THEN 'district' ELSE 'places' END""",
    "v_outages",
)
def backfill_scope(v):
    """Records that name their own district are ambiguous: what their sources say now decides."""
    named = v.outages.withColumn("area_keys", F.when(F.expr("event_id % 13 = 0"), F.array_append("area_keys", F.col("district"))).otherwise(F.col("area_keys")))
    again = _read_again(v).withColumn("scope", F.expr("if(event_id % 4 = 0, 'district', 'places')"))
    return store.rederive_scope(named, again, v.outages)


@query(
    "o_snk_ping",
    """WITH w AS (SELECT * FROM v_outages WHERE event_id % 50 = 0), p AS (SELECT '/' AS path UNION SELECT '/district/' || district FROM w
      UNION SELECT '/place/' || replace(k, ' ', '-') FROM (SELECT unnest(area_keys) AS k FROM w) JOIN v_settlements s ON lower(s.name) = k)
    SELECT unnest([path, '/en' || CASE WHEN path = '/' THEN '' ELSE path END]) AS path FROM p""",
    "v_outages", "v_settlements",
)
def snk_ping(v):
    pages = v.settlements.select(tx.fold_key(F.col("name")).alias("place_key"))
    return store.changed_paths(v.outages.where("event_id % 50 = 0"), pages)
