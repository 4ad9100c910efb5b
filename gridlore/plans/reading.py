"""Queries that readers of the site ask: selections, projections, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import live
from gridlore.plans.registry import query
from gridlore.views import NOW, _NAMES, now

_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {c}"
_NOW = f"TIMESTAMP '{NOW}'"
_NOTBAD = "cancelled_reason IS DISTINCT FROM 'bad_data'"
_STATUS = f"""CASE WHEN starts_at <= {_NOW} AND coalesce(ends_at, starts_at + INTERVAL 72 HOUR) > {_NOW} THEN 'active'
  WHEN starts_at > {_NOW} THEN 'upcoming' ELSE 'past' END"""
_ROW = ("id", "kind", "district", "starts_at", "ends_at", "scope")
_SQL_ROW = f"id, kind, district, {_ISO('starts_at')}, {_ISO('ends_at')}, scope"
_LOCAL = "timezone('Europe/Nicosia', timezone('UTC', starts_at))"


@query(
    "flagship",
    f"""SELECT district, {_STATUS} AS status, count(*) AS n, count(*) FILTER (kind = 'fault') AS faults,
      strftime(max(coalesce(ends_at, starts_at + INTERVAL 72 HOUR)), '%Y-%m-%dT%H:%M:%SZ') AS last_end
    FROM v_outages WHERE cancelled_at IS NULL AND starts_at >= {_NOW} - INTERVAL 30 DAY GROUP BY 1, 2""",
    "v_outages",
)
def flagship(v):
    """Interruptions by district and state of the moment."""
    shown = live.with_status(live.live(v.outages, now()), now())
    return shown.groupBy("district", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "fault", 1)).alias("faults"), F.max("read_end").alias("last_end")
    )


@query("o_flt_live", f"SELECT {_SQL_ROW} FROM v_outages WHERE cancelled_at IS NULL AND starts_at >= {_NOW} - INTERVAL 30 DAY", "v_outages")
def flt_live(v):
    return live.live(v.outages, now()).select(*_ROW)


@query("o_flt_notbad", f"SELECT {_SQL_ROW} FROM v_outages WHERE {_NOTBAD}", "v_outages")
def flt_notbad(v):
    return v.outages.where(live.not_bad_data()).select(*_ROW)


@query(
    "o_flt_archive",
    f"SELECT {_SQL_ROW}, cancelled_at IS NOT NULL AS cancelled FROM (SELECT * FROM v_outages WHERE starts_at < {_NOW} AND {_NOTBAD} ORDER BY starts_at DESC, id LIMIT {C.ARCHIVE_LIMIT})",
    "v_outages",
)
def flt_archive(v):
    return live.archive(v.outages, now()).select(*_ROW, "cancelled")


@query(
    "o_flt_prefix",
    f"SELECT {_SQL_ROW} FROM v_outages WHERE id LIKE '4e07%' AND {_NOTBAD} AND (SELECT count(*) FROM v_outages WHERE id LIKE '4e07%' AND {_NOTBAD}) = 1",
    "v_outages",
)
def flt_prefix(v):
    return live.by_prefix(v.outages, "4e07").select(*_ROW)


@query("o_flt_district", f"SELECT {_SQL_ROW} FROM (SELECT * FROM v_outages WHERE district = 'girne' AND {_NOTBAD} ORDER BY starts_at DESC, id LIMIT 60)", "v_outages")
def flt_district(v):
    return live.of_district(v.outages, "girne", 60).select(*_ROW)


@query(
    "o_flt_areakey",
    f"SELECT {_SQL_ROW} FROM (SELECT * FROM v_outages WHERE (list_contains(area_keys, 'place 7') OR (scope = 'district' AND district = 'girne')) AND {_NOTBAD} ORDER BY starts_at DESC, id LIMIT {C.PLACE_LIMIT})",
    "v_outages",
)
@query(
    "o_set_unionkey",
    f"""SELECT {_SQL_ROW} FROM (SELECT * FROM (SELECT * FROM v_outages WHERE list_contains(area_keys, 'place 7') AND {_NOTBAD}
      UNION SELECT * FROM v_outages WHERE scope = 'district' AND district = 'girne' AND {_NOTBAD}) ORDER BY starts_at DESC, id LIMIT {C.PLACE_LIMIT})""",
    "v_outages",
)
def flt_areakey(v):
    return live.of_place(v.outages, "place 7", "girne").select(*_ROW)


@query("o_flt_covers", f"SELECT {_SQL_ROW} FROM v_outages WHERE CASE WHEN scope = 'district' THEN district = 'girne' ELSE list_contains(area_keys, 'place 7') END", "v_outages")
def flt_covers(v):
    return v.outages.where(live.covers("place 7", "girne")).select(*_ROW)


@query("o_flt_refs", f"SELECT {_SQL_ROW} FROM (SELECT * FROM v_outages WHERE starts_at >= {_NOW} - INTERVAL 360 DAY AND {_NOTBAD} ORDER BY starts_at DESC, id LIMIT {C.REFS_LIMIT})", "v_outages")
def flt_refs(v):
    return live.references(v.outages, now() - tm.minutes(360 * 1440)).select(*_ROW)


@query("o_flt_lastrun", "SELECT strftime(max(started_at) FILTER (ok), '%Y-%m-%dT%H:%M:%SZ') AS last_ok FROM v_runs", "v_runs")
@query("o_win_latest", "SELECT strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS last_ok FROM v_runs WHERE ok ORDER BY started_at DESC LIMIT 1", "v_runs")
def flt_lastrun(v):
    return live.last_good_run(v.runs)


@query("o_flt_stale", f"SELECT max(started_at) FILTER (ok) IS NULL OR {_NOW} > max(started_at) FILTER (ok) + INTERVAL 2 HOUR AS stale FROM v_runs WHERE started_at <= {_NOW}", "v_runs")
@query("o_stm_fresh", f"SELECT max(started_at) FILTER (ok) IS NULL OR {_NOW} > max(started_at) FILTER (ok) + INTERVAL 2 HOUR AS stale FROM v_runs WHERE started_at <= {_NOW}", "v_runs")
def flt_stale(v):
    return live.last_good_run(v.runs.where(F.col("started_at") <= now())).select(live.stale(F.col("last_ok"), now()).alias("stale"))


@query("o_flt_status", f"SELECT id, {_STATUS} AS status FROM v_outages", "v_outages")
@query("o_stm_expire", f"SELECT id, {_STATUS} AS status FROM v_outages", "v_outages")
def flt_status(v):
    return live.with_status(v.outages, now()).select("id", "status")


@query(
    "o_flt_candidates",
    """WITH i AS (SELECT * FROM v_outages WHERE event_id % 10 = 3 AND starts_at >= TIMESTAMP '2024-01-12' AND starts_at < TIMESTAMP '2024-01-13' AND user_id_district < 3),
    b AS (SELECT min(starts_at) - INTERVAL 72 HOUR AS lo, max(starts_at) + INTERVAL 72 HOUR AS hi FROM i)
    SELECT s.id FROM v_outages s, b WHERE s.event_id % 10 <> 3 AND s.starts_at BETWEEN lo AND hi AND s.district IN (SELECT district FROM i)""".replace(
        "user_id_district < 3", "district IN ('lefkosa', 'girne', 'lefke')"
    ),
    "v_outages",
)
def flt_candidates(v):
    day = F.to_date("starts_at") == "2024-01-12"
    incoming = v.outages.where((F.col("event_id") % 10 == 3) & day & F.col("district").isin("lefkosa", "girne", "lefke"))
    return live.candidates(v.outages.where("event_id % 10 <> 3"), incoming).select("id")


@query("o_flt_ambig", "SELECT id FROM v_outages WHERE event_id % 13 = 0 OR (event_id % 13 = 1 AND district = 'lefke')", "v_outages")
def flt_ambig(v):
    """Every thirteenth record names its own district among its places, every next one names Lefke."""
    said = F.expr("case event_id % 13 when 0 then district when 1 then 'lefke' end")
    named = v.outages.withColumn("area_keys", F.when(said.isNull(), F.col("area_keys")).otherwise(F.array_append("area_keys", said)))
    return named.where(live.names_own_district()).select("id")


@query("o_flt_month", f"SELECT {_SQL_ROW} FROM v_outages WHERE district = 'lefke' AND strftime({_LOCAL}, '%Y-%m') = '2024-01'", "v_outages")
def flt_month(v):
    return v.outages.where((F.col("district") == "lefke") & live.in_month("2024-01")).select(*_ROW)


@query("o_flt_addressable", "SELECT id FROM v_outages WHERE regexp_matches(id, '^[0-9a-f]{8}')", "v_outages")
def flt_addressable(v):
    return v.outages.where(live.addressable()).select("id")


@query("o_flt_ics", f"SELECT {_SQL_ROW} FROM v_outages WHERE kind <> 'fault' AND cancelled_at IS NULL AND ends_at IS NOT NULL", "v_outages")
def flt_ics(v):
    return v.outages.where(live.in_calendar()).select(*_ROW)


@query(
    "o_flt_nearby",
    f"""WITH f AS (SELECT * FROM v_outages WHERE district = 'iskele' AND {_NOTBAD} ORDER BY starts_at DESC, id LIMIT 13)
    SELECT {_SQL_ROW} FROM (SELECT * FROM f WHERE id <> '0' ORDER BY starts_at DESC, id LIMIT {C.UI_LIMIT})""",
    "v_outages",
)
def flt_nearby(v):
    return live.nearby(v.outages, "iskele", "0").select(*_ROW)


@query("o_flt_slug", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)/(EN|fr)/[0-9]*7|utm_')")
def flt_slug(v):
    return v.table("pages").where(tx.slug_about(F.col("url"), "/(EN|fr)/[0-9]*7|utm_")).select("page_id")


@query("o_flt_outage_text", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'licen[cs]e|work') AND regexp_matches(lower(text), 'released|licensed')")
def flt_outage_text(v):
    return v.table("documents").where(tx.about(F.col("text"), "licen[cs]e|work", "released|licensed")).select("doc_id")


@query("o_prj_row", f"SELECT {_SQL_ROW}, array_to_string(areas, '|') AS areas, confidence, {_ISO('published_at')}, cancelled_reason FROM v_outages", "v_outages")
@query("o_src_table", f"SELECT {_SQL_ROW}, array_to_string(areas, '|') AS areas, confidence, {_ISO('published_at')}, cancelled_reason FROM v_outages", "v_outages")
def prj_row(v):
    return v.outages.select(*_ROW, "areas", "confidence", "published_at", "cancelled_reason")


_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("o_prj_areakeys", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(areas, lambda x: {_FOLD.format('x')}), lambda k: k <> ''))), '|') AS keys FROM v_outages", "v_outages")
def prj_areakeys(v):
    return v.outages.select("id", live.area_keys(F.col("areas")).alias("keys"))


_SLUG = f"strftime({_LOCAL}, '%Y-%m-%d') || '-' || district || '-' || replace({_FOLD.format('areas[1]')}, ' ', '-') || '-' || substr(id, 1, 8)"


@query("o_prj_slug", f"SELECT id, {_SLUG} AS slug FROM v_outages", "v_outages")
def prj_slug(v):
    return v.outages.select("id", live.slug().alias("slug"))


@query("o_prj_idprefix", "SELECT id, substr(id, 1, 8) AS prefix FROM v_outages", "v_outages")
def prj_idprefix(v):
    return v.outages.select("id", live.slug_prefix(live.slug()).alias("prefix"))


@query(
    "o_prj_routes",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'tr' END AS locale, CASE WHEN page_id % 3 = 0 THEN 'home' ELSE 'place' END AS section,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE 'p-' || page_id END AS rest FROM pages""",
)
def prj_routes(v):
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/en").otherwise(""), F.when(F.col("page_id") % 3 == 0, "/").otherwise(F.concat(F.lit("/place/p-"), "page_id")))
    return v.table("pages").select("page_id", live.route(path).alias("r")).select("page_id", "r.*")


@query(
    "o_prj_countdown",
    f"""WITH s AS (SELECT *, {_STATUS} AS status FROM v_outages)
    SELECT id, CASE WHEN status = 'upcoming' THEN 'until_start' WHEN status = 'active' AND ends_at IS NOT NULL THEN 'until_end' WHEN status = 'active' THEN 'since_start' END AS direction,
      strftime(CASE WHEN status = 'upcoming' THEN starts_at WHEN status = 'active' THEN coalesce(ends_at, starts_at) END, '%Y-%m-%dT%H:%M:%SZ') AS target FROM s""",
    "v_outages",
)
def prj_countdown(v):
    return v.outages.select("id", live.countdown(now()).alias("c")).select("id", "c.*")


@query(
    "o_prj_dot",
    f"""WITH s AS (SELECT *, {_STATUS} AS status FROM v_outages WHERE cancelled_at IS NULL)
    SELECT district, CASE WHEN count(*) FILTER (status = 'active') = 0 THEN 'lit' WHEN coalesce(bool_or(kind = 'fault') FILTER (status = 'active'), false) THEN 'fault' ELSE 'dark' END AS dot FROM s GROUP BY 1""",
    "v_outages",
)
def prj_dot(v):
    shown = live.with_status(v.outages.where("cancelled_at is null"), now()).groupBy("district").agg(
        F.count(F.when(F.col("status") == "active", 1)).alias("active"), F.coalesce(F.bool_or((F.col("status") == "active") & (F.col("kind") == "fault")), F.lit(False)).alias("fault")
    )
    return shown.select("district", live.dot(F.lit(False), F.col("active"), F.col("fault")).alias("dot"))


@query("o_srt_start", f"SELECT {_SQL_ROW} FROM v_outages ORDER BY v_outages.starts_at, id", "v_outages")
def srt_start(v):
    return v.outages.orderBy("starts_at", "id").select(*_ROW)


@query("o_srt_activefirst", f"SELECT id, {_STATUS} AS status FROM v_outages WHERE {_STATUS} <> 'past'", "v_outages")
def srt_activefirst(v):
    return live.active_first(v.outages, now()).select("id", "status")


@query("o_srt_recent", f"SELECT id FROM (SELECT * FROM v_outages WHERE {_STATUS} = 'past' ORDER BY starts_at DESC, id LIMIT 6)", "v_outages")
def srt_recent(v):
    return live.recent(v.outages, now()).select("id")


@query("o_srt_limit", "SELECT id FROM (SELECT * FROM v_outages ORDER BY starts_at DESC, id LIMIT 200)", "v_outages")
def srt_limit(v):
    return live.newest(v.outages, 200).select("id")


@query(
    "o_srt_official",
    """WITH g AS (SELECT district, date_trunc('hour', starts_at) AS hour, list({'n': source_name, 'k': source_kind} ORDER BY event_id) AS s FROM v_outages GROUP BY 1, 2)
    SELECT district, strftime(hour, '%Y-%m-%dT%H:%M:%SZ') AS hour, array_to_string(list_concat([x.n for x in s if x.k = 'official'], [x.n for x in s if x.k <> 'official']), '|') AS names FROM g""",
    "v_outages",
)
def srt_official(v):
    hour = F.date_trunc("hour", F.col("starts_at")).alias("hour")
    heard = v.outages.groupBy("district", hour).agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("sources")[0].alias("s")))).alias("g"))
    ordered = live.official_first(F.transform("g", lambda x: x["s"]))
    return heard.select("district", "hour", F.transform(ordered, lambda s: s["name"]).alias("names"))
