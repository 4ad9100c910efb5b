"""Queries about places."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.functions import text as tx
from gridlore.operators import live
from gridlore.operators import places as pl
from gridlore.plans.registry import query
from gridlore.views import NOW, now

_NOW = f"TIMESTAMP '{NOW}'"
_LIVE = "cancelled_at IS NULL AND starts_at <= {0} AND coalesce(ends_at, starts_at + INTERVAL 72 HOUR) > {0}".format(_NOW)
_COUNTS = """counts AS (SELECT place_key, count(*) AS n FROM (
    SELECT id, unnest(area_keys) AS place_key FROM v_outages WHERE scope <> 'district'
    UNION ALL SELECT o.id, lower(s.name) FROM v_outages o JOIN v_settlements s USING (district) WHERE o.scope = 'district') GROUP BY 1)"""
_PLACED = "placed AS (SELECT s.name, s.district, coalesce(c.n, 0) AS n FROM v_settlements s LEFT JOIN counts c ON c.place_key = lower(s.name))"
_DARK = f"""reading AS (SELECT s.name, o.*, 0 AS rank FROM (SELECT *, unnest(area_keys) AS k FROM v_outages WHERE scope <> 'district' AND {_LIVE}) o JOIN v_settlements s ON lower(s.name) = o.k
    UNION ALL SELECT s.name, o.*, s.name, 1 FROM v_outages o JOIN v_settlements s USING (district) WHERE o.scope = 'district' AND {_LIVE}),
  dark AS (SELECT name, id, kind, starts_at, ends_at, confidence, rank FROM reading QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, starts_at, id) = 1)"""
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {c}"
_BOTH = ("v_outages", "v_settlements")


def _active(v):
    return live.with_status(v.outages.where("cancelled_at is null"), now()).where("status = 'active'").drop("status", "read_end")


def _counts(v):
    return pl.key_counts(v.outages, v.settlements)


@query("o_jn_place", "SELECT o.id, s.name FROM (SELECT id, unnest(area_keys) AS k FROM v_outages) o JOIN v_settlements s ON lower(s.name) = o.k", *_BOTH)
def jn_place(v):
    return pl.of_area_names(v.outages, v.settlements).select("id", "name")


@query("o_jn_district", "SELECT o.id, s.name FROM v_outages o JOIN v_settlements s USING (district) WHERE scope = 'district'", *_BOTH)
def jn_district(v):
    return pl.of_district_wide(v.outages, v.settlements).select("id", "name")


@query("o_agg_keycount", f"WITH {_COUNTS} SELECT * FROM counts", *_BOTH)
@query("o_map_count", f"WITH {_COUNTS} SELECT * FROM counts", *_BOTH)
def agg_keycount(v):
    return _counts(v)


@query("o_jn_counts", f"WITH {_COUNTS}, {_PLACED} SELECT * FROM placed", *_BOTH)
def jn_counts(v):
    return pl.with_counts(v.settlements, _counts(v)).select("name", "district", "n")


@query("o_agg_eligible", f"WITH {_COUNTS}, {_PLACED} SELECT name, n FROM placed WHERE n >= {C.PLACE_PAGE_MIN_RECORDS}", *_BOTH)
@query("o_flt_page", f"WITH {_COUNTS}, {_PLACED} SELECT name, n FROM placed WHERE n >= {C.PLACE_PAGE_MIN_RECORDS}", *_BOTH)
def agg_eligible(v):
    return pl.eligible(v.settlements, _counts(v)).select("name", "n")


@query("o_flt_places_in_district", f"WITH {_COUNTS}, {_PLACED} SELECT name FROM placed WHERE n >= 3 AND district = 'lefke'", *_BOTH)
def flt_places_in_district(v):
    return pl.eligible(v.settlements, _counts(v)).where("district = 'lefke'").select("name")


@query("o_geo_5", f"WITH {_DARK} SELECT name, id, kind, {_ISO('starts_at')}, {_ISO('ends_at')}, confidence, rank FROM dark", *_BOTH)
@query("o_jn_overlay", f"WITH {_DARK} SELECT name, id, kind, {_ISO('starts_at')}, {_ISO('ends_at')}, confidence, rank FROM dark", *_BOTH)
@query("o_set_overlay", f"WITH {_DARK} SELECT name, id, kind, {_ISO('starts_at')}, {_ISO('ends_at')}, confidence, rank FROM dark", *_BOTH)
@query("o_win_firstwin", f"WITH {_DARK} SELECT name, id, kind, {_ISO('starts_at')}, {_ISO('ends_at')}, confidence, rank FROM dark", *_BOTH)
def geo_5(v):
    return pl.darkness(_active(v), v.settlements)


@query(
    "o_jn_searchlist",
    f"WITH {_COUNTS}, {_PLACED}, {_DARK} SELECT p.name, p.district, replace(lower(p.name), ' ', '-') AS slug, n >= 3 AS has_page, d.name IS NOT NULL AS out FROM placed p LEFT JOIN dark d USING (name)",
    *_BOTH,
)
def jn_searchlist(v):
    return pl.search_list(v.settlements, pl.eligible(v.settlements, _counts(v)), pl.darkness(_active(v), v.settlements))


@query("o_jn_slug", "SELECT name, district FROM v_sites WHERE replace(key, ' ', '-') = 'safak-17'", "v_sites")
def jn_slug(v):
    return v.sites.where(tx.hyphens(F.col("name")) == "safak-17").select("name", "district")


def _ranked(rows, *order):
    """The place of each row in the order of its district's page."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("district").orderBy(*order)))


@query("o_srt_tr", "SELECT district, name, row_number() OVER (PARTITION BY district ORDER BY c_custkey % 10, c_custkey::VARCHAR) AS rank FROM v_sites", "v_sites")
def srt_tr(v):
    return _ranked(v.sites, F.collate(F.col("name"), "tr")).select("district", "name", "rank")


@query("o_srt_lng", "SELECT district, name, lng, row_number() OVER (PARTITION BY district ORDER BY lng, key) AS rank FROM v_sites", "v_sites")
def srt_lng(v):
    return _ranked(v.sites, "lng", tx.fold_key(F.col("name"))).select("district", "name", "lng", "rank")


@query(
    "o_srt_search",
    """WITH r AS (SELECT *, CASE WHEN key LIKE 's%' OR key LIKE '% s%' THEN 0 WHEN key LIKE '%s%' THEN 1 END AS rank FROM v_sites)
    SELECT name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, c_custkey % 10, c_custkey::VARCHAR LIMIT 6""",
    "v_sites",
)
def srt_search(v):
    return pl.search(v.sites, "s").select("name", "rank")


@query(
    "o_jn_gaz",
    """WITH s AS (SELECT name, district, ordinal, unnest([name, alias]) AS spelling FROM v_places),
    k AS (SELECT *, trim(regexp_replace(lower(spelling), '[^a-z0-9]+', ' ', 'g')) AS key FROM s)
    SELECT key, name, district FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, ordinal) = 1""",
    "v_places",
)
def jn_gaz(v):
    return pl.gazetteer(v.places)


@query(
    "o_jn_fuzzy",
    """WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, min(ordinal) OVER (PARTITION BY trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS ordinal FROM v_places),
    w AS (SELECT DISTINCT substr(key, 1, length(key) - 1) || 'x' AS word FROM n),
    p AS (SELECT word, key, ordinal, 1 - levenshtein(word, key)::DOUBLE / greatest(length(word), length(key)) AS score FROM w, n WHERE length(word) >= 5)
    SELECT word, key, round(score, 6) AS score FROM p WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, ordinal, key) = 1""",
    "v_places",
)
def jn_fuzzy(v):
    keys = v.places.groupBy(tx.fold_key(F.col("name")).alias("key")).agg(F.min("ordinal").alias("ordinal"))
    words = keys.select(F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("x")).alias("word")).distinct()
    return pl.fuzzy(words, keys).select("word", "key", F.round("score", 6).alias("score"))


@query("o_geo_4", "SELECT DISTINCT district, key FROM v_sites", "v_sites")
def geo_4(v):
    return v.sites.select("district", tx.fold_key(F.col("name")).alias("key")).distinct()


_S = f"cos({pl._LATITUDE} * pi() / 180)"


@query(
    "o_geo_1",
    f"""WITH v AS (SELECT n_regionkey AS region, n_nationkey // 5 AS k, 32.7::DOUBLE + 0.25::DOUBLE * n_regionkey + 0.2::DOUBLE * cos(2 * pi() * (n_nationkey // 5) / 5) AS lng, 35.2::DOUBLE + 0.12::DOUBLE * sin(2 * pi() * (n_nationkey // 5) / 5) AS lat FROM nation),
    e AS (SELECT a.region, a.lng * {_S} AS ax, a.lat AS ay, b.lng * {_S} AS bx, b.lat AS b_y FROM v a JOIN v b ON a.region = b.region AND a.k = (b.k + 1) % 5),
    p AS (SELECT name, n_regionkey AS region, lng * {_S} AS x, lat AS y FROM v_sites JOIN nation ON n_nationkey = c_nationkey),
    t AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) AS t FROM p JOIN e USING (region))
    SELECT name, round(CASE WHEN count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax) % 2 = 1 THEN 0
      ELSE sqrt(min((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (b_y - ay)) ** 2)) * {pl._KM} END, 6) AS km FROM t GROUP BY name""",
    "v_sites",
)
def geo_1(v):
    """Kilometres from each site to the polygon of its region, whose vertices are the region's nations."""
    k = F.expr("cast(n_nationkey div 5 as double)")
    vertex = F.array(0.25 * F.col("n_regionkey") + 32.7 + 0.2 * F.cos(2 * math.pi * k / 5), 0.12 * F.sin(2 * math.pi * k / 5) + 35.2)
    nations = v.table("nation")
    rings = nations.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), vertex.alias("at")))), lambda x: x["at"]).alias("vertices"))
    sites = v.sites.join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    return pl.distances_km(sites, rings, "n_regionkey", "name").select("name", F.round("km", 6).alias("km"))


@query(
    "o_geo_2",
    """WITH c AS (SELECT 'name ' || p_partkey % 300 AS name, p_partkey AS candidate, 1 + p_partkey % 2 AS rank, (p_size % 8)::DOUBLE AS service_km, (p_size * 7 % 90) / 10.0::DOUBLE AS district_km FROM part),
    r AS (SELECT *, row_number() OVER w AS k, lead(rank) OVER w AS nr, lead(district_km) OVER w AS nk FROM c WHERE service_km <= 4 WINDOW w AS (PARTITION BY name ORDER BY rank DESC, district_km, candidate))
    SELECT name, candidate, rank::INT AS rank, district_km, coalesce(nr = rank AND nk - district_km <= 1, false) AS contested, district_km > 6 AS far FROM r WHERE k = 1""",
)
def geo_2(v):
    scored = v.table("part").selectExpr(
        "'name ' || p_partkey % 300 as name", "p_partkey as candidate", "cast(1 + p_partkey % 2 as int) as rank",
        "cast(p_size % 8 as double) as service_km", "cast(p_size * 7 % 90 as double) / 10 as district_km",
    )
    return pl.choose_candidates(scored)


@query(
    "o_geo_3",
    "SELECT name, round(lng * pi() / 180 * 100, 1) AS x, round(-ln(tan(pi() / 4 + lat * pi() / 360)) * 100, 1) AS y FROM v_sites",
    "v_sites",
)
def geo_3(v):
    return v.sites.select("name", pl.mercator(F.col("lng"), F.col("lat")).alias("m")).select("name", "m.*")
