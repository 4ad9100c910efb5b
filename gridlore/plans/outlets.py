"""Queries of outlets and of polite fetching, over recorded answers that are made from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.plans.registry import query
from gridlore.session import shared_folder
from gridlore.sources import outlets, polite
from gridlore.views import NOW

_NOW = datetime.fromisoformat(NOW + "+00:00")
#: Pages of an outlet on one sitemap of the record.
_CHUNK = 500


def recorded(v) -> tuple[str, list[outlets.Outlet]]:
    """A record of five outlets' answers made of ``pages``, and their registry: a sitemap for some hundred pages each.
    A third of the pages have the slug of an announcement; a fourth has no time on its sitemap, and of these some state one
    themselves; some have another subject after all; some are gone."""
    p = v.table("pages").withColumn("part", F.expr(f"concat('p', page_id % 5, '-', page_id div 5 div {_CHUNK})"))
    p = p.withColumn("at", F.expr("concat('https://outlet', page_id % 5, '.example/', part, '/', if(page_id % 3 = 0, 'elektrik-kesintisi-n', 'haberler-n'), page_id)"))
    p = p.withColumn("lastmod", F.expr("if(page_id % 4 = 1, null, timestamp'2024-01-20' - make_dt_interval(0, cast(page_id % 100 as int)))"))
    stated = F.expr("if(page_id % 8 = 1, concat('<meta property=\"article:published_time\" content=\"2024-01-19T', lpad(page_id % 24, 2, '0'), ':00:00Z\">'), '')")
    said = F.concat(F.expr("if(page_id % 9 = 0, 'Belediye meclisi toplanacak, sayfa ', 'Elektrik kesintisi olacak, sayfa ')"), tx.xml_escape(F.col("url")))
    html = F.concat(F.lit("<html><head>"), stated, F.lit("</head><body><h1>Kesinti "), "page_id", F.lit("</h1><p>"), said, F.lit("</p></body></html>"))
    articles = p.where("page_id % 15 <> 0").select("part", F.col("at").alias("url"), F.lit(200).alias("status"), html.alias("body"))
    time = F.expr("if(lastmod is null, '', concat('<lastmod>', date_format(lastmod, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '</lastmod>'))")
    entry = F.concat(F.lit("<url><loc>"), "at", F.lit("</loc>"), time, F.lit("</url>"))
    maps = p.groupBy("part", F.expr("concat('https://outlet', page_id % 5, '.example/', part, '/sitemap.xml')").alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</urlset>")).alias("body"))
    root = shared_folder(v.spark, "recorded")
    articles.unionByName(maps.select("part", "url", F.lit(200).alias("status"), "body")).repartition("part").write.partitionBy("part").parquet(root)
    of = {k: sorted(r["url"] for r in maps.select("url").collect() if r["url"].startswith(f"https://outlet{k}.")) for k in range(5)}
    return root, [outlets.Outlet(f"outlet{k}", f"Outlet {k}", f"https://outlet{k}.example", tuple(urls)) for k, urls in of.items() if urls]


@query(
    "o_src_adapter",
    """WITH p AS (SELECT *, page_id % 4 = 1 AS bare, TIMESTAMP '2024-01-20' - to_hours((page_id % 100)::INT) AS lastmod FROM pages WHERE page_id % 3 = 0 AND page_id % 9 <> 0 AND page_id % 15 <> 0)
    SELECT 'https://outlet' || page_id % 5 || '.example/p' || page_id % 5 || '-' || page_id // 5 // 500 || '/elektrik-kesintisi-n' || page_id AS url, 'Outlet ' || page_id % 5 AS name, 'Kesinti ' || page_id AS title,
      'Elektrik kesintisi olacak, sayfa ' || url AS body, strftime(CASE WHEN NOT bare THEN lastmod WHEN page_id % 8 = 1 THEN TIMESTAMP '2024-01-19' + to_hours((page_id % 24)::INT) ELSE TIMESTAMP '2024-01-20 12:00:00' END, '%Y-%m-%dT%H:%M:%SZ') AS published_at
    FROM p WHERE bare OR lastmod >= TIMESTAMP '2024-01-17 12:00:00'""",
)
@query(
    "o_src_registry",
    """WITH p AS (SELECT *, page_id % 4 = 1 AS bare, TIMESTAMP '2024-01-20' - to_hours((page_id % 100)::INT) AS lastmod FROM pages WHERE page_id % 3 = 0 AND page_id % 9 <> 0 AND page_id % 15 <> 0)
    SELECT 'https://outlet' || page_id % 5 || '.example/p' || page_id % 5 || '-' || page_id // 5 // 500 || '/elektrik-kesintisi-n' || page_id AS url, 'Outlet ' || page_id % 5 AS name, 'Kesinti ' || page_id AS title,
      'Elektrik kesintisi olacak, sayfa ' || url AS body, strftime(CASE WHEN NOT bare THEN lastmod WHEN page_id % 8 = 1 THEN TIMESTAMP '2024-01-19' + to_hours((page_id % 24)::INT) ELSE TIMESTAMP '2024-01-20 12:00:00' END, '%Y-%m-%dT%H:%M:%SZ') AS published_at
    FROM p WHERE bare OR lastmod >= TIMESTAMP '2024-01-17 12:00:00'""",
)
def src_adapter(v):
    """Announcements of a stream over all outlets of a registry: by address before the fetch, by text after it, dated
    by sitemap, page or fetch."""
    root, found = recorded(v)
    known = outlets.registry(outlets.registry_json(found))
    name = outlets.register(v.spark, known, polite.Recorded(root, "/(p[0-9]+-[0-9]+)/"), clock=polite.Ticks, now=lambda: _NOW)
    to = shared_folder(v.spark, "articles")
    articles = v.spark.readStream.format(name).load()
    articles.writeStream.option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/rows", format="parquet").awaitTermination()
    stored = v.spark.read.schema(outlets.ARTICLES).parquet(f"{to}/rows")
    every = outlets.announcements(stored, tx.about, most=1 << 30)
    return every.select("url", "source.name", "title", "body", "published_at")


_STATUSES = """CASE event_id % 6 WHEN 0 THEN [200] WHEN 1 THEN [304] WHEN 2 THEN [500, 200] WHEN 3 THEN [429, 503, 200] WHEN 4 THEN [0, 0, 0] ELSE [404] END"""


@query(
    "o_src_http",
    f"""WITH r AS (SELECT event_id, 'host' || user_id % 7 AS host, {_STATUSES} AS s FROM events),
    o AS (SELECT *, CASE event_id % 6 WHEN 1 THEN 'unchanged' WHEN 4 THEN 'skipped' WHEN 5 THEN 'skipped' ELSE 'ok' END AS status, len(s) AS attempts, len(s) * 0.25 + CASE len(s) WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS seconds FROM r)
    SELECT event_id, host, status, attempts, coalesce(sum(seconds + 1.5) OVER (PARTITION BY host ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS started FROM o""",
)
def src_http(v):
    """When each of many requests begins, and what becomes of it, where the answers to its attempts are known."""
    s = F.expr("case event_id % 6 when 0 then array(200) when 1 then array(304) when 2 then array(500, 200) when 3 then array(429, 503, 200) when 4 then array(0, 0, 0) else array(404) end")
    asked = v.table("events").select("event_id", F.expr("concat('host', user_id % 7)").alias("host"), F.col("event_id").alias("ordinal"), polite.outcomes(s).alias("o"))
    timed = asked.select("event_id", "host", "ordinal", "o.*", (F.col("o.attempts") * 0.25 + F.col("o.waited")).alias("seconds"))
    return polite.schedule(timed, "seconds").select("event_id", "host", "status", "attempts", "started")
