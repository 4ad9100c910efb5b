"""Queries over sitemaps, feeds and article heads: documents are written from events and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.plans.registry import query
from gridlore.sources import web

_MINUTE = "date_trunc('minute', ts)"
_ISO = "strftime(moment, '%Y-%m-%dT%H:%M:%SZ')"


def _events(v):
    """event_id, at and its two spellings, event_type."""
    e = v.table("events").select("event_id", "event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("at"))
    return e.withColumn("iso", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("mail", F.date_format("at", "EEE, d MMM yyyy HH:mm:ss '+0000'"))


_SITEMAP = """if(event_id % 3 = 0,
  concat('<urlset><loc>https://o.example/n', event_id, '?a=1&amp;b=2</loc>\n<loc> https://o.example/m', event_id, ' </loc></urlset>'),
  concat('<urlset>\n<url><loc>https://o.example/n', event_id % 500, '?a=1&amp;b=2</loc><lastmod>', iso, '</lastmod></url>',
    '<url>\n<loc> https://o.example/m', event_id, ' </loc></url></urlset>'))"""
_ENTRIES = f"""SELECT event_id, 0 AS place, 'https://o.example/n' || CASE WHEN event_id % 3 = 0 THEN event_id ELSE event_id % 500 END || '?a=1&b=2' AS url,
    CASE WHEN event_id % 3 <> 0 THEN {_MINUTE} END AS moment FROM events
  UNION ALL SELECT event_id, 1, 'https://o.example/m' || event_id, NULL FROM events"""


@query("o_src_sitemap", f"SELECT event_id, place, url, {_ISO} AS lastmod FROM ({_ENTRIES})")
def src_sitemap(v):
    return _events(v).select("event_id", F.posexplode(web.sitemap_entries(F.expr(_SITEMAP))).alias("place", "e")).select("event_id", "place", "e.url", "e.lastmod")


@query(
    "o_src_collect",
    f"""SELECT url, {_ISO} AS lastmod FROM (SELECT url, arg_min({{'moment': moment}}, event_id).moment AS moment FROM ({_ENTRIES})
      WHERE regexp_matches(url, '/n[0-9]') AND (moment IS NULL OR moment >= TIMESTAMP '2024-01-10') GROUP BY url)""",
)
def src_collect(v):
    sitemaps = _events(v).select(F.col("event_id").alias("ordinal"), F.expr(_SITEMAP).alias("xml"))
    return web.collect_entries(sitemaps, "/n[0-9]", F.lit("2024-01-10").cast("timestamp"))


_INDEX = """concat('<sitemapindex>', array_join(transform(sequence(0, cast(event_id % 12 as int)),
  k -> concat('<sitemap><loc>https://o.example/s', k, '.xml</loc></sitemap>')), '\n'), '</sitemapindex>')"""


@query(
    "o_src_sitemapindex",
    """SELECT event_id, true AS is_index, array_to_string(list_transform(range(least(event_id % 12 + 1, 8)), lambda k: 'https://o.example/s' || k || '.xml'), '|') AS first_ones,
      array_to_string(list_transform(range(least(event_id % 12 + 1, 3)), lambda k: 'https://o.example/s' || (event_id % 12 - k) || '.xml'), '|') AS last_ones FROM events""",
)
def src_sitemapindex(v):
    xml = F.expr(_INDEX)
    return v.table("events").select(
        "event_id", web.is_sitemap_index(xml).alias("is_index"), web.listed_sitemaps(xml).alias("first_ones"), web.listed_sitemaps(xml, 3, newest_last=True).alias("last_ones")
    )


_FEED = """if(event_id % 2 = 0,
  concat('<rss><item><title><![CDATA[Cut &amp; ', event_type, ']]></title><guid>https://o.example/g', event_id, '</guid>',
    if(event_id % 4 = 0, concat('<link>https://o.example/n', event_id, '</link>'), ''), '<description>of <b>', event_id, '</b></description><pubDate>', mail, '</pubDate></item><item><link>https://o.example/none</link></item></rss>'),
  concat('<feed><entry><title>', event_type, '</title><link rel="alternate" href="https://o.example/a', event_id, '"/><summary>sum ', event_id, '</summary>',
    if(event_id % 3 = 0, '', concat('<updated>', iso, '</updated>')), '</entry></feed>'))"""


@query(
    "o_src_feed",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Cut & ' || event_type ELSE event_type END AS title,
      'https://o.example/' || CASE WHEN event_id % 4 = 0 THEN 'n' WHEN event_id % 2 = 0 THEN 'g' ELSE 'a' END || event_id AS link,
      CASE WHEN event_id % 2 = 0 THEN 'of ' ELSE 'sum ' END || event_id AS description,
      CASE WHEN event_id % 2 = 0 OR event_id % 3 <> 0 THEN {_ISO} END AS published_at FROM (SELECT *, {_MINUTE} AS moment FROM events)""",
)
def src_feed(v):
    return _events(v).select("event_id", F.explode(web.feed_items(F.expr(_FEED))).alias("i")).select("event_id", "i.*")


_HEADS = """concat('<html><head>',
  if(event_id % 2 = 0, concat('<meta name="date" content="2020-01-01T00:00:00Z"><meta property="article:published_time" content="', iso, '">'), ''),
  if(event_id % 3 = 0, concat('<script type="application/ld+json">{"datePublished": "', iso, '"}</script>'), ''),
  if(event_id % 4 = 1, concat('<meta property="og:description" content="Announced by the works department for ', event_type, '">'), ''),
  '</head><body>', if(event_id % 5 = 0, concat('<time class="x" datetime="', iso, '">then</time>'), ''),
  if(event_id % 4 = 2, concat('<div class="lead spot">The lead of the page says <b>', event_type, '</b></div>'), ''),
  if(event_id % 4 = 3, '<div class="spot">Too short</div>', ''), '</body></html>')"""


@query("o_src_date", f"SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 THEN {_ISO} END AS published_at FROM (SELECT *, {_MINUTE} AS moment FROM events)")
def src_date(v):
    return _events(v).select("event_id", web.article_date(F.expr(_HEADS)).alias("published_at"))


@query(
    "o_src_summary",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'Announced by the works department for ' || event_type WHEN 2 THEN 'The lead of the page says ' || event_type ELSE '' END AS summary FROM events""",
)
def src_summary(v):
    return _events(v).select("event_id", web.summary(F.expr(_HEADS)).alias("summary"))
