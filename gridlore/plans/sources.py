"""Queries over web pages and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import resolve
from gridlore.plans.registry import query
from gridlore.session import shared_folder
from gridlore.sources import feeds, web
from gridlore.views import NOW, now

_NOW = f"TIMESTAMP '{NOW}'"
_SITE = "https://site.example"
_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<nav.*?</nav>', ' ', 'g'), '(?is)<footer.*?</footer>', ' ', 'g')"""


def _text(html: str) -> str:
    for pattern, by in (("(?is)<script.*?</script>", "' '"), ("(?is)<style.*?</style>", "' '"), ("(?i)</(p|div|li|tr|h[1-6])>", "chr(10)"), (r"(?i)<br\s*/?>", "chr(10)"), ("<[^>]+>", "' '")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    for name, letter in tx.ENTITIES.items():
        html = f"regexp_replace({html}, '(?i)&{name};', {_letter(letter)}, 'g')"
    line = "trim(regexp_replace(x, '[ \\t\\x{00A0}]+', ' ', 'g'))"
    return f"array_to_string(list_filter(list_transform(string_split({html}, chr(10)), lambda x: {line}), lambda x: x <> ''), chr(10))"


def _letter(letter: str) -> str:
    return "'\\&'" if letter == "&" and False else f"chr({ord(letter)})"


@query("o_str_html", f"SELECT page_id, {_text('html')} AS text FROM pages")
def str_html(v):
    return v.table("pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


_H1 = f"list_filter(list_transform(regexp_extract_all({_STRIP}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), lambda y: trim(regexp_replace({_text('y')}, '\\s+', ' ', 'g'))), lambda y: y <> '')"


_TITLE = f"trim(regexp_replace({_text(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)' + chr(41))}, '\\s+', ' ', 'g'))"
_HEAD = f"WITH h AS (SELECT page_id, html, {_H1} AS h1s, {_TITLE} AS declared FROM pages), t AS (SELECT *, CASE WHEN len(h1s) > 1 AND declared <> '' THEN list_filter(h1s, lambda z: starts_with(declared, z) OR starts_with(z, declared))[1] END AS stated FROM h)"


@query("o_src_headline", f"{_HEAD} SELECT page_id, coalesce(stated, h1s[1], declared) AS title FROM t")
def src_headline(v):
    return v.table("pages").select("page_id", web.headline(F.col("html")).alias("title"))


@query(
    "o_src_article",
    f"{_HEAD} SELECT page_id, coalesce(stated, h1s[1], declared) AS title, array_to_string(list_filter(list_transform(regexp_extract_all({_STRIP}, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda y: {_text('y')}), lambda y: length(y) > 25), chr(10)) AS body FROM t",
)
def src_article(v):
    return v.table("pages").select("page_id", web.article(F.col("html")).alias("a")).select("page_id", "a.*")


@query(
    "o_src_links",
    r"""WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^(https?://[^/]+(?:/.*/|/)?)', 1) AS folder, url,
      list_transform(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda x: regexp_replace(x, '#.*$', '')) AS hrefs FROM pages),
    u AS (SELECT page_id, origin, unnest(list_transform(hrefs, lambda x: CASE WHEN starts_with(x, '//') THEN regexp_extract(url, '^(https?:)', 1) || x WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN x
      WHEN starts_with(x, '/') THEN origin || x WHEN x = '' THEN url ELSE (CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END) || x END)) AS link FROM b)
    SELECT DISTINCT page_id, link FROM u WHERE regexp_extract(link, '^(https?://[^/]+)', 1) = origin""",
)
def src_links(v):
    links = web.article_links(F.col("html"), F.col("url"), "")
    return v.table("pages").select("page_id", F.explode(links).alias("link"))


@query("o_flt_robots", "SELECT page_id, NOT (regexp_matches(path, '^/p') OR regexp_matches(path, '^/.*[13579]$')) AS allowed FROM (SELECT page_id, CASE WHEN regexp_replace(url, '^https?://[^/]+', '') = '' THEN '/' ELSE regexp_replace(url, '^https?://[^/]+', '') END AS path FROM pages)")
def flt_robots(v):
    bare = F.regexp_replace("url", "^https?://[^/]+", "")
    rules = F.array(F.lit("/p"), F.lit("/*1"), F.lit("/*3"))
    path = F.when(bare == "", "/").otherwise(bare)
    odd = F.exists(F.array(*[F.lit(f"{k}") for k in (1, 3, 5, 7, 9)]), lambda k: path.endswith(k))
    return v.table("pages").select("page_id", (web.is_allowed(path, F.slice(rules, 1, 1)) & ~odd).alias("allowed"))


_SLUG = "strftime(timezone('Europe/Nicosia', timezone('UTC', starts_at)), '%Y-%m-%d') || '-' || district || '-' || replace(lower(areas[1]), ' ', '-') || '-' || substr(id, 1, 8)"
_NAME = "MAP {" + ", ".join(f"'{k}': '{n}'" for k, n in __import__("gridlore.constants", fromlist=["DISTRICTS"]).DISTRICTS.items()) + "}[district]"
_KIND = "MAP {" + ", ".join(f"'{k}': '{n}'" for k, n in feeds.KIND.items()) + "}[kind]"
_AREAS = f"CASE WHEN scope = 'district' THEN '{feeds.DISTRICT_WIDE}' ELSE array_to_string(areas, ', ') END"
_STAMP = lambda c: f"strftime({c}, '%Y%m%dT%H%M%SZ')"


@query(
    "o_snk_ics",
    f"""SELECT id, array_to_string(['BEGIN:VEVENT', 'UID:' || id || '@site.example', 'DTSTAMP:' || {_STAMP("ingested_at")}, 'DTSTART:' || {_STAMP("starts_at")}, 'DTEND:' || {_STAMP("ends_at")},
      'SUMMARY:' || replace({_KIND} || ' · ' || {_NAME} || ' — ' || {_AREAS}, ',', '\\,'), 'DESCRIPTION:' || source_name || ': ' || source_url, 'URL:{_SITE}/outage/' || {_SLUG}, 'END:VEVENT'], '|') AS event
    FROM v_outages WHERE kind <> 'fault' AND cancelled_at IS NULL AND ends_at IS NOT NULL""",
    "v_outages",
)
@query(
    "o_str_icsesc",
    f"""SELECT id, array_to_string(['BEGIN:VEVENT', 'UID:' || id || '@site.example', 'DTSTAMP:' || {_STAMP("ingested_at")}, 'DTSTART:' || {_STAMP("starts_at")}, 'DTEND:' || {_STAMP("ends_at")},
      'SUMMARY:' || replace({_KIND} || ' · ' || {_NAME} || ' — ' || {_AREAS}, ',', '\\,'), 'DESCRIPTION:' || source_name || ': ' || source_url, 'URL:{_SITE}/outage/' || {_SLUG}, 'END:VEVENT'], '|') AS event
    FROM v_outages WHERE kind <> 'fault' AND cancelled_at IS NULL AND ends_at IS NOT NULL""",
    "v_outages",
)
def snk_ics(v):
    return feeds.calendar_events(v.outages, _SITE, "site.example").select("id", "event")


_EVENT_LINES = f"""['BEGIN:VEVENT', 'UID:' || id || '@site.example', 'DTSTAMP:' || {_STAMP("ingested_at")}, 'DTSTART:' || {_STAMP("starts_at")}, 'DTEND:' || {_STAMP("ends_at")},
      'SUMMARY:' || replace({_KIND} || ' · ' || {_NAME} || ' — ' || {_AREAS}, ',', '\\,'), 'DESCRIPTION:' || source_name || ': ' || source_url, 'URL:{_SITE}/outage/' || {_SLUG}, 'END:VEVENT']"""
#: Lines (key, text) cut from the left: up to 75 octets, then 74 behind a blank.
_FOLD = """f AS (SELECT *, 0 AS step, NULL::VARCHAR AS line, text AS rest, 75 AS room, '' AS lead FROM lines
    UNION ALL SELECT * EXCLUDE (step, line, rest, room, lead, c), step + 1, lead || left(rest, c), substr(rest, c + 1), 74, ' '
      FROM (SELECT *, list_max(list_filter(range(1, 76), lambda k: strlen(left(rest, k)) <= room)) AS c FROM f WHERE rest <> ''))"""


@query(
    "o_str_icsfold",
    f"""WITH RECURSIVE lines AS (SELECT p_partkey, 'SUMMARY:' || repeat('Küçük Kaymaklı — ' || p_name || ' ığ😀', (1 + p_partkey % 9)::INT) AS text FROM part), {_FOLD}
    SELECT p_partkey, string_agg(line, chr(13) || chr(10) ORDER BY step) AS folded FROM f WHERE step > 0 GROUP BY p_partkey""",
)
def str_icsfold(v):
    """Calendar lines in parts of at most 75 octets; characters of one to four octets."""
    line = F.expr("'SUMMARY:' || repeat('Küçük Kaymaklı — ' || p_name || ' ığ😀', cast(1 + p_partkey % 9 as int))")
    return v.table("part").select("p_partkey", feeds.folded(line).alias("folded"))


@query(
    "o_snk_ics_files",
    f"""WITH RECURSIVE e AS (SELECT district, {_EVENT_LINES} AS event FROM v_outages WHERE kind <> 'fault' AND cancelled_at IS NULL AND ends_at IS NOT NULL),
    every AS (SELECT district, unnest(event) AS text FROM e UNION ALL
      SELECT district, unnest(['BEGIN:VCALENDAR', 'VERSION:2.0', 'X-WR-CALNAME:' || {_NAME}, 'X-WR-TIMEZONE:Asia/Nicosia', 'END:VCALENDAR']) FROM (SELECT DISTINCT district FROM e)),
    lines AS (SELECT district, text, count(*) AS n FROM every GROUP BY ALL), {_FOLD}
    SELECT district, line, sum(n)::BIGINT AS n FROM f WHERE step > 0 GROUP BY ALL""",
    "v_outages",
)
def snk_ics_files(v):
    """The calendars of all districts, written as files in ranges of time and read again."""
    path = shared_folder(v.spark, "calendars")
    feeds.write_calendars(v.outages, path, _SITE, "site.example")
    return feeds.calendar_lines(v.spark, path).groupBy("district", "line").agg(F.count(F.lit(1)).alias("n"))


_L = "timezone('Europe/Nicosia', timezone('UTC', {}))"
_MONTHS = f"{tm.MONTHS['tr']!r}"
_RANGE = f"""strftime({_L.format("starts_at")}, '%H:%M') || ' – ' || CASE WHEN ends_at IS NULL THEN '{feeds.END_UNKNOWN}' WHEN {_L.format("starts_at")}::DATE = {_L.format("ends_at")}::DATE THEN strftime({_L.format("ends_at")}, '%H:%M')
  ELSE day({_L.format("ends_at")}) || ' ' || substr({_MONTHS}[month({_L.format("ends_at")})], 1, 3) || ' ' || strftime({_L.format("ends_at")}, '%H:%M') END"""
_LONG = f"day({_L.format('starts_at')}) || ' ' || {_MONTHS}[month({_L.format('starts_at')})] || ' ' || year({_L.format('starts_at')})"


@query(
    "o_snk_rss",
    f"""SELECT id, '<item><title>' || CASE WHEN cancelled_at IS NOT NULL THEN '{feeds.CANCELLED}: ' ELSE '' END || {_NAME} || ' ' || {_LONG} || '</title><link>{_SITE}/outage/' || {_SLUG}
      || '</link><guid isPermaLink="true">{_SITE}/outage/' || {_SLUG} || '</guid><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description>' || {_KIND} || ' · ' || {_RANGE} || ' · ' || {_AREAS} || ' · ' || source_name || '</description></item>' AS item FROM v_outages""",
    "v_outages",
)
def snk_rss(v):
    return feeds.rss_items(v.outages, _SITE).select("id", "item")


@query("o_dt_range", f"SELECT id, {_RANGE} AS range, {_LONG} AS long FROM v_outages", "v_outages")
def dt_range(v):
    return v.outages.select("id", tm.time_range(F.col("starts_at"), F.col("ends_at"), "tr", feeds.END_UNKNOWN).alias("range"), tm.long_date(F.col("starts_at"), "tr").alias("long"))


@query(
    "o_snk_sitemap",
    f"""WITH s AS (SELECT * FROM v_outages WHERE starts_at >= {_NOW} - INTERVAL 7 DAY AND cancelled_reason IS DISTINCT FROM 'bad_data'),
    p AS (SELECT unnest(['', '/archive', '/about']) AS path, NULL::TIMESTAMP AS m UNION ALL SELECT '/district/' || district, max(ingested_at) FROM s GROUP BY 1
      UNION ALL SELECT '/place/' || replace(lower(name), ' ', '-'), NULL FROM v_settlements UNION ALL SELECT '/outage/' || {_SLUG}, ingested_at FROM s)
    SELECT unnest(['{_SITE}' || path, '{_SITE}/en' || path]) AS url, strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS lastmod FROM p""",
    "v_outages", "v_settlements",
)
def snk_sitemap(v):
    return feeds.sitemap_rows(v.outages, v.settlements, _SITE, now() - tm.minutes(7 * 1440))


@query(
    "o_snk_jsonld",
    f"""SELECT id, '{{"@context":"https://schema.org","@type":"SpecialAnnouncement","name":"' || {_NAME} || ' ' || {_KIND} || '","datePosted":"' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '"'
      || CASE WHEN ends_at IS NULL THEN '' ELSE ',"expires":"' || strftime(ends_at, '%Y-%m-%dT%H:%M:%SZ') || '"' END || ',"url":"{_SITE}/outage/' || {_SLUG} || '"}}' AS json FROM v_outages""",
    "v_outages",
)
def snk_jsonld(v):
    return feeds.announcements_json(v.outages, _SITE)


@query("o_str_xmlesc", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS x FROM pages")
def str_xmlesc(v):
    return v.table("pages").select("page_id", tx.xml_escape(F.col("html")).alias("x"))


@query("o_json_sources", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_sources(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


#: Answers of an extractor, one kind of defect for each remainder: no JSON, no list, no object, an unknown kind, a day that the calendar has
#: not, an unknown weekday, a start and an end that are no clock, no area of two letters, an unknown scope, a restoration that is no clock, flags
#: that are missing. Two entries stand in each list, the second without a defect.
_ANSWER = """case event_id % 14 when 0 then 'no answer at all' when 1 then '{"outages":"none"}' else concat('{"outages":[', case when event_id % 14 = 2 then 'null'
  else concat('{"kind":"', if(event_id % 14 = 3, 'weather', if(event_id % 2 = 0, 'planned', 'fault')), '","date":"', if(event_id % 14 = 4, '2026-02-31', concat('2026-02-', lpad(1 + event_id % 28, 2, '0'))), '","weekday":',
    if(event_id % 14 = 5, '"someday"', if(event_id % 3 = 0, '"monday"', 'null')), ',"start":', if(event_id % 14 = 6, '"24:00"', if(event_id % 5 = 0, 'null', '"9:05"')), ',"end":', if(event_id % 14 = 7, '"12:60"', '"17:30"'),
    ',"areas":', if(event_id % 14 = 8, '["x"," "]', concat('["Place ', event_id % 40, '","y"]')), ',"scope":"', if(event_id % 14 = 9, 'island', if(event_id % 4 = 0, 'district', 'places')), '"', if(event_id % 14 = 11, '', concat(',"cancelled":', event_id % 6 = 0, ',"resolved":', event_id % 6 = 1)),
    ',"restoredAt":', if(event_id % 14 = 10, '"late"', '"23:15"'), '}') end, ',{"kind":"rotating","date":"2026-03-01","weekday":null,"start":null,"end":null,"areas":["Place ', event_id % 7, '"]}]}') end"""
_VALID = """WITH a AS (SELECT event_id, event_id % 14 AS d FROM events WHERE event_id % 14 > 1),
  e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'planned' ELSE 'fault' END AS kind, '2026-02-' || lpad((1 + event_id % 28)::VARCHAR, 2, '0') AS date, CASE WHEN event_id % 3 = 0 THEN 'monday' END AS weekday,
      CASE WHEN event_id % 5 <> 0 THEN '9:05' END AS start, '17:30' AS "end", 'Place ' || event_id % 40 AS areas, CASE WHEN d <> 9 AND event_id % 4 = 0 THEN 'district' ELSE 'places' END AS scope,
      d <> 11 AND event_id % 6 = 0 AS cancelled, d <> 11 AND event_id % 6 = 1 AS resolved, CASE WHEN d <> 10 THEN '23:15' END AS restored_at FROM a WHERE d > 8
    UNION ALL SELECT event_id, 'rotating', '2026-03-01', NULL, NULL, NULL, 'Place ' || event_id % 7, 'places', false, false, NULL FROM a) """


@query("o_flt_validate", _VALID + "SELECT a.event_id, count(e.event_id) AS kept FROM (SELECT event_id FROM events WHERE event_id % 14 <> 0 AND event_id % 14 <> 1) a LEFT JOIN e ON e.event_id = a.event_id GROUP BY ALL UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 14 < 2")
def flt_validate(v):
    """How many entries of each answer are usable; null where it is no answer."""
    return v.table("events").select("event_id", resolve.valid_entries(F.expr(_ANSWER)).alias("e")).select("event_id", F.when(F.col("e").isNotNull(), F.size("e")).alias("kept"))


@query("o_json_extract", _VALID + 'SELECT event_id, kind, date, weekday, start, "end", areas, scope, cancelled, resolved, restored_at FROM e')
def json_extract(v):
    """The usable entries of answers, field by field."""
    e = v.table("events").select("event_id", F.explode(resolve.valid_entries(F.expr(_ANSWER))).alias("e")).select("event_id", "e.*")
    return e.select("event_id", "kind", "date", "weekday", "start", "end", "areas", "scope", "cancelled", "resolved", F.col("restoredAt").alias("restored_at"))


@query(
    "o_set_breadcrumbs",
    f"""SELECT id, '{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"home","item":"{_SITE}/"}},{{"@type":"ListItem","position":2,"name":"' || {_NAME} || '","item":"{_SITE}/district/' || district
      || '"}},{{"@type":"ListItem","position":3,"name":"' || {_AREAS} || '","item":"{_SITE}/outage/' || {_SLUG} || '"}}]}}' AS json FROM v_outages""",
    "v_outages",
)
def breadcrumbs(v):
    return feeds.breadcrumbs_json(v.outages, _SITE).select("id", "json")
