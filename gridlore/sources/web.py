"""Sitemaps, feeds and article pages as column expressions over their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.functions import time as tm

col = F.col


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# Layouts of dates that pages state.
_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss xx")


def stated_instant(text: Column) -> Column:
    """ISO and mail dates; null where none can be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", ""), " (GMT|UTC|Z)$", " +0000")
    return tm.once(bare, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(layout)) for layout in _LAYOUTS]))


_LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"


def sitemap_entries(xml: Column) -> Column:
    """[(url, lastmod)] of a sitemap; bare addresses where it has no url blocks."""
    blocks = F.filter(_all(xml, r"(?is)<url>(.*?)</url>"), lambda b: b.rlike(_LOC))
    entry = lambda b: F.struct(
        tx.decode_entities(_first(b, _LOC)).alias("url"), stated_instant(_first(b, r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>")).alias("lastmod")
    )
    bare = F.transform(_all(xml, _LOC), lambda u: F.struct(tx.decode_entities(u).alias("url"), F.lit(None).cast("timestamp").alias("lastmod")))
    return F.when(F.size(blocks) > 0, F.transform(blocks, entry)).otherwise(bare)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def listed_sitemaps(xml: Column, most: int = 8, match: str | None = None, newest_last: bool = False) -> Column:
    """Addresses of an index: the first ``most``, or the last ones in reverse."""
    urls = F.transform(_all(xml, _LOC), tx.decode_entities)
    urls = F.filter(urls, lambda u: u.rlike(match)) if match else urls
    return F.reverse(F.slice(urls, F.greatest(F.size(urls) - most + 1, F.lit(1)), most)) if newest_last else F.slice(urls, 1, most)


def collect_entries(sitemaps: DataFrame, match: str, since: Column | None = None) -> DataFrame:
    """(url, lastmod) over sitemaps (ordinal, xml): matching addresses, known older ones dropped, the first of
    each, newest first."""
    entries = sitemaps.select("ordinal", F.posexplode(sitemap_entries(col("xml"))).alias("place", "e")).select("ordinal", "place", "e.*")
    entries = entries.where(col("url").rlike(match))
    if since is not None:
        entries = entries.where(col("lastmod").isNull() | (col("lastmod") >= since))
    first = entries.groupBy("url").agg(F.min_by("lastmod", F.struct("ordinal", "place")).alias("lastmod"))
    return first.orderBy(col("lastmod").desc_nulls_last(), "url")


# --- reading marked-up text ---------------------------------------------------------------------------
#
# Three readers, and everything else selects from what they give: elements of a name with their heads and
# contents, heads of tags, and values of attributes in a head.


def elements(markup: Column, name: str) -> Column:
    """[(head, inner)] of the elements of a name, in order; an element ends at the first closing tag."""
    found = rf"(?is)<{name}\b([^>]*)>(.*?)</{name}>"
    return F.arrays_zip(_all(markup, found, 1).alias("head"), _all(markup, found, 2).alias("inner"))


def heads(markup: Column, name: str = "[a-z][a-z0-9:]*") -> Column:
    """What stands in the tags of a name, or of any."""
    return _all(markup, rf"(?is)<{name}\b([^>]*)>")


def attribute(head: Column, *names: str) -> Column:
    """The value of the first of ``names`` that stands in a head; null where none does."""
    return _first(head, rf"""(?is)\b(?:{"|".join(names)})\s*=\s*["']([^"']+)["']""")


def content_of(markup: Column, wanted) -> Column:
    """What follows the first tag whose head is ``wanted``, up to the next closing tag."""
    parts = F.split(markup, "<")
    begin = F.array_position(F.transform(parts, lambda x: x.rlike("^[a-zA-Z]") & x.contains(">") & F.coalesce(wanted(F.substring_index(x, ">", 1)), F.lit(False))), True)
    rest = F.slice(parts, F.greatest(begin, F.lit(1)).cast("int"), F.size(parts))
    end = F.array_position(F.transform(rest, lambda x: x.rlike("^/[a-zA-Z]+>")), True)
    inner = F.array_join(F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")), "<")
    return F.when((begin > 0) & (end > 0), F.regexp_replace(inner, "^[^>]*>", ""))


def _inner(markup: Column, name: str) -> Column:
    return F.get(elements(markup, name), F.lit(0))["inner"]


def _address(text: Column) -> Column:
    return F.when(text.rlike("(?i)^https?:"), text)


# Where feeds state a date and a description, by rank.
_FEED_DATES = ("pubDate", "published", "updated", "dc:date")
_FEED_TEXTS = ("description", "summary")


def feed_items(xml: Column) -> Column:
    """[(title, link, description, published_at)] of RSS items and Atom entries with a title or description."""

    def item(block: Column) -> Column:
        field = lambda name: F.trim(F.regexp_replace(_inner(block, name), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
        linked = F.transform(heads(block, "link"), lambda h: attribute(h, "href"))
        link = F.coalesce(_address(field("link")), F.get(F.filter(linked, lambda x: x.isNotNull()), F.lit(0)), _address(field("guid")), F.lit(""))
        plain = lambda *names: tx.html_to_text(F.coalesce(*map(field, names), F.lit("")))
        stated = stated_instant(F.coalesce(*map(field, _FEED_DATES)))
        return F.struct(plain("title").alias("title"), link.alias("link"), plain(*_FEED_TEXTS).alias("description"), stated.alias("published_at"))

    items = F.transform(_all(xml, r"(?is)<(item|entry)\b.*?</\1>", 0), item)
    return F.filter(items, lambda i: (i["title"] != "") | (i["description"] != ""))


def article_links(html: Column, base: Column, pattern: str) -> Column:
    """Distinct addresses on the page's own origin whose path matches; fragments are cut off."""
    origin, folder = F.regexp_extract(base, "^(https?://[^/]+)", 1), F.regexp_extract(base, "^(https?://[^/]+(?:/.*/|/)?)", 1)
    slash = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))

    def absolute(href: Column) -> Column:
        bare = F.regexp_replace(href, "#.*$", "")
        return (
            F.when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), bare))
            .when(bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), bare)
            .when(bare.startswith("/"), F.concat(origin, bare))
            .when(bare == "", base)
            .otherwise(F.concat(slash, bare))
        )

    urls = F.transform(_all(html, """(?i)href=["']([^"']+)["']"""), absolute)
    path = lambda u: F.regexp_replace(F.regexp_replace(u, "^https?://[^/]+", ""), r"\?.*$", "")
    return F.array_distinct(F.filter(urls, lambda u: (F.regexp_extract(u, "^(https?://[^/]+)", 1) == origin) & path(u).rlike(pattern)))


# Elements that are no content, names of the classes of summaries, characters that a paragraph
# or summary must exceed, and characters of a summary by which it is known in a body.
_CHROME = ("script", "style", "nav", "footer")
_SUMMARY_CLASSES = ("short_content", "spot", "ozet", "summary", "excerpt")
_LEAST_TEXT, _LEAD = 25, 40
# Where pages state their date, by rank.
_DATE_KEYS = ("article:published_time", "datepublished", "pubdate", "dc.date.issued", "datecreated", "date")


def without_chrome(html: Column) -> Column:
    return reduce(lambda text, name: F.regexp_replace(text, rf"(?is)<{name}.*?</{name}>", " "), _CHROME, html)


def _meta(html: Column, key: str, *named_by: str) -> Column:
    """The content of the first meta tag that is named ``key``."""
    wanted = F.filter(heads(html, "meta"), lambda h: (attribute(h, *named_by) == key) & attribute(h, "content").isNotNull())
    return attribute(F.get(wanted, F.lit(0)), "content")


def _line(markup: Column) -> Column:
    return tx.collapse_space(tx.html_to_text(F.coalesce(markup, F.lit(""))))


def _headline(html: Column, bare: Column) -> Column:
    shown = F.filter(F.transform(elements(bare, "h1"), lambda e: _line(e["inner"])), lambda x: x != "")
    declared = _line(F.coalesce(_meta(html, "og:title", "property", "name"), _inner(html, "title")))

    def chosen(h: Column) -> Column:
        agreeing = F.filter(h["shown"], lambda x: (h["declared"] != "") & (h["declared"].startswith(x) | x.startswith(h["declared"])))
        return F.coalesce(F.when(F.size(h["shown"]) > 1, F.get(agreeing, F.lit(0))), F.get(h["shown"], F.lit(0)), h["declared"])

    return tm.once(F.struct(shown.alias("shown"), declared.alias("declared")), chosen)


def headline(html: Column) -> Column:
    """The first h1; of several the one that agrees with the declared title; the declared title without any."""
    return tm.once(F.struct(html.alias("html"), without_chrome(html).alias("bare")), lambda x: _headline(x["html"], x["bare"]))


def _summary(html: Column, bare: Column) -> Column:
    stated = F.array(
        content_of(bare, lambda h: attribute(h, "itemprop") == "description"),
        content_of(bare, lambda h: attribute(h, "class").rlike("|".join(_SUMMARY_CLASSES))),
        F.coalesce(_meta(html, "og:description", "property"), _meta(html, "description", "name")),
    )
    plain = F.filter(F.transform(stated, tx.html_to_text), lambda t: F.char_length(t) > _LEAST_TEXT)
    return F.coalesce(F.get(plain, F.lit(0)), F.lit(""))


def summary(html: Column) -> Column:
    """The page's summary, or nothing: what is marked as its description, or by its class, or declared."""
    return tm.once(F.struct(html.alias("html"), without_chrome(html).alias("bare")), lambda x: _summary(x["html"], x["bare"]))


def article(html: Column) -> Column:
    """(title, body): the paragraphs, led by the summary unless one of them has it."""

    def parts(x: Column) -> Column:
        paragraphs = F.transform(elements(x["bare"], "p"), lambda e: tx.html_to_text(e["inner"]))
        paragraphs = F.filter(paragraphs, lambda p: F.char_length(p) > _LEAST_TEXT)
        return F.struct(_headline(x["html"], x["bare"]).alias("title"), paragraphs.alias("paragraphs"), _summary(x["html"], x["bare"]).alias("lead"))

    def whole(a: Column) -> Column:
        known = (a["lead"] == "") | F.exists(a["paragraphs"], lambda p: p.contains(F.substring(a["lead"], 1, _LEAD)))
        body = F.array_join(F.when(known, a["paragraphs"]).otherwise(F.array_prepend(a["paragraphs"], a["lead"])), "\n")
        return F.struct(a["title"].alias("title"), body.alias("body"))

    bare = F.struct(html.alias("html"), without_chrome(html).alias("bare"))
    return tm.once(tm.once(bare, parts), whole)


def article_date(html: Column) -> Column:
    """The first date of a page that can be read: its tags with a content by rank of their names, its
    structured data (with the rank of its name), its time tag."""
    stated = F.filter(heads(html), lambda h: attribute(h, "content").isNotNull())
    named = F.transform(stated, lambda h: F.struct(F.lower(F.trim(attribute(h, "property", "name", "itemprop"))).alias("key"), attribute(h, "content").alias("value")))
    linked = _first(html, r'(?i)"datePublished"\s*:\s*"([^"]+)"')
    timed = F.get(F.filter(F.transform(heads(html, "time"), lambda h: attribute(h, "datetime")), lambda x: x.isNotNull()), F.lit(0))

    def ranked(found: Column) -> Column:
        of_key = lambda key: F.get(F.filter(found["named"], lambda n: n["key"] == key), F.lit(0))["value"]
        return F.array(*[F.coalesce(of_key(k), found["linked"]) if k == "datepublished" else of_key(k) for k in _DATE_KEYS], found["timed"])

    candidates = tm.once(F.struct(named.alias("named"), linked.alias("linked"), timed.alias("timed")), ranked)
    return F.get(F.filter(F.transform(candidates, stated_instant), lambda t: t.isNotNull()), F.lit(0))


def robots_rules(text: Column) -> Column:
    """Paths that the group for all robots disallows."""
    line = lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))
    lines = F.filter(F.transform(F.split(text, "\n"), line), lambda x: x.contains(":"))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    start = F.struct(F.lit(False).alias("every"), F.array().cast("array<string>").alias("rules"))
    step = lambda s, f: F.when(f["k"] == "user-agent", F.struct((f["v"] == "*").alias("every"), s["rules"].alias("rules"))).otherwise(
        F.struct(s["every"].alias("every"), F.when(s["every"] & (f["k"] == "disallow") & (f["v"] != ""), F.array_append(s["rules"], f["v"])).otherwise(s["rules"]).alias("rules"))
    )
    return F.aggregate(fields, start, step)["rules"]


def is_allowed(path: Column, rules: Column) -> Column:
    """Whether no rule matches the start of a path; ``*`` stands for anything."""
    pattern = lambda r: F.concat(F.lit("^"), F.replace(F.regexp_replace(r, r"[.+^${}()|\[\]\\]", r"\\$0"), F.lit("*"), F.lit(".*")))
    return ~F.exists(rules, lambda r: F.regexp_like(path, pattern(r)))


def crawl_filter(articles: DataFrame, url_pattern: str, wanted, cap: int = 12) -> DataFrame:
    """Articles (outlet, url, html, lastmod, fetched_at) to keep: the address first, then the text; the newest
    ``cap`` of an outlet. published_at is the sitemap's date, else the page's, else the fetch."""
    named = articles.where(col("url").rlike(url_pattern)).withColumn("a", article(col("html"))).where(wanted(F.concat_ws(" ", "a.title", "a.body")))
    dated = named.withColumn("published_at", F.coalesce("lastmod", article_date(col("html")), "fetched_at"))
    order = Window.partitionBy("outlet").orderBy(col("published_at").desc(), "url")
    return dated.withColumn("k", F.row_number().over(order)).where(col("k") <= cap).select("outlet", "url", "a.title", "a.body", "published_at", "fetched_at")


def gazetteer_file(spark, path: str) -> DataFrame:
    """(name, district, aliases, ordinal) of a gazetteer file: one JSON object with a list ``places``. A district
    that is not known fails the read."""
    from gridlore.constants import DISTRICT_IDS

    schema = "places array<struct<name string, district string, aliases array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("places").alias("ordinal", "p")).select("p.*", "ordinal")
    known = col("district").isin(*DISTRICT_IDS)
    problem = F.concat(F.lit("unknown district "), F.coalesce("district", F.lit("(none)")), F.lit(" for "), "name")
    return rows.withColumn("district", F.when(known, col("district")).otherwise(F.raise_error(problem)))


def front_matter(text: Column) -> Column:
    """(fields, body) of a text that opens with ``key: value`` lines between two lines of ``---``."""
    parts = _first(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n")
    lines = F.filter(F.split(F.coalesce(parts, F.lit("")), "\r?\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    return F.struct(F.map_from_entries(F.transform(lines, entry)).alias("fields"), F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "").alias("body"))


