"""Calendar, news feed, sitemap and structured data of stored interruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import live

col = F.col
# Words of the feeds.
KIND = {"planned": "Planlı kesinti", "fault": "Arıza", "rotating": "Dönüşümlü kesinti"}
DISTRICT_WIDE, CANCELLED, END_UNKNOWN = "İlçe geneli", "İptal", "bitiş bilinmiyor"


def _kind() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair]), col("kind"))


def _areas() -> Column:
    return F.when(col("scope") == "district", DISTRICT_WIDE).otherwise(F.array_join("areas", ", "))


def _name() -> Column:
    return F.element_at(live.district_names(), col("district"))


def page_url(site: str) -> Column:
    return F.when(live.addressable(), F.concat(F.lit(f"{site}/outage/"), live.slug()))


def fold_octets(line: str) -> str:
    """A calendar line in parts of at most 75 octets, continued by a blank; no character is split."""
    parts, part, size, limit = [], [], 0, 75
    for letter in line:
        n = len(letter.encode())
        if size + n > limit:
            parts.append("".join(part))
            part, size, limit = [], 0, 74
        part.append(letter)
        size += n
    return "\r\n ".join([*parts, "".join(part)])


# On a line read as one character a byte: a part that more bytes follow than fit, up to the last byte that begins a character.
_PART = r"(?s)(\A(?=.{76}).{72,75}|(?!\A)\G(?=.{75}).{71,74})(?=[^\x80-\xBF])"


def folded(line: Column) -> Column:
    """``fold_octets`` as an expression; lines of up to 75 octets stay as they are."""
    octets = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    parts = F.regexp_replace(octets, _PART, "$1\r\n ")
    return F.when(F.octet_length(line) > 75, F.decode(F.encode(parts, "ISO-8859-1"), "UTF-8")).otherwise(line)


def calendar_events(outages: DataFrame, site: str, host: str) -> DataFrame:
    """(district, starts_at, id, event): the lines of an event for each record with a place in a calendar."""
    summary = F.concat(_kind(), F.lit(" · "), _name(), F.lit(" — "), _areas())
    source = col("sources")[0]
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), "id", F.lit(f"@{host}")),
        F.concat(F.lit("DTSTAMP:"), tm.ics_stamp(col("ingested_at"))),
        F.concat(F.lit("DTSTART:"), tm.ics_stamp(col("starts_at"))),
        F.concat(F.lit("DTEND:"), tm.ics_stamp(col("ends_at"))),
        F.concat(F.lit("SUMMARY:"), tx.ics_escape(summary)),
        F.concat(F.lit("DESCRIPTION:"), tx.ics_escape(F.concat(source["name"], F.lit(": "), source["url"]))),
        F.concat(F.lit("URL:"), page_url(site)),
        F.lit("END:VEVENT"),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return outages.where(live.in_calendar()).select("district", "starts_at", "id", kept.alias("event"))


def write_calendars(outages: DataFrame, path: str, site: str, host: str, parts: int | None = None) -> None:
    """A calendar for each district under ``path/district=..``: its files in the order of their names are the calendar,
    line by line. Records go through in order of start and id, however many a district has; nothing is gathered.

    ``parts`` fixes the number of ranges; else their size does. A district without records has no calendar. ``path`` is
    replaced.
    """
    events = calendar_events(outages, site, host)
    text = F.array_join(F.transform("event", folded), "\r\n")
    head = F.array_join(F.array(F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), folded(F.concat(F.lit("X-WR-CALNAME:"), tx.ics_escape(_name()))), F.lit("X-WR-TIMEZONE:Asia/Nicosia")), "\r\n")
    frames = events.select("district").distinct().select("district", F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(2)), F.array(head, F.lit("END:VCALENDAR")))).alias("place", "value"))
    nothing = [F.lit(None).cast("timestamp").alias("starts_at"), F.lit(None).cast("string").alias("id")]
    order = ["district", "place", "starts_at", "id"]
    lines = events.select("district", F.lit(1).alias("place"), "starts_at", "id", text.alias("value")).union(frames.select("district", "place", *nothing, "value"))
    ranged = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("district", "value").write.mode("overwrite").partitionBy("district").option("lineSep", "\r\n").text(path)


def calendar_lines(spark, path: str) -> DataFrame:
    """(district, line) of written calendars."""
    read = spark.read.schema("value string, district string").option("lineSep", "\r\n").text(path)
    return read.select("district", col("value").alias("line"))


def rss_items(outages: DataFrame, site: str) -> DataFrame:
    """(district, published_at, id, item): an item for each record; cancelled ones say so."""
    url = F.coalesce(page_url(site), F.concat(F.lit(f"{site}/district/"), "district"))
    title = F.concat(F.when(col("cancelled_at").isNotNull(), f"{CANCELLED}: ").otherwise(""), _name(), F.lit(" "), tm.long_date(col("starts_at"), "tr"))
    text = F.concat_ws(" · ", _kind(), tm.time_range(col("starts_at"), col("ends_at"), "tr", END_UNKNOWN), _areas(), col("sources")[0]["name"])
    item = F.concat(
        F.lit("<item><title>"), tx.xml_escape(title), F.lit("</title><link>"), tx.xml_escape(url), F.lit('</link><guid isPermaLink="true">'), tx.xml_escape(url),
        F.lit("</guid><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate><description>"), tx.xml_escape(text), F.lit("</description></item>"),
    )
    return outages.select("district", "published_at", "starts_at", "id", item.alias("item"))


def news_feeds(outages: DataFrame, site: str, limit: int = 30) -> DataFrame:
    """(district, rss): the newest records of each district."""
    from pyspark.sql import Window

    order = Window.partitionBy("district").orderBy(col("starts_at").desc(), "id")
    newest = rss_items(outages, site).withColumn("k", F.row_number().over(order)).where(col("k") <= limit)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n<channel>\n<title>'
    text = F.concat(F.lit(head), tx.xml_escape(_name()), F.lit("</title>\n<language>tr</language>\n"), col("items"), F.lit("\n</channel>\n</rss>\n"))
    return newest.groupBy("district").agg(items.alias("items")).select("district", text.alias("rss"))


def sitemap_rows(outages: DataFrame, places: DataFrame, site: str, since: Column) -> DataFrame:
    """(url, lastmod) of all pages in both languages: fixed ones, districts, places and records since ``since``."""
    spark, none = outages.sparkSession, F.lit(None).cast("timestamp")
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("", "/archive", "/about")))).alias("path"), none.alias("lastmod"))
    shown = outages.where((col("starts_at") >= since) & live.not_bad_data() & live.addressable())
    pages = (
        fixed.union(shown.groupBy("district").agg(F.max("ingested_at").alias("lastmod")).select(F.concat(F.lit("/district/"), "district"), "lastmod"))
        .union(places.select(F.concat(F.lit("/place/"), tx.hyphens(col("name"))), none))
        .union(shown.select(F.concat(F.lit("/outage/"), live.slug()), "ingested_at"))
    )
    return pages.select(F.explode(F.array(F.concat(F.lit(site), "path"), F.concat(F.lit(f"{site}/en"), "path"))).alias("url"), "lastmod")


def announcements_json(outages: DataFrame, site: str) -> DataFrame:
    """(id, json): each record as a special announcement; what is unknown is left out."""
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("SpecialAnnouncement").alias("@type"), F.concat_ws(" ", _name(), _kind()).alias("name"),
        tm.iso_utc(col("published_at")).alias("datePosted"), tm.iso_utc(col("ends_at")).alias("expires"), page_url(site).alias("url"),
    )
    return outages.select("id", F.to_json(body).alias("json"))


def breadcrumbs_json(outages: DataFrame, site: str) -> DataFrame:
    """(id, json): home, district, record."""
    step = lambda k, name, url: F.struct(F.lit("ListItem").alias("@type"), F.lit(k).alias("position"), name.alias("name"), url.alias("item"))
    steps = F.array(step(1, F.lit("home"), F.lit(f"{site}/")), step(2, _name(), F.concat(F.lit(f"{site}/district/"), "district")), step(3, _areas(), page_url(site)))
    return outages.select("id", F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), steps.alias("itemListElement"))).alias("json"))
