"""From extracted entries to records: places by name, schedules, scopes, one record a district."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import live, places
from gridlore.session import written

col = F.col
ENTRY = (
    "kind string, date string, weekday string, start string, end string, areas array<string>, scope string,"
    " cancelled boolean, ongoing boolean, continuation boolean, resolved boolean, restoredAt string"
)


class Extractor(Protocol):
    """Reads an announcement; its answer is JSON with a list ``outages``. Failures raise."""

    def __call__(self, title: str, body: str, published_day: str) -> str: ...


class Passing(Exception):
    """A failure of an extractor that may pass: too many requests, or a fault of the service."""


# Further requests after a failure that may pass, and seconds before the first of them, which the second
# doubles.
RETRIES, RETRY_SECONDS = 2, 1.5


def asked(extractor: Extractor, title: str, body: str, day: str, pause: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error) of one announcement. Failures that may pass, those of the network among them, are asked again;
    others fail the same way every time."""
    error = None
    for attempt in range(RETRIES + 1):
        if attempt:
            pause(RETRY_SECONDS * attempt)
        try:
            return extractor(title, body, day), None
        except (Passing, OSError) as e:
            error = str(e) or type(e).__name__
        except Exception as e:
            return None, str(e) or type(e).__name__
    return None, error


def extract(announcements: DataFrame, extractor: Extractor, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds ``payload`` and ``error``: what the extractor says, or why it could not. Keep the filters before
    this step; nothing is moved through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = zip(*(batch.column(c).to_pylist() for c in ("title", "body", "published_day")), strict=True)
            found = [asked(extractor, *x, pause) for x in asks]
            told = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "payload", "error"])

    day = F.date_format(tm.local(col("published_at")), "yyyy-MM-dd EEEE")
    asking = announcements.withColumn("published_day", day)
    return asking.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asking.schema) + ", payload string, error string")


def valid_entries(payload: Column) -> Column:
    """The usable entries of an answer; null where it is no answer at all."""
    listed = F.from_json(payload, f"outages array<struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>")["outages"]
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    names = lambda e: F.filter(e["areas"], lambda a: F.char_length(F.trim(a)) > 1)
    good = lambda e: (
        e["kind"].isin("planned", "fault", "rotating")
        & tm.valid_date(e["date"])
        & (e["weekday"].isNull() | e["weekday"].isin(*days))
        & (e["start"].isNull() | tm.valid_clock(e["start"]))
        & (e["end"].isNull() | tm.valid_clock(e["end"]))
        & (F.size(names(e)) > 0)
    )
    flag = lambda e, name: F.coalesce(e[name], F.lit(False)).alias(name)
    clean = lambda e: F.struct(
        e["kind"].alias("kind"), e["date"].alias("date"), e["weekday"].alias("weekday"), e["start"].alias("start"), e["end"].alias("end"), names(e).alias("areas"),
        F.when(e["scope"] == "district", "district").otherwise("places").alias("scope"), flag(e, "cancelled"), flag(e, "ongoing"), flag(e, "continuation"), flag(e, "resolved"),
        F.when(tm.valid_clock(e["restoredAt"]), e["restoredAt"]).alias("restoredAt"),
    )
    return F.transform(F.filter(listed, lambda e: e.isNotNull() & F.coalesce(good(e), F.lit(False))), clean)


# --- place names in free text --------------------------------------------------------------------------

MATCH = "array<struct<name:string,district:string,fuzzy:boolean,words:string>>"


class Gazetteer:
    """Place names of any number, as tables that texts are joined with: ``keys`` (key, name, district) for exact
    names, ``spellings`` (key, ordinal, name, district) for near ones. No task carries them."""

    def __init__(self, keys: DataFrame, spellings: DataFrame, most_words: int):
        self.keys, self.spellings, self.most_words = keys, spellings, most_words

    @classmethod
    def of(cls, place_rows: DataFrame) -> Gazetteer:
        """From (name, district, aliases, ordinal). Of near spellings that are as near, the first in the order of
        ``ordinal`` wins."""
        spelled = place_rows.select("name", "district", "ordinal", F.posexplode(F.concat(F.array("name"), "aliases")).alias("k", "s"))
        spellings = spelled.select(tx.fold_key(col("s")).alias("key"), F.struct("ordinal", "k").alias("ordinal"), "name", "district").where("key <> ''")
        words = F.size(F.filter(F.split("name", tx.SPACE), lambda w: w != ""))
        return cls(places.gazetteer(place_rows), spellings, place_rows.agg(F.max(words)).first()[0] or 0)

    def match(self, texts: DataFrame) -> DataFrame:
        """(text_id, found) of different texts (column ``text``) that name a place: from each capital the longest known
        run of words, else a word that is nearly a spelling; each place once, in the order of the text.

        ``text_id`` is the text's SHA-256: texts are not carried along. Runs of words meet the names on their keys, and
        words that are no name meet near spellings on segments, each different word once, so the cost of a text does
        not grow with the gazetteer. Null texts and texts without a capital have no row.
        """
        most = F.lit(max(self.most_words, 1))
        cut = texts.where("text is not null").select(F.sha2("text", 256).alias("text_id"), tx.tokens(col("text")).alias("w"))
        # A word of letters and digits folds to one word, so that a text is folded once and not run by run.
        cut = cut.withColumn("f", F.split(tx.fold_key(F.array_join("w", " ")), " "))
        starts = F.filter(F.transform("w", lambda x, i: F.when(tx.proper(x), i)), lambda i: i.isNotNull())
        joined = lambda words, at, n: F.array_join(F.slice(words, at + 1, n), " ")
        run = lambda at, n: F.struct(at.alias("at"), n.alias("n"), joined("w", at, n).alias("words"), joined("f", at, n).alias("key"))
        runs = F.flatten(F.transform(starts, lambda at: F.transform(F.sequence(F.lit(1), F.least(most, F.size("w") - at)), lambda n: run(at, n))))
        runs = written(cut.select("text_id", F.inline(runs)), "runs")  # read three times
        said = runs.groupBy("key").agg((F.min("n") == 1).alias("one"))
        exact = said.join(self.keys, "key").select("key", "name", "district", F.lit(False).alias("fuzzy"))
        unknown = said.where("one").join(self.keys, "key", "left_anti").select(col("key").alias("word"))
        near = places.fuzzy(unknown, self.spellings).select(col("word").alias("key"), "name", "district", F.lit(True).alias("fuzzy"))
        hits = runs.join(exact.union(near), "key").where(~col("fuzzy") | (col("n") == 1))
        hit = F.struct("at", (-col("n")).alias("less"), "name", "district", "fuzzy", "words")
        return hits.groupBy("text_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")).select("text_id", _read(col("hits")).alias("found"))

    def match_areas(self, rows: DataFrame, areas: Column, name: str = "m") -> DataFrame:
        """``rows`` with a column of the places of a list of names. A name that is none is read together with its
        neighbour, the left one first, where the two say more than the neighbour alone.

        Equal lists and equal names are matched and read once; what lists name is written, so that the rows stay where they
        are where it is small. ``rows`` are read twice, so what is not stored and is dear, or may
        change, is to be written first. Null and empty lists, and null names, have no places.
        """
        listed = rows.withColumn("__areas", F.coalesce(areas, F.array().cast("array<string>")))
        listed = listed.withColumn("__list", F.when(F.size("__areas") > 0, F.sha2(F.to_json("__areas"), 256)))
        each = listed.where("__list is not null").select("__list", "__areas").dropDuplicates(["__list"])
        alone_and_both = F.transform("__areas", lambda x, i: F.array(x, F.concat(x, F.lit(" "), F.get("__areas", i + 1))))
        said = each.select("__list", F.size("__areas").alias("n"), F.posexplode(F.flatten(alone_and_both)).alias("at", "text")).where("text is not null")
        found = self.match(said.select("text").distinct())
        hits = said.select("__list", "n", "at", F.sha2("text", 256).alias("text_id")).join(found, "text_id")
        by_list = hits.groupBy("__list").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "found"))).alias("found"))
        by_list = written(by_list.select("__list", _joined(col("n"), col("found")).alias("__places")), "lists")
        return listed.join(by_list, "__list", "left").withColumn(name, F.coalesce("__places", F.array().cast(MATCH))).drop("__list", "__areas", "__places")


def _distinct_names(found: Column) -> Column:
    """The first of each name."""
    return F.aggregate(found, F.array().cast(MATCH), lambda kept, m: F.when(F.exists(kept, lambda k: k["name"] == m["name"]), kept).otherwise(F.array_append(kept, m)))


def _read(hits: Column) -> Column:
    """Hits in order of place, the longest first, read from the left: what a run takes is not read again."""
    match = lambda h: F.struct(h["name"].alias("name"), h["district"].alias("district"), h["fuzzy"].alias("fuzzy"), h["words"].alias("words"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast(MATCH).alias("took"))
    take = lambda s, h: F.struct((h["at"] - h["less"]).alias("next"), F.array_append(s["took"], match(h)).alias("took"))
    return F.aggregate(hits, start, lambda s, h: F.when(h["at"] < s["next"], s).otherwise(take(s, h)), lambda s: _distinct_names(s["took"]))


def _joined(n: Column, found: Column) -> Column:
    """Places of a list of n names from those of each (at 2i) and of each with the next (at 2i + 1)."""
    none = F.array().cast(MATCH)
    get = lambda k: F.coalesce(found[k], none)
    alone, both = lambda i: get(2 * i), lambda i: get(2 * i + 1)
    names = lambda ms: F.transform(ms, lambda m: m["name"])
    adds = lambda pair, neighbour: F.size(F.array_except(names(pair), names(neighbour))) > 0
    side = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(F.size(alone(i)) > 0, "").when((i > 0) & adds(both(i - 1), alone(i - 1)), "left").when((i < n - 1) & adds(both(i), alone(i + 1)), "right").otherwise(""),
    )

    def of(i: Column, own: Column) -> Column:
        before, after = F.coalesce(F.get(side, i - 1), F.lit("")), F.coalesce(F.get(side, i + 1), F.lit(""))
        return F.when(after == "left", none).when(own == "left", both(i - 1)).when(own == "right", both(i)).when(before == "right", none).otherwise(alone(i))

    return _distinct_names(F.flatten(F.transform(side, lambda own, i: of(i, own))))


def entries(announcements: DataFrame) -> DataFrame:
    """One row an entry of each answer (e, numbered by ``entry``); one without an entry where there is none. ``unreadable``
    where it is no answer. announcements: url, source (name, url, kind), published_at, fetched_at, payload, and ``error``
    where there is one."""
    error = col("error") if "error" in announcements.columns else F.lit(None).cast("string")
    read = announcements.select("url", "source", "published_at", "fetched_at", error.alias("error"), valid_entries(col("payload")).alias("__e"))
    return read.select("url", "source", "published_at", "fetched_at", "error", col("__e").isNull().alias("unreadable"), F.posexplode_outer("__e").alias("entry", "e"))


def matched(read: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """``entries`` with the places that they name (m) and their times (s). They are read twice, so that those of many
    announcements are to be stored first."""
    return gazetteer.match_areas(read, col("e.areas")).withColumn("s", F.when(col("e").isNotNull(), tm.schedule(col("e"), col("published_at"))))


def resolve_announcements(announcements: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """One row a district of each entry: role (record, retraction, resolution) and the record's fields.

    announcements: url, source (name, url, kind), title, body, published_at, fetched_at, payload. Entries
    without a usable time or without a known place give no row; ``outcomes`` counts them. Announcements are read
    twice: an extractor's answers are to be stored first.
    """
    return records_of(matched(entries(announcements), gazetteer))


def records_of(matched: DataFrame) -> DataFrame:
    """``resolve_announcements`` of ``matched`` entries."""
    usable = matched.where(col("e").isNotNull() & (F.size("m") > 0) & (col("e.resolved") | col("s").isNotNull()))
    parts = usable.withColumn("district", F.explode(F.array_distinct(F.transform("m", lambda m: m["district"]))))
    areas = F.transform(F.filter("m", lambda m: m["district"] == col("district")), lambda m: m["name"])
    parts = parts.withColumn("areas", areas).withColumn("area_keys", live.area_keys(col("areas")))
    own = tx.fold_key(F.element_at(live.district_names(), col("district")))
    wide = (col("e.scope") == "district") & F.array_contains("area_keys", own)
    return parts.select(
        "url", "entry",
        F.when(col("e.resolved"), "resolution").when(col("e.cancelled"), "retraction").otherwise("record").alias("role"),
        F.when(~col("e.resolved"), fingerprint(col("s.starts_at"), col("s.ends_at"), col("area_keys"))).alias("id"),
        col("e.kind").alias("kind"), col("s.starts_at").alias("starts_at"), col("s.ends_at").alias("ends_at"), "district", "areas", "area_keys",
        F.when(wide, "district").otherwise("places").alias("scope"), F.array("source").alias("sources"), "published_at", col("fetched_at").alias("ingested_at"),
        F.when(col("s.inferred"), "low").otherwise("high").alias("confidence"), col("e.continuation").alias("continuation"),
        F.when(col("e.resolved"), tm.restored_at(col("e.restoredAt"), col("published_at"))).alias("resolved_at"),
        F.exists("m", lambda m: m["fuzzy"]).alias("fuzzy"),
    )


def fingerprint(starts_at: Column, ends_at: Column, area_keys: Column) -> Column:
    end = F.coalesce(tm.iso_utc(ends_at, True), F.lit("open"))
    return tx.sha256_prefix(F.concat_ws("|", tm.iso_utc(starts_at, True), end, F.array_join(area_keys, ",")))


def outcomes(announcements: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """(url, status, reason): parsed, skipped or failed, and why."""
    return outcomes_of(matched(entries(announcements), gazetteer))


def outcomes_of(told: DataFrame) -> DataFrame:
    """``outcomes`` of ``matched`` entries."""
    untimed = col("e").isNotNull() & ~col("e.resolved") & col("s").isNull()
    unplaced = col("e").isNotNull() & ~untimed & (F.size("m") == 0)
    by_url = told.groupBy("url").agg(
        F.max("error").alias("error"), F.bool_or("unreadable").alias("unreadable"), F.count("e").alias("n"),
        F.count(F.when(untimed, 1)).alias("no_time"), F.count(F.when(unplaced, 1)).alias("no_place"),
    )
    return by_url.select("url", *outcome(col("error"), col("unreadable"), col("n"), col("no_time"), col("no_place")))


def outcome(error: Column, unreadable: Column, n: Column, no_time: Column, no_place: Column) -> list[Column]:
    reason = (
        F.when((no_place > 0) & (no_time > 0), "no usable time, and no known place names")
        .when(no_time > 0, "no usable time in the announcement")
        .when(no_place > 0, "no known place names found")
        .otherwise("nothing usable in the extraction")
    )
    failed, empty, all_lost = error.isNotNull() | unreadable, n == 0, no_time + no_place == n
    return [
        F.when(failed, "failed").when(empty, "skipped").when(all_lost, "failed").otherwise("parsed").alias("status"),
        F.when(failed, F.coalesce(error, F.lit("unreadable answer"))).when(empty, "no outage in this article").when(all_lost, reason).alias("reason"),
    ]
