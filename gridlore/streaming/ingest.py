"""The ingest run as a stream: announcements in, stored tables out, batch after batch.

A batch reads the versions that were there before it and writes its own, so a repeated batch gives the
same tables. Steps keep their order: store, retract, resolve, queue, mark read, log.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore import constants as C
from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import live, resolve, store
from gridlore.session import written
from gridlore.streaming.snapshots import Snapshots

col = F.col
log = logging.getLogger(__name__)
_SOURCE = "struct<name:string,url:string,kind:string>"
ANNOUNCEMENT = f"url string, source {_SOURCE}, title string, body string, published_at timestamp, fetched_at timestamp"
OUTAGES = (
    "id string, kind string, starts_at timestamp, ends_at timestamp, district string, areas array<string>, area_keys array<string>, scope string,"
    f" sources array<{_SOURCE}>, published_at timestamp, ingested_at timestamp, confidence string, cancelled_at timestamp, cancelled_reason string, updated_at timestamp"
)
QUEUE = "fingerprint string, source_url string, raw_text string, reason string, created_at timestamp"
SEEN = "url string, content_hash string, attempts int, parsed_ok boolean, first_seen timestamp, last_seen timestamp"
RUNS = "batch bigint, started_at timestamp, ok boolean, read bigint, created bigint, updated bigint, queued bigint, sources array<string>, failed array<string>"


def _day(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


#: What a batch writes for itself; gone when it has come to its end.
_OWN = ("read", "entries", "matched", "parsed", "outcomes", "written", "upserted", "retracted", "after")
#: Parts of the stored records that a batch writes at most: where it changes more days, a part holds 2, 4, 8 .. days.
PARTS = 128


def _days_of(part: str) -> tuple[int, int]:
    """(length, index) of a part: a day by its date, or ``x<length>-<index>``, in days since 1970."""
    if part.startswith("x"):
        length, _, index = part[1:].partition("-")
        return int(length), int(index)
    return 1, (date.fromisoformat(part) - date(1970, 1, 1)).days


def _part(at: str, length: int) -> Column:
    """The part of a row whose parts hold ``length`` days."""
    return _day(at) if length == 1 else F.concat(F.lit(f"x{length}-"), F.floor(F.unix_date(F.to_date(at)) / length).cast("string"))


def _reach(parsed: DataFrame, parts: Iterable[str]) -> set[str]:
    """Those of ``parts`` with days of stored records that the records, retractions and repairs of a batch can mean."""
    low, high = F.min(F.least("starts_at", "resolved_at")), F.max(F.greatest("starts_at", "resolved_at"))
    day = lambda at: F.unix_date(F.to_date(at))
    found = parsed.agg(day(low - tm.minutes(C.RESOLUTION_WINDOW)).alias("low"), day(high + tm.minutes(C.CANDIDATE_WINDOW)).alias("high")).first()
    if found["low"] is None:
        return set()
    return {p for p in parts for n, k in [_days_of(p)] if k * n <= found["high"] and found["low"] < (k + 1) * n}


def _store(parsed: DataFrame, version: int, tables: Snapshots, now: Column) -> tuple[DataFrame, Observation]:
    """Store, retract and resolve: reads the days that the batch can mean, rewrites those that it changes."""
    parts = set(tables.manifest("outages", version))
    met = _reach(parsed, parts)
    stored = tables.read("outages", OUTAGES, version, met)
    records = parsed.where("role = 'record'").dropDuplicates(["id", "url"])
    counts = Observation()
    merged = store.identity.store(records, live.candidates(stored, records).withColumn("continuation", F.lit(False)))
    merged = merged.observe(counts, F.count(F.when(col("created"), 1)).alias("created"), F.count(F.when(~col("created"), 1)).alias("updated"))
    written = tables.put("written", version, merged)
    rows = written.withColumn("area_keys", live.area_keys(col("areas")))
    columns = StructType.fromDDL(OUTAGES).names
    facts = [c for c in columns if c not in ("cancelled_at", "cancelled_reason", "updated_at")]
    # Each step reads the table several times, so it is written before the next one.
    after = tables.put("upserted", version, store.upsert(stored, rows.select(*facts), now))
    after = store.retract(after.withColumn("continuation", F.lit(False)), parsed.where("role = 'retraction'"), now)
    after = tables.put("retracted", version, after)
    # Repairs count in the order in which they were announced, however the batch is stored.
    closing = parsed.where("role = 'resolution'").select("district", "area_keys", "resolved_at", F.struct("published_at", "url", "entry").alias("ordinal"))
    after = tables.put("after", version, store.resolve(after, closing).select(*columns))
    # A record changes the day where it is and, where its start moves, the day where it was.
    image = lambda df, name: df.select("id", F.struct(F.unix_date(F.to_date("starts_at")).alias("day"), F.xxhash64(*columns).alias("hash")).alias(name))
    both = image(stored, "was").join(image(after, "now"), "id", "full_outer").where(~col("was").eqNullSafe(col("now")))
    days = [r["day"] for r in both.select(F.explode(F.array("was.day", "now.day")).alias("day")).where("day is not null").distinct().collect()]
    # Parts are as long as the longest there is, and longer where the batch would write too many.
    length = max([n for n, _ in map(_days_of, parts)], default=1)
    while len({d // length for d in days}) > PARTS:
        length *= 2
    name = lambda k: (date(1970, 1, 1) + timedelta(days=k)).isoformat() if length == 1 else f"x{length}-{k}"
    touched = {d // length for d in days}
    # Shorter parts become part of the one that takes their place; what the batch has not met is as it was.
    gone = {p for p in parts for n, k in [_days_of(p)] if n < length and k * n // length in touched}
    if unmet := gone - met:
        after = after.unionByName(tables.read("outages", OUTAGES, version, unmet))
    touched = [name(k) for k in touched]
    tables.replace("outages", version, after.where(_part("starts_at", length).isin(touched)), _part("starts_at", length), touched, gone)
    return written, counts


def run_batch(
    batch: DataFrame, version: int, tables: Snapshots, extractor, gazetteer: resolve.Gazetteer, now=None, sources: Sequence[str] | None = None, failed_sources: Sequence[str] = ()
) -> None:
    """One run over a batch of announcements. The run is logged even where it fails; it is a success where
    its records are stored and, with ``sources`` given, at least one of them was read.

    What it writes grows with the batch: records by the days of their start and seen addresses by the day when they
    were first seen, of which those are rewritten that the batch changes; the queue and the log are appended to.
    Counts are observed as the rows are written."""
    spark = batch.sparkSession
    now = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    started = spark.range(1).select(now.alias("n")).first()["n"]
    now, counts, ok = F.lit(started), {}, False
    try:
        seen = tables.read("seen", SEEN, version)
        last = batch.groupBy("url").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "url"]), "fetched_at").alias("r")).select("url", "r.*")
        # What later steps read more than once is written: answers are paid for, and merging is the longest step.
        read_count, queue_count = Observation(), Observation()
        unread = resolve.extract(store.unread(last, seen), extractor).observe(read_count, F.count(F.lit(1)).alias("read"))
        read = tables.put("read", version, unread)
        # Answers are read and places found once, for records and outcomes alike.
        matched = tables.put("matched", version, resolve.matched(tables.put("entries", version, resolve.entries(read)), gazetteer))
        parsed = tables.put("parsed", version, resolve.records_of(matched))
        outcomes = tables.put("outcomes", version, resolve.outcomes_of(matched))
        _, store_count = _store(parsed, version, tables, now)
        failed = outcomes.where("status = 'failed'").join(read, "url")
        text = tx.collapse_space(F.concat_ws(". ", "title", "body"))
        new = store.enqueue(tables.read("queue", QUEUE, version), failed.select(col("url").alias("source_url"), text.alias("raw_text"), "reason"), now)
        tables.append("queue", version, new.observe(queue_count, F.count(F.lit(1)).alias("queued")), _day("created_at"))
        marked = read.join(outcomes, "url").select("url", "content_hash", (col("status") != "failed").alias("ok"), F.lit(0).alias("ordinal"))
        again = store.mark_read(seen, marked, now)
        days = [r["day"] for r in again.join(marked.select("url"), "url", "left_semi").select(_day("first_seen").alias("day")).distinct().collect()]
        tables.replace("seen", version, again.where(_day("first_seen").isin(days)), _day("first_seen"), days)
        counts = {k: v for o in (read_count, store_count, queue_count) for k, v in o.get.items()}
        ok = sources is None or len(sources) > 0
    finally:
        row = [(version, started, ok, *(counts.get(k, 0) for k in ("read", "created", "updated", "queued")), list(sources or ()), list(failed_sources))]
        tables.append("runs", version, spark.createDataFrame(row, RUNS), F.lit("all"))
        for table in _OWN:
            tables.drop(table)


def run_sources(sources: Mapping[str, Callable[[], DataFrame]], version: int, tables: Snapshots, extractor, gazetteer: resolve.Gazetteer, now=None) -> None:
    """One run over named sources of announcements. Each is read and written by itself before anything else
    is done, so that one which fails is logged by its name and stops no other."""
    read, failed = [], []
    for name, fetch in sources.items():
        try:
            tables.write(f"fetched-{name}", version, fetch())
            read.append(name)
        except Exception as why:  # whatever a source does, the rest goes on; the run's row names it
            log.warning("source %s failed: %s", name, why)
            failed.append(name)
    fetched = [tables.read(f"fetched-{name}", ANNOUNCEMENT, version + 1) for name in read]
    batch = reduce(DataFrame.unionByName, fetched) if fetched else tables.spark.createDataFrame([], ANNOUNCEMENT)
    run_batch(batch, version, tables, extractor, gazetteer, now, read, failed)
    for name in read:
        tables.drop(f"fetched-{name}")


def follow(announcements: DataFrame, tables: Snapshots, extractor, gazetteer: resolve.Gazetteer, checkpoint: str, once: bool = True, now=None):
    """Runs over a stream of announcements; ``once`` takes what is there and stops."""
    writer = announcements.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: run_batch(batch, k + 1, tables, extractor, gazetteer, now))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()


def start(spark: SparkSession, source: str, tables: Snapshots, extractor, gazetteer: resolve.Gazetteer, checkpoint: str, once: bool = True, now=None):
    """Stream JSON announcements from a folder."""
    return follow(spark.readStream.schema(ANNOUNCEMENT).json(source), tables, extractor, gazetteer, checkpoint, once, now)


def backfill(spark: SparkSession, archive: DataFrame, extractor, gazetteer: resolve.Gazetteer) -> DataFrame:
    """Records of an archive of announcements, one an event, without state and without a run row. Each is extracted once,
    by as many tasks as there are, however few files hold the archive; places and times are found once."""
    hashed = archive.repartition("url").withColumn("content_hash", tx.article_hash(col("title"), col("body")))
    read = written(resolve.entries(resolve.extract(hashed, extractor)), "entries")
    matched = written(resolve.matched(read, gazetteer), "matched")
    return store.identity.dedupe(written(resolve.records_of(matched).where("role = 'record'"), "parsed"))
