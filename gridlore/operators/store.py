"""Writing to the stored tables: every function returns the table as it is after the write, or the rows to
append. Snapshots are new versions; nothing is read and overwritten in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.functions import text as tx
from gridlore.functions import time as tm
from gridlore.operators import identity, live

col = F.col
_KEPT = ("cancelled_at", "cancelled_reason")


def upsert(stored: DataFrame, incoming: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """``stored`` with ``incoming`` in place of rows of the same key. Cancellations stay as stored, and
    ``updated_at`` moves where a value changes."""
    facts = [c for c in stored.columns if c not in (key, "updated_at", *_KEPT)]
    both = stored.alias("s").join(incoming.alias("i"), key, "full_outer")
    new = col("i." + facts[0]).isNotNull() | col("i." + facts[-1]).isNotNull()
    old = col("s." + facts[0]).isNotNull() | col("s." + facts[-1]).isNotNull()
    changed = ~F.coalesce(F.forall(F.array(*[col(f"s.{c}").eqNullSafe(col(f"i.{c}")) for c in facts]), lambda x: x), F.lit(False))
    values = [F.when(new, col(f"i.{c}")).otherwise(col(f"s.{c}")).alias(c) for c in facts]
    kept = [col(f"s.{c}").alias(c) for c in _KEPT if c in stored.columns]
    stamp = F.when(new & (~old | changed), now).otherwise(col("s.updated_at")).alias("updated_at")
    return both.select(key, *values, *kept, stamp)


def enqueue(queue: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the review queue: (source_url, raw_text, reason) whose fingerprint is new."""
    printed = items.withColumn("fingerprint", tx.review_fingerprint(col("source_url"), F.substring("raw_text", 1, C.RAW_TEXT_CAP)))
    fresh = printed.join(queue.select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint")
    first = F.min(F.struct("source_url", F.substring("raw_text", 1, C.RAW_TEXT_CAP).alias("raw_text"), "reason")).alias("r")
    return fresh.agg(first).select("fingerprint", "r.*", now.alias("created_at"))


def drop_older_duplicates(queue: DataFrame) -> DataFrame:
    """The row of the lowest id of each fingerprint."""
    order = Window.partitionBy("fingerprint").orderBy("id")
    return queue.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def unread(announcements: DataFrame, seen: DataFrame) -> DataFrame:
    """Announcements to read: unknown addresses, changed texts, and failures with attempts left."""
    hashed = announcements.withColumn("content_hash", tx.article_hash(col("title"), col("body")))
    state = seen.select("url", col("content_hash").alias("__hash"), "attempts", "parsed_ok")
    again = col("__hash").isNull() | (col("__hash") != col("content_hash")) | (~col("parsed_ok") & (col("attempts") < C.MAX_PARSE_ATTEMPTS))
    return hashed.join(state, "url", "left").where(again).drop("__hash", "attempts", "parsed_ok")


def mark_read(seen: DataFrame, read: DataFrame, now: Column) -> DataFrame:
    """Seen state after a run. read: url, content_hash, ok, ordinal; the last row of an address counts.
    A changed text starts its attempts anew."""
    last = read.groupBy("url").agg(F.max_by(F.struct("content_hash", "ok"), "ordinal").alias("r"))
    both = seen.join(last, "url", "full_outer")
    new, same = col("r").isNotNull(), col("content_hash").eqNullSafe(col("r.content_hash"))
    attempts = F.when(new, F.when(same, col("attempts")).otherwise(0) + 1).otherwise(col("attempts"))
    return both.select(
        "url",
        F.coalesce("r.content_hash", "content_hash").alias("content_hash"),
        attempts.cast("int").alias("attempts"),
        F.when(new, col("r.ok")).otherwise(col("parsed_ok")).alias("parsed_ok"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(new, now).otherwise(col("last_seen")).alias("last_seen"),
    )


def retract(stored: DataFrame, retractions: DataFrame, now: Column) -> DataFrame:
    """``stored`` with all rows cancelled that a retraction means, by id or as the same event. Rows cancelled
    before stay as they are."""
    hit = retracted_ids(stored, retractions).withColumn("__hit", F.lit(True))
    marked = stored.join(hit, "id", "left").withColumn("__hit", col("__hit").isNotNull() & col("cancelled_at").isNull())
    return (
        marked.withColumn("cancelled_at", F.when(col("__hit"), now).otherwise(col("cancelled_at")))
        .withColumn("cancelled_reason", F.when(col("__hit"), "retracted").otherwise(col("cancelled_reason")))
        .drop("__hit")
    )


def retracted_ids(stored: DataFrame, retractions: DataFrame) -> DataFrame:
    """Ids that retractions mean, those of cancelled rows included."""
    by_id = stored.select("id").join(retractions.select("id"), "id", "left_semi")
    return by_id.union(identity.in_same_event(stored, retractions)).distinct()


def resolve(stored: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``stored`` with open records closed by the first resolution (lowest ``ordinal``) that names their
    district and one of their places, at most 144 hours after their start.

    Time is cut into slots of 144 hours, so what a record can mean is the end of its own slot from its start on and the
    beginning of the next one. Both minima run along the slots of a place: nothing is paired, however many there are."""
    reach = C.RESOLUTION_WINDOW * 60_000_000
    place = lambda keys: F.explode(F.array_distinct(keys)).alias("__place")
    told = F.when(col("ordinal").isNotNull(), F.struct("ordinal", "resolved_at")).alias("__told")
    named = resolutions.where("resolved_at is not null").select("district", place("area_keys"), F.unix_micros("resolved_at").alias("__t"), told)
    open_ = stored.where("ends_at is null and cancelled_at is null and starts_at is not null").select("id", "district", place("area_keys"), F.unix_micros("starts_at").alias("__t"))
    asks = open_.withColumn("__from", F.lit(True)).union(open_.withColumn("__t", col("__t") + reach).withColumn("__from", F.lit(False)))
    rows = asks.unionByName(named, allowMissingColumns=True).where("district is not null and __place is not null")
    slot = Window.partitionBy("district", "__place", "__slot")
    onward, so_far = (F.min("__told").over(slot.orderBy(order)) for order in (col("__t").desc(), col("__t")))
    met = rows.withColumn("__slot", col("__t") - F.pmod("__t", F.lit(reach))).select("id", "__from", F.when(col("__from"), onward).otherwise(so_far).alias("__told"))
    closed = met.where("__from is not null and __told is not null").groupBy("id").agg(F.min("__told").alias("__told")).select("id", col("__told.resolved_at").alias("__end"))
    return stored.join(closed, "id", "left").withColumn("ends_at", F.coalesce("ends_at", "__end")).drop("__end")


def retire(stored: DataFrame, prefixes: DataFrame, reason: str, now: Column, dry_run: bool = True) -> DataFrame:
    """Cancel the records that ``prefixes`` (prefix) name, each prefix exactly one; a dry run only returns
    (prefix, verdict, id)."""
    wanted = prefixes.where(F.char_length("prefix") >= C.ID_PREFIX)
    keyed = stored.withColumn("__p", F.substring("id", 1, C.ID_PREFIX))
    met = wanted.withColumn("__p", F.substring("prefix", 1, C.ID_PREFIX)).join(keyed.select("__p", "id"), "__p", "left")
    found = met.groupBy("prefix").agg(F.collect_set(F.when(col("id").startswith(col("prefix")), col("id"))).alias("ids"))
    verdict = F.when(F.size("ids") == 0, "not found").when(F.size("ids") > 1, "ambiguous").otherwise("found")
    plan = found.select("prefix", verdict.alias("verdict"), F.when(F.size("ids") == 1, col("ids")[0]).alias("id"))
    if dry_run:
        return plan
    marked = stored.join(plan.where("id is not null").select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    hit = col("__hit").isNotNull() & col("cancelled_at").isNull()
    return (
        marked.withColumn("cancelled_reason", F.when(hit, F.lit(reason)).otherwise(col("cancelled_reason")))
        .withColumn("cancelled_at", F.when(hit, now).otherwise(col("cancelled_at")))
        .drop("__hit")
    )


def recompute_keys(stored: DataFrame, keys: Column) -> DataFrame:
    """(id, area_keys) of the rows whose stored keys differ from ``keys``; only these need a write."""
    return stored.select("id", keys.alias("new_keys"), "area_keys").where(~col("new_keys").eqNullSafe(col("area_keys"))).select("id", col("new_keys").alias("area_keys"))


def _cited(stored: DataFrame) -> DataFrame:
    """(id, article_key) of the articles that records cite."""
    return stored.select("id", F.explode("sources").alias("s")).select("id", identity.article_key(col("s.url")).alias("article_key")).distinct()


def _supported(stored: DataFrame, reparsed: DataFrame) -> DataFrame:
    """(id) of records that an article which they cite supports, read again as the same event. They meet within it."""
    citing = stored.withColumn("article_key", F.explode(F.array_distinct(F.transform("sources", lambda s: identity.article_key(s["url"])))))
    return identity.in_same_event(citing, reparsed.where("readable"), within=["article_key"])


def audit(stored: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Each record's verdict against what its sources say now. reparsed: article_key, readable, and the fields
    of a record. ``supported``: a reparsed record of one of its sources is the same event. ``edited_since``: a
    source was published anew after the record was taken in, so that what it says now is no evidence."""
    read = reparsed.groupBy("article_key").agg(F.bool_or("readable").alias("readable"), F.max(F.when(col("readable"), col("published_at"))).alias("edited_at"))
    cited = _cited(stored).join(stored.select("id", "ingested_at"), "id").join(read, "article_key", "left")
    by_id = cited.groupBy("id").agg(
        F.bool_or(F.coalesce("readable", F.lit(False))).alias("readable"), F.bool_or(F.coalesce(col("edited_at") > col("ingested_at"), F.lit(False))).alias("edited_since")
    )
    good = _supported(stored, reparsed).withColumn("supported", F.lit(True))
    verdict = F.when(~col("readable"), "unreadable").when(col("supported"), "supported").when(col("edited_since"), "edited since").otherwise("unsupported")
    return by_id.join(good, "id", "left").select("id", "readable", F.coalesce("supported", F.lit(False)).alias("supported"), "edited_since").withColumn("verdict", verdict)


def rederive_scope(stored: DataFrame, reparsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, scope) of the records whose scope changes: of those that name their own district among their
    places, and may mean it or the town, the widest scope that their sources state when read again. Records
    that no source supports any more keep theirs. ``known`` are the records as their sources knew them, where
    ``stored`` has been edited."""
    unsure = stored.where(live.names_own_district()).select("id", col("scope").alias("__old"))
    known = (known if known is not None else stored).join(unsure.select("id"), "id", "left_semi")
    wide = _supported(known, reparsed.where("scope = 'district'")).withColumn("scope", F.lit("district"))
    read = _supported(known, reparsed).join(wide, "id", "left").withColumn("scope", F.coalesce("scope", F.lit("places")))
    return unsure.join(read, "id").where("scope <> __old").select("id", "scope")


def changed_paths(written: DataFrame, pages: DataFrame, limit: int = C.URL_BATCH) -> DataFrame:
    """Paths of pages that written records change: home, their districts, and their places that have a page."""
    places = written.select(F.explode("area_keys").alias("place_key")).distinct().join(pages.select("place_key"), "place_key", "left_semi")
    paths = (
        written.limit(1).select(F.lit("/").alias("path"))
        .union(written.select(F.concat(F.lit("/district/"), "district")))
        .union(places.select(F.concat(F.lit("/place/"), F.replace(col("place_key"), F.lit(" "), F.lit("-")))))
    )
    both = paths.distinct().select(F.explode(F.array("path", F.concat(F.lit("/en"), F.when(col("path") == "/", "").otherwise(col("path"))))).alias("path"))
    return both.orderBy("path").limit(limit)
