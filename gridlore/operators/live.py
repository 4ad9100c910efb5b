"""Selections and projections over stored interruptions.

The stored table has id, kind, starts_at, ends_at, district, areas, area_keys, scope, sources,
published_at, ingested_at, confidence, cancelled_at, cancelled_reason. Every order ends in id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.functions import text as tx
from gridlore.functions import time as tm

col = F.col


def not_bad_data() -> Column:
    return ~col("cancelled_reason").eqNullSafe("bad_data")


def live(outages: DataFrame, now: Column) -> DataFrame:
    return outages.where(col("cancelled_at").isNull() & (col("starts_at") >= now - tm.minutes(C.LIVE_HORIZON))).orderBy("starts_at", "id")


def newest(outages: DataFrame, limit: int) -> DataFrame:
    return outages.orderBy(col("starts_at").desc(), "id").limit(limit)


def archive(outages: DataFrame, now: Column, limit: int = C.ARCHIVE_LIMIT) -> DataFrame:
    shown = outages.where((col("starts_at") < now) & not_bad_data())
    return newest(shown.withColumn("cancelled", col("cancelled_at").isNotNull()), limit)


def by_prefix(outages: DataFrame, prefix: str) -> DataFrame:
    """The one record whose id has this prefix; none where there are several. Two rows decide it."""
    found = outages.where(col("id").startswith(prefix) & not_bad_data()).orderBy("id").limit(2)
    return found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("__n = 1").drop("__n")


def of_district(outages: DataFrame, district: str, limit: int = C.DISTRICT_LIMIT) -> DataFrame:
    return newest(outages.where((col("district") == district) & not_bad_data()), limit)


def of_place(outages: DataFrame, key: str, district: str, limit: int = C.PLACE_LIMIT) -> DataFrame:
    named = F.array_contains("area_keys", key) | ((col("scope") == "district") & (col("district") == district))
    return newest(outages.where(named & not_bad_data()), limit)


def covers(key: str, district: str) -> Column:
    """Whether a record covers a place: a district-wide one by its district alone."""
    return F.when(col("scope") == "district", col("district") == district).otherwise(F.array_contains("area_keys", key))


def references(outages: DataFrame, since: Column, limit: int = C.REFS_LIMIT) -> DataFrame:
    known = col("district").isin(*C.DISTRICT_IDS)
    return newest(outages.where((col("starts_at") >= since) & not_bad_data() & known), limit)


def last_good_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max(F.when(col("ok"), col("started_at"))).alias("last_ok"))


def stale(last_ok: Column, now: Column) -> Column:
    return last_ok.isNull() | (now > last_ok + tm.minutes(C.STALE_AFTER))


def with_status(outages: DataFrame, now: Column) -> DataFrame:
    return outages.withColumn("status", tm.status(col("starts_at"), col("ends_at"), now)).withColumn(
        "read_end", tm.read_end(col("starts_at"), col("ends_at"))
    )


def candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored records that an incoming batch may meet: its districts, its span of starts widened on both
    sides. The batch's bounds are one row."""
    bounds = incoming.agg(
        (F.min("starts_at") - tm.minutes(C.CANDIDATE_WINDOW)).alias("__from"), (F.max("starts_at") + tm.minutes(C.CANDIDATE_WINDOW)).alias("__to")
    )
    near = stored.join(F.broadcast(bounds), col("starts_at").between(col("__from"), col("__to"))).drop("__from", "__to")
    return near.join(F.broadcast(incoming.select("district").where(col("district").isin(*C.DISTRICT_IDS)).distinct()), "district", "left_semi")


def names_own_district() -> Column:
    """Whether a record's areas contain its own district's name."""
    return F.array_contains("area_keys", tx.fold_key(F.element_at(district_names(), col("district"))))


def district_names() -> Column:
    return F.create_map(*[F.lit(x) for pair in C.DISTRICTS.items() for x in pair])


def in_month(month: str) -> Column:
    return tm.month_key(col("starts_at")) == month


def addressable() -> Column:
    return col("id").rlike(f"^[0-9a-f]{{{C.ID_PREFIX}}}")


def in_calendar() -> Column:
    return (col("kind") != "fault") & col("cancelled_at").isNull() & col("ends_at").isNotNull()


def nearby(outages: DataFrame, district: str, own_id: str, fetched: int = 13, shown: int = C.UI_LIMIT) -> DataFrame:
    return newest(of_district(outages, district, fetched).where(col("id") != own_id), shown)


def area_keys(areas: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(areas, tx.fold_key), lambda k: k != "")))


def slug() -> Column:
    """date-district-place-prefix; what is empty is left out."""
    date = F.date_format(tm.local(col("starts_at")), "yyyy-MM-dd")
    place = F.nullif(tx.hyphens(F.get(col("areas"), F.lit(0))), F.lit(""))
    return F.concat_ws("-", date, "district", place, F.substring("id", 1, C.ID_PREFIX))


def slug_prefix(slug_: Column) -> Column:
    return F.nullif(F.regexp_extract(slug_, "-([0-9a-f]{8})$", 1), F.lit(""))


def route(path: Column) -> Column:
    """(locale, section, rest) of a page's path; the default locale has no segment of its own."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    english = F.coalesce(F.get(parts, F.lit(0)) == "en", F.lit(False))
    rest = F.when(english, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.struct(
        F.when(english, "en").otherwise("tr").alias("locale"),
        F.coalesce(F.get(rest, F.lit(0)), F.lit("home")).alias("section"),
        F.array_join(F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), "/").alias("rest"),
    )


def countdown(now: Column) -> Column:
    """(direction, target): to the start, to the end, or since the start where no end is known."""
    at = tm.status(col("starts_at"), col("ends_at"), now)
    pick = lambda d, t: F.struct(F.lit(d).alias("direction"), t.alias("target"))
    return (
        F.when(at == "upcoming", pick("until_start", col("starts_at")))
        .when((at == "active") & col("ends_at").isNotNull(), pick("until_end", col("ends_at")))
        .when(at == "active", pick("since_start", col("starts_at")))
    )


def dot(stale_: Column, active: Column, any_fault: Column) -> Column:
    return F.when(stale_, "muted").when(active == 0, "lit").when(any_fault, "fault").otherwise("dark")


def active_first(outages: DataFrame, now: Column) -> DataFrame:
    rank = F.when(col("status") == "active", 0).when(col("status") == "upcoming", 1)
    return with_status(outages, now).where("status <> 'past'").orderBy(rank, "starts_at", "id")


def recent(outages: DataFrame, now: Column, limit: int = C.UI_LIMIT) -> DataFrame:
    return newest(with_status(outages, now).where("status = 'past'"), limit)


def official_first(sources: Column) -> Column:
    """Sources with the official ones in front, otherwise in their order."""
    return F.concat(F.filter(sources, lambda s: s["kind"] == "official"), F.filter(sources, lambda s: s["kind"] != "official"))
