"""Cards of records that start together: anchors by pointer doubling, in joins.

The first start of a kind is an anchor, and the first start more than five minutes after an anchor is the next one.
Which starts are anchors hangs on all before them, so a start knows its successor, successors of successors are joined
until none is left, and anchors are then marked from the longest jumps to the shortest: rounds grow with the
logarithm of a stretch without a gap. Starts after a gap are anchors in any case. All look-ups are by slots of five minutes,
so no task holds more than a slot, or one row a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.operators.clusters import written
from gridlore.session import remove_folder

col = F.col
_STEP = C.SAME_START * 60_000_000


def _slot(at: str = "p") -> Column:
    return F.floor(col(at) / _STEP)


def successors(starts: DataFrame) -> DataFrame:
    """(kind, p, next, sure) of distinct starts (kind, p): the first start more than a step after p, and whether there is
    none within a step before p."""
    slots = starts.groupBy("kind", _slot().alias("slot")).agg(F.min("p").alias("low"), F.max("p").alias("high"))
    order = Window.partitionBy("kind").orderBy("slot")
    slots = slots.withColumns({"after": F.lead("low").over(order), "before": F.lag("high").over(order)})
    # A start asks at the place a step after it; data at that very place come first, as they are not beyond it.
    asked = starts.select("kind", (col("p") + _STEP).alias("at"), col("p").alias("asks"), F.lit(None).cast("long").alias("p"))
    both = starts.select("kind", col("p").alias("at"), F.lit(None).cast("long").alias("asks"), "p").unionByName(asked).withColumn("slot", _slot("at"))
    onward = Window.partitionBy("kind", "slot").orderBy("at", col("asks").isNotNull())
    both = both.withColumns(
        {"found": F.first("p", ignorenulls=True).over(onward.rowsBetween(1, Window.unboundedFollowing)), "last": F.last("p", ignorenulls=True).over(onward.rowsBetween(Window.unboundedPreceding, -1))}
    )
    here = both.where("p is not null").join(slots.select("kind", "slot", "before"), ["kind", "slot"])
    sure = here.select("kind", "p", (F.coalesce(col("p") - F.coalesce("last", "before"), F.lit(_STEP + 1)) > _STEP).alias("sure"))
    # The slot where a start asks may hold no start; then the slot before it knows the next one.
    asks = both.where("asks is not null").select("kind", "asks", "found", "slot")
    first = asks.join(slots.select("kind", "slot", "after", F.lit(True).alias("there")), ["kind", "slot"], "left").withColumn("own", col("slot") - 1)
    prior = slots.select("kind", col("slot").alias("own"), col("after").alias("after_own"))
    first = first.join(prior, ["kind", "own"], "left").select("kind", col("asks").alias("p"), F.coalesce("found", "after", F.when(col("there").isNull(), col("after_own"))).alias("next"))
    return first.join(sure, ["kind", "p"])


def anchors(starts: DataFrame) -> DataFrame:
    """(kind, p) of the anchors among distinct starts."""
    spark, paths = starts.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        stored, path = written(df, "anchors")
        paths.append(path)
        return stored

    known = keep(successors(starts))
    marked = known.where("sure").select("kind", "p")
    # Jumps end before a start that is an anchor anyway.
    ends = marked.select("kind", col("p").alias("next"))
    jumps = [keep(known.select("kind", "p", "next").where("next is not null").join(ends, ["kind", "next"], "left_anti").select("kind", "p", "next"))]
    while not jumps[-1].isEmpty():
        on = jumps[-1].select("kind", col("p").alias("next"), col("next").alias("then"))
        jumps.append(keep(jumps[-1].join(on, ["kind", "next"]).select("kind", "p", col("then").alias("next"))))
    for jump in reversed(jumps[:-1]):
        marked = keep(marked.union(jump.join(marked, ["kind", "p"], "left_semi").select("kind", col("next").alias("p"))).distinct())
    marked, _ = written(marked, "anchors")
    for path in paths:
        remove_folder(spark, path)
    return marked


def cards(wide: DataFrame, descending: bool) -> DataFrame:
    """(lead, kind, districts, siblings) of records (id, kind, district, starts_at, ends_at): the lead is the open record
    that started first, else the one that ends last; siblings are the others in the order of reading."""
    p = F.unix_micros("starts_at") * (-1 if descending else 1)
    rows, path = written(wide.withColumn("p", p).withColumn("slot", _slot()), "cards")
    found = anchors(rows.select("kind", "p").distinct()).withColumn("anchor", col("p"))
    latest = found.groupBy("kind", (_slot() + 1).alias("slot")).agg(F.max("anchor").alias("earlier"))
    starts = rows.select("kind", "slot", "p").distinct().join(found, ["kind", "p"], "left").join(latest, ["kind", "slot"], "left")
    so_far = Window.partitionBy("kind", "slot").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    of = starts.select("kind", "p", F.coalesce(F.last("anchor", ignorenulls=True).over(so_far), "earlier").alias("anchor"))
    record = F.struct("p", "id", "district")
    is_open, end = col("ends_at").isNull(), F.unix_micros("ends_at")
    rank = F.struct(~is_open, F.when(is_open, F.unix_micros("starts_at")).otherwise(-end), "p", "id")
    grouped = rows.join(of, ["kind", "p"]).groupBy("kind", "anchor").agg(F.min_by("id", rank).alias("lead"), F.array_sort(F.collect_list(record)).alias("all"))
    rest = F.filter("all", lambda r: r["id"] != col("lead"))
    out, _ = written(grouped.select("lead", "kind", F.transform(rest, lambda r: r["district"]).alias("districts"), F.transform(rest, lambda r: r["id"]).alias("siblings")), "cards")
    remove_folder(wide.sparkSession, path)
    return out
