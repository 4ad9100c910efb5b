"""Operator 2: mix sources to target weights by Pareto order sampling, in DataFrame functions only.

1. Targets: sources share a part of all words by weight; what exceeds a source's limit is shared anew.
2. Expected copies of a document: in proportion to its merit, which rises with its length up to 64
   words (very short texts earn half), scaled so that a source's expectation is its target.
3. The whole part of the expectation is certain: so many copies. The fraction is the document's
   inclusion probability for one more copy.
4. Pareto order: random odds divided by inclusion odds. In this order documents are taken until the
   source's size in words is full; later ones of the closing bucket fill what gap remains.

A source may hold most rows: its order is cut into buckets of about 2,000 documents, whose word
counts are summed; only the bucket where the sample closes is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import RID, WORD, cut, table, text_or_empty, with_row_id
from gridlore.llm.sharding import numbered

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a part of all words; a target's limit, in copies of its source.
SHARE, LIMIT = 1.5, 2
#: Documents ranked together.
BUCKET = 2000
_EPS = 1e-9


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source."""
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, few by nature
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    at = (
        sources.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("source_size").over(up_to), F.lit(0)) * limit)
        .withColumn("shared", F.sum("weight").over(onward))
        .withColumn("capped", F.col("source_size") * limit <= (F.col("total") - F.col("full")) * F.col("weight") / F.col("shared"))
    )
    full = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0)) * limit
    rest = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    share_of = (F.col("total") - full) * F.col("weight") / rest
    target = F.when(F.col("capped"), (F.col("source_size") * limit).cast("double")).otherwise(share_of)
    return at.select("source", "source_size", target.alias("target"))


def expectations(levels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``copies`` (expected) to (source, level, words, target): min(limit, k * level), with k such
    that a source's expected words are its target. levels are whole numbers, merits in any unit."""
    down = Window.partitionBy("source").orderBy(F.col("level").desc())
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    merit = F.col("level") * F.col("words")
    at = levels.withColumn(
        "k", (F.col("target") - F.coalesce(F.sum("words").over(above), F.lit(0)) * limit) / F.nullif(F.sum(merit).over(below), F.lit(0))
    ).withColumn("capped", F.coalesce(F.col("k") * F.col("level") >= limit - _EPS, F.lit(False)))
    full = F.coalesce(F.sum(F.when(F.col("capped"), F.col("words"))).over(every), F.lit(0)) * limit
    rest = F.sum(F.when(~F.col("capped"), merit)).over(every)
    k = F.coalesce((F.col("target") - full) / F.nullif(rest, F.lit(0)), F.lit(0.0))
    at = at.withColumn("copies", F.when(F.col("capped"), F.lit(float(limit))).otherwise(F.greatest(k, F.lit(0.0)) * F.col("level")))
    return at.drop("k", "capped")


def same_rows() -> Column:
    """A digest of doc_id, source and text: rows that have it in common may take each other's place."""
    named = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    text = F.md5(F.encode(text_or_empty(), "UTF-8"))
    return F.md5(F.encode(F.concat_ws(":", named("doc_id"), named("source"), text), "UTF-8"))


def uniform(draw: Column) -> Column:
    """A number strictly between 0 and 1 from 48 bits of a digest; the same in every run."""
    return (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``__rid``, doc_id, size, source_size, target, copies and taken (words) for every row of ``docs``.

    Size is the number of words, 0 for null texts. A null source is a source, the last. A row's draw
    comes from its doc_id, source and text, and for repeated rows from their number among these (in the
    order of files and places), so that rows without doc_id or with a repeated one draw apart, and reruns
    agree. Rows of size 0 are taken as often as is certain, which adds no words. ``docs`` must be a stored
    Parquet table. Other columns are ignored; an empty table gives no rows.
    """
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    read = numbered(with_row_id(docs).select(RID, "doc_id", "source", size.alias("size"), same_rows().alias("sig")))
    draw = F.md5(F.encode(F.concat(F.lit("mix:"), "sig", F.lit(":"), F.col("copy").cast("string")), "UTF-8"))
    base = cut(read.select(RID, "doc_id", "source", "size", draw.alias("draw")))
    base = base.withColumn("level", (8 + F.least(F.lit(8), F.floor(F.col("size") / 8))).cast("long"))
    levels = cut(base.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    goal = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    levels = levels.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    levels = expectations(levels, limit)
    fraction, whole = F.col("copies") - F.floor("copies"), F.floor("copies")
    every = Window.partitionBy("source")
    drawn = F.when(F.col("fraction") > 0, F.col("rows"))
    levels = cut(
        levels.withColumn("whole", whole)
        .withColumn("fraction", fraction)
        .withColumn("gap", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
        .withColumn("drawn", F.coalesce(F.sum(drawn).over(every), F.lit(0)))
        .withColumn("mean", F.sum(F.col("fraction") * drawn).over(every) / F.col("drawn"))
        .withColumn("odds", F.col("mean") / (1 - F.col("mean")))
        .withColumn("buckets", F.greatest(F.lit(1), F.floor(F.col("drawn") / BUCKET)))
        .select(F.col("source").alias("s"), F.col("level").alias("l"), "source_size", "target", "whole", "fraction", "gap", "odds", "buckets")
    )
    u = uniform(F.col("draw"))
    order = u / (1 - u) / (F.col("fraction") / (1 - F.col("fraction")))
    even = F.col("order") * F.col("odds") / (1 + F.col("order") * F.col("odds"))
    rows = (
        base.join(levels, F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")))
        .withColumn("order", F.when((F.col("fraction") > 0) & (F.col("size") > 0), order))
        .withColumn("bucket", F.when(F.col("order").isNotNull(), F.least(F.floor(even * F.col("buckets")), F.col("buckets") - 1)))
        .select(RID, "doc_id", "source", "size", "source_size", "target", "whole", "gap", "order", "draw", "bucket")
    )
    sums = rows.where("order is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    sums = cut(sums.where("before < gap").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", (F.col("before") + F.col("words") > F.col("gap")).alias("closes")))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
    sure = rows.where("not coalesce(closes, false)").withColumn("more", F.when(F.col("closes").isNotNull(), 1).otherwise(0))
    closing = _close(rows.where("closes"))
    columns = [RID, "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("long").alias("copies")]
    return sure.select(*columns).union(closing.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))


def _close(rows: DataFrame) -> DataFrame:
    """Adds ``more`` (0 or 1) to the rows of closing buckets: a prefix of the Pareto order that fits the
    gap, then twice the later ones that fit what is left, then one that comes nearer by overshooting."""
    bucket = Window.partitionBy("source", "bucket")
    order = bucket.orderBy("order", "draw")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("left", F.col("gap") - F.col("before")).withColumn("more", F.lit(0))
    for _ in range(3):
        fits = (F.col("more") == 0) & (F.col("size") <= F.col("left"))
        rows = rows.withColumn("fits", fits if _ else F.lit(True)).withColumn("sum", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(running))
        rows = rows.withColumn("now", F.col("fits") & (F.col("sum") <= F.col("left")))
        rows = rows.withColumn("more", F.when(F.col("now"), 1).otherwise(F.col("more")))
        rows = rows.withColumn("left", F.col("left") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(bucket))
    near = (F.col("more") == 0) & (F.col("size") < 2 * F.col("left"))
    best = bucket.orderBy(F.col("near").desc(), "order", "draw")
    last = F.col("near") & (F.row_number().over(best) == 1)
    return rows.withColumn("near", near).withColumn("more", F.when(last, 1).otherwise(F.col("more")))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop(RID)


OP2_SQL = rf"""
WITH a0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce('v' || doc_id::VARCHAR, 'n') || ':' || coalesce('v' || source, 'n') || ':' || md5(coalesce(text, ''))) AS sig FROM documents),
b0 AS (SELECT *, md5('mix:' || sig || ':' || (row_number() OVER (PARTITION BY sig) - 1)) AS r FROM a0),
b AS (SELECT doc_id, source, size, r, (('0x' || substr(r, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM b0),
d AS (SELECT *, 8 + least(8, size // 8) AS level FROM b),
lv AS (SELECT source, level, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM lv GROUP BY ALL),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, 2 * source_size <= (total - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM s1 WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
s3 AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
    ELSE (total - 2 * coalesce(sum(source_size) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target FROM s2),
l1 AS (SELECT lv.*, source_size, target,
    (target - 2 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(level * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS k
  FROM lv JOIN s3 ON lv.source IS NOT DISTINCT FROM s3.source WINDOW o AS (PARTITION BY lv.source ORDER BY level DESC)),
l2 AS (SELECT *, coalesce(k * level >= {LIMIT - _EPS!r}, false) AS capped FROM l1),
l3 AS (SELECT *, CASE WHEN capped THEN 2.0::DOUBLE ELSE greatest(coalesce((target - 2 * coalesce(sum(words) FILTER (capped) OVER p, 0))
    / nullif(sum(level * words) FILTER (NOT capped) OVER p, 0), 0), 0) * level END AS copies FROM l2 WINDOW p AS (PARTITION BY source)),
l4 AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS fraction FROM l3),
l5 AS (SELECT *, target - sum(whole * words) OVER p AS gap, coalesce(sum(n) FILTER (fraction > 0) OVER p, 0) AS drawn,
    sum(fraction * n) FILTER (fraction > 0) OVER p / sum(n) FILTER (fraction > 0) OVER p AS mean FROM l4 WINDOW p AS (PARTITION BY source)),
r0 AS (SELECT d.*, source_size, target, whole, gap, mean / (1 - mean) AS odds, greatest(1, drawn // {BUCKET}) AS buckets,
    CASE WHEN fraction > 0 AND size > 0 THEN u / (1 - u) / (fraction / (1 - fraction)) END AS q
  FROM d JOIN l5 ON d.source IS NOT DISTINCT FROM l5.source AND d.level = l5.level),
r1 AS (SELECT *, CASE WHEN q IS NOT NULL THEN least(floor(q * odds / (1 + q * odds) * buckets), buckets - 1) END AS bucket FROM r0),
k0 AS (SELECT source, bucket, sum(size) AS words, any_value(gap) AS gap FROM r1 WHERE q IS NOT NULL GROUP BY ALL),
k1 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k0),
r2 AS (SELECT r1.*, CASE WHEN k1.before IS NULL OR k1.before >= r1.gap THEN 'no' WHEN k1.before + k1.words > r1.gap THEN 'closes' ELSE 'all' END AS part,
    r1.gap - k1.before AS left0 FROM r1 LEFT JOIN k1 ON r1.source IS NOT DISTINCT FROM k1.source AND r1.bucket = k1.bucket),
c1 AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY q, r ROWS UNBOUNDED PRECEDING) <= left0 AS t1 FROM r2 WHERE part = 'closes'),
c2 AS (SELECT *, left0 - coalesce(sum(size) FILTER (t1) OVER (PARTITION BY source, bucket), 0) AS left1 FROM c1),
c3 AS (SELECT *, NOT t1 AND size <= left1 AND sum(CASE WHEN NOT t1 AND size <= left1 THEN size ELSE 0 END) OVER (PARTITION BY source, bucket ORDER BY q, r ROWS UNBOUNDED PRECEDING) <= left1 AS t2 FROM c2),
c4 AS (SELECT *, t1 OR t2 AS t12, left1 - coalesce(sum(size) FILTER (t2) OVER (PARTITION BY source, bucket), 0) AS left2 FROM c3),
c5 AS (SELECT *, NOT t12 AND size <= left2 AND sum(CASE WHEN NOT t12 AND size <= left2 THEN size ELSE 0 END) OVER (PARTITION BY source, bucket ORDER BY q, r ROWS UNBOUNDED PRECEDING) <= left2 AS t3 FROM c4),
c6 AS (SELECT *, t12 OR t3 AS t123, left2 - coalesce(sum(size) FILTER (t3) OVER (PARTITION BY source, bucket), 0) AS left3 FROM c5),
c7 AS (SELECT *, t123 OR (NOT t123 AND size < 2 * left3 AND row_number() OVER (PARTITION BY source, bucket
    ORDER BY (NOT t123 AND size < 2 * left3) DESC, q, r) = 1) AS more FROM c6),
a AS (SELECT doc_id, size, source_size, target, whole + (part = 'all')::INT AS copies FROM r2 WHERE part <> 'closes'
  UNION ALL SELECT doc_id, size, source_size, target, whole + more::INT FROM c7)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM a
"""
