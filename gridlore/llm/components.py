"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import cut, drop

#: Parts that the rows of one key are dealt into.
SALT = 64


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")


def over_key(rows: DataFrame, key: str, by: str, **values) -> DataFrame:
    """``rows`` with values over all rows of their ``key``: name = aggregate.

    A key may have most rows. They are aggregated before they are shuffled, and the values go back to each
    salted part that the key has, so that no task holds all rows of a key. ``by`` is a column that tells
    rows of a key apart."""
    has = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _salt(by))).alias("__salts")
    whole = rows.groupBy(F.col(key).alias("__key")).agg(*[value.alias(name) for name, value in values.items()], has)
    every = F.sequence(F.lit(0), F.lit(SALT - 1))
    salts = F.filter(every, lambda k: F.getbit("__salts", k) == 1)
    back = whole.select("__key", *values, F.explode(salts).alias("__salt"))
    return rows.join(back, (F.col(key) == F.col("__key")) & (_salt(by) == F.col("__salt"))).drop("__key", "__salt")


def salted_join(rows: DataFrame, other: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, one row a key, where a key may have most of ``rows``."""
    dealt = rows.withColumn("__salt", _salt(by))
    parts = dealt.select(key, "__salt").distinct().join(other, key, how)
    return dealt.join(parts, [key, "__salt"], how).drop("__salt")


def _sum(edges: DataFrame) -> tuple[int, int]:
    one = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return one[0], one[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph of ``edges`` (u, v), any ordered type; null ends are no edges.

    Returns (node, component), one row for each node of an edge between two different nodes;
    component is the smallest node. No group is gathered: the neighbours of a node, however many, meet in
    minima of salted parts. Edges stay in the cluster; the driver sees one count and one checksum a round.
    Every round brings the sum of all ends down until the edges are stars, so rounds come to an end.
    """
    now = cut(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _sum(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = over_key(both, "u", "v", m=F.min("v")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        small = over_key(large, "u", "v", m=F.min("v"))
        rest = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(rest.union(small.where("v = m").select("u", "v")).distinct())
        drop(now)
        now, last, before = after, before, _sum(after)
        if before == last:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
