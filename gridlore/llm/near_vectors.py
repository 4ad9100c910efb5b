"""Operator 13: near-duplicate vectors by random-hyperplane sign hashing in several tables.

1. Equal vectors become one node. Each node has in every table a code: on which side of ``bits`` random
   hyperplanes it lies. The hyperplanes follow from a seed and have whole numbers, and so have the vectors that
   are held against them: sums are exact, so a code is the same wherever it is computed.
2. How many bits and tables: bits grow with the number of nodes, so that a bucket holds about ``FILL`` unrelated
   vectors at any size; tables are as many as the recall at the threshold needs with so many bits.
3. Vectors meet in the buckets of each table, large buckets in square blocks, and every pair is verified by its
   exact cosine. A pair counts in the first table where it meets, so that links are counted once. A block returns
   for each vector its number of links and one root, not pairs.
4. Connected components of the roots are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import RID, cut, drop, table, with_row_id
from gridlore.llm.components import connected_components, over_key, salted_join
from gridlore.llm.words import mix, stream

#: Vectors a side of a verified block; unrelated vectors that a bucket should hold.
BLOCK, FILL = 2048, 96
THRESHOLD, RECALL = 0.9, 0.9999


def choose_tables(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL, fill: int = FILL) -> tuple[int, int]:
    """(tables, bits): codes long enough for ``fill`` unrelated vectors a bucket, 4 to 24 bits, and as many
    tables as find a pair at ``threshold`` with probability ``recall``."""
    bits = min(24, max(4, math.ceil(math.log2(max(nodes, 1) / fill)) if nodes > fill else 4))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return (1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))), bits


@lru_cache(maxsize=8)
def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Hyperplanes of all tables as columns: whole numbers up to 2^15, near normal (sums of twelve uniforms)."""
    n = dim * tables * bits
    total = np.zeros(n)
    for k in range(3):
        u = mix(stream(n, 31 + k))
        for shift in (0, 16, 32, 48):
            total += ((u >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.float64) / 65536 - 0.5
    return np.round(total * 4096).reshape(dim, tables * bits)


def codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The code of each row in each table. Every product and sum is a whole number below 2^53."""
    q = np.round(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
    side = (q @ planes(x.shape[1], tables, bits)) >= 0
    return (side.reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column, and the offsets of its rows; null components are NaN."""
    flat, offsets = column.flatten(), column.offsets.to_numpy()
    size = np.diff(offsets)
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(size)))


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds node: a digest of the vector, null where it can link with nothing."""
    for batch in batches:
        flat, at = _vectors(batch.column("embedding"))
        nodes = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            v = flat[a:b]
            usable = b > a and np.isfinite(v).all() and v.any()
            nodes.append(hashlib.md5((v + 0.0).tobytes()).digest() if usable else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "node"])


def coder(tables: int, bits: int):
    """Arrow map (node, embedding) -> (node, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _vectors(batch.column("embedding"))
            size = np.diff(at)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for k in range(0, len(rows), 512):
                    part = rows[k : k + 512]
                    c = codes(flat[at[part][:, None] + np.arange(dim)], tables, bits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(c.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(part)), lists], ["node", "codes"])

    return run


def settle(similar: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches over a symmetric matrix of links: every row is read once."""
    label, seen = np.arange(len(similar)), np.zeros(len(similar), bool)
    for k in range(len(similar)):
        if seen[k]:
            continue
        seen[k], front = True, np.array([k])
        while len(front):
            label[front] = k
            front = np.flatnonzero(similar[front].any(axis=0) & ~seen)
            seen[front] = True
    return label


def links_of(x: np.ndarray, left: int, number: int, threshold: float, tables: int, bits: int) -> np.ndarray:
    """Links within a block (left = all), or between its first ``left`` rows and the others, that no table before
    ``number`` has: a boolean matrix over all rows."""
    unit = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # no overflow, no rounding
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    rows, cols = (slice(None), slice(None)) if left == len(x) else (slice(0, left), slice(left, None))
    a, b = np.nonzero(unit[rows] @ unit[cols].T >= threshold)
    b = b + (0 if left == len(x) else left)
    keep = a != b
    a, b = a[keep], b[keep]
    found = np.zeros((len(x), len(x)), bool)
    if len(a):
        code = codes(x, tables, bits)[:, :number] if number else None
        for k in range(0, len(a), 1 << 18):
            p, q = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            new = np.ones(len(p), bool)
            for t in range(number):
                new &= code[p, t] != code[q, t]
            found[p[new], q[new]] = found[q[new], p[new]] = True
    return found


def verifier(threshold: float, tables: int, bits: int):
    """Arrow map over rows sorted by unit: links and root of each vector that has a link in its unit."""
    keys = ("number", "code", "dim", "i", "j")

    def one(t: pa.Table) -> pa.RecordBatch | None:
        number, _, dim, i, j = (t.column(c)[0].as_py() for c in keys)
        left = len(t) if i == j else int((t.column("block").to_numpy() == i).sum())
        if len(t) < 2 or i != j and left in (0, len(t)):
            return None
        x = t.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), dim)
        found = links_of(x, left, number, threshold, tables, bits)
        linked = np.flatnonzero(found.any(axis=1))
        if not len(linked):
            return None
        root, times = settle(found)[linked], t.column("copies").to_numpy().astype(np.float64)
        links = np.round(found[linked] @ times).astype(np.int64)
        node = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(linked)), node.take(pa.array(root)), pa.array(links)], ["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = np.stack([t.column(c).to_numpy() for c in keys])
            ends = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(t))
            begin = 0
            for end in ends[:-1]:
                if end - begin > 1 and (made := one(t.slice(begin, end - begin))):
                    yield made
                begin = end
            rest = t.slice(begin)
        if rest is not None and len(rest) and (made := one(rest)):
            yield made

    return run


def units(nodes: DataFrame, block: int) -> DataFrame:
    """(node, number, code, dim, i, j, block) of ``nodes`` (node, dim, codes): the buckets of all tables with two
    vectors or more. A bucket of more than ``block`` is cut into blocks, and each pair of blocks is a unit."""
    rows = nodes.select("node", "dim", F.posexplode("codes").alias("number", "code"))
    rows = rows.withColumn("bucket", F.struct("number", "code", "dim"))
    rows = over_key(rows, "bucket", "node", size=F.count(F.lit(1))).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    # Bytes of a node are a digest, even over blocks; equal nodes do not occur.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return rows.withColumn("pair", F.explode(pairs)).select("node", "number", "code", "dim", "pair.i", "pair.j", "block")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): ``__rid``, vec_id, n_links, component_id, first.

    Two vectors of one length are linked where their cosine in double precision is ``threshold`` (above 0) or
    more. n_links counts the other rows that a row is linked with, component_id is the smallest vec_id that it
    reaches, ``first`` marks one row of each component: the smallest vec_id, nulls last, of equal ones the first
    stored. Null and empty vectors, zero ones and those with a null or non-finite component link with nothing.
    Vectors may have any length and lengths may differ; repeated rows are copies of each other. Rows without vec_id
    take part; a component of such rows only has a null component_id. ``vectors`` must be a stored Parquet table; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    id_type, kind = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))
    prepared = cut(with_row_id(vectors).select(RID, "vec_id", "embedding").mapInArrow(prepare, f"{RID} binary, vec_id {id_type}, embedding {kind}, node binary"))
    rows = prepared.select(RID, "vec_id", "node")
    usable = prepared.where("node is not null")
    held = cut(usable.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least")))
    tables, bits = choose_tables(held.count(), threshold, recall)
    coded = held.select("node", "embedding").mapInArrow(coder(tables, bits), "node binary, codes array<int>")
    dims = held.select("node", F.size("embedding").alias("dim"))
    dealt = units(cut(coded.join(dims, "node")), block).join(held.select("node", "copies", "embedding"), "node")
    key = ["number", "code", "dim", "i", "j"]
    met = dealt.select(*key, "block", "node", "copies", "embedding").repartition(*key).sortWithinPartitions(*key, "block", "node")
    found = cut(met.mapInArrow(verifier(threshold, tables, bits), "node binary, root binary, links long"))
    classes = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = (
        held.select("node", "copies", "least")
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .select("node", "copies", "least", F.coalesce("component", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    nodes = over_key(nodes, "root", "node", component_id=F.min("least")).select("node", "root", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = salted_join(rows, cut(nodes), "node", RID, "left")
    rank = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"), F.col(RID).alias("rid"))
    alone = F.col("node").isNull()
    out = out.select(
        RID,
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col(RID)).otherwise(F.col("root")).alias("root"),
        rank.alias("rank"),
    )
    return over_key(out, "root", RID, least=F.min("rank")).withColumn("first", F.col(RID) == F.col("least.rid")).drop("root", "rank", "least")


def keep_one(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` with one row of each component, all columns, whatever their names."""
    gone = near_vectors(vectors, threshold).where("not first").select(RID)
    return with_row_id(vectors).join(cut(gone).hint("shuffle_hash"), RID, "left_anti").drop(RID)


def op13_sign_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
