"""Operator 4: Jaccard self-join on word n-grams by MinHash banding.

1. One pass over the texts gives each its band hashes. How many bands of how many rows: the most
   selective split whose recall at the threshold reaches the target (``choose_bands``).
2. Texts that share a band hash are candidates of each other. Each is tied to its bucket's smallest text,
   never to all others; the components of these ties only say which texts can meet.
3. Candidates are verified on their full n-gram sets. A component of up to ``block`` texts is one unit.
   Larger ones, which chains of chance hits can make, are taken apart again: every bucket is a unit of
   its own, in square blocks of texts, and a pair counts in the first bucket that it shares, so that work
   grows with buckets and not with the square of a component. Both ways exactly the pairs that share a band
   hash are compared. A unit returns a count of links and one root for each text, not pairs.
4. The components of the verified links are the classes.

Equal texts are one node from the start and count by their multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import RID, cut, digest, drop, table, text_or_empty, with_row_id
from gridlore.llm.components import connected_components, over_key, salted_join
from gridlore.llm.words import Words, mix, pieces, shingle_sets, stream

#: Texts a side of a verified block.
BLOCK = 768


def choose_bands(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach ``recall`` at
    ``threshold`` with at most ``most_hashes`` hash functions."""
    for rows in range(most_hashes, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 0 else most_hashes + 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no split of the hash functions reaches this recall")


def signer(n: int, bands: int, rows: int):
    """Arrow map from (key.., text) batches to (key.., bands): the band hashes of each text."""
    a, b = stream(bands * rows, 11)[:, None], stream(bands * rows, 12)[:, None]
    fold, salt = stream(rows, 13), stream(bands, 14)

    def sign(grams: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), 4096):
            np.minimum(least, (a * grams[k : k + 4096] + b).min(axis=1), out=least)
        return mix((mix(least).reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + salt).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for row, data, at in pieces(text):
                signed = [sign(g) if len(g) else np.zeros(0, np.int64) for g in shingle_sets(Words.of(data, at), n)]
                ends = np.cumsum([0, *map(len, signed)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signed)))
                kept = [batch.column(c).slice(row, len(signed)) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, values], [*(c for c in batch.schema.names if c != "text"), "bands"])

    return run


def _incidence(sets: list[np.ndarray], step: int = 2048) -> Iterator[np.ndarray]:
    """0/1 matrices, texts by shared n-grams, ``step`` n-grams at a time."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - low)), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        yield m


def links_of(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which sets are similar: a boolean matrix. With ``left`` < all, only sets[:left] x sets[left:]."""
    size = np.array([len(s) for s in sets], np.int64)
    rows, cols = (slice(0, left), slice(left, None)) if left < len(sets) else (slice(None), slice(None))
    common = np.zeros((len(size[rows]), len(size[cols])), np.float64)
    if len(sets) and sum(map(len, sets)):
        for m in _incidence(sets):
            common += m[rows] @ m[cols].T
    union = size[rows][:, None] + size[cols][None, :] - common
    return (common > 0) & (common >= threshold * union - 1e-9)


def _settle(similar: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches over a symmetric matrix of links."""
    label = np.arange(len(similar))
    while True:
        new = np.minimum(label, np.where(similar, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def first_shared(bands: np.ndarray, left: int) -> np.ndarray:
    """The number of the first band whose hash two texts share, or -1: rows and columns as in ``links_of``."""
    rows, cols = (bands[:left], bands[left:]) if left < len(bands) else (bands, bands)
    first = np.full((len(rows), len(cols)), -1, np.int16)
    for b in range(bands.shape[1] - 1, -1, -1):
        first[rows[:, b][:, None] == cols[:, b][None, :]] = b
    return first


def verifier(n: int, threshold: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, _, band, i, j = key
        group = group.sort_values(["block", "node"], ignore_index=True)
        sets: list[np.ndarray] = []
        for _, data, at in pieces(pa.array(group["text"], pa.large_string())):
            sets += shingle_sets(Words.of(data, at), n)
        times = group["copies"].to_numpy(np.int64)
        k = len(group)
        left = k if i == j else int((group["block"] == i).sum())
        if i != j and left in (0, k):  # one of the two blocks has no text
            return pd.DataFrame({"node": group["node"], "root": group["node"], "links": 0})
        shared = first_shared(np.stack(group["bands"].to_numpy()), left)
        found = links_of(sets, left, threshold) & (shared >= 0 if band < 0 else shared == band)
        if left == k:
            np.fill_diagonal(found, False)
            similar, links = found, found @ times
        else:
            links = np.concatenate((found @ times[left:], found.T @ times[:left]))
            similar = np.zeros((k, k), bool)
            similar[:left, left:] = found
            similar |= similar.T
        root = group["node"].to_numpy()[_settle(similar)]
        return pd.DataFrame({"node": group["node"], "root": root, "links": links.astype(np.int64)})

    return run


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, component) of texts tied by equal band hashes; ``nodes``: node, bands."""
    bands = nodes.select(F.explode("bands").alias("band"), "node")
    ties = over_key(bands, "band", "node", hub=F.min("node")).where("node <> hub")
    return connected_components(ties.select(F.col("node").alias("u"), F.col("hub").alias("v")))


def units(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes`` (node, component, bands, ..) dealt into units of comparison: unit, band, i, j and block.

    A component of up to ``block`` nodes is one unit, band -1. Of larger ones each bucket is one, in squares
    of blocks i and j."""
    sized = over_key(nodes, "component", "node", size=F.count(F.lit(1)))
    zero = F.lit(0)
    small = sized.where(F.col("size") <= block).select(
        F.xxhash64("component").alias("unit"), F.col("component").alias("part"), F.lit(-1).alias("band"), zero.alias("i"), zero.alias("j"), zero.alias("block"), *nodes.columns
    )
    bucket = sized.where(F.col("size") > block).select(*nodes.columns, F.posexplode("bands").alias("band", "unit"))
    bucket = over_key(bucket, "unit", "node", size=F.count(F.lit(1))).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")),
    )
    large = bucket.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("pair", F.explode(pairs))
    return small.union(large.select("unit", F.lit(None).cast(nodes.schema["component"].dataType).alias("part"), "band", "pair.i", "pair.j", "block", *nodes.columns))


def ngram_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): light tables. rows: ``__rid``, doc_id, node, empty. classes: node, root, links.

    classes has the nodes with a link to another node only.
    """
    texts = with_row_id(docs).select(RID, "doc_id", digest().alias("node"), text_or_empty().alias("text"))
    schema = f"{RID} binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>"
    signed = cut(texts.mapInArrow(signer(n, *choose_bands(threshold, recall)), schema))
    rows = signed.select(RID, "doc_id", "node", (F.size("bands") == 0).alias("empty"))
    # One row a node from here on: copies meet in a partial aggregate before the shuffle.
    nodes = cut(
        signed.where(F.size("bands") > 0)
        .groupBy("node")
        .agg(F.min(RID).alias(RID), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    )
    groups = candidate_groups(nodes.select("node", "bands"))
    # The text of each candidate is that of its first row. Candidates grow with the corpus, so they are
    # never broadcast; they are the smaller side in every partition.
    grouped = nodes.join(groups, "node")
    held = cut(with_row_id(docs).select(RID, text_or_empty().alias("text")).join(grouped.hint("shuffle_hash"), RID).drop(RID))
    dealt = units(held.drop("text"), block).select("unit", "part", "band", "i", "j", "block", "node").join(held, "node")
    dealt = dealt.select("unit", "part", "band", "i", "j", "block", "node", "copies", "bands", "text")
    by_unit = dealt.groupBy("unit", "part", "band", "i", "j")
    found = cut(by_unit.applyInPandas(verifier(n, threshold), "node binary, root binary, links long"))
    classes = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    drop(held)
    return rows, links.join(classes, "node").select("node", F.col("component").alias("root"), "links")


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK
) -> DataFrame:
    """One row for each row of ``docs``: ``__rid``, doc_id, node, class_id, n_links.

    Two documents are linked where the Jaccard similarity of their sets of n-word shingles is at
    least ``threshold``; a text of 1 to n-1 words has one shingle, all its words. class_id is the
    smallest doc_id that a document reaches over links, n_links the number of other rows that it is
    linked with, copies included. Null and white-space texts have no shingles: no links, a class of
    their own. Repeated rows are copies. Rows without doc_id take part; a class of such rows only
    has a null class_id. Other columns are ignored; an empty table gives no rows.
    """
    rows, classes = ngram_classes(docs, n, threshold, recall, block)
    nodes = (
        rows.where("not empty")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .join(classes, "node", "left")
        .select("node", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    nodes = over_key(nodes, "root", "node", class_id=F.min("least"))
    nodes = nodes.select("node", "class_id", "root", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return salted_join(rows, nodes, "node", RID, "left").select(
        RID,
        "doc_id",
        "node",
        F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(~F.col("empty"), F.col("root")).alias("root"),
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of linked rows: the smallest doc_id, nulls last, and of repeated
    doc_ids the first stored.

    ``docs`` must be a stored Parquet table. Rows without words (null texts too) all stay. All columns pass
    through, whatever their names; an empty table gives no rows.
    """
    joined = ngram_join(docs, n, threshold)
    grouped = joined.where(F.col("root").isNotNull() & (F.col("n_links") > 0))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(RID).alias("rid"))
    ranked = over_key(grouped.select("root", RID, first.alias("rank")), "root", RID, kept=F.min("rank"))
    gone = cut(ranked.where(F.col(RID) != F.col("kept.rid")).select(RID))
    return with_row_id(docs).join(gone.hint("shuffle_hash"), RID, "left_anti").drop(RID)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
