"""Operator 11: ranked lexical search, WAND on shards of documents.

1. One pass over the texts keeps, for each document, its number of terms and the counts of the terms that any
   item asks for. Document frequencies, the number of documents and of their terms follow from that table; the
   driver gets one number for each asked term.
2. A shard is a run of rows of that table, bounded in postings. Its inverted lists are made in memory, with the
   impact of every posting and the maximum impact of every list.
3. Each item searches the shard in order of doc_id, in windows. Lists are ordered by maximum impact; those
   whose maxima together stay within the heap's threshold cannot make a pivot and are not walked, but looked up
   at the documents of the others. Pivots are the documents whose maxima sum to more than the threshold; only
   they are scored. The threshold is the least score of a full heap, and rises from window to window.
4. The heaps of all shards are merged by rank.

Items are many where a benchmark is large: they go in blocks, each a pass over the written table, so that what
travels to every task has a bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import RID, cut, table, text_or_empty, with_row_id
from gridlore.llm.words import pieces

#: A term, lower-cased in A-Z only: digits, ASCII letters and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Hits of an item; items searched together; postings and documents of a shard; first window of a search.
TOP, ITEMS, POSTINGS, DOCS, WINDOW = 10, 4096, 2_000_000, 1 << 16, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(text: str) -> list[str]:
    """The terms of one text, repeats included."""
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the terms of a run of texts; none runs from one row into the next."""
    inside = _INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = rows[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, asked: pa.Array) -> np.ndarray:
    """The place of each term in ``asked``, -1 where it is not: one look-up of whole terms by their bytes.

    Terms and the gaps between them are the values of one binary array without a copy; gaps match nothing,
    as they hold no byte of a term."""
    at = np.empty(2 * len(start), np.int64)
    at[::2], at[1::2] = start, end
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    found = pc.index_in(values, value_set=asked)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[::2].astype(np.int64)


def counter(vocabulary: list[str]):
    """Arrow map (.., text) -> (.., n, terms, counts): the number of terms of each text, and which of the
    sorted ``vocabulary`` it has, how often."""
    asked_bytes = [t.encode() for t in vocabulary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(asked_bytes, pa.large_binary())
        wide = max(len(asked), 1)
        for batch in batches:
            for row, data, rows in pieces(batch.column("text"), 1 << 21):
                data = _LOWER[data]
                start, end = spans(data, rows)
                first = np.searchsorted(start, rows)
                k = len(rows) - 1
                if len(start) and len(asked):
                    term = _numbers(data, start, end, asked)
                    doc = np.repeat(np.arange(k), np.diff(first))
                    key, count = np.unique((doc * wide + term)[term >= 0], return_counts=True)
                else:
                    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
                ends = np.searchsorted(key, np.arange(k + 1) * wide).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (key % wide, count)]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, k) for c in names), pa.array(np.diff(first).astype(np.int64)), *lists], [*names, "n", "terms", "counts"]
                )

    return run


class Shard:
    """Inverted lists of a run of documents, in order of doc_id, nulls last, equal ones by row."""

    def __init__(self, batches: list[pa.RecordBatch], weight: np.ndarray, total: int, length: int):
        t = pa.Table.from_batches(batches)
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), (RID, "ascending")], null_placement="at_end")).combine_chunks()
        self.ids, self.rids = t.column("doc_id"), t.column(RID)
        lists = t.column("terms").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        term, tf = (c.combine_chunks().flatten().to_numpy().astype(np.int64) for c in (t.column("terms"), t.column("counts")))
        n = t.column("n").to_numpy().astype(np.int64)
        m = 10 + (90 * n * total) // max(length, 1)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], doc[order]
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.term, at = np.unique(term, return_index=True)
        self.at = np.append(at, len(term))
        self.most = np.maximum.reduceat(self.impact, at) if len(term) else np.zeros(0, np.int64)
        self.size = len(size)

    def lists(self, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, impacts, maximum) of the lists of the asked terms, by rising maximum."""
        k = np.searchsorted(self.term, asked)
        k = k[(k < len(self.term))][self.term[k[k < len(self.term)]] == asked[k < len(self.term)]] if len(self.term) else k[:0]
        k = k[np.argsort(self.most[k], kind="stable")]
        return [(self.doc[self.at[i] : self.at[i + 1]], self.impact[self.at[i] : self.at[i + 1]], int(self.most[i])) for i in k]


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], size: int, top: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``top`` documents by score, equal ones by number, and how many were scored in full.

    Windows double, so that the threshold is high before most documents are reached."""
    best_doc, best, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    most = np.array([m for _, _, m in lists], np.int64)
    reach = np.cumsum(most)
    low = 0
    while low < size and len(lists):
        high = min(size, low + window)
        least = int(best[-1]) if len(best) == top else 0
        # Lists before ``free`` reach the threshold by no means together: no pivot lies on them alone.
        free = int(np.searchsorted(reach, least, "right"))
        if free == len(lists):
            break
        walked = []
        for doc, _, _ in lists[free:]:
            a, b = np.searchsorted(doc, (low, high))
            walked.append(doc[a:b])
        bound = np.zeros(high - low, np.int64)
        for doc, m in zip(walked, most[free:], strict=True):
            bound[doc - low] += m
        pivot = np.flatnonzero((bound > 0) & (bound + (reach[free - 1] if free else 0) > least))
        bound = bound[pivot]
        for k in range(free - 1, -1, -1):  # the long lists are looked up at what can still be a pivot
            if not len(pivot):
                break
            doc = lists[k][0]
            at = np.minimum(np.searchsorted(doc, pivot + low), len(doc) - 1)
            bound = bound + np.where(doc[at] == pivot + low, most[k], 0)
            alive = bound + (reach[k - 1] if k else 0) > least
            pivot, bound = pivot[alive], bound[alive]
        if len(pivot):
            score = np.zeros(len(pivot), np.int64)
            for doc, impact, _ in lists:
                at = np.minimum(np.searchsorted(doc, pivot + low), len(doc) - 1)
                score += np.where(doc[at] == pivot + low, impact[at], 0)
            scored += len(pivot)
            beats = score > least
            best_doc, best = np.concatenate((best_doc, pivot[beats] + low)), np.concatenate((best, score[beats]))
            order = np.lexsort((best_doc, -best))[:top]
            best_doc, best = best_doc[order], best[order]
        low, window = high, 2 * window
    return best_doc, best, scored


def searcher(items: list[tuple[int, np.ndarray]], weight: np.ndarray, total: int, length: int, top: int):
    """Arrow map from counted documents to hits (item, doc_id, __rid, score): the heaps of each shard."""

    def hits(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(batches, weight, total, length)
        which, docs, scores = [], [], []
        for number, asked in items:
            doc, score, _ = wand(shard.lists(asked), shard.size, top)
            which.append(np.full(len(doc), number))
            docs.append(doc)
            scores.append(score)
        at = pa.array(np.concatenate(docs))
        columns = [pa.array(np.concatenate(which).astype(np.int32)), *(c.take(at).combine_chunks() for c in (shard.ids, shard.rids)), pa.array(np.concatenate(scores))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", RID, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            postings += len(batch.column("terms").values)
            if rows >= DOCS or postings >= POSTINGS:
                yield from hits(held)
                held, rows, postings = [], 0, 0
        if held:
            yield from hits(held)

    return run


def weight_of(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """The ``top`` documents of each item (item_id, text): item_id, rank, doc_id, score, ``__rid``.

    A document's score for an item is the sum, over the item's distinct terms, of the term's weight times its
    saturated count. Only scores above 0 are hits; equal scores go by rising doc_id, nulls last, then by place in the
    table. Every row is a document, repeated ones too. Null and empty texts have no terms and hit nothing; very long
    texts are counted whole, piece by piece of 2 MB or one text. Repeated items are answered each. ``docs`` must be a
    stored Parquet table; other columns are ignored, whatever their names; an empty table on either side gives no
    rows. The items are read by the driver: a stated query set, in blocks of ``block`` a pass.
    """
    spark = docs.sparkSession
    asked_rows = [(r["item_id"], sorted(set(terms(r["text"] or "")))) for r in items.select("item_id", "text").toLocalIterator()]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item int, doc_id {id_type}, {RID} binary, score long"
    found = spark.createDataFrame([], schema)
    vocabulary = sorted({t for _, ts in asked_rows for t in ts}, key=lambda t: t.encode())
    rows = with_row_id(docs).select(RID, "doc_id", text_or_empty().alias("text"))
    counted = cut(rows.mapInArrow(counter(vocabulary), f"{RID} binary, doc_id {id_type}, n long, terms array<int>, counts array<int>").where("n > 0"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    total, length = sums["n"], sums["l"] or 0
    df = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
    number = {t: k for k, t in enumerate(vocabulary)}
    weight = np.array([weight_of(total, df.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    for k in range(0, len(asked_rows), block):
        part = [(k + i, np.array([number[t] for t in ts if number[t] in df], np.int64)) for i, (_, ts) in enumerate(asked_rows[k : k + block])]
        part = [(i, asked) for i, asked in part if len(asked)]
        if part:
            found = found.union(counted.select(RID, "doc_id", "n", "terms", "counts").mapInArrow(searcher(part, weight, total, length, top), schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), RID)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    item_type = items.schema["item_id"].dataType.simpleString()
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked_rows)], f"item int, item_id {item_type}")
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score", RID)


def op11_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(RID)


OP11_SQL = rf"""
WITH d0 AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
d AS (SELECT *, len(ts)::BIGINT AS n FROM d0 WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS ts FROM benchmark),
q AS (SELECT item, item_id, unnest(ts) AS term FROM i),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
x AS (SELECT q.item, q.item_id, d.row, d.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * d.n * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = q.term JOIN d ON d.row = tf.row CROSS JOIN s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
