"""Operator 10: a quality classifier on learned subword embeddings.

Every word and every character n-gram of a text (with the white space at a word's ends) is hashed to
a learned vector, and every word 3-gram to one of two, as the text has it once or repeats it. A text is the mean of its vectors, and a softmax layer tells good from poor. The
vectors are trained by numpy stochastic gradient descent on a bounded sample of labelled rows.

Scoring needs one number a vector, its product with the difference of the two output rows, so all
rows are scored on their whole texts by table look-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import cut, drop, table, text_or_empty
from gridlore.llm.toxicity import labelled_sample
from gridlore.llm.words import mix, stream, windows

#: Hashed vectors, their length, and the n-gram sizes.
VECTORS, WIDTH, GRAMS = 1 << 16, 12, (2, 3, 4)
#: How often the vector of a word 3-gram, fresh or repeated, counts against one of a character n-gram.
_WEIGHT = 6
#: Labelled rows to train on at most, about.
SAMPLE = 6_000
#: Feature counts of the sample that the driver holds at a time, about.
HELD = 8_000_000
#: A text is predicted good from this score on.
GOOD = 0.7
#: Characters hashed at a time, but for longer texts.
_PART = 1 << 17
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
_U = np.uint64


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vector numbers, row of each), rows ascending within each kind of feature."""
    joined = " " + " ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))  # the blank after each text
    space = np.isin(code, _SPACES)
    code[space] = 32
    wide = code.astype(_U) + _U(1)
    key = stream(max(GRAMS), 41)
    numbers, rows = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        total, inner = wide[:m] * key[0], np.zeros(m, bool)
        for k in range(1, n):
            total = total + wide[k : k + m] * key[k]
            if k < n - 1:
                inner |= space[k : k + m]
        at = np.flatnonzero(~inner & ~(space[:m] & space[n - 1 :]))
        numbers.append((mix(total[at] + _U(n)) % _U(VECTORS)).astype(np.int32))
        rows.append(np.searchsorted(ends, at + space[at], "right"))  # the row of its first character that is no space
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(start):
        size = np.flatnonzero(space[1:] & ~space[:-1]) + 1 - start
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        words = np.add.reduceat(wide[place + np.repeat(start, size)] * stream(int(size.max()), 42)[place], begin)
        numbers.append((mix(words) % _U(VECTORS)).astype(np.int32))
        rows.append(np.searchsorted(ends, start, "right"))
        row = rows[-1]
        whole = np.flatnonzero(row[:-2] == row[2:])
        window = windows(words, 3)[whole] + (row[whole] + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
        _, inverse, times = np.unique(mix(window), return_inverse=True, return_counts=True)
        numbers.append(np.tile(np.where(times[inverse.reshape(-1)] > 1, VECTORS, VECTORS + 1).astype(np.int32), _WEIGHT))
        rows.append(np.tile(row[whole], _WEIGHT))
    if not numbers:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.minimum(np.concatenate(rows), max(len(texts) - 1, 0))


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_PART`` characters: first row, texts."""
    row, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > _PART:
            yield row, texts[row:k]
            row, size = k, 0
        size += len(text)
    if row < len(texts):
        yield row, texts[row:]


@dataclass(frozen=True)
class QualityModel:
    scores: np.ndarray  # one number a vector
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        number, row = features_of(texts)
        total = np.bincount(row, self.scores[number], minlength=len(texts))
        mean = total / np.maximum(np.bincount(row, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))


Row = tuple[np.ndarray, np.ndarray, int]


def fit(parts: Sequence[Callable[[], list[Row]]], epochs: int = 4, rate: float = 0.1, seed: int = 5) -> QualityModel:
    """Stochastic gradient descent over (vector numbers, their counts, 0 or 1), in a fixed random order.
    The rate falls to nothing, and for each vector with what it has moved (AdaGrad by vector). ``parts`` fetch
    the rows, one part at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (VECTORS + 2, WIDTH)).astype(np.float32)
    moved = np.full(len(vectors), 1e-10, np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    pulled = np.full((2, 1), 1e-6, np.float32)
    for at in [(e, p) for e in range(epochs) for p in rng.permutation(len(parts))]:
        rows = parts[at[1]]()
        for nth, k in enumerate(rng.permutation(len(rows))):
            number, count, label = rows[k]
            step = rate * (1 - (at[0] + nth / len(rows)) / epochs)
            if not len(number):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ vectors[number]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back, slope = p @ out, p[:, None] * mean[None, :]
            pulled += (slope**2).mean(axis=1, keepdims=True)
            out -= step * slope / np.sqrt(pulled)
            bias -= step * 0.1 * p
            moved[number] += share**2 * (back**2).mean()
            vectors[number] -= (step * share / np.sqrt(moved[number]))[:, None] * back[None, :]
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out():
    """Whether a row is kept from all training: crc32 of its doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in parts(batch.column("text").to_pylist()):
            number, row = features_of(texts)
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(len(texts) + 1))
            found = [np.unique(number[order[a:b]], return_counts=True) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            kept = [batch.column(c).slice(first, len(texts)) for c in ("h", "y")]
            lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *lists], ["h", "y", "number", "times"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, held: int = HELD) -> QualityModel:
    """Fit on a bounded sample of labelled rows that are not held out; without any, all score 1/2. The driver
    fetches counts of about ``held`` features at a time, no texts."""
    sample = labelled_sample(docs.where(~held_out()), labels.where(~held_out()), "quality", most)
    sample = sample.select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")
    counted = cut(sample.mapInArrow(_counted, "h long, y int, number array<int>, times array<int>"))
    features = counted.agg(F.sum(F.size("number"))).first()[0] or 0
    parts = 1 + features // held

    @cache
    def fetch(k: int) -> list[Row]:
        rows = counted.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k).toArrow().sort_by("h")
        numbers, times = ([x.values.to_numpy() for x in rows.column(c)] for c in ("number", "times"))
        return list(zip(numbers, times, (rows.column("y").to_numpy() > 0).astype(int).tolist(), strict=True))

    # One part is fetched once; of several each in its turn, so that only one is held.
    model = fit([lambda k=k: (fetch if parts == 1 else fetch.__wrapped__)(k) for k in range(parts)])
    drop(counted)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of ``docs``.

    Null and empty texts have no features and score by the bias alone. A null doc_id is not held out.
    Repeated rows score alike. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch.column("text").to_pylist()):
                kept = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(texts), pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    scored = texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
