"""Operator 9: toxicity by cumulative-link (proportional-odds) ordinal regression.

A text is the set of its words and of their beginnings of 3 to 6 bytes, which stand for word families,
hashed into ``BUCKETS``, each with whether the text has it twice, and three times or more: one word of a
family may be chance. One weight a feature is shared by all ordered thresholds:
P(grade > k) = s(w . x - t_k), t_0 < t_1 < t_2; the result is the expected grade.

Labels only say whether a text is toxic, so grades 1 to 3 of toxic texts are derived, by cross-fitting:
the sample is cut into folds, and the toxic texts of each are split in equal thirds by their margin under a
model of two grades that is fitted on the other folds. A grade thus says how surely words seen in other texts tell that
a text is toxic; it has no meaning beyond that.

The models are fitted by proximal gradient steps with an L1 penalty, which leaves the words that matter, on
a bounded sample of labelled rows; every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import RID, cut, drop, table, text_or_empty, with_row_id
from gridlore.llm.words import Words, mix, pieces, stream

BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on, at most about so many.
SAMPLE = 12_000
#: Features a bucket: the text has it once or more, twice or more, three times or more.
TIMES = 3
#: Features that enter the model: all whose share differs between toxic and clean texts by so many standard
#: errors. There is no limit on their number beyond the sample's own.
LEAST_Z = 3.0
GRADES = 4
#: Parts of the sample that grades are derived for, each from the others.
FOLDS = 5
#: A text is toxic where P(grade > 0) is at least this.
TOXIC = 0.4

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: Lengths of word beginnings; a shorter word stands for itself.
_BEGINNINGS = (3, 4, 5, 6)


def buckets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, the buckets of all features of all words (runs of letters and digits
    in lower case), and the offsets of rows in these."""
    low = pc.utf8_lower(column)
    for row, data, at in pieces(low):
        plain = np.where(_BREAKS[data], np.uint8(32), data)
        words = Words.of(plain, at)
        size, whole = words.end - words.start, words.hashes()
        features = np.empty((len(whole), 1 + len(_BEGINNINGS)), np.uint64)
        features[:, 0] = whole
        sum_of, place = np.zeros(len(whole), np.uint64), stream(max(_BEGINNINGS), 31)
        for k in range(max(_BEGINNINGS)):
            byte = plain[np.minimum(words.start + k, len(plain) - 1)].astype(np.uint64) + np.uint64(1)
            sum_of = sum_of + byte * place[k]
            if k + 1 in _BEGINNINGS:
                features[:, 1 + _BEGINNINGS.index(k + 1)] = np.where(size > k + 1, mix(sum_of + np.uint64(k)), whole)
        yield row, (features.reshape(-1) >> np.uint64(44)).astype(np.int64), words.first * features.shape[1]


def counted(bucket: np.ndarray) -> np.ndarray:
    """The features of a text from the buckets of its words: bucket + k * BUCKETS where it has one more
    than k times."""
    base, times = np.unique(bucket, return_counts=True)
    return np.concatenate([base[times > k] + k * BUCKETS for k in range(TIMES)])


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # sorted; a feature is a bucket and how often (see counted)
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1

    def margins(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        """w . x of each row, from the buckets of its words."""
        base, at = np.unique(self.buckets % BUCKETS, return_inverse=True)
        weight = np.zeros((len(base) + 1, TIMES))
        weight[at, self.buckets // BUCKETS] = self.weights
        weight = np.concatenate((np.zeros((len(base) + 1, 1)), weight.cumsum(axis=1)), axis=1)
        place = np.full(BUCKETS, len(base), np.int32)
        place[base] = np.arange(len(base))
        found = place[bucket]
        hit = np.flatnonzero(found < len(base))
        row = np.searchsorted(first, hit, "right") - 1
        pair, times = np.unique(row * np.int64(len(base) + 1) + found[hit], return_counts=True)
        row, k = np.divmod(pair, len(base) + 1)
        return np.bincount(row, weight[k, np.minimum(times, TIMES)], minlength=len(first) - 1)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k), one column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -500, 500)))


def select_features(rows: DataFrame) -> DataFrame:
    """The features f of ``rows`` (y, bucket) whose share differs between toxic and clean texts, counted by
    Spark over all that occur."""
    n = {r["t"]: r["count"] for r in rows.groupBy((F.col("y") > 0).alias("t")).count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    counts = rows.select((F.col("y") > 0).cast("int").alias("t"), F.explode("bucket").alias("f")).groupBy("f").agg(F.sum("t").alias("one"), F.sum(1 - F.col("t")).alias("zero"))
    one, zero = F.col("one") + 0.5, F.col("zero") + 0.5
    z = (F.ln(one / (n1 + 1)) - F.ln(zero / (n0 + 1))) / F.sqrt(1 / one + 1 / zero)
    return counts.where(F.abs(z) >= LEAST_Z).select("f")


def derive_grades(sets: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Grades from 0/1 labels: toxic texts of each fold in thirds by their margin under a model of the others."""
    grades = np.zeros(len(sets), int)
    for k in np.unique(fold):
        learn, judge = np.flatnonzero(fold != k), np.flatnonzero((fold == k) & toxic)
        if not len(judge) or not len(learn):
            grades[judge] = 1
            continue
        model = fit([sets[i] for i in learn], toxic[learn].astype(int), chosen, steps=100, levels=2)
        weight = np.zeros(TIMES * BUCKETS)
        weight[model.buckets] = model.weights
        margin = np.array([weight[sets[i]].sum() for i in judge])
        cuts = np.quantile(margin, (1 / 3, 2 / 3))
        grades[judge] = 1 + (margin > cuts[0]).astype(int) + (margin > cuts[1])
    return grades


def fit(sets: list[np.ndarray], grades: np.ndarray, chosen: np.ndarray, penalty: float = 1e-4, steps: int = 400, levels: int = GRADES) -> OrdinalModel:
    """Minimise mean negative log likelihood + penalty * |w| by accelerated proximal gradient steps."""
    n = len(sets)
    place = np.full(TIMES * BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    found = [p[p >= 0] for p in (place[s] for s in sets)]
    rows, at = np.repeat(np.arange(n), [len(p) for p in found]), np.concatenate(found or [np.zeros(0, np.int32)])
    share = (np.bincount(grades, minlength=levels)[::-1].cumsum()[::-1][1:] + 0.5) / (n + 1)
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    w = np.zeros(len(chosen))
    # parameters: w, first threshold, logs of the steps between thresholds
    p = np.concatenate((w, [t[0]], np.log(np.maximum(np.diff(t), 1e-2))))
    fast, k, rate = p.copy(), 1.0, 1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    m = len(chosen)

    def loss(p: np.ndarray, slope: bool):
        t = np.concatenate(([p[m]], p[m] + np.cumsum(np.exp(p[m + 1 :]))))
        margin = np.bincount(rows, p[at], minlength=n)
        upper = np.where(grades < levels - 1, t[np.minimum(grades, levels - 2)] - margin, 40.0)
        lower = np.where(grades > 0, t[np.maximum(grades, 1) - 1] - margin, -40.0)
        a, b = sigmoid(upper), sigmoid(lower)
        q = np.maximum(a - b, 1e-12)
        if not slope:
            return -np.log(q).mean()
        da, db = a * (1 - a) * (grades < levels - 1) / q, b * (1 - b) * (grades > 0) / q
        g = np.zeros_like(p)
        g[:m] = np.bincount(at, (da - db)[rows], minlength=m)
        dt = np.array([-da[grades == j].sum() + db[grades == j + 1].sum() for j in range(levels - 1)])
        g[m] = dt.sum()
        g[m + 1 :] = [dt[j:].sum() * np.exp(p[m + j]) for j in range(1, levels - 1)]
        return -np.log(q).mean(), g / n

    for _ in range(steps):
        value, g = loss(fast, True)
        while True:
            new = fast - rate * g
            new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
            step = new - fast
            if loss(new, False) <= value + g @ step + (step @ step) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        fast, p, k, rate = new + (k - 1) / nk * (new - p), new, nk, rate * 1.1
    kept = np.flatnonzero(p[:m])
    thresholds = np.concatenate(([p[m]], p[m] + np.cumsum(np.exp(p[m + 1 :]))))
    return OrdinalModel(chosen[kept], p[:m][kept], thresholds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of about ``most`` labelled doc_ids at most, drawn by a hash of doc_id; one row each.

    Null labels and ids are no labels; of several labels of a document the largest counts, of several texts
    the one with the smallest digest.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    part = min(1.0, most / max(y.count(), 1))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)))
    # At most about ``most`` narrow rows by construction, whatever the tables' size.
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(y), "doc_id")
    least = F.min(F.struct(F.md5(F.encode("text", "UTF-8")).alias("d"), F.col("text").alias("text")))
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), least.alias("t")).select("doc_id", "y", "t.text")


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, bucket, first in buckets_of(batch.column("text")):
            found = [counted(bucket[a:b]).astype(np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [batch.column(c).slice(row, len(found)) for c in ("h", "y")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], ["h", "y", "bucket"])


def _kept(chosen: np.ndarray):
    """Arrow map that leaves of each row's features the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(x.values.to_numpy(), chosen).astype(np.int32) for x in batch.column("bucket")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["h", "y", "bucket"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents; without any, nothing is toxic. The driver gets
    labels and chosen features of the sample, no texts."""
    sample = labelled_sample(docs, labels, "toxic", most).select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")
    schema = "h long, y int, bucket array<int>"
    sparse = cut(sample.mapInArrow(_sparse, schema))
    chosen = np.sort(select_features(sparse).toArrow().column("f").to_numpy().astype(np.int64))
    rows = sparse.mapInArrow(_kept(chosen), schema).toArrow().sort_by("h")
    drop(sparse)
    if not rows.num_rows:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([10.0, 20.0, 30.0]))
    sets = [x.values.to_numpy() for x in rows.column("bucket")]
    toxic, fold = rows.column("y").to_numpy() > 0, mix(rows.column("h").to_numpy().view(np.uint64)) % np.uint64(FOLDS)
    return fit(sets, derive_grades(sets, toxic, fold, chosen), chosen)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``__rid``, doc_id, p_toxic, severity (expected grade, 0 to 3) and toxic for every row of ``docs``.

    Null and empty texts have no words: their score is that of the thresholds alone. Repeated rows
    score alike. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bucket, first in buckets_of(batch.column("text")):
                above = model.above(model.margins(bucket, first))
                part = batch.slice(row, len(above))
                yield pa.RecordBatch.from_arrays(
                    [part.column(RID), part.column("doc_id"), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(above[:, 0] >= TOXIC)],
                    [RID, "doc_id", "p_toxic", "severity", "toxic"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = with_row_id(docs).select(RID, "doc_id", text_or_empty().alias("text"))
    return texts.mapInArrow(
        run, f"{RID} binary, doc_id {kind}, p_toxic double, severity double, toxic boolean"
    )


def clean_only(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without toxic rows; all columns pass through, whatever their names. Null and empty texts have
    no toxic word and stay, repeated rows fare alike, an empty table gives no rows. One pass, nothing is
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bucket, first in buckets_of(batch.column("text")):
                part = batch.slice(row, len(first) - 1)
                yield part.filter(pa.array(model.above(model.margins(bucket, first))[:, 0] < TOXIC))

    return docs.mapInArrow(run, docs.schema)


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels"))).drop(RID)
