import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import quality, toxicity
from gridlore.llm.common import RID, table


def table_of_labels(stored, rows):
    return stored([(*r,) for r in rows], "doc_id long, quality int, toxic int")


def sample(seed, n=700):
    """Texts with toxic words in some, and poor texts that repeat themselves."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        toxic, good = k % 5 == 0, k % 3 != 0
        if not good:
            words = words[:6] * 8
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "vilest", "scum", "filth"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def test_toxicity_on_rows_it_has_not_seen(docs, stored):
    rows, labels = sample(1)
    model = toxicity.train(docs(rows[:500]), table_of_labels(stored, labels[:500]))
    found = {r["doc_id"]: r for r in toxicity.severity(docs(rows[500:]), model).collect()}
    right = sum(found[d]["toxic"] == bool(t) for d, _, t in labels[500:])
    assert len(found) == 200 and right >= 196
    assert all(0 <= r["severity"] <= 3 and 0 <= r["p_toxic"] <= 1 for r in found.values())
    kept = {r["doc_id"] for r in toxicity.clean_only(docs(rows[500:]), model).collect()}
    assert kept == {d for d, r in found.items() if not r["toxic"]}


def test_severity_is_the_sum_of_ordered_probabilities():
    model = toxicity.OrdinalModel(np.array([3, 9]), np.array([1.5, -0.5]), np.array([0.0, 1.0, 2.5]))
    above = model.above(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(above, axis=1) < 0).all() and (np.diff(above, axis=0) > 0).all()
    bucket, first = np.array([3, 3, 9, 5, 9]), np.array([0, 3, 4, 4, 5])
    assert model.margins(bucket, first).tolist() == [1.0, 0.0, 0.0, -0.5]


def test_ordinal_fit_finds_the_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 600)
    sets = [np.unique(np.concatenate((rng.integers(100, 140, 10), 7 + np.arange(g)))) for g in grades]
    model = toxicity.fit(sets, grades, np.arange(200), penalty=1e-3)
    margin = np.array([model.margins(s, np.array([0, len(s)]))[0] for s in sets])
    means = [margin[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and (np.diff(model.thresholds) > 0).all()
    expected = model.above(margin).sum(axis=1)
    assert np.abs(expected - grades).mean() < 0.5


def test_models_on_odd_rows_and_without_labels(docs, stored, odd_rows):
    empty = table_of_labels(stored, [])
    model = toxicity.train(docs(odd_rows), empty)
    assert toxicity.severity(docs(odd_rows), model).where("toxic").count() == 0
    assert toxicity.clean_only(docs(odd_rows), model).count() == len(odd_rows)
    assert toxicity.severity(docs([]), model).count() == 0
    plain = quality.train(docs(odd_rows), empty)
    scored = quality.score(docs(odd_rows), plain).collect()
    assert len(scored) == len(odd_rows) and all(r["score"] == 0.5 and r["predicted"] == 0 for r in scored)
    labels = table_of_labels(stored, [(1, 1, 0), (None, 1, 1), (6, None, None), (5, 0, 1), (6, 1, 0), (6, 0, 1)])
    assert toxicity.severity(docs(odd_rows), toxicity.train(docs(odd_rows), labels)).count() == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs(odd_rows), quality.train(docs(odd_rows), labels)).collect())
    assert quality.score(docs([]), plain).count() == 0


def test_quality_on_held_out_rows(docs, stored):
    rows, labels = sample(2, 900)
    t, y = docs(rows), table_of_labels(stored, labels)
    scored = {r["doc_id"]: r for r in quality.score(t, quality.train(t, y)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in scored.items())
    held = [(scored[d]["score"], q) for d, q, _ in labels if scored[d]["held_out"]]
    good, poor = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in poor] for a in good])
    assert auc > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in scored.values())


def test_held_out_labels_change_nothing(docs, stored):
    rows, labels = sample(3, 300)
    t = docs(rows)
    one = quality.train(t, table_of_labels(stored, labels))
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, x) for d, q, x in labels]
    two = quality.train(t, table_of_labels(stored, flipped))
    assert one.bias == two.bias and (one.scores == two.scores).all()


def test_one_row_of_a_labelled_id(docs, stored):
    t = docs([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "x")])
    found = toxicity.labelled_sample(t, table_of_labels(stored, [(1, 1, 1), (1, 0, 0), (2, 1, 0)]), "toxic", 10).collect()
    assert sorted((r["doc_id"], r["y"]) for r in found) == [(1, 1), (2, 0)] and all(r["text"] in "ab" for r in found)


def test_training_by_parts(docs, stored):
    rows, labels = sample(5, 400)
    t, y = docs(rows), table_of_labels(stored, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(t, quality.train(t, y, held=20_000)).collect()}
    good, poor = [scored[d] for d, q, _ in labels if q], [scored[d] for d, q, _ in labels if not q]
    assert np.mean([[a > b for b in poor] for a in good]) > 0.95


def test_grades_follow_margins_of_the_other_half():
    rng = np.random.default_rng(1)
    toxic = np.arange(400) % 2 == 0
    hits = np.where(toxic, 1 + np.arange(400) % 3, 0)
    sets = [np.unique(np.concatenate((rng.integers(100, 140, 10), rng.choice(np.arange(7, 13), 2 * h, replace=False), rng.integers(7, 13, 1)))) for h in hits]
    grades = toxicity.derive_grades(sets, toxic, rng.random(400) < 0.5, np.arange(200))
    assert (grades[~toxic] == 0).all() and set(grades[toxic]) == {1, 2, 3}
    assert [grades[hits == h].mean() for h in (1, 2, 3)] == sorted(grades[hits == h].mean() for h in (1, 2, 3))


def test_features_by_hand():
    number, row = quality.features_of(["ab ab", "", "ab"])
    assert set(row) <= {0, 2} and (np.sort(number[row == 2]) == np.unique(number[row == 2])).all()
    again, _ = quality.features_of(["ab ab"])
    assert sorted(again) == sorted(number[row == 0])


def test_a_score_does_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.normal(size=quality.VECTORS + 2).astype(np.float32), 0.1)
    texts = ["one two", "", "x", " a  b\n", "zwei drei vier", "", "é", "one two"]
    assert model.score(texts).tolist() == [model.score([t])[0] for t in texts]


def test_words_and_their_beginnings():
    found = list(toxicity.buckets_of(pa.array(["Vile, VILE vilest", None, "ab"])))
    assert len(found) == 1
    _, bucket, first = found[0]
    rows = [set(bucket[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    alone = [set(b.tolist()) for _, b, _ in toxicity.buckets_of(pa.array(["vile"]))][0]
    assert rows[1] == set() and alone <= rows[0] and len(rows[2]) == 1


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_accuracy_on_the_synthetic_tables(spark, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    if label == "toxic":
        half = labels.where("pmod(xxhash64(doc_id), 2) = 0")
        rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").select("doc_id", "toxic").withColumnRenamed("toxic", "label")
        found = toxicity.severity(docs, toxicity.train(docs, half)).drop(RID).join(rest, "doc_id").collect()
        assert np.mean([r["toxic"] == bool(r["label"]) for r in found]) > 0.95
    else:
        found = quality.score(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
        good, poor = [r["score"] for r in found if r["quality"]], [r["score"] for r in found if not r["quality"]]
        assert np.mean([[a > b for b in poor] for a in good]) > 0.85
