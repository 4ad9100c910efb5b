import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from gridlore.llm import packing, toxicity
from gridlore.llm.common import RID, table
from tests.llm.test_joins import brute, cut, plain_spans
from tests.llm.test_packing import plain_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage of the pipeline leaves of sf0.001, in the order of the stored table."""
    sf = "/root/testdata/sf0.001"
    found = [table(spark, sf, "documents")]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], sf).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_stages_but_the_last_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near copies", "passages", "mix", "packing"]


def test_toxic_rows_go(spark, stages):
    sf = "/root/testdata/sf0.001"
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    gone = {r[RID] for r in toxicity.severity(stages[0], model).where("toxic").collect()}
    assert stages[1].count() == stages[0].count() - len(gone) and gone


def test_one_of_each_class_stays(stages):
    before, after = rows_of(stages[1]), Counter(d for d, _ in rows_of(stages[2]))
    classes = brute(before)
    label = {}
    expected = Counter()
    for doc, cls, _ in classes:
        label.setdefault(cls, []).append(doc)
    blank = {d for d, t in before if not WORD.search(t or "")}
    for cls, docs in label.items():
        expected += Counter(docs) if docs[0] in blank else Counter([min(docs)])
    assert after == expected


def test_passages_are_cut(stages):
    before, after = rows_of(stages[2]), dict(rows_of(stages[3]))
    for (doc, text), spans in zip(before, plain_spans(before, line=30), strict=True):
        left = cut(text or "", spans)
        if spans and not WORD.search(left):
            assert doc not in after
        else:
            assert after[doc] == (left if spans else text)
    lengths = {r["doc_id"]: (r["n_chars"], len(r["text"] or "")) for r in stages[3].collect()}
    assert all(a == b for a, b in lengths.values())


def test_mix_keeps_its_targets(stages):
    size = lambda t: len(WORD.findall(t or ""))
    source, words, taken, copies = {}, Counter(), Counter(), Counter()
    for r in stages[3].collect():
        source[r["doc_id"]] = r["source"]
        words[r["source"]] += size(r["text"])
    for r in stages[4].collect():
        taken[r["source"]] += size(r["text"])
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(words, key=lambda s: (s is None, s)))}
    target, rest, free = {}, 1.5 * sum(words.values()), set(words)
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 2 * words[s]}
        target |= {s: 2 * words[s] for s in over} if over else share
        rest -= sum(2 * words[s] for s in over)
        free -= over or set(free)
    largest = max(size(r["text"]) for r in stages[3].collect())
    assert all(abs(taken[s] - target[s]) <= max(largest, 0.02 * target[s]) for s in words)


def test_packing_holds_all_ids(stages):
    copies, text = Counter(), {}
    for r in stages[4].collect():
        copies[r["doc_id"]] += 1
        text[r["doc_id"]] = r["text"]
    tokens = Counter()
    sequences = defaultdict(int)
    for p in stages[5].collect():
        tokens[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]] += p["length"]
        ids = np.array(plain_ids(text[p["doc_id"]]), "<u4")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert tokens == Counter({d: n * len(plain_ids(text[d])) for d, n in copies.items()})
    assert max(sequences.values()) <= packing.TIERS[0]


def test_stages_of_an_empty_table_and_odd_rows(spark, docs, odd_rows, sf, stored):
    for rows in ([], odd_rows):
        now = docs(rows)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, now, sf).collect()
            now = stored(out, now.schema)
        assert cp.pack(spark, now, sf).count() >= (1 if rows else 0)


def test_run_writes_and_rereads_between_stages(spark, sf, monkeypatch):
    seen = []

    def even(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.where("doc_id % 2 = 0")

    monkeypatch.setattr(cp, "STAGES", [("a", even), ("b", even), ("c", lambda spark, docs, sf_dir: seen.append(docs.inputFiles()) or docs.select("doc_id"))])
    assert cp.run(spark, sf).count() == stored_rows(spark, sf)
    assert not set(seen[0]) & set(seen[1]) and not set(seen[1]) & set(seen[2]) and all(seen)


def stored_rows(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 2 = 0").count()
