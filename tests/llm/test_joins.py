import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridlore.llm import ngram_join as nj
from gridlore.llm import passages as ps
from gridlore.llm import sharding as sh
from gridlore.llm.components import connected_components
from gridlore.llm.words import Words


def grams(text, n=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """{index: (class id, links)} by comparing all rows."""
    sets = [grams(t) for _, t in rows]
    near = [[i != j and bool(a and b) and len(a & b) >= threshold * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, min(ids, default=None) if sets[i] else doc, sum(near[i])))
    return sorted(out, key=repr)


def near_copies(seed, families=6, members=8, words=80):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("block", [768, 3])
def test_ngram_join_equals_brute_force(docs, seed, block):
    rows = near_copies(seed)
    found = nj.ngram_join(docs(rows), block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_ngram_join_on_odd_rows(docs, odd_rows):
    rows = [*odd_rows, (40, "a b c d"), (41, "a b  c\nd"), (42, "a b c d e")]
    found = nj.ngram_join(docs(rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)
    assert nj.ngram_join(docs([])).count() == 0


def test_keep_one(docs, odd_rows):
    rows = near_copies(3, families=3) + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)] + [(0, "x y z x y z")] * 3
    t = docs(rows)
    kept = nj.keep_one(t).collect()
    sets = brute([(k, t) for k, (_, t) in enumerate(rows)])
    assert len(kept) == len({c for _, c, _ in sets})
    assert nj.keep_one(docs([])).count() == 0


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.9999), (0.8, 0.99), (0.5, 0.95), (1.0, 0.9)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = nj.choose_bands(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall - 1e-12 and bands * rows <= 128


def test_links_of_rectangles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    whole = nj.links_of(sets, 20, 0.5)
    exact = np.array([[len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (whole == exact).all() and (nj.links_of(sets, 7, 0.5) == exact[:7, 7:]).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(5, 5), (None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "u int, v int"))
    assert {r["node"]: r["component"] for r in found.collect()} == label and found.count() == len(label)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def check_shards(rows, n, shards=8):
    assert len(rows) == n
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)]
    assert all(x == list(range(len(x))) for x in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


@pytest.mark.parametrize("hot", [0, 300, 700])
def test_shards(docs, hot):
    rng = random.Random(hot)
    rows = [(k, "hot" if k < hot else f"t{rng.randrange(500)}") for k in range(900)]
    placed = sh.shard_documents(docs(rows)).collect()
    check_shards(placed, 900)
    by_text: dict = {}
    text = dict(rows)
    for r in placed:
        by_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    split = [t for t, s in by_text.items() if len(s) > 1 and t != "hot"]
    assert len(split) <= 0.02 * len(by_text)
    if hot:
        assert len(by_text["hot"]) <= -(-hot * 8 // 900) + 2
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 for r in placed)


def test_shards_do_not_depend_on_how_the_table_is_stored(stored):
    rng = random.Random(11)
    texts = ["hot"] * 200 + [f"t{rng.randrange(300)}" for _ in range(700)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    found = []
    for files in (2, 5):
        rng.shuffle(rows)
        placed = sh.shard_documents(stored(rows, files=files)).collect()
        found.append(sorted((texts[r["doc_id"]], r["shard"]) for r in placed))
    assert found[0] == found[1]


def test_groups_are_whole_where_rows_without_copies_leave_room(docs):
    rows = [(k, f"g{k // 6}" if k < 600 else f"single {k}") for k in range(800)]
    by_text: dict = {}
    placed = sh.shard_documents(docs(rows)).collect()
    check_shards(placed, 800)
    for r in placed:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert max(map(len, by_text.values())) == 1


def plain_cut(vertices, label):
    """Shares of neighbours that are elsewhere, by weight, over all vertices and keys: by pairs."""
    total = 0
    for v in vertices:
        for key in v["keys"]:
            others = [u for u in vertices if key in u["keys"] and (u["sig"], u["piece"]) != (v["sig"], v["piece"])]
            n = sum(u["w"] for u in others)
            total += v["w"] * sum(u["w"] for u in others if label[u["sig"]] != label[v["sig"]]) / max(n, 1)
    return total


def test_propagation_shrinks_the_cut_under_quotas(stored):
    rng = random.Random(3)
    rows = [(f"s{k:03d}", 0, rng.choice((1, 1, 2, 5)), [f"s{k:03d}", "everywhere", f"g{k % 24}", f"h{k % 24 // 2}"], rng.randrange(4)) for k in range(240)]
    table = stored(rows, "sig string, piece long, w long, keys array<string>, label int")
    vertices, total = [r.asDict() for r in table.collect()], sum(r[2] for r in rows)
    found = {r["sig"]: r for r in sh.propagate(table, sh._capacities(total, 4)).collect()}
    assert {k: (r["w"], r["keys"]) for k, r in found.items()} == {r[0]: (r[2], r[3]) for r in rows}
    before, after = (plain_cut(vertices, x) for x in ({r[0]: r[4] for r in rows}, {k: r["label"] for k, r in found.items()}))
    assert after < 0.8 * before
    sizes = [sum(r["w"] for r in found.values() if r["label"] == s) for s in range(4)]
    first = [sum(r[2] for r in rows if r[4] == s) for s in range(4)]
    assert all(n <= max(f, total / 4 + 1) + 5 * 12 for n, f in zip(sizes, first, strict=True))


def test_different_texts_with_a_line_in_common_are_linked(docs):
    lines = [f"This line of family {k} stands in several texts." for k in range(30)]
    rows = [(k, f"Own words {k} here.\n{lines[k % 30]}\nshort one\n{lines[k % 30 // 3]}") for k in range(600)] + [(600 + k, f"Own words {k} here.\n{lines[k % 30]}") for k in range(5)]
    found = sh.shared_lines(docs(rows).select(F.md5("text").alias("sig"), "text")).collect()
    holders = {x: {t for _, t in rows if x in t.split("\n")} for x in {x for _, t in rows for x in t.split("\n")}}
    expected = sum(len(t) for x, t in holders.items() if len(t) > 1 and len(x.split()) >= sh.LINK_WORDS)
    assert len(found) == len({(r["sig"], r["key"]) for r in found}) == expected
    placed = sh.shard_documents(docs(rows)).collect()
    check_shards(placed, len(rows))
    family: dict = {}
    for r in placed:
        family.setdefault(r["doc_id"] % 30, []).append(r["shard"])
    together = sum(max(x.count(s) for s in range(8)) for x in family.values())
    assert together > 0.7 * len(rows)  # a random split leaves a quarter of a family in its first shard


def test_shards_of_odd_rows(docs, odd_rows):
    placed = sh.shard_documents(docs(odd_rows)).collect()
    check_shards(placed, len(odd_rows))
    assert sorted(r["size"] for r in placed if r["doc_id"] in (1, 2)) == [1, 1]
    assert sh.shard_documents(docs([])).count() == 0


def test_propagation_over_several_keys(spark, stored):
    rng = random.Random(7)
    members = [(r, f"g{r % 40}") for r in range(400)] + [(r, f"h{r % 40 // 2}") for r in range(0, 400, 3)]
    rows = stored([(r,) for r in range(400)], "__rid long")
    table = stored(sorted(members, key=lambda _: rng.random()), "__rid long, key string")
    placed = {r["__rid"]: r["shard"] for r in sh.shard_rows(rows, table, 8).collect()}
    parts = lambda label: sum(len({label[r] for r, k in members if k == key}) - 1 for key in {k for _, k in members})
    assert len(placed) == 400 and parts(placed) < 0.4 * parts({r: rng.randrange(8) for r in range(400)})
    counts = [list(placed.values()).count(s) for s in range(8)]
    assert max(counts) - min(counts) <= 1


PASSAGE = "Mora tal ena vish. Kor plen dax mi sol. Ran tek lum ora pez nik. Gal fen rus bo til quar zet. Hin jas kel vom pru. Tor ban ile wox mur. Sep dal fi ron ked ush amo. Vil tas nor pim gel. Bru hok jen das ul tevi. Lom kir."


def words(rng, n):
    return " ".join(f"q{rng.randrange(10**5)}" for _ in range(n))


def picked(word):
    """Whether a word begins a new sentence in a long one."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words.of(data, np.array([0, len(data)])).hashes()[0]) % 8 == 0


def plain_spans(rows, least=30, line=1, unit=3, chain=12, long=24):
    """The same rule on lists of words."""
    import re

    seen, out = set(), []
    for k, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        low = [m.group().lower() for m in found]
        cuts = [i for i, m in enumerate(found) if not i or "\n" in text[found[i - 1].end() : m.start()]]
        lines = {(a, b) for a, b in zip(cuts, [*cuts[1:], len(found)]) if b - a >= line}
        starts = [i for i, m in enumerate(found) if i in cuts or found[i - 1].group()[-1] in ".!?" or m.group()[0] != low[i][0]]
        for a, b in list(zip(starts, [*starts[1:], len(found)])):
            starts += [i for i in range(a + 1, b) if b - a > long and picked(low[i])]
        starts.sort()
        units = [(a, b) for a, b in zip(starts, [*starts[1:], len(found)]) if b - a >= unit]
        chains = set(lines)
        for i, (a, b) in enumerate(units):
            chains |= {(a, next((e for _, e in units[i:] if e - a >= chain), None))}
            chains |= {(next((s for s, _ in units[i::-1] if b - s >= chain), None), b)}
        gone = []
        for a, b in sorted(c for c in chains if None not in c):
            key = tuple(low[a:b])
            if key in seen and gone and a <= gone[-1][1]:
                gone[-1] = (gone[-1][0], max(b, gone[-1][1]), gone[-1][2] + [(a, b)] * ((a, b) in lines))
            elif key in seen:
                gone.append((a, b, [(a, b)] * ((a, b) in lines)))
            seen.add(key)
        spans = [s for a, b, own in gone for s in ([(a, b)] if b - a >= least else own)]
        out.append((k, [(found[a].start(), found[b - 1].end()) for a, b in spans]))
    return [s for _, s in sorted(out)]


def cut(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


@pytest.mark.parametrize(("seed", "line"), [(0, 30), (1, 1)])
def test_passages_equal_plain_form(docs, seed, line):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        parts = [words(rng, 20), PASSAGE if k % 3 else PASSAGE.replace(" ", "  "), words(rng, 10)] if k % 2 else [words(rng, 40)]
        if k % 5 == 0:
            parts.append("É" + PASSAGE + "\n" + PASSAGE)
        rows.append((k, ("\n" if k % 4 else " ").join(parts)))
    t = docs(rows)
    found = {r["doc_id"]: r for r in ps.dedup_passages(t, line_words=line).collect()}
    for (doc, text), spans in zip(rows, plain_spans(rows, line=line), strict=True):
        assert [(s["begin"], s["end"]) for s in found[doc]["spans"] or []] == spans, doc
        assert found[doc]["text"] == cut(text, spans)
    holders = [d for d, r in found.items() if "pez nik" in (r["text"] or "").lower() and "vom pru" in r["text"].lower()]
    assert len(holders) <= 2


def test_passages_of_odd_rows(docs, odd_rows):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [*odd_rows, (50, long), (51, long), (52, f"{long}. Other words here stay"), (None, long)]
    found = ps.dedup_passages(docs(rows)).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[50][0]["text"] == long and by_id[51][0]["text"] == "" and by_id[1][0]["text"] is None
    assert [s["kept_in"] for s in by_id[51][0]["spans"]] == [50]
    assert sorted(r["text"] for r in by_id[None]) == ["", "alpha beta"]
    assert sorted(r["text"] for r in by_id[6]) == ["", "same text here"]
    assert by_id[7][0]["text"] == ""
    longer = ps.dedup_passages(docs(rows), line_words=30).where("doc_id = 6").collect()
    assert [r["text"] for r in longer] == ["same text here"] * 2  # too short to be a passage
    assert ps.dedup_passages(docs([])).count() == 0


def test_repeated_rows_are_later_occurrences(docs):
    long = " ".join(f"w{k}" for k in range(40))
    assert sorted(r["text"] for r in ps.dedup_passages(docs([(1, long)] * 3)).collect()) == ["", "", long]


def test_no_line_is_left_twice_and_no_other_word_goes(docs):
    rng = random.Random(4)
    stock = ["Five words in this line.", "two words", "x", "Read more about it here and there"]
    rows = [(k, "\n".join(rng.choice([rng.choice(stock), rng.choice(stock).upper(), words(rng, 7)]) for _ in range(6))) for k in range(60)]
    found = {r["doc_id"]: r["text"] for r in ps.dedup_passages(docs(rows)).collect()}
    lines = lambda text: [x for x in (" ".join(line.lower().split()) for line in text.split("\n")) if x]
    left = [x for _, text in sorted(found.items()) for x in lines(text)]
    assert len(left) == len(set(left)) and set(left) == {x for _, text in rows for x in lines(text)}


def test_passage_without_boundaries_in_other_text(docs):
    rng = random.Random(9)
    shared = words(rng, 120)
    rows = [(k, f"{words(rng, 40)} {shared} {words(rng, 40)}") for k in range(5)]
    found = ps.dedup_passages(docs(rows)).orderBy("doc_id").collect()
    assert found[0]["text"] == rows[0][1]
    for r, (_, text) in zip(found[1:], rows[1:]):
        own = set(text.split()) - set(shared.split())
        assert own <= set(r["text"].split()) and len(r["text"].split()) <= 80 + 40


def test_ids_of_other_types(stored):
    rows = [("b", "one line here\nsecond", 1), ("a", "one line here\nthird", 2), (None, "second", 3)]
    found = {r["doc_id"]: r["text"].strip() for r in ps.dedup_passages(stored(rows, "doc_id string, text string, word int")).collect()}
    assert found == {"a": "one line here\nthird", "b": "second", None: ""}
