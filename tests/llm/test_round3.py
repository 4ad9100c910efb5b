"""Ranked search, source divergence and near vectors against plain forms."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import divergence, near_vectors, search, words
from gridlore.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, oracle_rows, rows_of


@pytest.mark.parametrize("name", ["op11_wand_search", "op12_source_divergence"])
def test_matches_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def _oracle(sql, tmp_path, **tables):
    folder = tmp_path / "tables"
    folder.mkdir(exist_ok=True)
    for name, df in tables.items():
        df.toPandas().astype({"doc_id": "Int64"} if name == "documents" else {}).to_parquet(folder / f"{name}.parquet")
    return oracle_rows(sql, str(folder))


# --- ranked search ------------------------------------------------------------------------------------

ITEM = "item_id long, text string"


def plain_search(rows, items, top=10):
    terms = {k: re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, (_, t) in enumerate(rows)}
    terms = {k: t for k, t in terms.items() if t}
    n_docs, length = len(terms), sum(map(len, terms.values()))
    counts = {k: Counter(t) for k, t in terms.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        found = []
        for k, c in counts.items():
            m = 10 + (90 * len(terms[k]) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(search.terms(text or "")) if t in c)
            if score > 0:
                found.append((-score, rows[k][0] is None, rows[k][0] or 0, k))
        out += [(item, r + 1, rows[k][0], -s) for r, (s, _, _, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def _hits(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_equals_plain_search_over_many_shards(docs, stored, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    p = 1 / np.arange(1, 201)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    rows = [(int(k), text(int(rng.integers(1, 60)))) for k in rng.permutation(900)] + [(900 + k, "w1 w150 w151") for k in range(40)]
    items = [(k, text(12)) for k in range(20)] + [(20, "w150 w151"), (21, "never said"), (22, None), (20, "w150 w151")]
    monkeypatch.setattr(search, "DOCS", 100)  # bounds are read on the driver and travel with the function
    found = search.search(docs(rows), stored(items, ITEM))
    assert _hits(found) == plain_search(rows, items)
    assert _hits(search.search(docs(rows), stored(items, ITEM), top=3, block=7)) == plain_search(rows, items, 3)


def test_search_of_odd_rows(docs, stored, odd_rows, tmp_path):
    items = [(1, "same TEXT here"), (2, "ünï 漢字"), (3, "alpha, beta; word"), (4, ""), (5, "b a"), (None, "x" * 50_000)]
    t, i = docs(odd_rows), stored(items, ITEM)
    found = search.search(t, i)
    assert _hits(found) == plain_search(odd_rows, items)
    assert _hits(found)[0][3] > 0 and len({r["__rid"] for r in found.where("item_id = 1").collect()}) == 3  # repeated rows are hits each
    names, rows = _oracle(search.OP11_SQL, tmp_path, documents=t, benchmark=i)
    assert rows == rows_of(names, [tuple(r[c] for c in names) for r in found.collect()])[1]


def test_search_of_empty_tables_and_clashing_columns(docs, stored):
    one = stored([(1, "a b", "x", 5)], "doc_id long, text string, score string, n long")
    assert search.search(docs([]), stored([(1, "a")], ITEM)).count() == 0
    assert search.search(one, stored([], ITEM)).count() == 0
    assert _hits(search.search(one, stored([(1, "a", 3)], ITEM + ", rank int"))) == plain_search([(1, "a b")], [(1, "a")])


def test_terms_in_bytes_are_terms_in_characters():
    texts = ["Ab-c ÇD e 漢字,x9 \x00_q", "", "no end", "z" * 70_000 + " A"]
    data, rows = words.utf8(pa.array(texts))
    start, end = search.spans(data, rows)
    lower = search._LOWER[data]
    assert [bytes(lower[a:b]).decode() for a, b in zip(start, end, strict=True)] == [w for t in texts for w in search.terms(t)]


def test_pivots_skip_documents():
    """Documents that only have frequent terms are not scored once the heap is full."""
    rng = np.random.default_rng(2)
    n = 20_000
    common = (np.arange(n), rng.integers(50, 100, n), 100)
    rare_at = np.sort(rng.choice(n, 400, replace=False))
    rare = (rare_at, rng.integers(900, 1000, 400), 1000)
    doc, score, scored = search.wand([common, rare], n, 10)
    full = common[1].copy()
    full[rare_at] += rare[1]
    best = np.lexsort((np.arange(n), -full))[:10]
    assert list(doc) == list(best) and list(score) == list(full[best]) and scored < 2000


# --- divergence ---------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    groups, occ, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        ts = re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(ts)
        occ[lang].update(ts)
        held[lang].update(set(ts))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}

    def share(counts, lang):
        total, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept[lang]}

    out = []
    for (lang, source), counts in groups.items():
        p, q = share(counts, lang), share(occ[lang], lang)
        pairs = [(-sum(abs(p[t] - r[t]) for t in p), other) for (x, other), c in groups.items() if x == lang and other != source for r in [share(c, lang)]]
        terms = [(q[t] - p[t], t) for t in p if counts[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            order = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(order)]
    return sorted(out)


def test_divergence_equals_plain_form(stored):
    rng = np.random.default_rng(3)
    words = ["the", "Of", "été", "漢字", "x-ray", "don't", "α", "Zz", "a1b"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 30)))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "ß", None])) for k in range(400)]
    rows = [(k, t, None if lang == "None" else lang, s) for k, t, lang, s in [(k, str(t), lang and str(lang), s and str(s)) for k, t, lang, s in rows]]
    rows += [(400, None, "de", "s1"), (401, "only here", "de", "s2"), (402, "", "xx", "alone"), (None, "the " * 30_000, "en", "s1"), (7, "the the", "en", "s1"), (7, "the the", "en", "s1")]
    t = stored([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, salt int")
    for least, top in ((30, 50), (2, 3)):
        found = divergence.divergence(t, least, top)
        assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found.collect()) == plain_divergence(rows, least, top)


def test_divergence_of_an_empty_table(docs):
    assert divergence.divergence(docs([])).count() == 0


# --- near vectors -------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>"


def plain_near(rows, threshold=0.9):
    n = len(rows)
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in linked[k] if j not in seen and not seen.add(j)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(linked[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def _found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=repr)


def _vectors(seed, n, dim=24, groups=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    spread = rng.choice([0.0, 0.05, 0.3, 0.45], n)[:, None]
    x = base[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread
    return [(int(k), [float(c) for c in x[i]]) for i, k in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_equal_all_pairs(stored, block):
    rows = _vectors(5, 400)
    found = near_vectors.near_vectors(stored(rows, VEC), block=block)
    assert _found(found) == plain_near(rows)
    assert found.where("first and vec_id <> component_id").count() == 0


def test_odd_vectors(stored):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (None, [1.0, 1.1]), (9, [1.0, 1.0, 0.0]), (10, [1e-30, 1e-30]), (11, [-1.0, -1.0]), (None, [-3.0, 3.0]), (None, [-3.0, 3.0]), (12, [3e38, 3e38]), (13, [5.0]), (14, [-5.0])]
    found = near_vectors.near_vectors(stored([(*r, 1, "x") for r in rows], VEC + ", n_links int, node string"))
    assert _found(found) == plain_near(rows)
    assert found.where("first").count() == len({(r[2] if r[2] is not None else f"none {k}") for k, r in enumerate(plain_near(rows)) if r[2] is not None}) + 1
    assert near_vectors.near_vectors(stored([], VEC)).count() == 0


def test_keep_one(stored):
    rows = _vectors(6, 120)
    kept = near_vectors.keep_one(stored(rows, VEC))
    assert sorted(r["vec_id"] for r in kept.collect()) == sorted({c for _, _, c in plain_near(rows)})


def test_doubles_and_wide_vectors(stored):
    rows = [(k, v) for k, v in _vectors(7, 60, dim=300)]
    t = stored(rows, "vec_id string, embedding array<double>".replace("string", "long"))
    assert [r[1:] for r in _found(near_vectors.near_vectors(t))] == [r[1:] for r in plain_near(rows)]


def test_tables_reach_the_recall():
    for nodes in (1, 1000, 50_000, 10**9):
        tables, bits = near_vectors.choose_tables(nodes)
        hit = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - hit) ** tables >= 0.9999 and 4 <= bits <= 24


def test_codes_do_not_depend_on_the_batch():
    x = np.random.default_rng(8).normal(size=(500, 64))
    whole = near_vectors.codes(x, 33, 9)
    parts = np.concatenate([near_vectors.codes(x[k : k + 7], 33, 9) for k in range(0, 500, 7)])
    assert (whole == parts).all()


def test_query_equals_all_pairs(spark, sf):
    found = QUERIES["op13_sign_hash_dedup"](spark, sf)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert _found(found) == plain_near(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.collect())
