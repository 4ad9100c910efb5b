import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.operators import clusters
from gridlore.operators import identity as idn
from tests.plain_identity import fold, match_rows, plain_cards

T0 = datetime(2026, 8, 23, 6)
SCHEMA = (
    "id string, kind string, starts_at timestamp, ends_at timestamp, district string, areas array<string>, area_keys array<string>, scope string,"
    " sources array<struct<name:string,url:string,kind:string>>, published_at timestamp, ingested_at timestamp, confidence string,"
    " continuation boolean, cancelled_at timestamp, cancelled_reason string"
)


def record(id="a", kind="planned", start=0, length=360, district="lefkosa", areas=("Gönyeli", "Hamitköy"), scope="places", official=True, url=None, confidence="high", continuation=False, published=0):
    begin = T0 + timedelta(minutes=start)
    source = ("Utility" if official else "Paper", url or f"https://{'u' if official else 'p'}.example/{id}", "official" if official else "press")
    keys = sorted({a.lower().replace("ö", "o") for a in areas})
    end = None if length is None else begin + timedelta(minutes=length)
    return (id, kind, begin, end, district, list(areas), keys, scope, [source], T0 + timedelta(minutes=published), T0, confidence, continuation, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pair(spark, a, b):
    return bool(idn.same_event_pairs(frame(spark, [record("a", **a)]), frame(spark, [record("b", **b)])).count())


@pytest.mark.parametrize(
    "a, b, same",
    [
        ({}, {"areas": ("Gonyeli",)}, True),
        ({}, {"start": 15}, True),
        ({}, {"start": 16}, False),
        ({}, {"district": "girne"}, False),
        ({}, {"areas": ("Alsancak",)}, False),
        ({}, {"length": None}, False),
        ({"length": None}, {"length": None, "start": 15}, True),
        ({"length": None, "kind": "fault"}, {"length": None, "kind": "fault", "start": 360}, True),
        ({"length": None, "kind": "fault"}, {"length": None, "kind": "fault", "start": 361}, False),
        ({"length": None, "kind": "fault"}, {"length": None, "kind": "fault", "start": 26 * 60}, False),
        ({"length": None, "kind": "fault"}, {"length": None, "kind": "fault", "start": 26 * 60, "continuation": True}, True),
        ({"areas": ()}, {}, True),
        ({"areas": ()}, {"start": 5}, False),
    ],
)
def test_same_event(spark, a, b, same):
    assert pair(spark, a, b) is same
    rows = frame(spark, [record("a", **a), record("b", **b)])
    assert idn.dedupe(rows).count() == (1 if same else 2)


def test_merge_takes_facts_of_the_official_record(spark):
    rows = frame(spark, [record("a", official=False, areas=("GONYELI",), published=9), record("b", start=10, areas=("Gönyeli", "Hamitköy"), scope="district", confidence="low")])
    r = idn.dedupe(rows).first()
    assert r["id"] == "a" and r["starts_at"] == T0 + timedelta(minutes=10)
    assert r["areas"] == ["GONYELI", "Hamitköy"] and r["scope"] == "district" and r["confidence"] == "high"
    assert [s["kind"] for s in r["sources"]] == ["official", "press"] and r["published_at"] == T0
    assert r["n_members"] == 2 and {tuple(m) for m in idn.membership(rows).collect()} == {("a", "a"), ("b", "a")}


def _plain(rows):
    names = [c.split()[0] for c in SCHEMA.replace("name:string,url:string,kind:string", "").split(", ")]
    plain = []
    for r in rows:
        d = dict(zip(names, r, strict=True))
        d["sources"] = [dict(zip(("name", "url", "kind"), s, strict=True)) for s in d["sources"]]
        d |= {"area_folds": [a.lower() for a in d["areas"]], "source_keys": [s["url"].removeprefix("https://") for s in d["sources"]], "members": [d["id"]]}
        plain.append(d | {"keys": set(d["area_folds"])})
    return plain


_SHOWN = ("id", "kind", "starts_at", "ends_at", "district", "scope", "published_at", "ingested_at", "confidence", "continuation")


def _shown(r, n):
    return (*(r[c] for c in _SHOWN), tuple(r["areas"]), tuple(s["url"] for s in r["sources"]), n)


def _random(rng, n, starts, ids=None, articles=None):
    names = ["Alfa", "Beta", "Gama", "Delta"]
    return [
        record(
            (ids or (lambda: f"{rng.randrange(10**6):06d}{k}"))(), rng.choice(["planned", "fault"]), starts(), rng.choice([None, 60, 70, 200]), rng.choice(["girne", "lefke"]),
            tuple(rng.sample(names, rng.choice([0, 1, 1, 2, 3]))), official=rng.random() < 0.3, continuation=rng.random() < 0.2, published=rng.randrange(9), confidence=rng.choice(["high", "low"]),
            url=f"https://p.example/{rng.randrange(articles)}" if articles else None,
        )
        for k in range(n)
    ]


@pytest.mark.parametrize("seed, together", [(0, 10_000), (1, 10_000), (2, 10_000), (3, 10_000), (2, 25), (3, 25)])
def test_rounds_equal_the_fold(spark, seed, together, monkeypatch):
    monkeypatch.setattr(clusters, "TOGETHER", together)
    rng = random.Random(seed)
    starts = (lambda: rng.choice([0, 5, 10, 20, 400, 4000, 9000]) + rng.randrange(12)) if seed % 2 else (lambda: rng.randrange(1500))
    rows = _random(rng, 150, starts, articles=40 if seed > 1 else None)
    plain = _plain(rows)
    rng.shuffle(rows)
    found = idn.dedupe(frame(spark, rows)).collect()
    assert sorted(map(str, (_shown(r, r["n_members"]) for r in found))) == sorted(map(str, (_shown(e, len(e["members"])) for e in fold(plain))))
    events = {m: e["id"] for e in fold(plain) for m in e["members"]}
    assert {r["id"]: r["event"] for r in idn.membership(frame(spark, rows)).collect()} == events


@pytest.mark.parametrize("seed, together", [(0, 10_000), (1, 10_000), (2, 20)])
def test_rounds_equal_the_fold_into_stored_rows(spark, seed, together, monkeypatch):
    monkeypatch.setattr(clusters, "TOGETHER", together)
    rng = random.Random(10 + seed)
    starts = lambda: rng.randrange(900)
    stored = _random(rng, 60, starts, articles=30)
    known = [r[0] for r in stored]
    incoming = _random(rng, 60, starts, ids=lambda: rng.choice(known) if rng.random() < 0.2 else f"{rng.randrange(10**6):06d}x", articles=30)
    incoming = list({r[0]: r for r in incoming}.values())
    found = idn.store(frame(spark, incoming), frame(spark, stored)).collect()
    expected = [e for e in fold(_plain(incoming), _plain(stored)) if e["touched"]]
    assert sorted(str((*_shown(r, r["n_members"]), r["created"])) for r in found) == sorted(str((*_shown(e, len(e["members"])), e["created"])) for e in expected)


def test_one_event_of_most_records(spark, monkeypatch):
    """An open fault that falls back and back, with a third of all rows: no block and no event is gathered."""
    monkeypatch.setattr(clusters, "TOGETHER", 50)
    rng = random.Random(4)
    rows = [record(f"{k:05d}", "fault", 60 * 24 * 10 - 3 * k, None, "girne", ("Alfa",), official=False) for k in range(400)]
    rows += [record(f"x{k:05d}", "fault", rng.randrange(60 * 24 * 10), None, "girne", ("Beta", "Gama")[k % 2 :], official=False) for k in range(300)]
    found = idn.dedupe(frame(spark, rows)).collect()
    assert sorted(map(str, (_shown(r, r["n_members"]) for r in found))) == sorted(map(str, (_shown(e, len(e["members"])) for e in fold(_plain(rows)))))
    assert max(r["n_members"] for r in found) == 400


def test_dense_times_settle_in_few_rounds(spark, monkeypatch):
    """Some ten records near each: decisions hang on each other over two days, rounds hang on tiles only."""
    monkeypatch.setattr(clusters, "TOGETHER", 20)
    rounds, written = [], clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, kind: rounds.append(kind) or written(df, kind))
    rng = random.Random(6)
    names = [f"Yer {k}" for k in range(8)]
    rows = [
        record(f"{rng.randrange(10**6):06d}{k}", "planned", rng.randrange(2880), rng.choice([60, 70, 80, 90]), "girne", tuple(rng.sample(names, 2)), official=rng.random() < 0.2, url=f"https://p.example/{k % 60}")
        for k in range(1500)
    ]
    found = {r["id"]: r["event"] for r in idn.membership(frame(spark, rows)).collect()}
    assert found == {m: e["id"] for e in fold(_plain(rows)) for m in e["members"]}
    assert sum(kind in ("folded", "assigned") for kind in rounds) <= 6


def test_repeated_ids_and_no_records(spark):
    assert idn.dedupe(frame(spark, [])).count() == idn.store(frame(spark, []), frame(spark, [record("s")])).count() == 0
    twice = [record("a", url="https://p.example/1"), record("a", url="https://p.example/2"), record("a", url="https://p.example/2"), record("b", district="girne", areas=())]
    rows = {r["id"]: r for r in idn.dedupe(frame(spark, twice)).collect()}
    assert len(rows["a"]["sources"]) == 2 and rows["a"]["n_members"] == 3 and rows["b"]["areas"] == []


def test_store(spark):
    stored = frame(spark, [record("s1"), record("s2", start=5000)])
    incoming = frame(spark, [record("n1", start=5), record("n2", start=900, areas=("Alsancak",)), record("s2", start=99000)])
    rows = {r["id"]: r for r in idn.store(incoming, stored).collect()}
    assert set(rows) == {"s1", "n2", "s2"}
    assert (rows["s1"]["created"], rows["n2"]["created"], rows["s2"]["created"]) == (False, True, False)
    cancelled = stored.withColumn("cancelled_at", F.lit(T0))
    assert {(r["id"], r["created"]) for r in idn.store(frame(spark, [record("n1")]), cancelled).collect()} == {("n1", True)}


def test_siblings_depend_on_direction(spark):
    rows = frame(spark, [record(k, "fault", 4 * n, None, d, scope="district") for n, (k, d) in enumerate([("a", "girne"), ("b", "lefke"), ("c", "iskele")])])
    cards = lambda desc: sorted((r["lead"], tuple(r["siblings"])) for r in idn.group_siblings(rows, desc).collect())
    assert cards(False) == [("a", ("b",)), ("c", ())]
    assert cards(True) == [("a", ()), ("b", ("c",))]


@pytest.mark.parametrize("descending", [False, True])
def test_cards_without_any_gap(spark, descending):
    """A start a minute or two, days on end, and a third of all rows at one of them."""
    rng = random.Random(5)
    rows = [record(f"{k:05d}", rng.choice(["fault", "planned"]), 2 * k + rng.randrange(2), rng.choice([None, 60, 90]), rng.choice(["girne", "lefke"]), scope="district") for k in range(600)]
    rows += [record(f"x{k:05d}", "fault", 700, rng.choice([60, 90]), "iskele", scope="district") for k in range(200)]
    rows += [record(f"y{k}", "rotating", 5 * k + (k > 6), None, "girne", scope="district") for k in range(12)]
    found = idn.group_siblings(frame(spark, rows), descending).collect()
    assert sorted((r["lead"], r["kind"], tuple(r["districts"]), tuple(r["siblings"])) for r in found) == plain_cards(_plain(rows), descending)


def test_open_records_lead(spark):
    rows = frame(spark, [record("a", "fault", 0, None, "girne", scope="district"), record("b", "fault", 0, 60, "lefke", scope="district"), record("c", "fault", 2, None, "guzelyurt", scope="district")])
    card = idn.group_siblings(rows).first()
    assert (card["lead"], card["districts"]) == ("a", ["lefke", "guzelyurt"])


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.paper.example/c35-X/n611748-one-slug", "paper.example#611748"),
        ("https://paper.example/c35-X/n611748-other", "paper.example#611748"),
        ("https://www.daily.example/title-176634h.htm", "daily.example#176634"),
        ("https://www.site.example/a-story", "site.example/a-story"),
        ("not a url at all", "not a url at all"),
    ],
)
def test_article_key(spark, url, key):
    assert spark.range(1).select(idn.article_key(F.lit(url)).alias("k")).first()["k"] == key


def test_sources(spark):
    s = [("A", "https://a.example/n1-x", "press"), ("B", "https://b.example/n1-x", "press"), ("A", "https://www.a.example/n1-y", "press"), ("A", "https://a.example/z", "official")]
    df = spark.createDataFrame([(s,)], "s array<struct<name:string,url:string,kind:string>>")
    row = df.select(idn.dedupe_sources(F.col("s")).alias("d"), idn.label_sources(F.col("s")).alias("l"), idn.area_union(F.array(F.lit("Gönyeli")), F.array(F.lit("GONYELI"), F.lit("Lapta"))).alias("u")).first()
    assert [x["url"] for x in row["d"]] == [s[0][1], s[1][1], s[3][1]]
    assert row["l"] == ["A (1)", "B", "A (2)", "A (3)"]
    assert row["u"] == ["Gönyeli", "Lapta"]


def test_fold_key_of_area_keys(spark):
    assert spark.range(1).select(tx.fold_key(F.lit("Gönyeli"))).first()[0] == "gonyeli"


def test_pairs_over_a_dense_month_equal_all_pairs(spark):
    """An event every other minute: candidates meet in slots of time, and none is lost at a slot's edge."""
    rng = random.Random(3)
    places = [f"Yer {k}" for k in range(12)]
    rows = [
        record(f"r{k:05}", kind=rng.choice(["planned", "fault"]), start=2 * k + rng.randrange(3), length=rng.choice([None, 30, 40]), areas=tuple(rng.sample(places, rng.choice([1, 2]))), continuation=rng.random() < 0.02)
        for k in range(700)
    ]
    t = frame(spark, rows)
    found = {tuple(r) for r in idn.same_event_pairs(t, t).where("a < b").collect()}
    plain = [dict(zip(("id", "kind", "starts_at", "ends_at", "keys", "continuation"), (r[0], r[1], r[2], r[3], set(r[6]), r[12]))) for r in rows]
    assert found == {(a["id"], b["id"]) for a in plain for b in plain if a["id"] < b["id"] and match_rows(a, b)}


def test_articles_and_labels_of_a_group_of_any_size(spark):
    """As ``dedupe_sources`` and ``label_sources``, with steps in proportion to the sources."""
    n = 30_000
    s = spark.range(n).selectExpr("'g' as g", "id as k", "struct('Outlet ' || id % 7 as name, 'https://www.o.example/n' || id % 500 || '-' || id as url) as s")
    s = s.union(spark.sql("select 'h', 3L, struct('A', 'https://a.example/x') union all select 'h', 1L, struct('B', 'https://b.example/x') union all select 'h', 2L, struct('A', 'https://www.a.example/x/')"))
    rows = {r["g"]: r for r in idn.articles_of(s, ["g"], "k").collect()}
    assert rows["g"]["articles"] == [f"o.example#{k}" for k in range(500)] and rows["g"]["n"] == 500
    assert rows["h"]["articles"] == ["b.example/x", "a.example/x"]
    labels = {r["g"]: r["labels"] for r in idn.labels_of(s, ["g"], "k").collect()}
    assert labels["g"] == [f"Outlet {k % 7} ({k // 7 + 1})" for k in range(n)]
    assert labels["h"] == ["B", "A (1)", "A (2)"]


def test_pairs_come_once_and_meet_within_a_column(spark):
    """Two places in common, continued open faults and equal records without places: no pair comes twice."""
    both = dict(areas=("Gönyeli", "Hamitköy", "Lapta"))
    rows = [record(f"r{k}", "fault", 5 * k, None, continuation=k < 2, **both) for k in range(4)] + [record(f"s{k}", start=5 * k, **both) for k in range(3)] + [record(f"t{k}", start=9000, areas=()) for k in range(2)]
    t = frame(spark, rows)
    pairs = [tuple(r) for r in idn.same_event_pairs(t, t).collect()]
    assert len(pairs) == len(set(pairs)) == 16 + 9 + 4
    left, right = t.withColumn("article", F.substring("id", 2, 1)), t.withColumn("article", F.when(F.col("id") == "r1", "3").otherwise("none"))
    assert {r["id"] for r in idn.in_same_event(left, right, within=["article"]).collect()} == {"r3"}
    assert {r["id"] for r in idn.in_same_event(t, t.where("id in ('r1', 't0')")).collect()} == {"r0", "r1", "r2", "r3", "t0", "t1"}
