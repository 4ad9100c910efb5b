import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridlore.operators import live, places, resolve, totals
from gridlore.operators import store as st
from tests.plain_places import Plain, alike
from tests.test_identity import T0, frame, record

PLACES = [
    ("Küçük Kaymaklı", "lefkosa", ["Kaymaklı Küçük"], 0), ("Gönyeli", "lefkosa", ["GONYELI", "Geunyeli"], 1), ("Boğaz", "iskele", [], 2), ("Girne", "girne", ["Kyrenia"], 3),
    ("Girne Boğazı", "girne", [], 4), ("Lefkoşa", "lefkosa", [], 5), ("Dipkarpaz Yukarı", "iskele", ["Dipkarpazyukari"], 6),
]


@pytest.fixture(scope="module")
def place_rows(spark):
    return spark.createDataFrame(PLACES, "name string, district string, aliases array<string>, ordinal int")


@pytest.fixture(scope="module")
def gazetteer(place_rows):
    return resolve.Gazetteer.of(place_rows)


@pytest.mark.parametrize(
    "text, names",
    [
        ("Yarın Gönyeli'de ve GONYELI'de kesinti", ["Gönyeli"]),
        ("gönyeli küçük harfle", []),
        ("Girne Boğazı bölgesi", ["Girne Boğazı"]),
        ("Girne, Boğaz", ["Girne", "Boğaz"]),
        ("Dipkarpazyukarl tarafı", ["Dipkarpaz Yukarı"]),
        ("", []),
    ],
)
def test_match(spark, gazetteer, text, names):
    found = gazetteer.match(spark.createDataFrame([(text,)], "text string")).first()
    assert [m["name"] for m in (found["found"] if found else [])] == names == [m[0] for m in Plain(PLACES).match(text)]


def matched(spark, gazetteer, lists):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, areas array<string>")
    return [[tuple(m) for m in r["m"]] for r in gazetteer.match_areas(rows, F.col("areas")).orderBy("k").collect()]


def test_match_areas_joins_neighbours(spark, gazetteer):
    found = matched(spark, gazetteer, [["Küçük", "Kaymaklı"], ["Boğaz", "Girne"], ["Girne", "Boğaz"], [], None, ["Boğaz", None], ["Küçük", "Kaymaklı"]])
    assert [[m[0] for m in x] for x in found] == [["Küçük Kaymaklı"], ["Boğaz", "Girne"], ["Girne", "Boğaz"], [], [], ["Boğaz"], ["Küçük Kaymaklı"]]


def test_matching_equals_the_plain_form(spark, gazetteer):
    draw, plain = random.Random(7), Plain(PLACES)
    words = "Küçük Kaymaklı Kaymakli Gönyeli Gonyelı Gonyelx Geunyeli Geunyelı Boğaz Girne Boğazı GIRNE Girne'de Dipkarpazyukarl Dipkarpaz Yukarı Lefkoşa'nın Lefkoşalı bölgesi ve, Ev 12".split(" ")
    lists = [[" ".join(draw.choices(words, k=draw.choice((0, 1, 1, 1, 2, 4, 30)))) for _ in range(draw.choice((1, 2, 3, 5)))] for _ in range(300)]
    assert matched(spark, gazetteer, lists) == [plain.match_areas(x) for x in lists]


def test_an_empty_gazetteer_and_no_texts(spark, gazetteer, place_rows):
    none = resolve.Gazetteer.of(place_rows.limit(0))
    assert matched(spark, none, [["Girne", "Boğaz"]]) == [[]]
    assert matched(spark, gazetteer, []) == []


def test_a_gazetteer_of_any_size_and_long_texts(spark):
    """More names than a task would carry, and a text of 40,000 words."""
    rows = spark.range(150_000).selectExpr("'Town' || upper(substr(sha2(cast(id as string), 256), 1, 12)) as name", "'lefke' as district", "cast(array() as array<string>) as aliases", "id as ordinal")
    names = [r["name"] for r in rows.where("id in (5, 77777, 149999)").orderBy("id").collect()]
    text = "Filler " * 40_000 + f"{names[2]} {names[0][:-1]}Z {names[1]}"
    assert [(m[0], m[2]) for m in matched(spark, resolve.Gazetteer.of(rows), [[text]])[0]] == [(names[2], False), (names[0], True), (names[1], False)]


def test_longer_name_wins_a_key(spark):
    rows = spark.createDataFrame([("Ova", "girne", ["Ovacık"], 0), ("Ovacık Köyü", "lefke", ["Ovacık"], 1), ("Ovacik Koyu", "iskele", ["Ovacık"], 2)], "name string, district string, aliases array<string>, ordinal int")
    assert places.gazetteer(rows).where("key = 'ovacik'").first()["name"] == "Ovacık Köyü"


def test_fuzzy_join_equals_all_pairs(spark):
    keys = [("dipkarpaz yukari mah", 0), ("dipkarpaz yukari mahalle", 1), ("gonyeli", 2), ("yeni bogazici koyu", 3)]
    words = ["dipkarpaz yukari mxh", "dipkarpaz yukari mahalls", "gonyelu", "gonyeli", "yeni bogazicikoyu", "abc"]
    df = places.fuzzy(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(keys, "key string, ordinal int"))
    found = {r["word"]: r["key"] for r in df.collect()}
    expected = {}
    for w in words:
        scores = [(alike(w, k, 0.9), -o, k) for k, o in keys]
        if len(w) >= 5 and max(scores)[0] >= 0.9:
            expected[w] = max(scores)[2]
    assert found == expected and len(found) >= 4


def entry(**more):
    return {"kind": "planned", "date": "2026-08-26", "weekday": None, "start": "09:00", "end": "13:00", "areas": ["Gönyeli"], "cancelled": False, "ongoing": False, "resolved": False} | more


def announcements(spark, *payloads):
    rows = [
        (f"https://p.example/n{k}-x", ("P", f"https://p.example/n{k}-x", "press"), "T", "B", datetime(2026, 8, 26, 5), datetime(2026, 8, 26, 5, 5), p if isinstance(p, str) or p is None else json.dumps({"outages": p}), None)
        for k, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, "url string, source struct<name:string,url:string,kind:string>, title string, body string, published_at timestamp, fetched_at timestamp, payload string, error string")


def test_validation(spark):
    bad = [entry(kind="x"), entry(date="2026-02-31"), entry(weekday="someday"), entry(start="25:00"), entry(areas=[" ", "a"]), entry(areas=None)]
    good = [entry(scope="district", restoredAt="99:99"), entry(weekday="friday", start="9:05", end=None)]
    df = announcements(spark, bad + good, "no json", [], '{"outages": 3}')
    rows = [r["v"] for r in df.orderBy("url").select(resolve.valid_entries(F.col("payload")).alias("v")).collect()]
    assert [len(x) if x is not None else None for x in rows] == [2, None, 0, None]
    assert rows[0][0]["scope"] == "district" and rows[0][0]["restoredAt"] is None and rows[0][1]["scope"] == "places"


def test_announcements_become_records(spark, gazetteer):
    df = announcements(
        spark,
        [entry(areas=["Gönyeli", "Girne Boğazı", "Lefkoşa"], scope="district")],
        [entry(cancelled=True), entry(resolved=True, restoredAt="07:30")],
        [entry(areas=["Mars"]), entry(start=None)],
        [],
        "no json",
        [entry(areas=["Mars"])],
    )
    rows = resolve.resolve_announcements(df, gazetteer).collect()
    first = {r["district"]: r for r in rows if "/n0-" in r["url"]}
    assert first["lefkosa"]["areas"] == ["Gönyeli", "Lefkoşa"] and first["lefkosa"]["scope"] == "district"
    assert first["girne"]["scope"] == "places" and first["girne"]["id"] != first["lefkosa"]["id"] and len(first["girne"]["id"]) == 32
    assert first["girne"]["starts_at"] == datetime(2026, 8, 26, 6)
    second = {r["role"]: r for r in rows if "/n1-" in r["url"]}
    assert set(second) == {"retraction", "resolution"} and second["resolution"]["resolved_at"] == datetime(2026, 8, 26, 4, 30)
    told = {r["url"][18:20]: (r["status"], r["reason"]) for r in resolve.outcomes(df, gazetteer).collect()}
    assert told["n0"] == ("parsed", None) and told["n1"] == ("parsed", None)
    assert told["n2"] == ("failed", "no usable time, and no known place names")
    assert told["n3"] == ("skipped", "no outage in this article") and told["n4"][0] == "failed"
    assert told["n5"] == ("failed", "no known place names found")


def test_extractor_errors_are_rows(spark):
    def extractor(title, body, day):
        if "boom" in body:
            raise ValueError("no answer")
        return json.dumps({"outages": [], "day": day})

    df = spark.createDataFrame([("a", "T", "ok", datetime(2026, 8, 25, 22)), ("b", "T", "boom", datetime(2026, 8, 25, 22))], "url string, title string, body string, published_at timestamp")
    rows = {r["url"]: r for r in resolve.extract(df, extractor).collect()}
    assert rows["b"]["error"] == "no answer" and rows["b"]["payload"] is None
    assert "2026-08-26 Wednesday" in rows["a"]["payload"] and rows["a"]["error"] is None


def test_failures_that_may_pass_are_asked_again(spark):
    waits, calls = [], []

    def flaky(title, body, day):
        calls.append(body)
        if body == "busy" and len(calls) < 3:
            raise resolve.Passing("responded 429")
        if body == "down":
            raise ConnectionError("no route")
        if body == "bad":
            raise ValueError("responded 400")
        return "{}"

    assert resolve.asked(flaky, "t", "busy", "d", waits.append) == ("{}", None) and waits == [1.5, 3.0] and len(calls) == 3
    assert resolve.asked(flaky, "t", "down", "d", waits.append) == (None, "no route") and len(calls) == 6
    assert resolve.asked(flaky, "t", "bad", "d", waits.append) == (None, "responded 400") and len(calls) == 7

    def refuses(title, body, day):
        raise resolve.Passing(body)

    df = spark.createDataFrame([("a", "T", "still busy", datetime(2026, 8, 25, 22))], "url string, title string, body string, published_at timestamp")
    assert resolve.extract(df, refuses, pause=lambda s: None).first()["error"] == "still busy"


def test_monthly_totals(spark):
    at = lambda *a: datetime(2026, *a)
    rows = [("fault", at(8, 29, 9, 29), None), ("fault", at(8, 30), None), ("fault", at(8, 29, 9, 29), at(9, 1, 5, 45)), ("planned", at(8, 1), None), ("planned", at(8, 2, 2), at(8, 2, 1)), ("planned", datetime(2025, 1, 1), datetime(2025, 1, 2))]
    df = spark.createDataFrame(rows, "kind string, starts_at timestamp, ends_at timestamp")
    got = {r["month"]: r for r in totals.monthly_totals(df, F.lit("2026-08-31 12:00:00").cast("timestamp")).collect()}
    assert len(got) == 12
    august = got["2026-08"]
    assert (august["open_faults"], august["fault_hours"], august["planned_hours"]) == (2, 68.3, 0.0)


def test_month_bounds_differ_by_the_offset(spark):
    now = F.lit("2026-08-31 12:00:00").cast("timestamp")
    r = spark.range(1).select(totals.stored_month_bound(now).alias("s"), totals.exact_month_bound(now).alias("e")).first()
    assert (r["s"], r["e"]) == (datetime(2025, 9, 1), datetime(2025, 8, 31, 21))


def test_prefix_needs_exactly_one(spark):
    rows = frame(spark, [record("aa11" + "0" * 28), record("aa22" + "0" * 28), record("bb" + "0" * 30)])
    assert live.by_prefix(rows, "bb").count() == 1 and live.by_prefix(rows, "aa").count() == 0 and live.by_prefix(rows, "cc").count() == 0


def test_not_bad_data_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("bad_data",), ("retracted",)], "cancelled_reason string")
    assert df.where(live.not_bad_data()).count() == 2


def test_empty_tables(spark, place_rows):
    none = frame(spark, [])
    settlements = spark.createDataFrame([("Gönyeli", "lefkosa")], "name string, district string")
    assert places.darkness(none, settlements).count() == 0
    assert places.with_counts(settlements, places.key_counts(none, settlements)).first()["n"] == 0
    assert totals.district_states(spark, none, F.lit(T0)).where("state = 'quiet'").count() == 6
    assert st.retract(none, none, F.lit(T0)).count() == 0


def test_queue_keeps_one_of_a_text(spark):
    queue = spark.createDataFrame([("x",)], "fingerprint string")
    items = spark.createDataFrame([("u", "long " * 3000, "r"), ("u", "long " * 3000, "r"), (None, "t", "r")], "source_url string, raw_text string, reason string")
    rows = st.enqueue(queue, items, F.lit(T0)).collect()
    assert len(rows) == 2 and max(len(r["raw_text"]) for r in rows) == 8000


def test_turkish_order(spark):
    df = spark.createDataFrame([("Çamlıbel", "x"), ("Cihangir", "x"), ("Doğancı", "x"), ("İskele", "x"), ("Ilgaz", "x")], "name string, district string")
    counts = spark.createDataFrame([("camlibel", 3), ("cihangir", 3), ("doganci", 4), ("iskele", 3), ("ilgaz", 3)], "place_key string, n long")
    assert [r["name"] for r in places.eligible(df, counts).collect()] == ["Doğancı", "Cihangir", "Çamlıbel", "Ilgaz", "İskele"]
