"""What grows with the input and no faster: parts of tables, closings, distances."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridlore.operators import clusters, places, store
from gridlore.operators import identity as idn
from gridlore.streaming import ingest
from gridlore.streaming.snapshots import Snapshots
from tests.test_identity import frame, record
from tests.test_resolve import entry
from tests.test_streaming import NOW, article, extractor, gazetteer  # noqa: F401


def test_a_large_part_is_written_by_many_tasks(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path))
    t.write("t", 1, spark.range(0, 1000, 1, 4).selectExpr("cast(id as int) as k", "'d' as day", "'x' as x"))
    assert len([f for f in os.listdir(tmp_path / "t/data/v=1/part=all") if f.endswith(".parquet")]) == 4
    assert t.read("t", "k int, day string, x string").count() == 1000


def test_many_days_lie_in_few_parts(spark, tmp_path, gazetteer, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ingest, "PARTS", 2, raising=False)
    t = Snapshots(spark, str(tmp_path))
    day = lambda k: (datetime(2026, 8, 1) + timedelta(days=k)).date().isoformat()
    for version, days in ((1, [3]), (2, range(2, 26, 4)), (3, [3, 60])):
        rows = [json.dumps(article(100 * version + k, [entry(date=day(k), weekday=None)])) for k in days]
        ingest.run_batch(spark.read.schema(ingest.ANNOUNCEMENT).json(spark.sparkContext.parallelize(rows)), version, t, extractor, gazetteer, NOW)
    parts = [t.manifest("outages", v) for v in (2, 3, 4)]
    assert list(parts[0]) == [day(3)] and 1 < len(parts[1]) <= 3 and any(p.startswith("x") for p in parts[1])
    found = t.read("outages", ingest.OUTAGES).select(F.date_format("starts_at", "yyyy-MM-dd").alias("d"), F.size("sources").alias("n")).collect()
    assert sorted((r["d"], r["n"]) for r in found) == sorted([(day(3), 2), (day(60), 1), *((day(k), 1) for k in range(2, 26, 4))])


def test_closings_are_not_paired(spark):
    rng, t0 = random.Random(3), datetime(2026, 1, 1)
    at = lambda: t0 + timedelta(hours=rng.choice([0, 144, 288, rng.randrange(900)]))
    rows = [(f"r{k}", "girne" if k % 9 else None, at(), at() if k % 7 == 0 else None, rng.sample(["a", "b", "c"], rng.randrange(4)), t0 if k % 8 == 0 else None) for k in range(200)]
    ends = [(rng.choice(["girne", "lefke"]), rng.sample(["a", "b", "d"], 2), at(), k if k % 5 else None) for k in range(60)]
    stored = spark.createDataFrame(rows, "id string, district string, starts_at timestamp, ends_at timestamp, area_keys array<string>, cancelled_at timestamp")
    closed = store.resolve(stored, spark.createDataFrame(ends, "district string, area_keys array<string>, resolved_at timestamp, ordinal int"))

    def end(r):
        fits = [e for e in ends if e[0] == r[1] and e[3] is not None and set(e[1]) & set(r[4]) and r[2] <= e[2] <= r[2] + timedelta(hours=144)]
        return r[3] or (min(fits, key=lambda e: e[3])[2] if fits and r[5] is None else None)

    assert {r["id"]: r["ends_at"] for r in closed.collect()} == {r[0]: end(r) for r in rows}
    assert sum(line.lstrip(" :+-").startswith("Join") for line in closed._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1


def test_distances_to_rings(spark):
    rng = random.Random(5)
    rings = [("r", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]]), ("s", [[1.0, 1.0], [1.0, 1.0], [3.0, 2.0]])]
    points = [(k, rng.choice("rs"), rng.uniform(-1, 5), rng.uniform(-1, 5)) for k in range(300)]
    points, rings = spark.createDataFrame(points, "k int, ring string, lng double, lat double"), spark.createDataFrame(rings, "ring string, vertices array<array<double>>")
    one = points.join(rings, "ring").select("k", places.ring_distance_km(F.col("vertices"), F.col("lng"), F.col("lat")).alias("km"))
    expected = {r["k"]: r["km"] for r in one.collect()}
    found = {r["k"]: r["km"] for r in places.distances_km(points, rings, "ring", "k").collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_texts_are_cut_once(spark, gazetteer):  # noqa: F811
    texts = spark.createDataFrame([("Works in Girne and GÖNYELİ, not in Mars",), ("Çatalköy'de Lefkoşa",)], "text string")
    found = gazetteer.match(texts)
    assert "inline" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(sorted(m["name"] for m in r["found"]) for r in found.collect())[0][:1] == ["Girne"]


def test_stored_records_that_none_has_met_stay_where_they_are(spark, monkeypatch):
    """A batch is joined and written with the stored records that it meets, not with all of them."""
    rows, written = {}, clusters.written

    def counted(df, kind):
        out = written(df, kind)
        rows[kind] = max(rows.get(kind, 0), out[0].count())
        return out

    monkeypatch.setattr(clusters, "written", counted)
    monkeypatch.setattr(clusters, "TOGETHER", 20)
    stored = [record(f"s{k:02d}", start=500 * k) for k in range(60)]
    found = idn.store(frame(spark, [record("n1", start=1005), record("n2", start=-900)]), frame(spark, stored))
    assert {(r["id"], r["created"], r["n_members"]) for r in found.collect()} == {("s02", False, 2), ("n2", True, 1)}
    assert rows["clustered"] == 3 and rows["grown"] == rows["states"] == 1 and "light" not in rows


def test_lists_are_read_once(spark, gazetteer):  # noqa: F811
    """Rows meet what their list names: nothing is read row by row."""
    rows = spark.createDataFrame([(1, ["Girne", "Lapta"]), (2, ["Girne", "Lapta"]), (3, []), (4, None), (5, [None, "Mars"])], "k int, areas array<string>")
    found = gazetteer.match_areas(rows, F.col("areas"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    names = {r["k"]: [m["name"] for m in r["m"]] for r in found.collect()}
    assert names[1] == names[2] and "Girne" in names[1] and names[3] == names[4] == names[5] == []
