"""Tables in parts: what a write touches, repeated and broken writes, removal of old versions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridlore.streaming import ingest
from gridlore.streaming.snapshots import Snapshots
from tests.test_resolve import entry
from tests.test_streaming import NOW, article, extractor, gazetteer  # noqa: F401

SCHEMA = "k int, day string, x string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files_of(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_write_touches_its_parts_only(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path))
    first = [(k, f"d{k % 5}", "a" * 100) for k in range(500)]
    t.replace("t", 1, table(spark, first), F.col("day"), [f"d{k}" for k in range(5)])
    before = files_of(tmp_path)
    second = [(k, d, "b") for k, d, _ in first if d == "d2"] + [(999, "d9", "c")]
    t.replace("t", 2, table(spark, second), F.col("day"), ["d2", "d9"])
    assert rows_of(t.read("t", SCHEMA)) == sorted([r for r in first if r[1] != "d2"] + second)
    assert rows_of(t.read("t", SCHEMA, 2)) == sorted(first) and rows_of(t.read("t", SCHEMA, 1)) == []
    assert rows_of(t.read("t", SCHEMA, parts=["d9", "none"])) == [(999, "d9", "c")]
    new = {f: n for f, n in files_of(tmp_path).items() if f not in before}
    assert {f.split("part=")[1].split("/")[0] for f in new} == {"d2", "d9"} and set(before) <= set(files_of(tmp_path))
    t.replace("t", 3, table(spark, []), F.col("day"), ["d9"])  # a part may become empty
    assert t.versions("t") == [1, 2, 3] and "d9" not in t.manifest("t")
    with pytest.raises(ValueError, match="not replaced"):
        t.replace("t", 4, table(spark, second), F.col("day"), ["d2"])
    assert t.versions("t") == [1, 2, 3]


def test_repeated_and_broken_writes(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path))
    t.append("t", 1, table(spark, [(1, "d1", "a")]), F.col("day"))
    t.append("t", 2, table(spark, [(2, "d1", "b")]), F.col("day"))
    t.append("t", 2, table(spark, [(2, "d1", "b")]), F.col("day"))
    assert rows_of(t.read("t", SCHEMA)) == [(1, "d1", "a"), (2, "d1", "b")]
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        t.append("t", 3, table(spark, [(3, "d1", "half")]), F.col("day"))
    assert rows_of(Snapshots(spark, str(tmp_path)).read("t", SCHEMA)) == [(1, "d1", "a"), (2, "d1", "b")]
    t._publish = publish
    t.append("t", 3, table(spark, [(3, "d1", "c")]), F.col("day"))
    assert rows_of(t.read("t", SCHEMA)) == [(1, "d1", "a"), (2, "d1", "b"), (3, "d1", "c")]
    assert json.load(open(tmp_path / "t/manifest/3.json")) == {"d1": ["data/v=1/part=d1", "data/v=2/part=d1", "data/v=3/part=d1"]}


def test_vacuum(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path))
    for v in range(1, 6):
        t.replace("t", v, table(spark, [(v, f"d{v % 2}", "x")]), F.col("day"), [f"d{v % 2}"])
    gone = t.vacuum("t", keep=2)
    assert t.versions("t") == [4, 5] and set(gone) == {"data/v=1/part=d1", "data/v=2/part=d0"}
    assert rows_of(t.read("t", SCHEMA)) == [(4, "d0", "x"), (5, "d1", "x")] and rows_of(t.read("t", SCHEMA, 5)) == [(3, "d1", "x"), (4, "d0", "x")]
    assert t.vacuum("t", keep=2) == [] and t.vacuum("none") == []


def test_a_run_writes_what_it_changes(spark, tmp_path, gazetteer):  # noqa: F811
    """A batch of one record rewrites that record's day of a long table, and no more."""
    t = Snapshots(spark, str(tmp_path / "t"))
    many = spark.range(300).selectExpr(
        "cast(id as string) as id", "'planned' as kind", "timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id as int)) as starts_at", "timestamp'2026-01-01 03:00:00' + make_interval(0, 0, 0, cast(id as int)) as ends_at",
        "'lefkosa' as district", "array('Gönyeli') as areas", "array('gonyeli') as area_keys", "'places' as scope", "array(struct('P' as name, concat('https://p.example/n', 5000 + id, '-x') as url, 'press' as kind)) as sources",
        "timestamp'2026-01-01' as published_at", "timestamp'2026-01-01' as ingested_at", "'high' as confidence", "cast(null as timestamp) as cancelled_at", "cast(null as string) as cancelled_reason", "timestamp'2026-01-01' as updated_at",
    )
    day = F.date_format("starts_at", "yyyy-MM-dd")
    t.replace("outages", 1, many, day, [r["d"] for r in many.select(day.alias("d")).collect()])
    before = files_of(tmp_path)
    batch = spark.read.schema(ingest.ANNOUNCEMENT).json(spark.sparkContext.parallelize([json.dumps(article(1, [entry()]))]))
    for _ in range(2):  # a repeated batch changes nothing
        ingest.run_batch(batch, 2, t, extractor, gazetteer, NOW)
        after = files_of(tmp_path)
        outages = {f.split("part=")[1].split("/")[0] for f in after if f not in before and "/outages/" in f}
        assert len(outages) == 1 and not [f for f in before if f not in after]
        assert t.read("outages", ingest.OUTAGES).count() == 301 and t.read("outages", ingest.OUTAGES, 2).count() == 300
        assert not os.path.exists(tmp_path / "t/parsed") and t.read("runs", ingest.RUNS).select("read", "created", "updated", "queued").collect() == [(1, 1, 0, 0)]
