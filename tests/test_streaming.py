import json
from datetime import datetime

import pytest

from gridlore.operators import resolve
from gridlore.streaming import ingest, seen
from gridlore.streaming.snapshots import Snapshots
from tests.test_resolve import PLACES, entry

NOW = datetime(2026, 8, 26, 12)


def article(k, entries, body=None, fetched=5):
    return {
        "url": f"https://p.example/n{k}-x", "source": {"name": "P", "url": f"https://p.example/n{k}-x", "kind": "press"}, "title": f"T{k}",
        "body": body or json.dumps({"outages": entries}), "published_at": "2026-08-26T05:00:00Z", "fetched_at": f"2026-08-26T05:{fetched:02d}:00Z",
    }


def extractor(title, body, day):
    return body


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


@pytest.fixture
def gazetteer(spark):
    return resolve.Gazetteer.of(spark.createDataFrame(PLACES, "name string, district string, aliases array<string>, ordinal int"))


def run(spark, tmp_path, name, batches, gazetteer):
    source, root = tmp_path / f"{name}-in", tmp_path / name
    source.mkdir()
    tables = Snapshots(spark, str(root))
    for k, rows in enumerate(batches):
        write(source, f"{k}.json", rows)
        q = ingest.start(spark, str(source), tables, extractor, gazetteer, str(tmp_path / f"{name}-checkpoint"), now=NOW)
        q.awaitTermination()
        assert q.exception() is None
    return tables


def test_stream(spark, tmp_path, gazetteer):
    open_fault = entry(kind="fault", start="05:00", end=None, areas=["Girne"])
    batches = [
        [article(1, [entry()]), article(2, [entry(areas=["Gönyeli", "Lefkoşa"])]), article(3, [entry(areas=["Mars"])]), article(4, [open_fault])],
        [article(1, [entry()], fetched=9), article(5, [entry(resolved=True, areas=["Girne"], restoredAt="07:30")]), article(6, [entry(cancelled=True)])],
    ]
    tables = run(spark, tmp_path, "two", batches, gazetteer)
    rows = {r["district"]: r for r in tables.read("outages", ingest.OUTAGES).collect()}
    assert set(rows) == {"lefkosa", "girne"}
    assert rows["lefkosa"]["areas"] == ["Gönyeli", "Lefkoşa"] or sorted(rows["lefkosa"]["areas"]) == ["Gönyeli", "Lefkoşa"]
    assert rows["lefkosa"]["cancelled_reason"] == "retracted"
    assert rows["girne"]["ends_at"] == datetime(2026, 8, 26, 4, 30)
    assert [r["reason"] for r in tables.read("queue", ingest.QUEUE).collect()] == ["no known place names found"]
    runs = tables.read("runs", ingest.RUNS).orderBy("batch").collect()
    assert [(r["ok"], r["read"]) for r in runs] == [(True, 4), (True, 2)]  # the repeated article is not read again
    seen_rows = {r["url"][18:20]: r for r in tables.read("seen", ingest.SEEN).collect()}
    assert seen_rows["n3"]["parsed_ok"] is False and seen_rows["n3"]["attempts"] == 1 and seen_rows["n1"]["parsed_ok"] is True


def test_repeated_batch_gives_the_same_tables(spark, tmp_path, gazetteer):
    tables = run(spark, tmp_path, "again", [[article(1, [entry()])]], gazetteer)
    before = tables.read("outages", ingest.OUTAGES).collect()
    batch = spark.read.schema(ingest.ANNOUNCEMENT).json(str(tmp_path / "again-in"))
    ingest.run_batch(batch, 1, tables, extractor, gazetteer, NOW)
    assert tables.read("outages", ingest.OUTAGES).collect() == before and tables.versions("outages") == [1]


def test_failed_run_is_logged(spark, tmp_path):
    write(tmp_path, "a.json", [article(1, [entry()])])
    tables = Snapshots(spark, str(tmp_path / "bad"))
    batch = spark.read.schema(ingest.ANNOUNCEMENT).json(str(tmp_path / "a.json"))
    with pytest.raises(Exception, match="match_areas"):  # there is no gazetteer
        ingest.run_batch(batch, 1, tables, extractor, None, NOW)
    assert [r["ok"] for r in tables.read("runs", ingest.RUNS).collect()] == [False]


def test_backfill(spark, gazetteer):
    rows = spark.read.schema(ingest.ANNOUNCEMENT).json(spark.sparkContext.parallelize([json.dumps(article(k, [entry()])) for k in (1, 2)]))
    assert ingest.backfill(spark, rows, extractor, gazetteer).count() == 1


def test_unread_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = []
    for k, batch in enumerate([[("a", "x"), ("b", "x")], [("a", "x"), ("b", "y")], [("a", "x")], [("a", "x")]]):
        write(source, f"{k}.json", [{"url": u, "title": "t", "body": b} for u, b in batch])
        stream = spark.readStream.schema("url string, title string, body string").json(str(source))
        q = seen.unread_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: rows.extend((r["url"], r["body"], r["attempt"]) for r in df.collect())).start()
        q.awaitTermination()
    assert sorted(rows) == [("a", "x", 1), ("a", "x", 2), ("a", "x", 3), ("b", "x", 1), ("b", "y", 1)]


def test_reading_in_the_stream(spark, tmp_path):
    """Failures are tried three times, a text that was read is left, a changed text starts anew."""
    source = tmp_path / "in"
    source.mkdir()

    def read(title, body, day):
        if body == "bad":
            raise ValueError("no answer")
        return body

    rows = []
    for k, batch in enumerate([[("a", "bad"), ("b", "x")], [("a", "bad"), ("b", "x")], [("a", "bad"), ("b", "y")], [("a", "bad")], [("a", "good")]]):
        write(source, f"{k}.json", [{"url": u, "title": "t", "body": b} for u, b in batch])
        stream = spark.readStream.schema("url string, title string, body string").json(str(source))
        found = seen.unread_stream(stream, extractor=read)
        found.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: rows.extend((r["url"], r["attempt"], r["payload"], r["error"]) for r in df.collect())).start().awaitTermination()
    assert sorted(rows, key=str) == sorted([("a", 1, None, "no answer"), ("a", 2, None, "no answer"), ("a", 3, None, "no answer"), ("a", 1, "good", None), ("b", 1, "x", None), ("b", 1, "y", None)], key=str)


def test_a_failing_source_stops_no_other(spark, tmp_path, gazetteer):
    write(tmp_path, "a.json", [article(1, [entry()])])
    tables = Snapshots(spark, str(tmp_path / "partial"))
    good = lambda: spark.read.schema(ingest.ANNOUNCEMENT).json(str(tmp_path / "a.json"))
    bad = lambda: spark.read.schema(ingest.ANNOUNCEMENT).parquet(str(tmp_path / "missing"))
    ingest.run_sources({"bad": bad, "good": good}, 1, tables, extractor, gazetteer, NOW)
    ingest.run_sources({"bad": bad}, 2, tables, extractor, gazetteer, NOW)
    runs = tables.read("runs", ingest.RUNS).orderBy("batch").collect()
    assert [(r["ok"], r["read"], r["sources"], r["failed"]) for r in runs] == [(True, 1, ["good"], ["bad"]), (False, 0, [], ["bad"])]
    assert tables.read("outages", ingest.OUTAGES).count() == 1
