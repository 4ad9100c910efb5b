"""Polite fetching and outlets as a data source."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.sources import outlets, polite
from gridlore.sources.polite import Answer, Polite, Ticks

NOW = datetime(2026, 8, 26, 12, tzinfo=UTC)


class Script:
    """Answers by address, one after the other; the last one stays. A request takes a quarter of a second."""

    def __init__(self, clock, **answers):
        self.clock, self.answers, self.asked = clock, answers, []

    def get(self, url, headers):
        self.clock.sleep(0.25)
        self.asked.append((url, dict(headers), self.clock.now()))
        found = self.answers.get(url.rsplit("/", 1)[-1].replace(".", "_"), [Answer(404)])
        answer = found.pop(0) if len(found) > 1 else found[0]
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_one_request_a_host_with_a_pause():
    clock = Ticks()
    script = Script(clock, a=[Answer(200, "A")], b=[Answer(500), Answer(200, "B")], c=[Answer(403)], d=[OSError("down")])
    p = Polite(script, "agent", clock)
    found = [p.fetch(f"https://one.example/{x}") for x in "abcd"]
    assert [(f.status, f.body, f.attempts) for f in found] == [("ok", "A", 1), ("ok", "B", 2), ("skipped", "", 1), ("skipped", "", 3)]
    assert found[2].reason == "responded 403" and found[3].reason == "failed after 3 attempts: down"
    assert [f.started for f in found] == [0.25, 2.0, 5.0, 6.75]  # the first request is for robots.txt
    other = p.fetch("https://two.example/a")
    assert other.started == clock.now() - 0.25  # another host does not wait


def test_rules_for_robots():
    rules = polite.rules_of("User-agent: x\nDisallow: /all\nUser-Agent: * # everyone\nDisallow: /private\nDisallow: /*.pdf\nDisallow:\n")
    assert rules == ["/private", "/*.pdf"]
    assert [polite.allowed(x, rules) for x in ("/", "/private/a", "/a/b.pdf", "/all", "/privat")] == [True, False, False, True, True]
    clock = Ticks()
    p = Polite(Script(clock, robots_txt=[Answer(200, "User-agent: *\nDisallow: /no")], a=[Answer(200)]), "agent", clock)
    assert p.fetch("https://one.example/no").reason == "disallowed by robots.txt: /no"


def test_conditional_requests():
    clock, cache = Ticks(), {}
    script = Script(clock, a=[Answer(200, "A", {"etag": "x1", "last-modified": "then"}), Answer(304)])
    assert Polite(script, "agent", clock, cache).fetch("https://one.example/a").status == "ok"
    assert Polite(script, "agent", clock, cache).fetch("https://one.example/a").status == "unchanged"
    assert script.asked[-1][1]["if-none-match"] == "x1" and script.asked[-1][1]["if-modified-since"] == "then"


@pytest.mark.parametrize("part", [3, 10_000])
def test_schedule_of_recorded_requests_equals_fetching(spark, part):
    statuses = [[200], [500, 200], [304], [0, 0, 0], [429, 503, 200], [404], [200], [503, 304]]
    clock = Ticks()
    script = Script(clock, robots_txt=[Answer(404)], **{f"u{k}": [OSError("x") if s == 0 else Answer(s) for s in row] for k, row in enumerate(statuses)})
    p = Polite(script, "agent", clock)
    p._rules["https://h.example"] = []
    fetched = [p.fetch(f"https://h.example/u{k}") for k in range(len(statuses))]
    rows = spark.createDataFrame([("h", k, s) for k, s in enumerate(statuses)], "host string, ordinal long, s array<int>").withColumn("o", polite.outcomes(F.col("s")))
    timed = rows.select("host", "ordinal", "o.*", (F.col("o.attempts") * 0.25 + F.col("o.waited")).alias("seconds"))
    found = polite.schedule(timed, "seconds", part).orderBy("ordinal").collect()
    assert [(r["status"], r["attempts"], r["started"]) for r in found] == [(f.status, f.attempts, f.started) for f in fetched]


def page(k, day=None, words="Elektrik kesintisi olacak bu gece"):
    meta = f'<meta property="article:published_time" content="{day}">' if day else ""
    return f"<html><head>{meta}</head><body><h1>T{k}</h1><p>{words} {k} numara</p></body></html>"


@pytest.fixture
def site(spark, tmp_path):
    """A recorded outlet with a sitemap and one with a listing; ``put`` records answers."""
    root = str(tmp_path / "record")

    def put(**answers):
        rows = [("x", f"https://{'l' if name.startswith('l') else 's'}.example/x/{url}", 200, body) for name, (url, body) in answers.items()]
        spark.createDataFrame(rows, "part string, url string, status int, body string").write.mode("append").partitionBy("part").parquet(root)

    return put, polite.Recorded(root, "/(x)/"), root


SITE = outlets.Outlet("s", "Site", "https://s.example", ("https://s.example/x/map.xml",))
LIST = outlets.Outlet("l", "Lists", "https://l.example", (), ("https://l.example/x/home",), article_pattern=r"/n\d+-")


def entry(k, at=None):
    return f"<url><loc>https://s.example/x/elektrik-n{k}</loc>" + (f"<lastmod>{at}</lastmod>" if at else "") + "</url>"


def test_batch(spark, site):
    put, fetcher, _ = site
    listing = '<a href="/x/n1-elektrik-yok#c">a</a><a href="https://l.example/x/n1-elektrik-yok">b</a><a href="/x/n2-spor">c</a><a href="https://m.example/x/n3-elektrik">d</a>'
    put(
        s1=("map.xml", entry(1, "2026-08-26T05:00:00+03:00") + entry(2, "2026-08-01") + entry(3) + entry(4, "2026-08-25") + entry(1, "2026-08-26") + "<url><loc>https://s.example/x/spor</loc></url>"),
        s2=("elektrik-n1", page(1)), s3=("elektrik-n3", page(3, "2026-08-24T00:00:00Z")), s4=("elektrik-n4", page(4, words="Belediye meclisi bu gece toplanacak")),
        l1=("home", listing), l2=("n1-elektrik-yok", page(9)),
    )
    name = outlets.register(spark, [SITE, LIST], fetcher, clock=Ticks, now=lambda: NOW, name="outlets_batch")
    rows = spark.read.format(name).load()
    assert sorted(r["url"].rsplit("/", 1)[1] for r in rows.collect()) == ["elektrik-n1", "elektrik-n3", "elektrik-n4", "n1-elektrik-yok"]
    found = {r["title"]: r for r in outlets.announcements(rows, tx.about).collect()}
    assert {t: r["published_at"] for t, r in found.items()} == {"T1": datetime(2026, 8, 26, 2), "T3": datetime(2026, 8, 24), "T9": datetime(2026, 8, 26, 12)}
    assert found["T9"]["source"].asDict() == {"name": "Lists", "url": "https://l.example/x/n1-elektrik-yok", "kind": "press"}
    assert [r["title"] for r in outlets.announcements(rows, tx.about, most=1).where("source.name = 'Site'").collect()] == ["T1"]


def test_a_stream_goes_on_from_its_marks(spark, site, tmp_path):
    put, fetcher, root = site
    read = []

    def run(at):
        name = outlets.register(spark, [SITE, outlets.Outlet("gone", "Gone", "https://g.example", ("https://g.example/none.xml",))], fetcher, clock=Ticks, now=lambda: at, name="outlets_stream")
        q = spark.readStream.format(name).load().writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: read.append(sorted(r["url"].rsplit("/", 1)[1] for r in df.collect()))).start().awaitTermination()

    put(a=("elektrik-n1", page(1)), b=("elektrik-n2", page(2)), c=("elektrik-n3", page(3)), d=("map.xml", entry(1, "2026-08-25") + entry(2, "2026-08-26")))
    run(NOW)
    run(NOW + timedelta(hours=1))  # nothing new
    import shutil

    shutil.rmtree(root)
    put(a=("elektrik-n1", page(1)), b=("elektrik-n2", page(2)), c=("elektrik-n3", page(3)), d=("map.xml", entry(1, "2026-08-25") + entry(2, "2026-08-26") + entry(3, "2026-08-26T13:00:00Z")))
    run(NOW + timedelta(hours=2))
    assert [x for x in read if x] == [["elektrik-n1", "elektrik-n2"], ["elektrik-n3"]]


def test_registry():
    assert outlets.registry(outlets.registry_json([SITE, LIST])) == [SITE, LIST]
    with pytest.raises(ValueError, match="one id"):
        outlets.registry(outlets.registry_json([SITE, SITE]))
    with pytest.raises(ValueError, match="neither"):
        outlets.registry(json.dumps([{"id": "a", "name": "A", "origin": "https://a.example"}]))
