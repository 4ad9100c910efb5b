from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridlore.sources import feeds, web
from tests.test_identity import T0, frame, record


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://a.example/1?x=1&amp;y=2 </loc><lastmod>2026-08-26T05:00:00Z</lastmod></url><url><loc>https://a.example/2</loc><lastmod>soon</lastmod></url><url><x/></url></urlset>"
    rows = one(spark, web.sitemap_entries(F.lit(xml)))
    assert [(r["url"], r["lastmod"]) for r in rows] == [("https://a.example/1?x=1&y=2", datetime(2026, 8, 26, 5)), ("https://a.example/2", None)]
    bare = one(spark, web.sitemap_entries(F.lit("<loc>https://a.example/3</loc>")))
    assert [r["url"] for r in bare] == ["https://a.example/3"]
    assert one(spark, web.sitemap_entries(F.lit(""))) == []


def test_sitemap_index(spark):
    xml = F.lit("<sitemapindex><loc>a1</loc><loc>b2</loc><loc>a3</loc></sitemapindex>")
    assert one(spark, web.is_sitemap_index(xml)) and not one(spark, web.is_sitemap_index(F.lit("<urlset/>")))
    assert one(spark, web.listed_sitemaps(xml, 2)) == ["a1", "b2"]
    assert one(spark, web.listed_sitemaps(xml, 2, newest_last=True)) == ["a3", "b2"]
    assert one(spark, web.listed_sitemaps(xml, 8, "^a")) == ["a1", "a3"]


def test_collect(spark):
    block = lambda u, d="": f"<url><loc>{u}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>"
    pages = [(0, block("x/elektrik-1", "2026-08-25") + block("x/other") + block("x/elektrik-2")), (1, block("x/elektrik-1", "2026-08-27") + block("x/elektrik-3", "2026-08-01") + block("x/elektrik-4", "2026-08-26"))]
    df = web.collect_entries(spark.createDataFrame(pages, "ordinal int, xml string"), "(?i)elektrik", F.lit("2026-08-20").cast("timestamp"))
    assert [r["url"] for r in df.collect()] == ["x/elektrik-4", "x/elektrik-1", "x/elektrik-2"]


def test_feed(spark):
    xml = """<rss><item><title><![CDATA[A &amp; B]]></title><link>https://a.example/1</link><pubDate>Wed, 26 Aug 2026 05:00:00 GMT</pubDate></item>
    <entry><title>C</title><link rel="x" href="https://a.example/2"/><summary>&lt;p&gt;d&lt;/p&gt;</summary><updated>2026-08-26T05:00:00Z</updated></entry>
    <item><guid>https://a.example/3</guid><description>e</description></item><item><guid>x</guid></item></rss>"""
    rows = one(spark, web.feed_items(F.lit(xml)))
    assert [(r["title"], r["link"], r["published_at"]) for r in rows] == [
        ("A & B", "https://a.example/1", datetime(2026, 8, 26, 5)), ("C", "https://a.example/2", datetime(2026, 8, 26, 5)), ("", "https://a.example/3", None)
    ]


def test_links(spark):
    html = """<a href="/x/n1-a#top">1</a><a href='n2-b'>2</a><a href="//a.example/n3-c">3</a><a href="https://b.example/n4-d">4</a><a href="/x/n1-a">5</a><a href="/about">6</a><a href="mailto:a@b">7</a>"""
    found = one(spark, web.article_links(F.lit(html), F.lit("https://a.example/list/"), "/n[0-9]+-"))
    assert found == ["https://a.example/x/n1-a", "https://a.example/list/n2-b", "https://a.example/n3-c"]


LONG = "Bakım çalışması nedeniyle yarın elektrik kesilecektir."


def test_article(spark):
    html = f"<title>Kesinti var - Site</title><nav><p>{LONG}</p></nav><h1>Logo</h1><h1>Kesinti var</h1><p>kısa</p><p>{LONG}</p><script>p()</script>"
    a = one(spark, web.article(F.lit(html)))
    assert (a["title"], a["body"]) == ("Kesinti var", LONG)
    with_summary = html + '<meta name="description" content="Özet: bambaşka ve yeterince uzun bir metin.">'
    assert one(spark, web.article(F.lit(with_summary)))["body"].startswith("Özet: bambaşka")
    said = html + f'<meta name="description" content="{LONG}">'
    assert one(spark, web.article(F.lit(said)))["body"] == LONG
    empty = one(spark, web.article(F.lit("")))
    assert (empty["title"], empty["body"]) == ("", "")


@pytest.mark.parametrize(
    "html, at",
    [
        ('<meta property="article:published_time" content="2026-08-26T08:00:00+03:00"><time datetime="2020-01-01">', datetime(2026, 8, 26, 5)),
        ('<meta name="date" content="bad"><script>{"datePublished": "2026-08-26"}</script>', datetime(2026, 8, 26)),
        ('<time class="x" datetime="2026-08-26T05:00:00Z">', datetime(2026, 8, 26, 5)),
        ("<p>no date</p>", None),
    ],
)
def test_article_date(spark, html, at):
    assert one(spark, web.article_date(F.lit(html))) == at


def test_robots(spark):
    text = "User-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /admin # x\nDisallow:\nDisallow: /*.pdf\nAllow: /a"
    assert one(spark, web.robots_rules(F.lit(text))) == ["/admin", "/*.pdf"]
    allowed = lambda p: one(spark, web.is_allowed(F.lit(p), web.robots_rules(F.lit(text))))
    assert [allowed(p) for p in ("/", "/admin/x", "/a/b.pdf", "/ad")] == [True, False, False, True]
    assert one(spark, web.robots_rules(F.lit(""))) == []


def test_crawl_filter(spark):
    page = lambda word: f"<h1>T</h1><p>Yarın {word} kesintisi uygulanacaktır, bilginize.</p>"
    at = datetime(2026, 8, 26)
    rows = [("o", f"https://o.example/n{k}-x", page("elektrik" if k % 2 else "su"), None, at.replace(hour=k)) for k in range(9)] + [("o", "https://o.example/other", page("elektrik"), None, at)]
    df = spark.createDataFrame(rows, "outlet string, url string, html string, lastmod timestamp, fetched_at timestamp")
    from gridlore.functions.text import about

    kept = web.crawl_filter(df, "/n[0-9]+-", about, cap=3).collect()
    assert sorted(r["url"][-3] for r in kept) == ["3", "5", "7"]


def test_gazetteer_file_rejects_unknown_districts(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"places": [{"name": "Lapta", "district": "girne", "aliases": ["LAPTA"]}]}')
    bad.write_text('{"places": [{"name": "Nowhere", "district": "moon", "aliases": []}]}')
    assert web.gazetteer_file(spark, str(good)).first()["name"] == "Lapta"
    with pytest.raises(Exception, match="unknown district moon for Nowhere"):
        web.gazetteer_file(spark, str(bad)).collect()


def test_front_matter(spark):
    r = one(spark, web.front_matter(F.lit("---\ntitle: A: b\nx: 1\n---\nBody\n")))
    assert (r["fields"], r["body"]) == ({"title": "A: b", "x": "1"}, "Body\n")


def calendar(path, district="lefkosa"):
    return b"".join(f.read_bytes() for f in sorted((path / f"district={district}").glob("part-*"))).decode()


def test_calendar(spark, tmp_path):
    rows = frame(spark, [record("0" * 32, areas=("Gönyeli",) * 1 + tuple(f"Köy{k}" for k in range(30))), record("1" * 32, "fault", length=None), record("2" * 32)])
    rows = rows.withColumn("cancelled_at", F.when(F.col("id").startswith("2"), F.lit(T0)))
    feeds.write_calendars(rows, str(tmp_path / "ics"), "https://site.example", "site.example")
    ics = calendar(tmp_path / "ics")
    assert ics.count("BEGIN:VEVENT") == 1 and ics.endswith("END:VCALENDAR\r\n")
    assert max(len(line.encode()) for line in ics.split("\r\n")) <= 75
    unfolded = ics.replace("\r\n ", "")
    assert "DTSTART:20260823T060000Z" in unfolded and "Köy29" in unfolded


def test_fold_octets_keeps_characters():
    line = "SUMMARY:" + "ğüş" * 60
    folded = feeds.fold_octets(line)
    assert folded.replace("\r\n ", "") == line
    assert all(len(x.encode()) <= 75 for x in folded.split("\r\n"))


@pytest.mark.parametrize("letters", ["a", "ğ", "—", "😀", "ağ—😀", "😀a", "ab—"])
def test_folding_as_an_expression_equals_the_plain_form(spark, letters):
    lines = [(letters * 200)[:n] for n in (*range(0, 90), 147, 148, 149, 150, 151, 199)]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", feeds.folded(F.col("x")).alias("f"))
    assert [r["f"] for r in df.collect()] == [feeds.fold_octets(r["x"]) for r in df.collect()]


def test_a_calendar_in_many_parts_is_one_calendar(spark, tmp_path):
    rows = frame(spark, [record(f"{k:032d}", start=500 - k // 2) for k in range(400)])
    for parts in (1, 7):
        feeds.write_calendars(rows, str(tmp_path / f"{parts}"), "https://site.example", "site.example", parts)
    one, many = calendar(tmp_path / "1"), calendar(tmp_path / "7")
    assert one == many and one.startswith("BEGIN:VCALENDAR\r\n") and one.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n")
    assert len(list((tmp_path / "7" / "district=lefkosa").glob("part-*"))) > 3
    starts = [x for x in one.split("\r\n") if x.startswith("DTSTART:")]
    assert len(starts) == 400 and starts == sorted(starts) and one.count("BEGIN:VCALENDAR") == one.count("END:VCALENDAR") == 1
    feeds.write_calendars(rows.limit(0), str(tmp_path / "none"), "https://site.example", "site.example")
    assert feeds.calendar_lines(spark, str(tmp_path / "7")).count() == one.count("\r\n")


def test_rss_and_json(spark):
    rows = frame(spark, [record("0" * 32, areas=("A & B",)), record("x", length=None, start=9)])
    rss = feeds.news_feeds(rows, "https://site.example").first()["rss"]
    assert "A &amp; B" in rss and rss.index("/district/lefkosa") < rss.index("/outage/")
    by_id = {r["id"]: r["json"] for r in feeds.announcements_json(rows, "https://site.example").collect()}
    assert '"expires"' in by_id["0" * 32] and '"expires"' not in by_id["x"] and '"url"' not in by_id["x"]
