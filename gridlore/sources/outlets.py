"""Outlets as a Spark data source: their sitemaps and listings say what is new, their articles are rows.

    spark.dataSource.register(outlet_source(outlets, fetcher))
    spark.readStream.format("outlets").load()       # or spark.read.format("outlets").load()

A task reads one outlet, politely. The offset of a stream is a mark for each outlet: the newest time that its
sitemaps state, or of a listing the time of the poll. A batch is what lies between two marks, so a stream that is begun
again goes on from its checkpoint. An outlet that cannot be read keeps its mark and stops no other. What the rows are then
worth is said in column expressions (``web.crawl_filter``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from html import unescape
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridlore.sources import web
from gridlore.sources.polite import Clock, Fetcher, Polite

ARTICLES = "outlet string, name string, url string, lastmod timestamp, fetched_at timestamp, html string"
#: How far back a run looks, accepted articles of an outlet and run, sitemaps of an index, what the address of an
#: announcement says, and what an article's address looks like.
SINCE_DAYS, MOST_ARTICLES, MOST_SITEMAPS = 3, 12, 8
SLUG, ARTICLE_PATH = "elektrik|elektriksiz|enerji-veril", "/[a-z0-9-]{8,}$"
AGENT = "gridlore/1.0 (polite reader of public announcements)"


@dataclass(frozen=True)
class Outlet:
    """A press outlet: compact sitemaps where it has them, listing pages where it has not."""

    id: str
    name: str
    origin: str
    sitemaps: tuple[str, ...] = ()
    listings: tuple[str, ...] = ()
    article_pattern: str = ARTICLE_PATH
    since_days: int = SINCE_DAYS


def registry(text: str) -> list[Outlet]:
    """Outlets of a JSON list of objects; ids must differ, and each needs a sitemap or a listing."""
    found = [Outlet(**{k: tuple(v) if isinstance(v, list) else v for k, v in o.items()}) for o in json.loads(text)]
    if len({o.id for o in found}) < len(found):
        raise ValueError("two outlets have one id")
    for o in found:
        if not (o.sitemaps or o.listings):
            raise ValueError(f"outlet {o.id} has neither sitemaps nor listings")
    return found


def registry_json(outlets: Sequence[Outlet]) -> str:
    return json.dumps([asdict(o) for o in outlets], ensure_ascii=False)


def _time(text: str | None) -> datetime | None:
    """An instant as a sitemap states it; without a zone it is UTC, and what is no instant is none."""
    try:
        found = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC)


def _entries(xml: str) -> list[tuple[str, datetime | None]]:
    loc = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
    found = []
    for block in re.findall(r"(?is)<url>(.*?)</url>", xml):
        if at := re.search(loc, block):
            said = re.search(r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>", block)
            found.append((unescape(at[1]), _time(said and said[1])))
    return found or [(unescape(u), None) for u in re.findall(loc, xml)]


class Visit:
    """One outlet in one run."""

    def __init__(self, outlet: Outlet, polite: Polite, slug: str):
        self.outlet, self.polite, self.slug = outlet, polite, re.compile(slug, re.I)

    def _body(self, url: str) -> str:
        answer = self.polite.fetch(url)
        return answer.body if answer.status == "ok" else ""

    def _sitemaps(self) -> Iterator[str]:
        for root in self.outlet.sitemaps:
            xml = self._body(root)
            if re.search(r"(?i)<sitemapindex[\s>]", xml):
                listed = [unescape(u) for u in re.findall(r"(?i)<loc>\s*([^<]+?)\s*</loc>", xml)]
                yield from map(self._body, listed[:MOST_SITEMAPS])
            elif xml:
                yield xml

    def listed(self, since: datetime | None) -> Iterator[tuple[str, datetime | None]]:
        """Addresses of announcements on sitemaps, each once, those known to be older than ``since`` left out, newest
        first within a sitemap."""
        seen: set[str] = set()
        for xml in self._sitemaps():
            fits = [(u, t) for u, t in _entries(xml) if self.slug.search(u) and (since is None or t is None or t >= since)]
            for url, at in sorted(fits, key=lambda e: (e[1] is not None, e[1] or datetime.min.replace(tzinfo=UTC)), reverse=True):
                if url not in seen:
                    seen.add(url)
                    yield url, at

    def linked(self) -> Iterator[str]:
        """Addresses of announcements on listings, each once, on the outlet's own origin."""
        seen: set[str] = set()
        for listing in self.outlet.listings:
            for href in re.findall(r"""(?i)href=["']([^"']+)["']""", self._body(listing)):
                url = urldefrag(urljoin(listing, unescape(href))).url
                same = urlsplit(url)[:2] == urlsplit(listing)[:2]
                if same and url not in seen and re.search(self.outlet.article_pattern, urlsplit(url).path, re.I) and self.slug.search(url):
                    seen.add(url)
                    yield url

    def articles(self, after: datetime | None, upto: datetime, now: datetime) -> Iterator[tuple]:
        """Rows of what is new after one mark and up to another. Addresses without a time are read at every visit;
        what was read before is known by the state of seen articles downstream."""
        seen: set[str] = set()
        since = now - timedelta(days=self.outlet.since_days)
        new = (e for e in self.listed(since) if e[1] is None or (after is None or e[1] > after) and e[1] <= upto)
        for url, at in (*new, *((u, None) for u in self.linked())):
            if url in seen:
                continue
            seen.add(url)
            answer = self.polite.fetch(url)
            if answer.status == "ok":
                yield self.outlet.id, self.outlet.name, url, at, now, answer.body


@dataclass
class _Part(InputPartition):
    outlet: Outlet
    after: str | None
    upto: str
    now: str


def outlet_source(
    outlets: Sequence[Outlet], fetcher: Fetcher, slug: str = SLUG, clock: Callable = Clock, now: Callable[[], datetime] | None = None, again: timedelta = timedelta(0), name: str = "outlets"
) -> type[DataSource]:
    """A data source class over outlets, to be registered with a session. ``fetcher`` answers requests, ``clock`` keeps
    the pauses, ``now`` says when a run takes place; tests give their own. An article that cannot be fetched is left out of its
    batch; with ``again`` a batch also reads what was stated so long before its mark, so that it gets another chance."""
    outlets, present = list(outlets), now or (lambda: datetime.now(UTC))

    def visit(outlet: Outlet) -> Visit:
        return Visit(outlet, Polite(fetcher, AGENT, clock() if isinstance(clock, type) else clock), slug)

    def rows(part: _Part) -> Iterator[tuple]:
        try:
            yield from visit(part.outlet).articles(part.after and _time(part.after), _time(part.upto), _time(part.now))
        except OSError:
            return  # one outlet stops no other; its next visit looks as far back again

    class Batch(DataSourceReader):
        def partitions(self):
            at = present().isoformat()
            return [_Part(o, None, at, at) for o in outlets]

        def read(self, partition):
            return rows(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self):
            self.marks = {o.id: "" for o in outlets}

        def initialOffset(self) -> dict:
            return {o.id: "" for o in outlets}

        def latestOffset(self) -> dict:
            at = present()
            for o in outlets:
                try:
                    stated = [t for _, t in visit(o).listed(at - timedelta(days=o.since_days))]
                except OSError:
                    continue  # it keeps its mark
                times = [t for t in stated if t is not None]
                if o.listings or len(times) < len(stated):
                    self.marks[o.id] = at.isoformat()
                elif times:
                    self.marks[o.id] = max(times).isoformat()
            return dict(self.marks)

        def partitions(self, start: dict, end: dict):
            at = present().isoformat()
            moved = [(o, start.get(o.id) or None, end.get(o.id) or "") for o in outlets]
            return [_Part(o, _back(a), b, at) for o, a, b in moved if b and (a is None or b > a)]

        def read(self, partition):
            return rows(partition)

    def _back(mark: str | None) -> str | None:
        return mark and (_time(mark) - again).isoformat()

    class Outlets(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ARTICLES

        def reader(self, schema):
            return Batch()

        def streamReader(self, schema):
            return Stream()

    return Outlets


def announcements(articles: DataFrame, wanted, slug: str = SLUG, most: int = MOST_ARTICLES) -> DataFrame:
    """Announcements among fetched articles: those whose text is ``wanted``, the newest of each outlet, dated by the
    sitemap, else by the page, else by the fetch; in the form that the ingest run takes."""
    names = articles.select("outlet", "name").distinct()
    kept = web.crawl_filter(articles, f"(?i){slug}", wanted, most).join(names, "outlet")
    source = F.struct("name", "url", F.lit("press").alias("kind"))
    return kept.select("url", source.alias("source"), "title", "body", "published_at", "fetched_at")


def register(spark: SparkSession, outlets: Sequence[Outlet], fetcher: Fetcher, **more) -> str:
    """Register the source; returns the name of its format."""
    source = outlet_source(outlets, fetcher, **more)
    spark.dataSource.register(source)
    return source.name()
