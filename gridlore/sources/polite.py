"""Polite fetching: one request a host at a time with a pause between, rules for robots, conditional requests and
bounded retries. ``Polite`` does it against a fetcher and a clock of your choice; ``outcomes`` and ``schedule`` say the
same of recorded requests, as column expressions."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds before a request is given up, between two of a host, before the second attempt (doubled for
# each further one), and attempts.
TIMEOUT, PAUSE, BACKOFF, ATTEMPTS = 20.0, 1.5, 1.0, 3


@dataclass(frozen=True)
class Answer:
    status: int
    body: str = ""
    headers: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Fetched:
    """What became of an address: ``ok`` with its body, ``unchanged`` or ``skipped`` with the reason."""

    status: str
    body: str = ""
    reason: str = ""
    attempts: int = 0
    started: float = 0.0


class Fetcher(Protocol):
    def get(self, url: str, headers: Mapping[str, str]) -> Answer:
        """The answer to one request; raises OSError where there is none."""


class Http:
    """Requests over the network."""

    def get(self, url: str, headers: Mapping[str, str]) -> Answer:
        request = urllib.request.Request(url, headers=dict(headers))
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return Answer(answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), {k.lower(): v for k, v in answer.headers.items()})
        except urllib.error.HTTPError as e:
            return Answer(e.code, "", {k.lower(): v for k, v in e.headers.items()})


class Recorded:
    """Answers from a stored Parquet table (part, url, status, body) with a folder a part. ``part`` names the part
    of an address by the first group of a pattern; two parts are held at a time. What is not recorded is answered 404."""

    def __init__(self, root: str, part: str):
        self.root, self.part, self._held = root, part, {}

    def _answers(self, part: str) -> dict[str, Answer]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        if part not in self._held:
            where = f"{self.root}/part={part}"
            files, path = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (None, where)
            if (files or fs.LocalFileSystem()).get_file_info(path).type == fs.FileType.NotFound:
                return {}
            rows = pq.read_table(path, columns=["url", "status", "body"], filesystem=files, partitioning=None).to_pylist()
            self._held = dict([*self._held.items(), (part, {r["url"]: Answer(r["status"], r["body"] or "") for r in rows})][-2:])
        return self._held[part]

    def get(self, url: str, headers: Mapping[str, str]) -> Answer:
        found = re.search(self.part, url)
        return self._answers(found[1]).get(url, Answer(404)) if found else Answer(404)

    def __getstate__(self):
        return {"root": self.root, "part": self.part, "_held": {}}


class Clock:
    now = staticmethod(time.time)
    sleep = staticmethod(time.sleep)


class Ticks:
    """A clock that only waiting moves."""

    def __init__(self, now: float = 0.0):
        self._now = now

    def now(self) -> float:
        return self._now

    def sleep(self, seconds: float) -> None:
        self._now += seconds


def rules_of(text: str) -> list[str]:
    """Paths that the group for all robots disallows."""
    rules, every = [], False
    for line in text.split("\n"):
        name, colon, value = line.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon and name == "user-agent":
            every = value == "*"
        elif every and name == "disallow" and value:
            rules.append(value)
    return rules


def allowed(path: str, rules: list[str]) -> bool:
    return not any(re.match(".*".join(map(re.escape, rule.removesuffix("$").split("*"))), path) for rule in rules)


class Polite:
    """Requests under one name. ``cache`` keeps the validators of addresses (etag, last-modified) from run to run."""

    def __init__(self, fetcher: Fetcher, agent: str, clock=Clock, cache: MutableMapping[str, dict[str, str]] | None = None):
        self.fetcher, self.agent, self.clock, self.cache = fetcher, agent, clock, {} if cache is None else cache
        self._free: dict[str, float] = {}
        self._rules: dict[str, list[str]] = {}

    def _robots(self, origin: str) -> list[str]:
        if origin not in self._rules:
            try:
                answer = self.fetcher.get(f"{origin}/robots.txt", {"user-agent": self.agent})
                self._rules[origin] = rules_of(answer.body) if 200 <= answer.status < 300 else []
            except OSError:
                self._rules[origin] = []
        return self._rules[origin]

    def fetch(self, url: str) -> Fetched:
        parts = urlsplit(url)
        if not allowed(parts.path or "/", self._robots(f"{parts.scheme}://{parts.netloc}")):
            return Fetched("skipped", reason=f"disallowed by robots.txt: {parts.path or '/'}")
        self.clock.sleep(max(0.0, self._free.get(parts.netloc, 0.0) - self.clock.now()))
        started = self.clock.now()
        try:
            return self._attempts(url, started)
        finally:
            self._free[parts.netloc] = self.clock.now() + PAUSE

    def _attempts(self, url: str, started: float) -> Fetched:
        known = self.cache.get(url, {})
        conditions = {"etag": "if-none-match", "last-modified": "if-modified-since"}
        headers = {"user-agent": self.agent, "accept": "application/xml, text/xml, text/html;q=0.9", "accept-language": "tr,en;q=0.8"}
        headers |= {conditions[k]: v for k, v in known.items()}
        for attempt in range(1, ATTEMPTS + 1):
            try:
                answer = self.fetcher.get(url, headers)
                if answer.status == 304:
                    return Fetched("unchanged", attempts=attempt, started=started)
                if answer.status != 429 and answer.status < 500:
                    if not 200 <= answer.status < 300:
                        return Fetched("skipped", reason=f"responded {answer.status}", attempts=attempt, started=started)
                    validators = {k: answer.headers[k] for k in conditions if answer.headers.get(k)}
                    if validators:
                        self.cache[url] = validators
                    return Fetched("ok", answer.body, attempts=attempt, started=started)
                why = f"upstream responded {answer.status}"
            except OSError as e:
                why = str(e) or type(e).__name__
            if attempt < ATTEMPTS:
                self.clock.sleep(BACKOFF * 2 ** (attempt - 1))
        return Fetched("skipped", reason=f"failed after {ATTEMPTS} attempts: {why}", attempts=ATTEMPTS, started=started)


# --- of recorded requests ----------------------------------------------------------------------------


def outcomes(statuses: Column) -> Column:
    """(status, attempts, waited) of a request whose attempts would be answered by ``statuses``; a status of 0 is no
    answer. ``waited`` are the seconds of waiting for another attempt."""
    again = lambda s: (s == 0) | (s == 429) | (s >= 500)
    tried = F.slice(statuses, 1, ATTEMPTS)
    last = F.filter(tried, lambda s: ~again(s))
    attempts = F.when(F.size(last) > 0, F.array_position(F.transform(tried, lambda s: ~again(s)), True)).otherwise(ATTEMPTS).cast("int")
    final = F.get(last, F.lit(0))
    status = F.when(final == 304, "unchanged").when((final >= 200) & (final < 300), "ok").otherwise("skipped")
    return F.struct(status.alias("status"), attempts.alias("attempts"), (BACKOFF * (F.pow(2.0, attempts - 1) - 1)).alias("waited"))


def schedule(requests: DataFrame, seconds: str, part: int = 10_000) -> DataFrame:
    """Adds ``started``, seconds after the first request of its host: requests of a host (host, ordinal) follow each
    other, each after the seconds of those before it and a pause. Hosts may have any number of requests: they are summed by
    parts of ``part`` ordinals, and only within a part in order."""
    took = F.col(seconds) + PAUSE
    rows = requests.withColumn("__part", F.floor(F.col("ordinal") / part))
    sums = rows.groupBy("host", "__part").agg(F.sum(took).alias("__took"))
    before = Window.partitionBy("host").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("host", "__part", F.coalesce(F.sum("__took").over(before), F.lit(0.0)).alias("__before"))
    within = Window.partitionBy("host", "__part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, ["host", "__part"]).withColumn("started", F.col("__before") + F.coalesce(F.sum(took).over(within), F.lit(0.0)))
    return joined.drop("__part", "__before")
