"""Faults, their follow-ups and their repairs as keyed state in event time: reports of a stream may come late and in any
order, and state goes when nothing can reach it any more.

Reports of a district and place wait until the watermark has passed them and are then taken in the order of their
times. A report of a fault joins the open one that began at most 6 h before it, or 72 h where it says that the fault goes
on; else it begins a fault. A repair closes all open ones that began at most 144 h before it. A fault that none has closed
by then ends open. So state holds what the last 144 h and the delay of the watermark can reach, however long the stream
is. Waiting reports lie in slots of time, as they came: a slot is read when the watermark enters it, so a report is
written and read once or twice however many batches it waits for.

The session must use the RocksDB state store, as Spark asks for timers and lists of state.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlore import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes that a watermark stays behind the latest report.
DELAY = C.RESOLUTION_WINDOW
FAULTS = "district string, place_key string, id string, starts_at timestamp, ends_at timestamp, reports int"
_SLOT = "slot long, part long"
_WAITING = "ids array<string>, at array<long>, repairs array<boolean>, continuations array<boolean>"
_OPEN = "id string, at long, reports int"
_MINUTE = 60_000
#: Milliseconds of a slot of waiting reports, and reports of a part of it.
_LENGTH, _PART = 6 * 60 * _MINUTE, 5_000


def advance(open_: list[tuple], reports: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(open faults, ended faults) after reports (id, at, repair, continuation) in the order of their times. Open ones are
    (id, at, reports), ended ones have a last value: their end or None. Times are milliseconds."""
    window, open_, ended = C.RESOLUTION_WINDOW * _MINUTE, list(open_), []
    for id, at, repair, continuation in sorted(reports, key=itemgetter(1, 0)):
        # Open ones are in the order of their starts.
        while open_ and at - open_[0][1] > window:
            ended.append((*open_.pop(0), None))
        if repair:
            ended += [(*f, at) for f in open_]
            open_.clear()
            continue
        reach = (C.NO_END_ASSUMED_OVER if continuation else C.OPEN_FAULT_TOLERANCE) * _MINUTE
        known = next((k for k, f in enumerate(open_) if at - f[1] <= reach), None)
        if known is None:
            open_.append((id, at, 1))
        else:
            f = open_[known]
            open_[known] = (f[0], f[1], f[2] + 1)
    return open_, ended


class FollowUps(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _SLOT, _WAITING)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            at = (frame["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
            new += zip(frame["id"].tolist(), map(int, at.tolist()), map(bool, frame["repair"].tolist()), map(bool, frame["continuation"].tolist()), strict=True)
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [])

    def _ready(self, watermark: int, new: list[tuple]) -> tuple[list[tuple], list[int]]:
        """(reports that the watermark has passed, times to wake at for the others); what waits is kept by slots."""
        waiting = self.waiting.exists()
        parts = sorted(tuple(k) for k in self.waiting.keys()) if waiting else []
        ready, later = [], defaultdict(list)
        for r in new:
            (ready if r[1] <= watermark else later[r[1] // _LENGTH]).append(r)
        for key in [k for k in parts if k[0] * _LENGTH <= watermark]:
            for r in zip(*self.waiting.getValue(key), strict=True):
                (ready if r[1] <= watermark else later[r[1] // _LENGTH]).append(r)
            self.waiting.removeKey(key)
        kept = dict(k for k in parts if k[0] * _LENGTH > watermark)  # the last part of each slot
        for slot, reports in later.items():
            for n, k in enumerate(range(0, len(reports), _PART), kept.get(slot, -1) + 1):
                self.waiting.updateValue((slot, n), tuple(map(list, zip(*reports[k : k + _PART], strict=True))))
        # A slot that is kept begins after the watermark; of the one where the watermark is, the reports are known.
        return ready, [slot * _LENGTH for slot in kept] + [min(r[1] for r in reports) for reports in later.values()]

    def _settle(self, key, watermark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        ready, wake = self._ready(watermark, new)
        was = [*map(tuple, self.open.get())] if self.open.exists() else []
        open_, ended = advance(was, ready)
        reach = C.RESOLUTION_WINDOW * _MINUTE
        ended += [(*f, None) for f in open_ if watermark > f[1] + reach]
        open_ = [f for f in open_ if watermark <= f[1] + reach]
        if open_ != was:
            self.open.put(open_) if open_ else self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # The next thing to happen here: a report becomes ready, or an open fault is out of reach.
        if times := [*wake, *(f[1] + reach for f in open_)]:
            self.handle.registerTimer(min(times) + 1)
        if ended:
            stamp = lambda c: pd.to_datetime(pd.Series(c, dtype="Int64"), unit="ms")
            ids, at, reports, ends = zip(*ended, strict=True)
            yield pd.DataFrame({"district": key[0], "place_key": key[1], "id": ids, "starts_at": stamp(at), "ends_at": stamp(ends), "reports": pd.Series(reports, dtype="int32")})

    def close(self) -> None:
        pass


def session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep state with timers; ``spark`` keeps its settings."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def follow_ups(reports: DataFrame, delay: int = DELAY) -> DataFrame:
    """The faults of a stream of reports (id, district, place_key, at, repair, continuation), each once, when nothing
    can change it any more. Reports that come more than ``delay`` minutes after later ones are dropped, as Spark drops
    what the watermark has passed."""
    known = reports.select("id", "district", "place_key", "at", "repair", "continuation").withWatermark("at", f"{delay} minutes")
    return known.groupBy("district", "place_key").transformWithStateInPandas(FollowUps(), FAULTS, "Append", "EventTime")
