"""Reports in event time: any order within the delay gives what the plain fold gives."""

import random
from datetime import datetime, timedelta

import pytest

from gridlore.streaming import late

T0 = datetime(2026, 8, 1)
SCHEMA = "id string, district string, place_key string, at timestamp, repair boolean, continuation boolean"


def ms(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1000)


def plain(rows):
    out = []
    for key in {r[1:3] for r in rows}:
        open_, ended = late.advance([], [(r[0], ms(r[3]), r[4], r[5]) for r in rows if r[1:3] == key])
        out += [(*key, f[0], f[1], None if len(f) < 4 else f[3], f[2]) for f in [*ended, *open_]]
    return sorted(out, key=str)


def stream(spark, tmp_path, files, name):
    own, source = late.session(spark), tmp_path / f"in-{name}"
    sizes, found = [], []
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        reports = own.readStream.schema(SCHEMA).parquet(str(source))
        out = late.follow_ups(reports).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True)
        q = out.foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start()
        q.awaitTermination()
        assert q.exception() is None
        sizes.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return sorted(((*r[:3], ms(r[3]), r[4] and ms(r[4]), r[5]) for r in found), key=str), sizes


def end(k):
    return (f"end{k}", "none", "none", T0 + timedelta(days=900 + k), True, False)


@pytest.mark.parametrize("seed", [1])
def test_late_reports(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"{k:04d}", rng.choice(["girne", "lefke"]), rng.choice(["a", "b"]), T0 + timedelta(minutes=rng.randrange(60 * 24 * 40)), rng.random() < 0.25, rng.random() < 0.3) for k in range(200)]
    came = sorted(rows, key=lambda r: r[3] + timedelta(days=rng.choice([0, 0, 0, 3])))
    found, sizes = stream(spark, tmp_path, [came[:70], came[70:140], came[140:], [end(0)], [end(1)]], "late")
    assert [r for r in found if r[0] != "none"] == plain(rows)
    assert sizes[-1] <= 4 < min(sizes[:3])  # what is left is the last row's own


def test_advance():
    h = 3_600_000
    open_, ended = late.advance([], [("a", 0, False, False), ("b", 5 * h, False, False), ("c", 50 * h, False, False), ("d", 60 * h, False, True), ("e", 100 * h, True, False)])
    assert open_ == [] and ended == [("a", 0, 3, 100 * h), ("c", 50 * h, 1, 100 * h)]
    assert late.advance([("a", 0, 1)], [("r", 145 * h, True, False)]) == ([], [("a", 0, 1, None)])
    assert late.advance([], [("r", 0, True, False), ("a", h, False, False)]) == ([("a", h, 1)], [])


class Kept(dict):
    """State by slots that counts the reports that are read and written."""

    read = written = 0
    exists, keys, removeKey = (lambda self: bool(self)), (lambda self: list(dict.keys(self))), dict.pop

    def getValue(self, key):
        self.read += len(self[key][0])
        return self[key]

    def updateValue(self, key, value):
        self.written += len(value[0])
        self[key] = value


def test_waiting_reports_are_not_read_in_every_batch():
    hour, run = 3_600_000, late.FollowUps()
    run.waiting = Kept()
    rows = [(f"{k:03d}", k * hour // 2, False, False) for k in range(400)]
    ready = []
    for batch in range(50):  # four hours each
        new, watermark = rows[8 * batch : 8 * batch + 8], (4 * batch - 100) * hour
        found, wake = run._ready(watermark, new)
        ready += found
        assert sorted(found) == found and (not run.waiting or watermark - late._LENGTH < min(wake))
    assert len(ready) == 193 and run.waiting.read < 3 * len(rows) and run.waiting.written < 3 * len(rows)
    assert sorted([*ready, *run._ready(400 * hour, [])[0]]) == rows and not run.waiting
