"""Operator 1: shards by balanced label propagation.

Documents that share a link key (here: equal texts, and lines that different texts have in common) are linked. Rows
with the same keys are bundled into vertices of at most 1/64 of a shard, so that a text has at most 64 vertices a
shard, however many copies it has. A key is a hub: neighbours meet in its counts by shard, never in pairs. Each round joins vertices
with their hubs' counts, lets each wish for the shard that holds most of its neighbours (each key counts once, by the
shares of its neighbours, so that a line of a third of all rows does not outweigh what few share), and grants wishes
under capacity quotas: wishes are counted by pair of shards and gain, and the driver turns this fixed
small table into one threshold a pair. Rounds go on until no wish can be granted or the cut hardly
shrinks.

Then sizes are made exact. Rows of one bundle and shard are a clump; clumps of two rows or more are placed
whole, the largest first, in their shard, else where there is room; rows without copies that are linked stay in their
shard while it has room, the others fill up. Only what finds no room as a whole is split. Nothing depends on where a row is stored: labels, draws and orders come
from digests of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import RID, WORD, crc32_text, cut, digest, drop, table, text_or_empty, with_row_id

#: Vertices of a full shard that has nothing but one bundle.
_PIECES = 64
#: Parts that copies of one text are numbered in.
_SALT = 64
#: Rows that one task sums up at a time, and hash buckets of a running sum at most.
_RANKED, _BUCKETS = 10_000, 4096
_LEVELS = 40
#: Rounds that end the propagation where each shrinks the cut by less than 1 in ``_GAIN``.
_PATIENCE, _GAIN = 3, 32
#: What the neighbours of one key weigh.
_SHARE = 1024
#: Words of a line that links the texts that have it.
LINK_WORDS = 5


def _capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _draw(*columns, seed: int) -> Column:
    """20 bits that depend on the columns' values alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 20)).cast("int")


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _grant(asked: dict, room: list[int], shards: int) -> dict:
    """(from, to) -> (level, share of draws): wishes above the level are granted, and that share of the level.

    Two shards may swap as many rows as wish both ways; beyond that, wishes share a shard's room.
    """
    total = {(i, j): sum(asked.get((i, j, k), 0) for k in range(_LEVELS)) for i in range(shards) for j in range(shards)}
    quota = {(i, j): min(n, total[j, i]) for (i, j), n in total.items()}
    for j in range(shards):
        rest = {i: total[i, j] - quota[i, j] for i in range(shards)}
        left = min(max(room[j], 0), sum(rest.values()))
        for i, n in rest.items():
            quota[i, j] += left * n // max(sum(rest.values()), 1)
    bars = {}
    for (i, j), left in quota.items():
        if not left:
            continue
        at = (-1, 0)
        for k in range(_LEVELS - 1, -1, -1):
            n = asked.get((i, j, k), 0)
            if n > left:
                at = (k, (left << 20) // n)
                break
            left -= n
        bars[i, j] = at
    return bars


def propagate(vertices: DataFrame, capacity: list[int]) -> DataFrame:
    """``vertices`` (sig, piece, w, keys, label) with the labels that propagation ends in.

    Wishes count the shares of each key's neighbours, by weight, oneself left out. A vertex may move in every other round, by its
    draw, so that neighbours do not change places for ever; the labels of the smallest cut are returned.
    """
    shards = len(capacity)
    now, best, still, turn = cut(vertices), None, 0, 0
    while still < _PATIENCE:
        member = now.select("sig", "piece", "w", "label", F.explode("keys").alias("key"))
        hubs = member.groupBy("key").agg(*[F.sum(F.when(F.col("label") == s, F.col("w")).otherwise(0)).alias(f"n{s}") for s in range(shards)])
        others = sum((F.col(f"n{s}") for s in range(1, shards)), F.col("n0")) - F.col("w")
        share = [F.expr(f"((n{s} - if(label = {s}, w, 0L)) * {_SHARE}) div others") for s in range(shards)]
        near = (
            member.join(hubs, "key")
            .withColumn("others", F.greatest(others, F.lit(1)))
            .groupBy("sig", "piece", "w", "label")
            .agg(*[F.sum(x).alias(f"n{s}") for s, x in enumerate(share)], F.min("key").alias("tie"))
        )
        rank = [F.struct(F.col(f"n{s}").alias("n"), _draw("tie", F.lit(s), seed=2).alias("tie"), F.lit(s).alias("s")) for s in range(shards)]
        own = F.element_at(F.array(*[F.col(f"n{s}") for s in range(shards)]), F.col("label") + 1)
        total = sum((F.col(f"n{s}") for s in range(1, shards)), F.col("n0"))
        wish = cut(
            near.select("sig", "piece", "w", "label", own.alias("own"), (F.col("w") * (total - own)).alias("apart"), F.greatest(*rank).alias("best")).select(
                "sig",
                "piece",
                "w",
                "label",
                "apart",
                F.col("best.s").alias("to"),
                F.least(F.floor(F.log2(F.col("best.n") - F.col("own") + 1)).cast("int"), F.lit(_LEVELS - 1)).alias("level"),
                (F.col("best.n") > F.col("own")).alias("gains"),
                _draw("sig", "piece", seed=100 + turn).alias("draw"),
            )
        )
        moves = (F.col("to") != F.col("label")) & (F.col("gains") | (F.col("level") == 0)) & (F.col("draw") % 2 == 0)
        counts = wish.groupBy("label", "to", F.when(moves, F.col("level")).alias("level")).agg(F.sum("w").alias("w"), F.sum("apart").alias("apart")).collect()
        apart = sum(r["apart"] for r in counts)
        if best is None or apart < best[0]:
            still = 0 if best is None or apart * _GAIN < best[0] * (_GAIN - 1) else still + 1
            if best is not None:
                drop(best[1])
            best = (apart, now)
        else:
            still += 1
        size = [sum(r["w"] for r in counts if r["label"] == s) for s in range(shards)]
        asked = {(r["label"], r["to"], r["level"]): r["w"] for r in counts if r["level"] is not None}
        bars = _grant(asked, [c - n for c, n in zip(capacity, size, strict=True)], shards)
        if not bars or not apart:
            drop(wish)
            break
        pair = F.col("label") * shards + F.col("to")
        at, share = (_pick([bars.get((i, j), (_LEVELS, 0))[k] for i in range(shards) for j in range(shards)], pair) for k in (0, 1))
        granted = moves & ((F.col("level") > at) | ((F.col("level") == at) & (F.col("draw") < share)))
        moved = wish.where(granted).select("sig", "piece", F.col("to").alias("__to"))
        stay = now.join(moved, ["sig", "piece"], "left")
        old, now = now, cut(stay.withColumn("label", F.coalesce("__to", "label")).select(*vertices.columns))
        drop(wish)
        if old is not best[1]:
            drop(old)
        turn += 1
    return best[1]


def _running(clumps: DataFrame, group: str) -> DataFrame:
    """Adds ``before``: the weight of all clumps ahead in ``group``, heavier ones first, then by hash. Clumps
    fall into buckets in that order, buckets are summed, and their sums are summed in turn: at most
    64 x ``_BUCKETS`` of them a group."""
    buckets = max(256, min(_BUCKETS, clumps.count() // _RANKED))
    tier = 63 - F.floor(F.log2("w")).cast("int")
    rows = clumps.withColumn("__b", tier * buckets + F.pmod(F.xxhash64("sig", "label", "off"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(group, "__b").agg(F.sum("w").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(group, "__b").orderBy("sig", "label", "off").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("w").over(inner), F.lit(0)))
    return rows.join(sums, [group, "__b"]).withColumn("before", F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def _intervals(room: list[int]) -> list[tuple[int, int, int]]:
    """(shard, first, end) of the shards' rooms one after another, the largest first."""
    found, at = [], 0
    for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
        if room[s] > 0:
            found.append((s, at, at + room[s]))
            at += room[s]
    return found


def settle(clumps: DataFrame, capacity: list[int]) -> DataFrame:
    """(sig, label, off, w, shard) of ``clumps`` (sig, label, w, tied): each whole in one shard, or, what finds no
    room, cut into parts that begin at ``off``. Single rows that are ``tied`` stay where groups leave room. Every shard
    ends with exactly its capacity."""
    shards = len(capacity)
    columns = ["sig", "label", "off", "w", "shard"]
    clumps = clumps.withColumn("off", F.lit(0).cast("long"))
    groups, singles = clumps.where("w > 1"), clumps.where("w = 1")
    home = cut(_running(groups, "label").withColumn("stays", F.col("before") + F.col("w") <= _pick(capacity, F.col("label"))))
    done = [home.where("stays").withColumn("shard", F.col("label")).select(*columns)]
    room = list(capacity)

    def take(placed: DataFrame) -> int:
        found = {r["shard"]: r["w"] for r in placed.groupBy("shard").agg(F.sum("w").alias("w")).collect()}
        for s, w in found.items():
            room[s] -= w
        return len(found)

    take(done[0])
    pool = home.where("not stays").select("sig", "label", "off", "w")
    while True:
        inside = F.lit(None).cast("int")
        for s, first, end in _intervals(room):
            inside = F.when((F.col("before") >= first) & (F.col("before") + F.col("w") <= end), s).otherwise(inside)
        tried = cut(_running(pool.withColumn("g", F.lit(0)), "g").withColumn("shard", inside))
        done.append(tried.where("shard is not null").select(*columns))
        pool = tried.where("shard is null").select("sig", "label", "off", "w")
        if not take(done[-1]):
            break
    near = cut(_running(singles.where("tied"), "label").withColumn("stays", F.col("before") < _pick(room, F.col("label"))))
    done.append(near.where("stays").withColumn("shard", F.col("label")).select(*columns))
    take(done[-1])
    pool = pool.union(near.where("not stays").select("sig", "label", "off", "w")).union(singles.where("not tied").select("sig", "label", "off", "w"))
    # What is left fills the rooms in order, groups first; singles never cross an edge.
    rest = _running(pool.withColumn("g", F.lit(0)), "g")
    edges = _intervals(room)
    parts = F.array(
        *[
            F.struct(F.lit(s).alias("shard"), F.greatest(F.col("before"), F.lit(a)).alias("a"), F.least(F.col("before") + F.col("w"), F.lit(b)).alias("b"))
            for s, a, b in edges
        ]
    )
    if edges:
        part = rest.select("sig", "label", "before", F.explode(F.filter(parts, lambda p: p["a"] < p["b"])).alias("p"))
        done.append(part.select("sig", "label", (F.col("p.a") - F.col("before")).alias("off"), (F.col("p.b") - F.col("p.a")).alias("w"), "p.shard"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def place_bundles(bundles: DataFrame, rows: int, shards: int) -> tuple[int, DataFrame]:
    """Where the rows of ``bundles`` (sig, n, keys) go: vertex size, and (sig, piece, lo, hi, shard, slot):
    the copies ``lo`` to ``hi`` (excluded) of a bundle, in its vertex ``piece``, and the slot of the first."""
    capacity = _capacities(rows, shards)
    size = max(1, rows // (shards * _PIECES))
    first = F.coalesce(F.get("keys", F.lit(0)), F.col("sig"))
    spread = F.floor(F.col("piece") * size / max(1, 3 * rows // (4 * shards)))
    vertices = bundles.select("sig", "n", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("piece")).select(
        "sig", "piece", F.least(F.lit(size), F.col("n") - F.col("piece") * size).cast("long").alias("w"), "keys",
        F.pmod(F.pmod(F.xxhash64(first, F.lit(1)), F.lit(shards)) + spread, F.lit(shards)).cast("int").alias("label"),
    )
    vertices = cut(vertices)
    # Vertices with a neighbour; the others have nothing to follow.
    hubs = vertices.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key")
    near = vertices.select("sig", "piece", F.explode("keys").alias("key")).join(hubs, "key").select("sig", "piece").distinct()
    linked = propagate(vertices.join(near, ["sig", "piece"]), capacity).select("sig", "piece", F.col("label").alias("__to"))
    labelled = vertices.join(linked, ["sig", "piece"], "left").select("sig", "piece", "w", F.coalesce("__to", "label").alias("label"), F.col("__to").isNotNull().alias("tied"))
    inner = Window.partitionBy("sig", "label").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    labelled = cut(labelled.withColumn("at", F.coalesce(F.sum("w").over(inner), F.lit(0))))
    settled = cut(settle(labelled.groupBy("sig", "label").agg(F.sum("w").alias("w"), F.bool_or("tied").alias("tied")), capacity))
    slots = _running(settled, "shard").select("sig", "label", "off", F.col("w").alias("len"), "shard", F.col("before").alias("slot"))
    lo, hi = F.greatest("at", "off"), F.least(F.col("at") + F.col("w"), F.col("off") + F.col("len"))
    found = labelled.join(slots, ["sig", "label"]).where(lo < hi)
    from_first = F.col("piece") * size - F.col("at")
    return size, found.select("sig", "piece", (lo + from_first).alias("lo"), (hi + from_first).alias("hi"), "shard", (F.col("slot") + lo - F.col("off")).alias("slot"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: numbers from 0 within ``sig``. Copies are dealt into ``_SALT`` parts, which are counted
    and numbered apart, so that no task has all copies of a text."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(RID), F.lit(_SALT)).cast("int"))
    counts = rows.groupBy("sig", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("sig").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sig", "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    inner = Window.partitionBy("sig", "__salt").orderBy(RID)
    rows = rows.withColumn("__k", F.row_number().over(inner) - 1).join(starts, ["sig", "__salt"])
    return rows.withColumn("copy", F.col("__first") + F.col("__k")).drop("__salt", "__k", "__first")


def shard_bundled(rows: DataFrame, bundles: DataFrame, shards: int) -> DataFrame:
    """``rows`` (stored, with sig and copy) with shard and slot; ``bundles`` are (sig, n, keys)."""
    size, parts = place_bundles(bundles, rows.count(), shards)
    parts = cut(parts)
    placed = rows.withColumn("piece", F.floor(F.col("copy") / size)).join(parts, ["sig", "piece"]).where("copy >= lo and copy < hi")
    return placed.withColumn("slot", F.col("slot") + F.col("copy") - F.col("lo")).drop("sig", "piece", "copy", "lo", "hi")


def shard_rows(rows: DataFrame, members: DataFrame, shards: int = 8) -> DataFrame:
    """(``__rid``, shard, slot) of ``rows`` (``__rid``), linked by ``members`` (``__rid``, key).

    A row may have several keys, few by nature; a row without any is its own bundle. An empty table gives
    no rows.
    """
    keys = members.groupBy(RID).agg(F.sort_array(F.collect_set(F.col("key").cast("string"))).alias("keys"))
    sig = F.md5(F.coalesce(F.to_json("keys"), F.concat(F.lit("row "), F.hex(F.col(RID)))))
    rows = cut(numbered(rows.select(RID).join(keys, RID, "left").withColumn("sig", sig)))
    bundles = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    return shard_bundled(rows.drop("keys"), bundles, shards)


def shared_lines(texts: DataFrame, least: int = LINK_WORDS) -> DataFrame:
    """(sig, key): the lines of ``least`` words or more that texts of different ``sig`` have in common, for each of
    them once. texts: sig, text; copies count once. Keys are 64-bit hashes: two lines that share one link two texts
    more, nothing else."""
    long = F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"(?:{WORD}[\x20\x09-\x0D]+){{{least - 1}}}{WORD}"))
    lines = texts.select("sig", F.explode(F.array_distinct(F.transform(long, lambda x: F.xxhash64(x)))).alias("key"))
    of = F.xxhash64("sig")
    shared = cut(lines.groupBy("key").agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b").select("key"))
    return lines.join(shared, "key", "left_semi").select("sig", F.hex("key").alias("key")).distinct()


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Linked are rows of equal text, null counting as empty, and different texts with a line of ``LINK_WORDS`` words or
    more in common; texts of any length are linked by all their lines. Counts of shards differ by one at most, slots
    run from 0 without gaps. A group of copies is split only where no shard has room for the whole of it
    once larger groups are placed. Which shards a text's copies go to depends on the texts and their
    counts, not on how the table is stored. Repeated rows and repeated or null doc_ids are rows of their
    own. ``docs`` must be a stored Parquet table. Other columns are ignored; an empty table gives no rows.
    """
    base = with_row_id(docs).select(
        RID,
        "doc_id",
        (F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")) + 1).cast("long").alias("size"),
        crc32_text().alias("text_crc32"),
        F.hex(digest()).alias("sig"),
    )
    rows = cut(numbered(base).drop(RID))
    lines = shared_lines(docs.select(F.hex(digest()).alias("sig"), "text")).groupBy("sig").agg(F.sort_array(F.collect_set("key")).alias("lines"))
    bundles = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).join(lines, "sig", "left")
    bundles = bundles.select("sig", "n", F.concat(F.array("sig"), F.coalesce("lines", F.array().cast("array<string>"))).alias("keys"))
    placed = shard_bundled(rows, bundles, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
