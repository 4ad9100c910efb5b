"""Operator 6: hierarchical packing of documents into sequences of several lengths.

Each document is tokenised and closed by an end id. Its full windows are sequences of their own; the
rest is routed to the shortest tier (256, 512, 1024 or 2048) that holds it. From the longest tier
down, each window's gap is filled with the best-fitting pieces of shorter tiers, the last one cut to
fit, so that windows close at exactly their tier's length and need no padding. What remains is joined
into the longest windows. The sequences of a tier are dealt into step groups of equal tokens.

Every partition packs what it reads, pool after pool, so no text is shuffled, and hands the open rest of a
pool to the next; only a partition's last sequence can be padded. Step groups go over all partitions.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import cut, table, text_or_empty

#: Window lengths, longest first.
TIERS = (2048, 1024, 512, 256)
#: Token ids that are packed together.
POOL = 4_000_000
#: Tokens of a step group.
STEP = 16 * 2048

Piece = tuple[int, int, int]  # document, start, length


def pack(items: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences (tier, pieces) of ``items``, and the pieces that fill no window: fewer tokens
    than the longest tier."""
    top, full = tiers[0], []
    queue: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # length, document, start
    for doc, start, size in items:
        while size >= top:
            full.append((top, [(doc, start, top)]))
            start, size = start + top, size - top
        if size:
            tier = min(t for t in tiers if t >= size)
            if size == tier:
                full.append((tier, [(doc, start, size)]))
            else:
                queue[tier].append((size, doc, start))
    loose: list[Piece] = []
    shorter = sorted(x for t in tiers[1:] for x in queue[t])
    for tier, below in zip(tiers, (*tiers[1:], tiers[-1] // 2), strict=True):
        own = queue[tier] if tier == top else [x for x in shorter if x[0] > below]
        if tier != top:
            shorter = [x for x in shorter if x[0] <= below]
        for size, doc, start in sorted(own, reverse=True):
            window, gap = [(doc, start, size)], tier - size
            while gap and shorter:
                k = bisect.bisect_right(shorter, (gap, 1 << 62, 0)) - 1
                length, d, s = shorter.pop(max(k, 0))
                if length > gap:
                    bisect.insort(shorter, (length - gap, d, s + gap))
                    length = gap
                window.append((d, s, length))
                gap -= length
            if gap:
                loose += window
            else:
                full.append((tier, window))
    loose += [(d, s, n) for n, d, s in reversed(shorter)]
    window, gap = [], top
    for doc, start, size in loose:
        while size:
            n = min(size, gap)
            window.append((doc, start, n))
            start, size, gap = start + n, size - n, gap - n
            if not gap:
                full.append((top, window))
                window, gap = [], top
    return full, window


def encoder(tokenizer: str, ranks: str):
    """A function from a text to its ids, as ``Tokenizer.from_file(tokenizer)`` encodes it without adding
    special tokens: strings of special tokens in a text are those tokens. It runs from the same vocabulary's
    rank file ``ranks``, four times as fast; texts that its regular expressions give up on go to the
    tokenizer itself."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    special = {t.content: k for k, t in whole.get_added_tokens_decoder().items()}
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            ids = fast.encode(text, allowed_special="all")
        except ValueError:
            ids = whole.encode(text, add_special_tokens=False).ids
        return np.array([*ids, 1], "<u4")

    return encode


def packer(tokenizer: str, ranks: str, id_type: pa.DataType, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, ranks), TaskContext.get().partitionId()
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        items: list[Piece] = []
        made, made_of = 0, dict.fromkeys(tiers, 0)
        held = count = 0

        def out(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for tier, pieces in sequences:
                offset = 0
                for doc, start, size in pieces:
                    crc = zlib.crc32(ids[doc][start : start + size].tobytes())
                    rows.append((names[doc], start, size, crc, len(ids[doc]), (part << 32) + made, offset, tier, part, made_of[tier]))
                    offset += size
                made += 1
                made_of[tier] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            types = [id_type, *[pa.int64()] * 6, *[pa.int32()] * 2, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids[count], names[count] = encode(text.as_py()), name.as_py()
                items.append((count, 0, len(ids[count])))
                held += len(ids[count])
                count += 1
                if held >= pool:
                    full, items = pack(items, tiers)
                    yield out(full)
                    ids = {d: ids[d] for d, _, _ in items}
                    names = {d: names[d] for d, _, _ in items}
                    held = sum(n for _, _, n in items)
        full, rest = pack(items, tiers)
        yield out([*full, *([(tiers[0], rest)] if rest else [])])

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "part", "nth"]


def with_step_groups(pieces: DataFrame, step: int = STEP) -> DataFrame:
    """``pieces`` (stored, with the partition ``part`` that made them and ``nth``, their sequence's number in it
    by tier) with ``step_group``: the sequences of a tier, over all partitions, dealt into groups of ``step``
    tokens; only the last group of a tier has fewer. One count a partition and tier is summed up."""
    made = pieces.groupBy("tier", "part").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = made.select("tier", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    group = F.floor((F.col("first") + F.col("nth")) * F.col("tier") / step) * 64 + F.log2("tier").cast("long")
    return pieces.join(first, ["tier", "part"]).withColumn("step_group", group.cast("long")).select(*NAMES[:-2], "step_group")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """One row a piece of each row's ids; null texts are empty, one end id. Repeated rows and repeated
    doc_ids (null too) are packed row by row. Other columns are ignored; an empty table gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    made = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        packer(tokenizer, ranks, to_arrow_type(kind), tiers, pool),
        f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part int, nth long",
    )
    return with_step_groups(cut(made), step)


def byte_bpe() -> tuple[str, str]:
    """Where this installation keeps the vocabulary: its JSON file and its rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *byte_bpe())
