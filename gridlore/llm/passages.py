"""Operator 8: substring dedup by hashing lines and the sentences in them.

Units are hashed by their words in lower case, whatever white space between:

* every line of ``line_words`` words or more;
* chains of sentences, for passages that begin or end inside a line. A sentence begins at a line's start,
  after a sentence end, or at a word with a capital; where none begins for long, words begin one that their
  hash picks, so that the same words are cut in the same places in any text. From each sentence on, and
  back, a chain has just enough of them for ``chain_words`` words, so that a digest stands for the same
  amount of text however short sentences are.

Digests are grouped over the whole corpus; the earliest occurrence is kept. In every other place repeated
lines go, and so do runs of adjacent repeated units of at least ``least_words`` words. Words that are in no
repeated unit are never removed. Runs are spans of the original text, so all offsets stay known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import RID, cut, table, text_or_empty, with_row_id
from gridlore.llm.components import over_key
from gridlore.llm.words import Words, mix, pieces, utf8

#: Words of a sentence that is an anchor, of a chain that is hashed, and of a run that is removed.
UNIT_WORDS, CHAIN_WORDS, RUN_WORDS = 3, 12, 30
#: Words of a line that the query and the pipeline remove by itself; shorter ones (notices, headings, stock
#: phrases) are common to documents that have nothing else in common. The operator itself takes all lines.
LINE_WORDS = 30
#: Words of a sentence that is cut further, and one in how many words begins another there.
LONG_WORDS, _ONE_IN = 24, 8
#: An odd factor and its inverse modulo 2**64: the digest of a chain does not depend on its place.
_U = np.uint64
_FACTOR = 0xD1342543DE82EF95
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rows_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.rows) - 1), np.diff(words.first))


def lines_of(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word (end excluded) of every line of ``least`` words or more."""
    n, row, line = len(words.start), _rows_of(words), np.cumsum(words.data == 10)[words.start]
    start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])))) if n else np.zeros(0, int)
    end = np.append(start[1:], n)
    keep = end - start >= least
    return start[keep], end[keep]


def anchors_of(words: Words, lower: Words, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word (end excluded) of every sentence of ``least`` words or more. ``lower`` has the
    same words in lower case, ``hashes`` theirs."""
    n, data, low, a, b = len(words.start), words.data, lower.data, words.start, lower.start
    row, line = _rows_of(words), np.cumsum(data == 10)[a]
    begins = np.ones(n, bool)
    begins[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | np.isin(data[words.end[:-1] - 1], list(b".!?"))
    capital = data[a] != low[b]
    for k, lead in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        long = np.flatnonzero((data[a] >= lead) & (a + k < len(data)) & (b + k < len(low)))
        capital[long] |= data[a[long] + k] != low[b[long] + k]
    begins |= capital
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, n))
    begins |= np.repeat(size > LONG_WORDS, size) & (hashes % _U(_ONE_IN) == 0)
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    keep = end - start >= least
    return start[keep], end[keep]


def chains_of(words: Words, lower: Words, hashes: np.ndarray, unit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (end excluded) of every chain: from each anchor onward, and back, just enough
    sentences for ``least`` words."""
    start, end = anchors_of(words, lower, hashes, unit)
    n, k, row = len(start), np.arange(len(start)), _rows_of(words)
    onward = np.searchsorted(end, start + least)
    back = np.searchsorted(start, end - least, "right") - 1
    a, b = np.concatenate((k, back)), np.concatenate((onward, k))
    inside = (a >= 0) & (b < n)
    a, b = start[a[inside]], end[b[inside]]
    inside = row[a] == row[b - 1]
    return a[inside], b[inside]


def units_of(words: Words, lower: Words, line: int, unit: int, chain: int) -> tuple[np.ndarray, ...]:
    """Row, digest, words and characters of every line and chain. Words are first * 2**32 + last of the row,
    characters first * 2**32 + 2 * last + whether it is a line; ends are excluded."""
    hashes = lower.hashes()
    first, last = lines_of(words, line)
    (a, b), n = chains_of(words, lower, hashes, unit, chain), len(words.start) + 1
    whole = first * np.int64(n) + last
    key = np.unique(np.concatenate((whole, a * np.int64(n) + b)))
    start, end = np.divmod(key, n)
    row = _rows_of(words)[start]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * _powers(_FACTOR, len(hashes)), dtype=_U)))
    digest = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(hashes) + 1)[start] + (end - start).astype(_U)).view(np.int64)
    char = np.cumsum((words.data & 0xC0) != 0x80) - 1
    char -= np.repeat(np.append(char, 0)[words.rows[:-1]], np.diff(words.rows))  # within the row
    begin, stop = char[words.start[start]], char[words.end[end - 1] - 1] + 1
    return row, digest, (start - words.first[row] << 32) + end - words.first[row], (begin << 32) + 2 * stop + np.isin(key, whole)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _units(line_words: int, unit_words: int, chain_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in pieces(batch.column("text")):
                part = batch.slice(first, len(at) - 1)
                words, lower = Words.of(data, at), Words.of(*utf8(_lower(part.column("text"))))
                row, *found = units_of(words, lower, line_words, unit_words, chain_words)
                units = [part.column(RID).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in found)]
                yield pa.RecordBatch.from_arrays(units, [RID, "digest", "words", "chars"])

    return run


def repeated_spans(
    docs: DataFrame, least_words: int = RUN_WORDS, line_words: int = 1, unit_words: int = UNIT_WORDS, chain_words: int = CHAIN_WORDS
) -> DataFrame:
    """(``__rid``, spans): what to remove from each row, spans in order, begin and end in characters.

    Occurrences are ranked by doc_id (of any type that has an order; rows without one last), then row and
    place. ``kept_in`` names the doc_id of the earliest occurrence of the span's first unit.
    """
    texts = with_row_id(docs).select(RID, text_or_empty().alias("text"))
    found = cut(texts.mapInArrow(_units(line_words, unit_words, chain_words), f"{RID} binary, digest long, words long, chars long"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(RID).alias("rid"), F.col("words").alias("words"))
    # Most digests occur once: counts leave them out before ids and ranks are shuffled. What is left is
    # written, as it is read twice.
    shared = over_key(found, "digest", RID, n=F.count(F.lit(1))).where("n > 1").drop("n")
    shared = cut(shared.join(with_row_id(docs).select(RID, "doc_id"), RID))
    later = over_key(shared, "digest", RID, least=F.min(rank)).where(rank > F.col("least"))
    low = lambda packed: F.col(packed).bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda packed: F.shiftright(packed, 32)
    later = later.select(
        RID, "words", high("words").alias("word"), low("words").alias("end_word"), high("chars").alias("begin"), F.shiftright(low("chars"), 1).alias("end"),
        (F.col("chars") % 2 == 1).alias("line"), F.col("least.id").alias("kept_in"),
    )
    in_row = Window.partitionBy(RID).orderBy("words")
    reached = F.max("end_word").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    span = lambda begin, end, words, kept: F.struct(begin.alias("begin"), end.alias("end"), words.alias("words"), kept.alias("kept_in"))
    line = span(F.col("begin"), F.col("end"), F.col("end_word") - F.col("word"), F.col("kept_in"))
    runs = (
        later.withColumn("opens", F.when(F.col("word") <= reached, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(RID, "run")
        .agg(
            span(F.min("begin"), F.max("end"), F.max("end_word") - F.min("word"), F.min_by("kept_in", "words")).alias("whole"),
            F.collect_list(F.when(F.col("line"), line)).alias("lines"),
        )
    )
    spans = F.when(F.col("whole.words") >= least_words, F.array("whole")).otherwise(F.col("lines"))
    return runs.groupBy(RID).agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("spans")).where(F.size("spans") > 0)


def without_spans(text: str = "text", spans: str = "spans") -> Column:
    """The text without its spans."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.char_length(text).cast("long")))
    part = lambda i: F.substring(F.col(text), (edges[i] + 1).cast("int"), (begins[i] - edges[i]).cast("int"))
    rest = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), part), "")
    return F.when(F.col(spans).isNull(), F.col(text)).otherwise(rest)


def dedup_passages(docs: DataFrame, least_words: int = RUN_WORDS, line_words: int = 1) -> DataFrame:
    """``docs`` with repeated lines and passages cut out of ``text``, and the cut ``spans`` (null where none).

    Every row stays, even where nothing of its text does: equal texts lose all but the first. Null texts
    stay null, texts without words stay as they are. Repeated rows are later occurrences. ``docs`` must be
    a stored Parquet table; extra columns pass through (one named ``spans`` is replaced). An empty table
    gives no rows. A passage that begins or ends inside a sentence is found from its first to its last
    boundary; a repeated line is always found.
    """
    spans = repeated_spans(docs, least_words, line_words)
    return with_row_id(docs.drop("spans")).join(spans.hint("shuffle_hash"), RID, "left").drop(RID).withColumn("text", without_spans())


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what stays), n_spans, cut_chars, and the spans as JSON with original offsets."""
    found = dedup_passages(table(spark, sf_dir, "documents"), line_words=LINE_WORDS)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select(
        "doc_id",
        "text",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(total, F.lit(0)).cast("long").alias("cut_chars"),
        F.coalesce(F.to_json("spans"), F.lit("[]")).alias("spans"),
        F.array_distinct(F.transform("spans", lambda s: s["kept_in"])).alias("kept_in"),
    )
