"""Operator 7: quality rules as a ledger of bitmasks.

``ledger`` measures every text and evaluates every rule once, in one pass; failures are bits of one
number beside the measurements. Which bits matter is a policy, a versioned mask: ``apply_policy``
decides from stored bits, and ``ablations`` counts what each rule does, from the few distinct masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import table, text_or_empty
from gridlore.llm.words import Words, mix, pieces, windows

#: Rules in the order of their bits: name, failure as SQL over the measurements.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("same_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "100 * n_upper > 30 * word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("exclaiming", "100 * n_exclaim > 30 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    1: ("few_words", "repeats"),
    2: ("few_words", "repeats", "symbols", "same_lines", "shouting", "word_length", "exclaiming"),
}
BASE, LATEST = 1, 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _EXCLAIM = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"!")


def _per_row(flag: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[rows[1:]] - total[rows[:-1]]


def _repeated(words: Words, n: int = 5) -> np.ndarray:
    """Words of each row within an n-word window that the row has twice or more."""
    first, count = words.first, len(words.start)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = windows(words.hashes(), n)
    whole = np.flatnonzero(row[: len(window)] == row[n - 1 :]) if len(window) else np.zeros(0, int)
    key = mix(window[whole] + (row[whole] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    begin = whole[times[inverse.reshape(-1)] > 1]
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    return _per_row(np.cumsum(edge[:-1]) > 0, first)


def measure(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """MEASURES of a run of texts, given as bytes and row offsets."""
    words = Words.of(data, rows)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    lines = np.zeros((2, len(rows) - 1), np.int64)
    for k, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
        worded = [x for x in data[a:b].tobytes().split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines[:, k] = len(worded), len(worded) - len(set(worded))
    return [
        np.diff(words.first),
        _per_row(inside & ((data & 0xC0) != 0x80), rows),
        _per_row(_SYMBOL[data], rows),
        lines[1],
        _repeated(words),
        lines[0],
        _per_row(_UPPER[data], rows),
        _per_row(_EXCLAIM[data], rows),
    ]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, at in pieces(batch.column("text")):
            found = [pa.array(m, pa.int64()) for m in measure(data, at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(at) - 1), *found], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and ``fail_bits`` of every row; null and white-space texts have no words. Repeated rows
    and repeated or null doc_ids are rows of their own. Other columns are ignored; an empty table gives no
    rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    measured = texts.mapInArrow(_run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"if({test}, {1 << k}, 0)" for k, (_, test) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(f"cast({bits} as bigint)"))


def apply_policy(ledger: DataFrame, version: int = LATEST) -> DataFrame:
    """``kept`` under a policy: no failed bit among those that it enforces."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """version, rule, failed, only, kept, kept_without: what each rule of each policy rejects, what it
    alone rejects, and what is kept with and without it. Rows are counted by mask first, at most
    2 ** len(RULES) of them, and the rest is arithmetic on these."""
    masks = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *(
            F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(mask(v)).alias("mask"), F.lit(BIT[name]).alias("bit"))
            for v, names in POLICIES.items()
            for name in names
        )
    )
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return (
        masks.select("fail_bits", "n", F.inline(rules))
        .groupBy("version", "rule")
        .agg(
            count(failed.bitwiseAND(F.col("bit")) != 0)("failed"),
            count(failed == F.col("bit"))("only"),
            count(failed == 0)("kept"),
            count((failed == 0) | (failed == F.col("bit")))("kept_without"),
        )
    )


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), "kept", "fail_bits",
    )


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS gram FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaim FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask(LATEST)}) = 0 AS kept, fail_bits FROM b
"""
