"""Operator 12: audit how the sources of a language differ in their words, in plain relational steps.

1. Explode the terms of every text, and beside them its distinct terms; one grouping counts both, so that
   occurrences and documents of a (lang, source, term) come from one scan and one shuffle.
2. A language keeps the terms that enough of its documents hold.
3. Groups meet the kept vocabulary of their language, so that a term which a source never uses has a count
   of 0 there, and every count becomes a smoothed share p in billionths.
4. The table of shares joins itself on language and term: absolute differences are summed for each pair of
   sources. A term's own difference is taken from the share that it has in the whole language.
5. Windows rank both.

Language and source are few values with many rows each, so wherever rows meet on them alone they also meet
on a salt of the term; the dense table has terms times sources rows and not more.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.llm.common import cut, table

#: A term: a longest run of letters, where every character beyond ASCII counts as one; and what lies between terms.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a kept term needs; its pseudo-count; shares are parts of this.
LEAST, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Terms reported for each group.
TOP = 50
#: Parts that the vocabulary of one language is dealt into.
SALT = 64


def terms(text: Column) -> Column:
    """All matches of TERM in order, found as what is left between matches of its complement, which takes an eighth
    of the time of extracting them; an empty string may stand at either end."""
    lower = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(lower, BETWEEN)


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exact: decimals, as counts of a large corpus
    times a billion pass 64 bits."""
    return F.expr(f"1 + ({UNIT} * cast({count} + {SMOOTH} as decimal(27, 0))) div cast({total} + {SMOOTH} * {kept} as decimal(27, 0))").cast("long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with at least one."""
    found = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], terms(F.coalesce("text", F.lit(""))).alias("all"))
    # The distinct terms of a text follow its terms in one array, so that a place tells what a term counts for.
    listed = found.select("lang", "source", F.size("all").alias("size"), F.posexplode(F.concat("all", F.array_distinct("all"))).alias("at", "term"))
    again = F.col("at") >= F.col("size")
    rows = listed.where("term <> ''").select("lang", "source", "term", F.when(again, 0).otherwise(1).alias("n"), F.when(again, 1).otherwise(0).alias("docs"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").cast("long").alias("n"), F.sum("docs").cast("long").alias("docs"))


def shares(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(groups, dense): groups has each (lang, source) once; dense has for each group and kept term of its
    language the count ``n``, the share ``p`` and the share ``q`` that the term has in the language."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = cut(term_counts(docs))
    held = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    held = cut(held.select("lang", "term", "lang_n"))
    langs = held.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    kept_counts = counts.join(held.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    totals = kept_counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    group_rows = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").select("*", salts)
    zeros = held.withColumn("salt", _salt()).join(group_rows, ["lang", "salt"])
    dense = zeros.join(kept_counts, ["lang", "source", "term"], "left").select(
        "lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"), "kept", "lang_n", "lang_total"
    )
    return groups, dense.select("lang", "source", "term", "n", _share("n", "total", "kept").alias("p"), _share("lang_n", "lang_total", "kept").alias("q"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank), ranks from 1 by falling value, equal ones by item.

    Part ``pair``: item is each other source of the language, value the difference of their shares summed over
    the kept terms (0 where the language keeps none). Part ``term``: item is a kept term which the source uses
    more than its language does, value how much more; the first ``top``.

    Null text, lang and source count as ''; empty texts have no terms, but their group is there. Repeated rows
    count each. Very long texts are split into terms whole. Other columns are ignored, whatever their names; an
    empty table gives no rows."""
    groups, dense = shares(docs, least)
    dense = cut(dense)
    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    half = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    summed = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    more = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(more.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT c.lang, source, term, n, (1 + ({UNIT} * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY c.lang, source)::HUGEINT + {SMOOTH} * v))::BIGINT AS p FROM c JOIN v ON c.lang = v.lang),
q AS (SELECT l.lang, term, (1 + ({UNIT} * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY l.lang)::HUGEINT + {SMOOTH} * v))::BIGINT AS q FROM l JOIN v ON l.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= {TOP}
"""
