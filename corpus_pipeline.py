"""The corpus pipeline: five stages over whole document tables, each written and read again.

Each stage takes (spark, docs, sf_dir), where ``docs`` is a stored table, and decides on all that the
stage before kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import mixing, ngram_join, packing, passages, toxicity
from gridlore.llm.common import RID, WORD, table, with_row_id, write_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal regression rejects go. It is fitted on labelled rows of the whole table. Rows
    with null or empty texts have no toxic word and stay, repeated rows fare alike; all columns pass
    through; an empty table gives no rows."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_only(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts linked at Jaccard 0.8 on five-word shingles: the smallest doc_id, nulls
    last. Rows with null texts or without words all stay; all columns pass through; an empty table gives
    no rows."""
    return ngram_join.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier row has are cut from ``text``; a row goes only where the cuts leave no
    word. ``n_chars`` follows the text. Rows with null texts or without words stay as they are; other
    columns pass through; an empty table gives no rows."""
    found = passages.dedup_passages(docs, line_words=passages.LINE_WORDS)
    kept = found.where(F.col("spans").isNull() | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        length = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
        kept = kept.withColumn("n_chars", length)
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it. Null texts have no words; they and rows
    without doc_id or source take part; other columns pass through; an empty table gives no rows."""
    copies = mixing.mix(docs).where("copies > 0").select(F.col(RID), F.col("copies").alias("__copies"))
    taken = with_row_id(docs).join(copies.hint("shuffle_hash"), RID)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing operator returns them: null texts are one end id, repeated
    rows are packed each, an empty table gives no rows."""
    return packing.pack_documents(docs, *packing.byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", one_of_near_copies),
    ("passages", cut_passages),
    ("mix", mix_sources),
    ("packing", pack),
]
#: SQL cannot express trained models, MinHash and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spark.read.parquet(write_scratch(docs, "stage"))
    return docs
