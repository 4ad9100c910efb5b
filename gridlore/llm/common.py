"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here reads it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Internal name of a row's identity; documents may carry any other column.
RID = "__rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset a folder
    of the warehouse, which is shared as well."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_scratch(df: DataFrame, kind: str) -> str:
    """Write ``df`` to a new path of the shared folder; it goes when the session's JVM ends, if not before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _hadoop(spark, path)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that outlives executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, "cut"))


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` has written, once nothing reads them any more."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            files, place = _hadoop(df.sparkSession, path)
            files.delete(place, True)


def with_row_id(docs: DataFrame) -> DataFrame:
    """Identify the rows of a stored Parquet table by file and place in it: 16 bytes, the same in every scan,
    however its files are split. Anything but a file scan is refused, as it has no such places."""
    at = F.col("_metadata")
    part = lambda number: F.lpad(F.hex(number), 16, "0")
    return docs.withColumn(RID, F.unhex(F.concat(part(F.xxhash64(at["file_path"])), part(at["row_index"]))))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc32_text(column: str = "text") -> Column:
    return F.crc32(F.encode(text_or_empty(column), "UTF-8"))


def digest(column: str = "text") -> Column:
    """128 bits that stand for a whole text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.encode(text_or_empty(column), "UTF-8")))
