"""Sessions with the settings that the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere; plans are adapted at run time. Nothing here depends on the size of a cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "gridlore", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir`` or, where that is unset,
    in the warehouse; it goes when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, kind: str) -> DataFrame:
    """A table written once and read again: what is dear, or may differ when it is computed anew."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` gave, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
