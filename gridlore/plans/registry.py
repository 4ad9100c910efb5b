"""All named queries over the analytic tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def presented(df: DataFrame) -> DataFrame:
    """Instants as ISO text and arrays as text, so that engines agree on what they print."""
    shown = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        shown.append(c.alias(field.name))
    return df.select(*shown)


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of ``Views`` under ``name``; without ``sql`` there is no oracle."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: presented(f(Views(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *views) if views else sql.strip()
        return f

    return add


from gridlore.plans import crawling, events, outlets, places, reading, sources, storing, streams, texts, times, totals  # noqa: E402,F401
