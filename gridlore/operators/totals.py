"""Totals by month and district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore import constants as C
from gridlore.functions import time as tm

col = F.col


def month_spine(spark, now: Column, months: int = 12) -> DataFrame:
    """The last ``months`` local months, now's included."""
    return spark.range(1).select(F.explode(last_months(now, months)).alias("month"))


def last_months(now: Column, months: int = 12) -> Column:
    first = F.trunc(tm.local(now), "month").cast("date")
    every = F.sequence(F.add_months(first, 1 - months), first, F.expr("interval 1 month"))
    return F.transform(every, lambda d: F.date_format(d, "yyyy-MM"))


def monthly_totals(outages: DataFrame, now: Column, *by: str, months: int = 12) -> DataFrame:
    """Hours lost by local month of the start, every month present: planned (all but faults), faults, and
    faults without an end. Durations of no or negative length are skipped; minutes are added whole."""
    spine = month_spine(outages.sparkSession, now, months)
    length = (F.unix_seconds(col("ends_at")) - F.unix_seconds(col("starts_at"))) / 60
    long = F.when(length > 0, length.cast("long"))
    fault = col("kind") == "fault"
    sums = outages.groupBy(*by, tm.month_key(col("starts_at")).alias("month")).agg(
        F.sum(F.when(~fault, long)).alias("planned"), F.sum(F.when(fault, long)).alias("faults"), F.count(F.when(fault & col("ends_at").isNull(), 1)).alias("open")
    )
    every = outages.select(*by).distinct().select(*by, F.explode(last_months(now, months)).alias("month")) if by else spine
    hours = lambda m: F.floor(F.coalesce(m, F.lit(0)) * 10 / 60 + 0.5) / 10
    return every.join(sums, [*by, "month"], "left").select(
        *by, "month", hours(col("planned")).alias("planned_hours"), hours(col("faults")).alias("fault_hours"), F.coalesce("open", F.lit(0)).alias("open_faults")
    )


def stored_month_bound(now: Column, months: int = 12) -> Column:
    """The bound that stored totals are read from: the first of the oldest month at midnight UTC, which drops
    the first local hours of it (months are local). ``exact_month_bound`` does not."""
    return F.add_months(F.trunc(now, "month"), 1 - months).cast("timestamp")


def exact_month_bound(now: Column, months: int = 12) -> Column:
    return tm.to_utc(F.add_months(F.trunc(tm.local(now), "month"), 1 - months).cast("timestamp"))


def total_and_peak(monthly: DataFrame) -> DataFrame:
    """Hours in all, the highest month's (1 at least) and the first month that has it."""
    both = col("planned_hours") + col("fault_hours")
    return monthly.agg(
        F.round(F.sum(both), 1).alias("total_hours"),
        F.greatest(F.max(both), F.lit(1.0)).alias("peak"),
        F.min_by("month", F.struct((-both).alias("h"), "month")).alias("peak_month"),
        F.sum("open_faults").alias("open_faults"),
    )


def district_states(spark, outages: DataFrame, now: Column) -> DataFrame:
    """Every district: active (a fault outranks other kinds), else its next start, else quiet."""
    at = tm.status(col("starts_at"), col("ends_at"), now)
    states = outages.groupBy("district").agg(
        F.count(F.when(at == "active", 1)).alias("active"),
        F.coalesce(F.bool_or((at == "active") & (col("kind") == "fault")), F.lit(False)).alias("fault"),
        F.min_by("kind", F.when(at == "active", F.struct("starts_at", "id"))).alias("first_kind"),
        F.min(F.when(at == "upcoming", col("starts_at"))).alias("next_start"),
    )
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, C.DISTRICT_IDS))).alias("district"))
    active = F.coalesce("active", F.lit(0))
    return every.join(states, "district", "left").select(
        "district",
        F.when(active > 0, "active").when(col("next_start").isNotNull(), "upcoming").otherwise("quiet").alias("state"),
        active.alias("active"),
        F.when(active > 0, F.when(col("fault"), "fault").otherwise(col("first_kind"))).alias("kind"),
        F.when(active == 0, col("next_start")).alias("next_start"),
    )
