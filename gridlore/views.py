"""Views that map the analytic tables to the domain's, the same in Spark and in DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.constants import DISTRICT_IDS, DISTRICTS

NOW = "2024-01-20 12:00:00"
HISTORY_NOW = "1998-06-15 09:00:00"


SITE_NAMES = ("Cihan", "Çatal", "Işık", "İnce", "Oba", "Ördek", "Su", "Şafak", "Uzun", "Ünlü")
SITE_KEYS = ("cihan", "catal", "isik", "ince", "oba", "ordek", "su", "safak", "uzun", "unlu")


def now(text: str = NOW):
    return F.lit(text).cast("timestamp")


def _at(values, index: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(index) + 1).cast("int"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def outages(self) -> DataFrame:
        e = self.table("events").withColumn("starts_at", F.date_trunc("minute", F.col("ts").cast("timestamp")))
        e = e.withColumn("open", F.expr("event_type = 'error' and event_id % 2 = 0"))
        e = e.withColumn("reason", F.expr("case when event_id % 29 = 0 then 'bad_data' when event_id % 23 = 0 then 'retracted' end"))
        return e.select(
            "event_id",
            F.expr("substr(sha2(cast(event_id as string), 256), 1, 32)").alias("id"),
            F.expr("case event_type when 'error' then 'fault' when 'signup' then 'rotating' else 'planned' end").alias("kind"),
            "starts_at",
            F.expr("case when not open then starts_at + make_dt_interval(0, 0, 30 + event_id % 240) end").alias("ends_at"),
            _at(DISTRICT_IDS, "user_id % 6").alias("district"),
            F.expr("array('Place ' || user_id % 40, 'Place ' || event_id % 40)").alias("areas"),
            F.expr("array_sort(array_distinct(array('place ' || user_id % 40, 'place ' || event_id % 40)))").alias("area_keys"),
            F.expr("if(event_id % 17 = 0, 'district', 'places')").alias("scope"),
            F.expr(
                "array(struct('Outlet ' || event_id % 5 as name, 'https://www.outlet' || event_id % 5 || '.example/n' || event_id % 1000 || '-'"
                " || event_type as url, if(event_id % 7 = 0, 'official', 'press') as kind))"
            ).alias("sources"),
            F.expr("starts_at - make_dt_interval(0, cast(event_id % 6 as int))").alias("published_at"),
            F.expr("starts_at + make_dt_interval(0, 0, 5)").alias("ingested_at"),
            F.expr("if(open, 'low', 'high')").alias("confidence"),
            F.lit(False).alias("continuation"),
            F.expr("if(reason is not null, starts_at + make_dt_interval(0, 1), null)").alias("cancelled_at"),
            F.col("reason").alias("cancelled_reason"),
        )

    @cached_property
    def history(self) -> DataFrame:
        ends = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("timestamp").alias("ends_at"))
        o = self.table("orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"))
        return o.select(
            F.expr("'h' || o_orderkey").alias("id"),
            F.col("o_orderdate").cast("timestamp").alias("starts_at"),
            F.expr("case when o_orderkey % 11 <> 0 then ends_at end").alias("ends_at"),
            F.expr("case o_orderstatus when 'F' then 'fault' when 'P' then 'rotating' else 'planned' end").alias("kind"),
            _at(DISTRICT_IDS, "o_custkey % 6").alias("district"),
            F.expr("'place ' || o_custkey % 40").alias("place_key"),
        )

    @cached_property
    def settlements(self) -> DataFrame:
        k = self.spark.range(40)
        return k.select(
            F.expr("'Place ' || id").alias("name"), _at(DISTRICT_IDS, "id % 6").alias("district"),
            F.expr("35.0 + id / 100.0").cast("double").alias("lat"), F.expr("32.5 + id * 7 % 40 * 3 / 100.0").cast("double").alias("lng"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """A place for each customer, under names in the order of the Turkish alphabet."""
        c = self.table("customer")
        return c.select(
            "c_custkey", "c_nationkey", F.concat(_at(SITE_NAMES, "c_custkey % 10"), F.lit(" "), "c_custkey").alias("name"), _at(DISTRICT_IDS, "c_custkey % 6").alias("district"),
            F.expr("35.0D + cast(c_custkey * 37 % 500 as double) / 1000").alias("lat"), F.expr("32.4D + cast(c_custkey * 53 % 1300 as double) / 1000").alias("lng"),
        )

    @cached_property
    def announcements(self) -> DataFrame:
        """One announcement an address of events: its last."""
        e = self.table("events").withColumn("url", F.expr("'https://www.outlet' || event_id % 5 || '.example/n' || event_id % 4000"))
        last = e.groupBy("url").agg(F.max_by(F.struct("event_id", "user_id", "props", "ts"), "event_id").alias("e")).select("url", "e.*")
        return last.select("url", F.expr("'Notice ' || user_id").alias("title"), F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("published_at"), "event_id")

    @cached_property
    def seen(self) -> DataFrame:
        """State of two thirds of the addresses: some with the same text, some read, some given up."""
        from gridlore.functions.text import article_hash

        known = self.announcements.where("event_id % 3 <> 0")
        body = F.expr("if(event_id % 4 = 0 or event_id % 5 = 1, body || '!', body)")
        return known.select(
            "url", article_hash(F.col("title"), body).alias("content_hash"), F.expr("cast(event_id % 5 as int)").alias("attempts"), F.expr("event_id % 7 < 3").alias("parsed_ok"),
            F.col("published_at").alias("first_seen"), F.col("published_at").alias("last_seen"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """A run each six hours of events; every fifth failed."""
        e = self.table("events").withColumn("slot", F.expr("cast(floor(unix_seconds(cast(ts as timestamp)) / 21600) as bigint)"))
        return e.groupBy("slot").agg(F.count(F.lit(1)).alias("created"), F.count(F.expr("if(event_type = 'error', 1, null)")).alias("queued")).select(
            F.expr("timestamp_seconds(slot * 21600)").alias("started_at"), F.expr("slot % 5 <> 0").alias("ok"), "created", "queued"
        )

    @cached_property
    def places(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_name").alias("name"), _at(DISTRICT_IDS, "p_partkey % 6").alias("district"), F.array("p_brand").alias("aliases"), F.col("p_partkey").alias("ordinal")
        )


_DISTRICT = lambda index: f"[{', '.join(repr(d) for d in DISTRICT_IDS)}][({index}) + 1]"
_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in DISTRICTS.items()) + "}"

SQL = {
    "v_outages": f"""SELECT event_id, substr(sha256(event_id::VARCHAR), 1, 32) AS id,
  CASE event_type WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'rotating' ELSE 'planned' END AS kind,
  date_trunc('minute', ts) AS starts_at,
  CASE WHEN NOT (event_type = 'error' AND event_id % 2 = 0) THEN date_trunc('minute', ts) + to_minutes(30 + event_id % 240) END AS ends_at,
  {_DISTRICT("user_id % 6")} AS district,
  ['Place ' || user_id % 40, 'Place ' || event_id % 40] AS areas,
  list_sort(list_distinct(['place ' || user_id % 40, 'place ' || event_id % 40])) AS area_keys,
  CASE WHEN event_id % 17 = 0 THEN 'district' ELSE 'places' END AS scope,
  'Outlet ' || event_id % 5 AS source_name,
  'https://www.outlet' || event_id % 5 || '.example/n' || event_id % 1000 || '-' || event_type AS source_url,
  CASE WHEN event_id % 7 = 0 THEN 'official' ELSE 'press' END AS source_kind,
  date_trunc('minute', ts) - to_hours(event_id % 6) AS published_at,
  date_trunc('minute', ts) + to_minutes(5) AS ingested_at,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN event_id % 29 = 0 OR event_id % 23 = 0 THEN date_trunc('minute', ts) + to_hours(1) END AS cancelled_at,
  CASE WHEN event_id % 29 = 0 THEN 'bad_data' WHEN event_id % 23 = 0 THEN 'retracted' END AS cancelled_reason FROM events""",
    "v_history": f"""SELECT 'h' || o_orderkey AS id, o_orderdate::TIMESTAMP AS starts_at, CASE WHEN o_orderkey % 11 <> 0 THEN e END AS ends_at,
  CASE o_orderstatus WHEN 'F' THEN 'fault' WHEN 'P' THEN 'rotating' ELSE 'planned' END AS kind,
  {_DISTRICT("o_custkey % 6")} AS district, 'place ' || o_custkey % 40 AS place_key
  FROM orders JOIN (SELECT l_orderkey, min(l_shipdate)::TIMESTAMP AS e FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "v_settlements": f"""SELECT 'Place ' || k AS name, {_DISTRICT("k % 6")} AS district, 35.0::DOUBLE + k / 100.0 AS lat,
  32.5::DOUBLE + k * 7 % 40 * 3 / 100.0 AS lng FROM range(40) AS t(k)""",
    "v_sites": f"""SELECT c_custkey, c_nationkey, {list(SITE_NAMES)}[c_custkey % 10 + 1] || ' ' || c_custkey AS name, {list(SITE_KEYS)}[c_custkey % 10 + 1] || ' ' || c_custkey AS key, {_DISTRICT("c_custkey % 6")} AS district,
  35.0::DOUBLE + (c_custkey * 37 % 500)::DOUBLE / 1000 AS lat, 32.4::DOUBLE + (c_custkey * 53 % 1300)::DOUBLE / 1000 AS lng FROM customer""",
    "v_announce": """SELECT url, 'Notice ' || user_id AS title, props AS body, ts AS published_at, event_id FROM (
  SELECT *, 'https://www.outlet' || event_id % 5 || '.example/n' || event_id % 4000 AS url FROM events)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id DESC) = 1""",
    "v_seen": """SELECT url, substr(sha256(title || chr(0) || body || CASE WHEN event_id % 4 = 0 OR event_id % 5 = 1 THEN '!' ELSE '' END), 1, 32) AS content_hash,
  (event_id % 5)::INT AS attempts, event_id % 7 < 3 AS parsed_ok, published_at AS first_seen, published_at AS last_seen FROM v_announce WHERE event_id % 3 <> 0""",
    "v_runs": """SELECT to_timestamp(slot * 21600)::TIMESTAMP AS started_at, slot % 5 <> 0 AS ok, count(*) AS created, count(*) FILTER (event_type = 'error') AS queued
  FROM (SELECT *, floor(epoch(ts) / 21600)::BIGINT AS slot FROM events) GROUP BY slot""",
    "v_places": f"SELECT p_name AS name, {_DISTRICT('p_partkey % 6')} AS district, p_brand AS alias, p_partkey AS ordinal FROM part",
}
_NEEDS = {"v_seen": ["v_announce"]}


def oracle(body: str, *views: str) -> str:
    """A query over views, as one statement."""
    names = list(dict.fromkeys(x for v in views for x in [*_NEEDS.get(v, []), v]))
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):].strip()}"
    return f"WITH {heads}, {body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {heads} {body}"
