"""Curated-event, mention, track and site rows made from the test tables by integer arithmetic.

``EVENT_SQL`` and the others are the same tables as SQL subqueries for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("RU", "FR", "US", "UA", "CN", "IR", "DE", "BR", "JP", "EG")


def lat_of(k: Column) -> Column:
    return (k * 7919 % 17001) / F.lit(100.0) - F.lit(85.0)


def lon_of(k: Column) -> Column:
    return (k * 104729 % 36000) / F.lit(100.0) - F.lit(180.0)


LAT_SQL = "(({k} * 7919) % 17001) / 100.0::DOUBLE - 85.0"
LON_SQL = "(({k} * 104729) % 36000) / 100.0::DOUBLE - 180.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated-event rows from ``documents``."""
    k = F.col("doc_id")
    countries = F.array(*map(F.lit, COUNTRIES))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"),
        F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"),
        F.concat(F.coalesce("source", F.lit("none")), F.lit(".example")).alias("domain"),
        lat_of(k).alias("lat"),
        lon_of(k).alias("lon"),
        ((k * 37 % 201) / F.lit(10.0) - F.lit(10.0)).alias("tone"),
        F.lpad((1 + k % 20).cast("string"), 2, "0").alias("root"),
        F.when(k % 20 == 17, F.lpad((180 + k % 4).cast("string"), 3, "0")).otherwise(
            F.concat(F.lpad((1 + k % 20).cast("string"), 2, "0"), (k % 10).cast("string"))).alias("code"),
        F.when(k % 43 != 42, k % 7).alias("sources"),
        F.when(k % 37 != 36, k % 11).alias("articles"),
        F.when(k % 29 != 28, k % 23).alias("mentions"),
        (1 + k % 4).alias("geo_type"),
        F.when(k % 41 != 40, (k % 30).cast("double")).alias("age_h"),
        F.get(countries, (k % len(COUNTRIES)).cast("int")).alias("country"),
    )


EVENT_SQL = f"""(SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title,
  coalesce(source, 'none') || '.example' AS domain,
  {LAT_SQL.format(k="doc_id")} AS lat, {LON_SQL.format(k="doc_id")} AS lon,
  ((doc_id * 37) % 201) / 10.0::DOUBLE - 10.0 AS tone, lpad((1 + doc_id % 20)::VARCHAR, 2, '0') AS root,
  CASE WHEN doc_id % 20 = 17 THEN lpad((180 + doc_id % 4)::VARCHAR, 3, '0') ELSE lpad((1 + doc_id % 20)::VARCHAR, 2, '0') || (doc_id % 10)::VARCHAR END AS code,
  CASE WHEN doc_id % 43 <> 42 THEN doc_id % 7 ELSE 0 END AS sources, CASE WHEN doc_id % 37 <> 36 THEN doc_id % 11 ELSE 0 END AS articles, CASE WHEN doc_id % 29 <> 28 THEN doc_id % 23 ELSE 0 END AS mentions,
  1 + doc_id % 4 AS geo_type, CASE WHEN doc_id % 41 <> 40 THEN (doc_id % 30)::DOUBLE END AS age_h,
  ({list(COUNTRIES)!r})[1 + doc_id % {len(COUNTRIES)}] AS country FROM documents)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of events from ``lineitem``: confidence ties, and rows without an identifier."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (key % 1000).alias("event_id"),
        F.col("l_quantity").cast("double").alias("confidence"),
        (key * 10 + line).alias("seq"),
        F.when(key % 5 != 0, F.concat(F.lit("m"), key.cast("string"), F.lit("-"), line.cast("string"))).alias("identifier"),
    )


MENTION_SQL = """(SELECT l_orderkey % 1000 AS event_id, l_quantity::DOUBLE AS confidence, l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_orderkey % 5 <> 0 THEN 'm' || l_orderkey || '-' || l_linenumber END AS identifier FROM lineitem)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports of entities from ``events``."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("seq"),
        F.col("user_id").alias("entity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        lat_of(k).alias("lat"),
        lon_of(k).alias("lon"),
        (k * 37 % 360).cast("double").alias("heading"),
        (F.lit(100.0) + k % 50).alias("speed"),
        F.col("event_type").alias("kind"),
    )


POSITION_SQL = f"""(SELECT event_id AS seq, user_id AS entity, epoch_us(ts) AS ts_us, {LAT_SQL.format(k="event_id")} AS lat, {LON_SQL.format(k="event_id")} AS lon,
  ((event_id * 37) % 360)::DOUBLE AS heading, 100.0::DOUBLE + event_id % 50 AS speed, event_type AS kind FROM events)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed places from ``supplier``."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), lat_of(k * 3).alias("site_lat"), lon_of(k * 3).alias("site_lon"),
        (k % 9 * 100 + 150).cast("double").alias("radius_km"))


SITE_SQL = f"""(SELECT s_suppkey AS site, {LAT_SQL.format(k="s_suppkey * 3")} AS site_lat, {LON_SQL.format(k="s_suppkey * 3")} AS site_lon,
  (s_suppkey % 9 * 100 + 150)::DOUBLE AS radius_km FROM supplier)"""


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"
