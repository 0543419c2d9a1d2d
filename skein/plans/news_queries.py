"""Queries of the news cycle over headlines that the test tables number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news
from .shims import LAT_SQL, LON_SQL, km_sql, lat_of, lon_of, table
from .signal_queries import _at, _pick, _q

HEADS = ("Navy warship fleet", "SpaceX Falcon 9", "Fighter jet", "Hezbollah rocket", "Hypersonic missile", "Troops", "Spy satellite",
    "Airline passenger", "Cruise ship", "Artemis moon mission", "Stock market")
ACTS = ("test launch seen", "strike reported", "summit talks", "exercise begins", "deploy to front", "launch new product",
    "intercept drone", "could escalate into war", "years ago anniversary", "collision incident", "patrol ends with clash",
    "wins football medal", "visit hospital")
WHERE = ("near the strait", "in 1999", "over the capital", "off the coast", "at the border today", "as sanction looms", "in orbit")
FEEDS = ("naval", "spatial", "aviation", "missile", "military")
AS_OF = "2024-01-31 00:00:00"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines from ``documents``, some without a date, place or source."""
    k = F.col("doc_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + k * 10007 % 2592000)
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat_ws(" ", _pick(HEADS, k), _pick(ACTS, k * 4 + 1), _pick(WHERE, k * 2),
                F.when(k % 3 == 0, F.concat(F.lit("no "), (k % 29).cast("string")))).alias("title"),
        _pick(FEEDS, k * 3).alias("feed_domain"), F.when(k % 23 != 22, ts).alias("ts"),
            F.concat(F.lit("s"), (k % 12).cast("string")).alias("source"),
        F.when(k % 5 != 4, lat_of(k % 40)).alias("lat"), F.when(k % 5 != 4, lon_of(k % 40)).alias("lon"), (k * 617 % 1000003).alias("ord"),
    )


ITEM_SQL = f"""(SELECT doc_id AS id, concat_ws(' ', {_at(HEADS, "doc_id")}, {_at(ACTS, "doc_id * 4 + 1")}, {_at(WHERE, "doc_id * 2")}, CASE WHEN doc_id % 3 = 0 THEN 'no ' || doc_id % 29 END) AS title,
  {_at(FEEDS, "doc_id * 3")} AS feed_domain, CASE WHEN doc_id % 23 <> 22 THEN make_timestamp((1704067200 + doc_id * 10007 % 2592000) * 1000000) END AS ts, 's' || doc_id % 12 AS source,
  CASE WHEN doc_id % 5 <> 4 THEN {LAT_SQL.format(k="(doc_id % 40)")} END AS lat, CASE WHEN doc_id % 5 <> 4 THEN {LON_SQL.format(k="(doc_id % 40)")} END AS lon, doc_id * 617 % 1000003 AS ord FROM documents)"""


def news_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.classified(items(spark, sf_dir)).select("id", "domain", "type", "confidence", "enough",
        news.spatial_noise(F.col("title")).alias("noise"))


def news_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are at most 48 hours old or have no date."""
    return items(spark, sf_dir).where(news.recent_enough(F.col("ts"), F.lit(AS_OF).cast("timestamp"))).select("id")


def news_for_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.for_map(news.classified(items(spark, sf_dir))).select("id", "domain", "confidence", "color", "label")


def news_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and those sure enough by domain."""
    return news.classified(items(spark, sf_dir)).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("enough").alias("n_enough"))


def news_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import keep_one

    rows = items(spark, sf_dir).withColumn("key", news.short_key(F.col("title")))
    return keep_one(rows, ["key"], F.col("ord")).select("id", "key")


def news_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.duplicates(items(spark, sf_dir).where("ts is not null"))


def news_gray_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = news.gray_pairs(items(spark, sf_dir).where("ts is not null"))
    return pairs.select("a", "b", F.floor(F.col("similarity") * 10000 + 0.5).cast("long").alias("similarity"))


def news_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in their order without those that repeat a kept one."""
    return news.unique_items(items(spark, sf_dir).where("ts is not null")).select("id")


def news_without_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without the older one of each gray pair that a third of the verdicts call the same."""
    rows = items(spark, sf_dir).where("ts is not null")
    verdicts = news.gray_pairs(rows).select("a", "b", "older", ((F.col("a") + F.col("b")) % 3 == 0).alias("same"))
    return news.without_gray(rows, verdicts).select("id")


def news_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of at most 500 items: new ones, then those of the last 72 hours."""
    rows = items(spark, sf_dir)
    return news.merged_cache(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0"), F.lit(AS_OF).cast("timestamp")).select("id")


QUERIES = {f.__name__: f for f in (news_classes, news_recent, news_for_map, news_counts, news_title_keys, news_duplicates, news_gray_pairs,
        news_without_gray, news_unique, news_cache)}


def _says(pattern: str, but: str) -> str:
    return f"regexp_matches(t, {_q(pattern)})" + (f" AND NOT regexp_matches(t, {_q(but)})" if but else "")


_DOMAIN = "CASE " + " ".join(f"WHEN {_says(p, b)} THEN '{n}'" for n, p, b in news.DOMAINS) + " ELSE 'military' END"
_TYPE = "CASE domain " + " ".join(f"WHEN '{n}' THEN CASE " + " ".join(f"WHEN {_says(p, '')} THEN '{k}'" for p, k in kinds)
    + " ELSE domain END" for n, kinds in news.TYPES.items()) + " END"
_POINTS = " + ".join(f"CASE WHEN {_says(p, b)}" + (f" AND domain = '{n}'" if n else "") + f" THEN {x} ELSE 0 END" for n, x, p,
    b in news.POINTS)
_CLASSES = f"""lowered AS (SELECT *, lower(title) AS t FROM {ITEM_SQL}), named AS (SELECT *, {_DOMAIN} AS domain FROM lowered),
sure AS (SELECT *, {_TYPE} AS type, greatest(10, least(95, 55 + CASE WHEN domain = feed_domain THEN 10 ELSE 0 END + CASE WHEN lat IS NOT NULL THEN 15 ELSE 0 END
  + CASE WHEN len(regexp_split_to_array(t, '\\s+')) <= 15 THEN 5 ELSE 0 END + {_POINTS})) AS confidence FROM named),
classes AS (SELECT *, confidence >= CASE domain WHEN 'spatial' THEN 62 WHEN 'aviation' THEN 60 WHEN 'naval' THEN 60 WHEN 'missile' THEN 55 ELSE 50 END AS enough FROM sure)"""
_WORDS = f"w AS (SELECT *, list_distinct(regexp_split_to_array(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+')) AS words, regexp_replace(lower(title), '[^a-z0-9_]', '', 'g')[1:80] AS k FROM {ITEM_SQL} WHERE ts IS NOT NULL)"


def _pairs_sql(rows: str) -> str:
    return f"""pairs AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.words, y.words))::DOUBLE / greatest(len(x.words), len(y.words)) AS sim, abs(epoch(x.ts) - epoch(y.ts)) AS apart,
  x.source = y.source AS same, {km_sql("x.lat", "x.lon", "y.lat", "y.lon")} AS km FROM {rows} x JOIN {rows} y ON x.ord < y.ord AND abs(epoch(x.ts) - epoch(y.ts)) <= 259200),
dup AS (SELECT a, b FROM pairs WHERE sim > 0.55 OR (same AND apart < 21600 AND sim > 0.35) OR (km < 100 AND sim > 0.40))"""


SQL = {
    "news_classes": f"WITH {_CLASSES} SELECT id, domain, type, confidence, enough, {_says(news.SPATIAL_NOISE, news.STRATEGIC)} AS noise FROM classes",
    "news_recent": f"SELECT id FROM {ITEM_SQL} WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOURS",
    "news_for_map": f"""WITH {_CLASSES} SELECT id, domain, confidence, CASE domain WHEN 'spatial' THEN '#a855f7' WHEN 'missile' THEN '#ef4444' WHEN 'naval' THEN '#3b82f6' WHEN 'aviation' THEN '#f59e0b' ELSE '#dc2626' END AS color,
  upper(domain) AS label FROM classes WHERE lat <> 0 AND lon <> 0 AND confidence >= 30""",
    "news_counts": f"WITH {_CLASSES} SELECT domain, count(*) AS n, count(*) FILTER (enough) AS n_enough FROM classes GROUP BY domain",
    "news_title_keys": f"SELECT id, regexp_replace(lower(title), '[^a-z0-9_]', '', 'g')[1:80] AS key FROM {ITEM_SQL} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1",
    "news_duplicates": f"WITH {_WORDS}, {_pairs_sql('w')} SELECT a, b FROM dup",
    "news_gray_pairs": f"WITH {_WORDS}, {_pairs_sql('w')} SELECT a, b, floor(sim * 10000 + 0.5)::BIGINT AS similarity FROM pairs WHERE sim >= 0.25 AND sim < 0.55 AND apart <= 86400",
    "news_unique": f"""WITH RECURSIVE {_WORDS}, once AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1), {_pairs_sql('once')},
left_(n, a, b) AS (SELECT 0, a, b FROM dup UNION ALL SELECT l.n + 1, l.a, l.b FROM left_ l WHERE l.a IN (SELECT b FROM left_) AND l.a NOT IN (SELECT b FROM left_ WHERE a NOT IN (SELECT b FROM left_))
  AND l.b NOT IN (SELECT b FROM left_ WHERE a NOT IN (SELECT b FROM left_))),
gone AS (SELECT DISTINCT x.b FROM left_ x ANTI JOIN left_ y ON y.n = x.n AND y.b = x.a)
SELECT id FROM once WHERE id NOT IN (SELECT b FROM gone)""",
    "news_without_gray": f"""WITH {_WORDS}, {_pairs_sql('w')}, gray AS (SELECT a, b FROM pairs WHERE sim >= 0.25 AND sim < 0.55 AND apart <= 86400 AND (a + b) % 3 = 0),
gone AS (SELECT CASE WHEN x.ts >= y.ts THEN b ELSE a END AS id FROM gray JOIN w x ON x.id = a JOIN w y ON y.id = b) SELECT id FROM w WHERE id NOT IN (SELECT id FROM gone)""",
    "news_cache": f"""WITH both_ AS (SELECT id, ord, 0 AS old FROM {ITEM_SQL} WHERE id % 4 = 0 UNION ALL SELECT id, ord, 1 FROM {ITEM_SQL} WHERE id % 4 <> 0 AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOURS)
SELECT id FROM both_ ORDER BY old, ord, id LIMIT 500""",
}
