"""Queries over urls, daily records, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import KEPT, accents, host, normalize, title_key
from ..operators import rollups, scoring
from .shims import table


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def day_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = rollups.day_history(orders, "day", F.col("o_orderpriority"), F.col("o_orderstatus"))
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)),
            lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return out.select("day", "count", told("categories").alias("categories"), told("severities").alias("severities"))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_kept"),
        F.count_if(F.col("toxic") == 1).alias("n_review"))


def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples: each conversation as one JSON line of messages, given here by its counts."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("m"))
    line = F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    back = F.from_json(line, "messages array<struct<role string, content string>>")["messages"]
    return rows.select("conv_id", F.size(back).cast("long").alias("n_messages"),
        F.aggregate(back, F.lit(0), lambda a, t: a + F.length(F.coalesce(t["content"], F.lit("")))).cast("long").alias("n_chars"))


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return rows.select("doc_id", normalize(F.col("title")).alias("normalized"), title_key(F.col("title")).alias("key"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an hour are usable where all three kinds are there."""
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH"))
    kinds = ["view", "click", "purchase"]
    wide = rows.groupBy("hour").pivot("event_type", kinds).agg(F.max("event_id"))
    return wide.where(" and ".join(f"`{k}` is not null" for k in kinds)).select("hour", *kinds)


def aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency penalty and fusion bonus over a range of ages and distances."""
    k = F.col("l_linenumber") + F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("k")).distinct()
    bonus = scoring.fusion_bonus((F.col("k") * 3).cast("double"), 220.0, F.col("k") % 101, F.col("k") % 2 == 0)
    return rows.select("k", scoring.recency_penalty(F.col("k").cast("double")).alias("penalty"), bonus.alias("bonus"))


QUERIES = {f.__name__: f for f in (url_hosts, day_history, label_stats, chat_export, normalized_titles, kind_counts, aging)}

_NORMAL = "trim(regexp_replace(regexp_replace(translate(lower(split_part(coalesce(text, ''), chr(10), 1)), '{}', '{}'), '[^{}]', ' ', 'g'), '\\s+', ' ', 'g'))".format(
    *accents(), KEPT)
_HISTOGRAM = "string_agg({c} || '=' || n, ';' ORDER BY {c})"
SQL = {
    "url_hosts": r"SELECT coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS host, count(*) AS n FROM pages GROUP BY 1",
    "day_history": f"""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, coalesce(o_orderpriority, 'incident') AS c, coalesce(o_orderstatus, 'LOW') AS s FROM orders),
a AS (SELECT day, sum(n)::BIGINT AS count, {_HISTOGRAM.format(c="c")} AS categories FROM (SELECT day, c, count(*) AS n FROM o GROUP BY ALL) GROUP BY day),
b AS (SELECT day, {_HISTOGRAM.format(c="s")} AS severities FROM (SELECT day, s, count(*) AS n FROM o GROUP BY ALL) GROUP BY day) SELECT * FROM a JOIN b USING (day)""",
    "normalized_titles": f"""WITH n AS (SELECT doc_id, {_NORMAL} AS normalized FROM documents)
SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(normalized, '\\b\\d{{5,}}\\b', ' ', 'g'), '\\b[a-f0-9]{{8,}}\\b', ' ', 'g'), '\\s+', ' ', 'g'))[1:140] AS key FROM n""",
    "label_stats": "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_kept, count(*) FILTER (toxic = 1) AS n_review FROM labels LEFT JOIN documents USING (doc_id) GROUP BY source",
    "chat_export": "SELECT conv_id, count(*) AS n_messages, sum(coalesce(length(text), 0))::BIGINT AS n_chars FROM conversations GROUP BY conv_id",
    "kind_counts": "SELECT * FROM (SELECT strftime(ts, '%Y%m%d%H') AS hour, max(event_id) FILTER (event_type = 'view') AS view, max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1) WHERE view IS NOT NULL AND click IS NOT NULL AND purchase IS NOT NULL",
    "aging": """WITH r AS (SELECT DISTINCT l_linenumber + floor(l_quantity)::BIGINT AS k FROM lineitem)
SELECT k, CASE WHEN k <= 6 THEN 0 ELSE least(24, floor(10 * log2(1 + k / 36.0::DOUBLE) + 0.5)) END::BIGINT AS penalty,
  floor(18 * (1 - (k * 3)::DOUBLE / 220.0) * (CASE WHEN k % 101 = 0 THEN 50 ELSE k % 101 END) / 100 * CASE WHEN k % 2 = 0 THEN 1.15::DOUBLE ELSE 1.0 END + 0.5)::BIGINT AS bonus FROM r""",
}
