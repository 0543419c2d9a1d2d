"""Mention summaries, daily history, calibration counts and grid clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grid


def mention_summary(mentions: DataFrame) -> DataFrame:
    """Per event: mentions, and the identifier of the most confident one (the last of equals; rows without one count but can't win)."""
    named = F.when(F.coalesce("identifier", F.lit("")) != "", F.struct("confidence", "seq", "identifier"))
    out = mentions.groupBy("event_id").agg(F.count("*").alias("mention_count"), F.max(named).alias("best_"))
    return out.select("event_id", "mention_count", F.col("best_.confidence").alias("best_confidence"),
        F.col("best_.identifier").alias("best_identifier"))


def day_history(rows: DataFrame, day: str, category: Column, severity: Column) -> DataFrame:
    """Per day: rows, and histograms of category and severity as maps, in one pass by (day, kind, value)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit(d)).alias("value")) for k, v,
                d in (("c", category, "incident"), ("s", severity, "LOW")))))
    counts = rows.select(F.col(day).alias("day"), kinds.alias("k")).groupBy("day", "k.kind", "k.value").agg(F.count("*").alias("n"))
    histogram = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n")))))
    total = F.sum(F.when(F.col("kind") == "c", F.col("n")))
    return counts.groupBy("day").agg(total.alias("count"), histogram("c").alias("categories"), histogram("s").alias("severities"))


def calibration(events: DataFrame) -> DataFrame:
    """Counts by region, category, country, domain and bucket (where there is one) in one pass of grouping sets, with the share of strategic ones.

    What is unknown is ``other``, ``incident`` and ``general``; rows without country or domain don't count there.
    """
    unknown = {"region": "other", "category": "incident", "bucket": "general"}
    facets = [c for c in ("region", "category", "country", "domain", "bucket") if c in events.columns]
    named = events.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in unknown.items() if c in facets})
    out = named.groupingSets([[c] for c in facets], *facets).agg(F.count("*").alias("n"),
        F.sum(F.col("strategic").cast("long")).alias("n_strategic"), F.grouping_id().alias("gid"))
    facet = F.lit(None).cast("string")
    for i, name in enumerate(reversed(facets)):  # the last facet's bit is the lowest, and a grouped facet's bit is 0
        facet = F.when(F.col("gid") == (1 << len(facets)) - 1 - (1 << i), name).otherwise(facet)
    return out.select(facet.alias("facet"), F.coalesce(*facets).alias("value"), "n", "n_strategic").where("value is not null")


def calibration_text(counts: DataFrame, most: int = 12) -> DataFrame:
    """(facet, text): the ``most`` most frequent values of each facet as ``value=n``, best first."""
    best = counts.withColumn("rank_", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(
        F.col("rank_") <= most)
    told = F.sort_array(F.collect_list(F.struct("rank_", F.concat_ws("=", "value", F.col("n").cast("string")).alias("t"))))
    return best.groupBy("facet").agg(F.array_join(F.transform(told, lambda x: x["t"]), " ").alias("text"))


def grid_clusters(events: DataFrame, size: int = 2, least: int = 3, most: int = 30) -> DataFrame:
    """The cells with the most events, best first; cells of few events are none."""
    cells = events.groupBy(grid(F.col("lat"), size).alias("cell_lat"), grid(F.col("lon"), size).alias("cell_lon"))
    return cells.agg(F.count("*").alias("n"), F.max("score").alias("top_score")).where(F.col("n") >= least).orderBy(F.desc("n"),
        "cell_lat", "cell_lon").limit(most)


def cluster_members(events: DataFrame, clusters: DataFrame, k: int = 10, size: int = 2) -> DataFrame:
    """The ``k`` best events of each cluster."""
    rows = events.withColumns({"cell_lat": grid(F.col("lat"), size), "cell_lon": grid(F.col("lon"), size)}).join(
        clusters.select("cell_lat", "cell_lon"), ["cell_lat", "cell_lon"])
    best = Window.partitionBy("cell_lat", "cell_lon").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
