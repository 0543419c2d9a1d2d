"""Histories of moving entities: bounded trails, turns, orbits and sticky facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, turn
from ..functions.numbers import population_cv


def last_points(reports: DataFrame, n: int, entity: str = "entity", *order: str) -> DataFrame:
    """The newest ``n`` reports of each entity."""
    newest = Window.partitionBy(entity).orderBy(*(F.col(c).desc() for c in (order or ("ts_us", "seq"))))
    return reports.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)


def rotation(reports: DataFrame, entity: str = "entity") -> DataFrame:
    """Sum of signed heading changes and number of points of each entity."""
    path = Window.partitionBy(entity).orderBy("ts_us", "seq")
    step = F.coalesce(turn(F.lag("heading").over(path), F.col("heading")), F.lit(0.0))
    return reports.withColumn("step_", step).groupBy(entity).agg(F.sum("step_").alias("rotation"), F.count("*").alias("points"))


def orbits(reports: DataFrame, n: int = 30, entity: str = "entity") -> DataFrame:
    """Whether the newest points of an entity circle a place: by rotation, or by an even radius and enough rotation."""
    recent = last_points(reports, n, entity)
    turned = rotation(recent, entity)
    own = Window.partitionBy(entity)
    centred = recent.withColumns({"mid_lat": F.avg("lat").over(own), "mid_lon": F.avg("lon").over(own)})
    radius = centred.groupBy(entity).agg(F.collect_list(haversine(F.col("lat"), F.col("lon"), F.col("mid_lat"), F.col("mid_lon"))).alias(
            "radii"))
    mean = F.aggregate("radii", F.lit(0.0), lambda a, v: a + v) / F.size("radii")
    out = turned.join(radius, entity).select(entity, "points", "rotation", population_cv(F.col("radii")).alias("cv"), mean.alias("mean_km"))
    turns = F.abs("rotation")
    circles = (F.col("points") >= 8) & ((turns >= 270) | ((F.col("cv") < 0.25) & (F.col("mean_km") > 5) & (turns > 90)))
    return out.withColumn("orbit", F.coalesce(circles, F.lit(False)))


def steady(values: Column, least: int, most_cv: float) -> Column:
    """Whether an array has enough values and little variation."""
    return (F.size(values) >= least) & F.coalesce(population_cv(values) < most_cv, F.lit(False))


def sticky(reports: DataFrame, fact: Column, to: str, entity: str = "entity") -> DataFrame:
    """Each report with the last non-null fact that its entity stated before or with it."""
    path = Window.partitionBy(entity).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn(to, F.last(fact, ignorenulls=True).over(path))


def thinned(points: Column, least_degrees: float = 0.001) -> Column:
    """A trail without points that are within a step of the last kept one: a fold over an ordered array of (lat, lon)."""
    far = lambda a, b: (F.abs(a["lat"] - b["lat"]) >= least_degrees) | (F.abs(a["lon"] - b["lon"]) >= least_degrees)
    return F.aggregate(
        points,
        F.slice(points, 1, 0),
        lambda kept, p: F.when((F.size(kept) == 0) | far(F.element_at(kept, -1), p), F.concat(kept, F.array(p))).otherwise(kept),
    )
