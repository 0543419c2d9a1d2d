"""Connected components by hooking and contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stage


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges (a, b), a < b, between different labels of their ends; an end without a label keeps its own name."""
    named = lambda end: labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    rows = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    a, b = F.coalesce("a_root", "a"), F.coalesce("b_root", "b")
    return rows.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after the labels themselves were given the labels in ``found``."""
    if labels is None:
        return found
    up = found.select(F.col("node").alias("root"), F.col("root").alias("up"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return moved.union(found.join(labels, "node", "left_anti").select("node", "root"))


def components(links: DataFrame, stage: Stage, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every end of a link (a, b); root is the least node of its component.

    Each round every node takes the label of its least neighbour's least neighbour, and
    links are contracted to links between different labels: what is settled drops out,
    so later rounds work on what is left. ``known`` are components that the links join
    further, as an earlier call gave them. Nothing comes to the driver but whether a
    link is left.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = _contracted(pairs, known) if known is not None else pairs.select(F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b")).distinct()
    edges, labels, n = stage.keep(edges, f"{name}-edges"), known, 0
    while not edges.isEmpty():
        n += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-{n}-hooks")
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        found = stage.keep(hooks.join(up, "root").select("node", F.col("up").alias("root")), f"{name}-{n}-found")
        labels = stage.keep(_merged(labels, found), f"{name}-{n}")
        edges = stage.keep(_contracted(edges, found), f"{name}-{n}-edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
