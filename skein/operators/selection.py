"""Removing duplicates and choosing ranked subsets, with total orders throughout."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Stage

# Quotas of the regions in the order in which they are filled.
QUOTAS = (
    ("france", 40), ("europe", 70), ("russia_ukraine", 80), ("east_asia", 75), ("south_central_asia", 55), ("middle_east", 90),
    ("africa", 95), ("south_america", 55), ("north_america", 25), ("oceania", 15), ("other", 20),
)


#: Undecided rows, or conflicts between rows, that one task goes through.
LAST = 50_000


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order; rows with a null in the key are all kept, each a group of its own."""
    has_key = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    own = df.withColumn("own_", F.when(~has_key, F.monotonically_increasing_id()))
    rank = F.row_number().over(Window.partitionBy(*keys, "own_").orderBy(*order))
    return own.withColumn("rank_", rank).where("rank_ = 1").drop("rank_", "own_")


def quota_select(df: DataFrame, group: str, quotas: tuple[tuple[str, int], ...], most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows: each group's best up to its quota, groups in quota order, then the best of the rest.

    Two ranked limits, both bounded by ``most`` and the quotas, whatever the input.
    """
    table = df.sparkSession.createDataFrame([(g, q, i) for i, (g, q) in enumerate(quotas)], f"`{group}` string, quota_ int, place_ int")
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = ranked.where(F.col("rank_") <= max(q for _, q in quotas) + most)  # no later row can be chosen
    # written once, as three steps read it: at most the quotas and twice ``most`` rows of each group
    placed = Stage(df.sparkSession, "quota").keep(ranked.join(F.broadcast(table), group, "left"), "placed")
    within = placed.where("rank_ <= quota_").orderBy("place_", "rank_").limit(most).withColumn("pass_", F.lit(0))
    used = within.agg(F.count("*").alias("used_"))
    rest = placed.join(within.select(group, "rank_"), [group, "rank_"], "left_anti").orderBy(*order).limit(most).withColumn("pass_",
        F.lit(1))
    rest = rest.withColumn("next_", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(used)).where(
        F.col("next_") <= most - F.col("used_"))
    return within.unionByName(rest.drop("next_", "used_")).drop("rank_", "quota_", "place_", "pass_")


def greedy_distinct(df: DataFrame, keys: list[str], order: list[Column], stage) -> DataFrame:
    """Rows in order, leaving out each that shares a non-null value of any key with a kept one.

    Rounds: an undecided row that is first among the undecided in every one of its key
    groups is kept, and rows sharing a key with it go; equal to going through all rows in
    order, without bringing them together. ``stage`` keeps each round's table. What is left
    is gone through in order by one task as soon as it is no more than ``LAST`` rows, of which
    only keys and places are sent.
    """
    place = F.monotonically_increasing_id()
    numbered = stage.keep(df.withColumn("row_", place).withColumn("order_", F.struct(*order, "row_")), "greedy-0")
    undecided, kept, n = numbered.select("row_", "order_", *keys), [], 0
    while undecided.limit(LAST + 1).count() > LAST:
        n += 1
        marked = undecided
        for i, k in enumerate(keys):  # least order of each key; null keys meet nowhere
            first = undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("order_").alias(f"first{i}_"))
            marked = _beside(marked, first, k)
        wins = reduce(lambda a, b: a & b, (F.col(k).isNull() | (F.col(f"first{i}_") == F.col("order_")) for i, k in enumerate(keys)))
        marked = stage.keep(marked.withColumn("wins_", wins).select(*undecided.columns, "wins_"), f"greedy-{n}")
        won = marked.where("wins_").drop("wins_")
        kept.append(won.select("row_"))
        left = marked.where("not wins_").drop("wins_")
        for i, k in enumerate(keys):
            left = _beside(left, won.where(F.col(k).isNotNull()).select(k).distinct().withColumn("gone_", F.lit(True)),
                k).where("gone_ is null").drop("gone_")
        undecided = stage.keep(left.select(*undecided.columns), f"greedy-{n}-left")

    def go_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rows, *values = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            good = []
            for row, own in zip(rows, zip(*values, strict=True), strict=True):
                named = [(i, k) for i, k in enumerate(own) if k is not None]
                if seen.isdisjoint(named):
                    seen.update(named)
                    good.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["row_"])

    last = undecided.repartition(1).sortWithinPartitions("order_").select("row_", *keys).mapInArrow(go_through, "row_ long")
    every = stage.keep(reduce(lambda a, b: a.unionByName(b), [*kept, last]), "greedy-kept")
    return numbered.join(every, "row_").drop("row_", "order_")


def _beside(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows with what was found for their key; rows with a null key stay where they are and find nothing."""
    with_key = rows.where(F.col(key).isNotNull()).join(found, key, "left")
    without = rows.where(F.col(key).isNull())
    return with_key.unionByName(without, allowMissingColumns=True)


def greedy_independent(rows: DataFrame, conflicts: DataFrame, key: str, stage: Stage) -> DataFrame:
    """Rows in the order of ``order_``, leaving out each that conflicts with a kept one.

    ``conflicts``: (a, b), pairs of keys of which a comes first. Rounds: an undecided row with no
    undecided row before it among its conflicts is kept, and what conflicts with it goes; equal to
    going through all rows in order. Only rows that are in some conflict take part in the rounds, and one
    task does the rest as soon as no more than ``LAST`` conflicts are left.
    """
    pairs = stage.keep(conflicts.select("a", "b").distinct(), "conflicts-0")
    gone, n = [], 0
    while pairs.limit(LAST + 1).count() > LAST:
        n += 1
        held_back = pairs.select(F.col("b").alias("a")).distinct()
        winners = pairs.select("a").distinct().join(held_back, "a", "left_anti")
        out = stage.keep(pairs.join(winners, "a").select(F.col("b").alias("out")).distinct(), f"conflicts-{n}-out")
        gone.append(out)
        left = pairs.join(winners, "a", "left_anti").join(out, F.col("a") == F.col("out"), "left_anti").join(out,
            F.col("b") == F.col("out"), "left_anti")
        pairs = stage.keep(left, f"conflicts-{n}")

    kind = conflicts.schema["a"].dataType

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict = {}
        waits: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                after.setdefault(a, []).append(b)
                waits[b] = waits.get(b, 0) + 1
        ready, out = [a for a in after if a not in waits], set()
        while ready:  # a row is settled once all before it are
            a = ready.pop()
            for b in after.get(a, ()):
                if a not in out:
                    out.add(b)
                waits[b] -= 1
                if not waits[b]:
                    ready.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.from_numpy_dtype("int64") if kind.typeName() == "long" else pa.string())],
            ["out"])

    last = pairs.select("a", "b").repartition(1).mapInArrow(settle, f"out {kind.simpleString()}")
    gone.append(stage.keep(last, "conflicts-last"))
    every = reduce(lambda a, b: a.unionByName(b), gone)
    return rows.join(every, rows[key] == every["out"], "left_anti")
