"""Places and running sums in ordered groups of any size: a group may stretch over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64
from .storage import Stage, map_batches

#: Running sums are kept modulo 2^62, so that two of them add up without overflow.
MASK = (1 << 62) - 1


def _in_parts(columns: list[str], group: str, sums: list[str]):
    """Place and sums within a task's share of each group; rows come ordered by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before, acc = TaskContext.get().partitionId(), None, 0, [U64(0)] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(columns.index(group))
            first = np.ones(n, bool)
            first[1:] = pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            at, carried = np.arange(n) - begin, begin == 0
            if names[0].as_py() != last:
                carried[:] = False
            at[carried] += before
            totals = []
            for i, name in enumerate(sums):
                value = batch.column(columns.index(name)).to_numpy(zero_copy_only=False).astype(U64)
                total = np.cumsum(value)
                total -= (total - value)[begin]
                total[carried] += acc[i]
                totals.append(total & U64(MASK))
            last, before, acc = names[n - 1].as_py(), int(at[-1]) + 1, [t[-1] for t in totals]
            more = [pa.array(np.full(n, part, np.int64)), pa.array(at), *(pa.array(t.astype(np.int64)) for t in totals)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*columns, "part_", "at", *(f"run_{s}" for s in sums)])

    return run


def _carried_over(parts: list, sums: list[str]) -> list[tuple]:
    """What the parts before add to the first group of each part: (part, group, place, sums...)."""
    out, group, carry = [], None, [0] * (1 + len(sums))
    for p in parts:
        own = [p["last"]["at"] + 1, *(p["last"][f"run_{s}"] for s in sums)]
        if group is not None and p["first"] == group:
            out.append((p["part_"], group, *carry))
        if group is not None and p["last"]["group"] == group:
            carry = [(a + b) & MASK for a, b in zip(carry, own, strict=True)]
        else:
            group, carry = p["last"]["group"], own
    return out


def running(rows: DataFrame, group: str, order: list[str | Column], sums: list[str], keep: list[str | Column], stage: Stage,
    name: str) -> DataFrame:
    """The columns ``keep`` (which hold ``group``, never null, and ``sums``) with ``at`` and ``run_<sum>``.

    ``keep`` is computed after the rows were dealt out, so once; the order is looked at before, for a sample of its ranges.

    ``at`` is the row's place in its group by ``order``, from 0, and each ``run_<sum>`` the sum (modulo 2^62) up to and
    with the row. Rows are dealt out by ranges of group and order, so a group that holds most rows is spread over as many
    tasks as it needs. What one task hands to the next is one row a task: the only thing that comes to the driver.
    """
    spark = rows.sparkSession
    keys = [F.col(group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    dealt = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).select(*keep)
    keep = dealt.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, part_ long, at long"
    schema += "".join(f", run_{s} long" for s in sums)
    placed = stage.keep(map_batches(dealt, _in_parts(keep, group, sums), schema), name)
    last = F.struct(F.col(group).alias("group"), "at", *(f"run_{s}" for s in sums))
    edges = placed.groupBy("part_").agg(F.min(group).alias("first"), F.max_by(last, F.struct(group, "at")).alias("last"))
    carried = _carried_over(sorted(edges.collect(), key=lambda p: p["part_"]), sums)
    if not carried:
        return placed.drop("part_")
    kind = placed.schema[group].dataType.simpleString()
    more = spark.createDataFrame(carried, f"part_ long, `{group}` {kind}, more_at long" + "".join(f", more_{s} long" for s in sums))
    joined = placed.join(F.broadcast(more), ["part_", group], "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).bitwiseAND(F.lit(MASK)).alias(a)
    return joined.select(*keep, plus("at", "more_at"), *(plus(f"run_{s}", f"more_{s}") for s in sums))
