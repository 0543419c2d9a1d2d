"""Streams of position reports and events: rolling counts, repeats, trails with expiry, verified ships, batch ingest and look-back snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fleets import SHIP_NAME, ship_number, valid_position
from ..operators.selection import keep_one
from ..sinks.tables import Versions


def without_repeats(reports: DataFrame, keys: list[str], late: str = "24 hours") -> DataFrame:
    """Each key once within the time in which late rows are still taken; state goes with the watermark."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def hourly(reports: DataFrame, late: str = "24 hours") -> DataFrame:
    """Reports per kind and hour; rows older than ``late`` behind the newest are left out."""
    counts = reports.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "kind", "n")


def segments(reports: DataFrame, gap: str = "10 minutes", late: str = "24 hours") -> DataFrame:
    """Stretches of an entity's reports without a longer gap."""
    own = reports.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity").agg(F.count("*").alias("n"))
    return own.select("entity", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _timeout(idle_ms: int | None) -> str:
    """State that goes when idle needs a query that runs on; None suits one that ends with its input."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


TRAIL = "entity long, points long, newest long, lats array<double>, lons array<double>"


def trails(reports: DataFrame, most: int = 30, idle_ms: int | None = 600_000) -> DataFrame:
    """The newest points of each entity, oldest first; state is bounded by ``most`` points and goes when idle."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in rows:
            held = sorted([*held, *zip(part["ts_us"].tolist(), part["lat"].tolist(), part["lon"].tolist(), strict=True)])[-most:]
        columns = [list(x) for x in zip(*held, strict=True)]
        state.update(tuple(columns))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"entity": [key[0]], "points": [len(held)], "newest": [held[-1][0]], "lats": [columns[1]], "lons": [columns[2]]})

    grouped = reports.select("entity", "ts_us", "lat", "lon").groupBy("entity")
    return grouped.applyInPandasWithState(update, TRAIL, "ts array<long>, lats array<double>, lons array<double>", "update",
        _timeout(idle_ms))


SHOWN = "number string, ship string, ts_us long, lat double, lon double"


def verified_positions(messages: DataFrame, idle_ms: int | None = 4 * 3_600_000) -> DataFrame:
    """Positions of ships shown to be military by an earlier static message or by their number; what is known goes after ``idle_ms``.

    ``messages``: number, ts_us, seq, kind, name, ship_type, lat, lon. Rows of a micro-batch are taken in the order of time.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name = state.get[0] if state.exists else None
        own = pd.concat(list(rows)).sort_values(["ts_us", "seq"])
        out = []
        for row in own.itertuples():
            if row.shown is not None and row.shown == row.shown:
                name = row.shown
            elif row.kind == "position" and row.valid and (name is not None or row.warship):
                out.append((key[0], name or key[0], row.ts_us, row.lat, row.lon))
        if name is not None:
            state.update((name,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["number", "ship", "ts_us", "lat", "lon"])

    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), "@+$", ""))
    shown = F.when((F.col("kind") == "static") & (name.rlike(SHIP_NAME) | F.coalesce(F.col("ship_type") == 35, F.lit(False))),
        F.coalesce(F.nullif(name, F.lit("")), F.col("number")))
    rows = messages.select("number", "ts_us", "seq", "kind", "lat", "lon", shown.alias("shown"),
        ship_number(F.col("number"))["warship"].alias("warship"), valid_position(F.col("lat"), F.col("lon")).alias("valid"))
    return rows.groupBy("number").applyInPandasWithState(update, SHOWN, "name string", "append", _timeout(idle_ms))


def ingest(spark: SparkSession, folder: str, schema, take: Callable[[DataFrame, int], None], checkpoint: str, files: int = 8,
    format: str = "parquet") -> StreamingQuery:
    """Give the files that came since the last run to ``take``, so many at a time; each feed with its own checkpoint has its own mark."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def look_back(snapshot: Versions, key: str, ts: str = "ts", hours: int = 24, order: tuple = ("score",)) -> Callable[[DataFrame, int], None]:
    """What ``ingest`` calls to keep a snapshot: old and new rows of the last hours before the newest, of each key the best."""

    def take(batch: DataFrame, number: int) -> None:
        held = snapshot.read()
        rows = batch if held is None else held.unionByName(batch)
        newest = rows.agg(F.max(ts).alias("newest_"))
        rows = rows.join(F.broadcast(newest)).where(F.col(ts) >= F.col("newest_") - F.expr(f"INTERVAL {hours} HOURS")).drop("newest_")
        snapshot.replace(keep_one(rows, [key], *(F.desc(o) for o in order), F.desc(ts)))

    return take
