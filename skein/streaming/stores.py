"""Streams with state of their own life: ships with trails, a store of what was seen, and batches whose failures are kept and retried.

All lives are counted in event time. Timers fire as the watermark passes them, and the watermark only moves while messages
arrive, so a stream that falls silent loses nothing, however long the silence is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.fleets import SHIP_NAME, ship_number, valid_position

#: What a session must be set to for these streams.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HOUR_MS = 3_600_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that keeps several states of a key."""
    spark.conf.set(*STATE_STORE)
    return spark


def _one(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="stable").reset_index(drop=True)


SHIPS = "number string, event string, ship string, us long, lat double, lon double, points long, lats array<double>, lons array<double>"


class Ships(StatefulProcessor):
    """What is known of one ship: its name once it is shown to be military, its last position, and its newest points.

    Only then are its positions kept. A point within a step of the last kept one is none of the trail. ``expire_ms`` after its last
    position (in event time) the ship goes, with a last row ``gone``.
    """

    def __init__(self, most: int, step: float, expire_ms: int):
        self.most, self.step, self.expire_ms = most, step, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.name = handle.getValueState("name", "name string")
        self.last = handle.getValueState("last", "us long, lat double, lon double")
        self.trail = handle.getListState("trail", "lat double, lon double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = _one(rows, "us", "seq")
        name = self.name.get()[0] if self.name.exists() else None
        kept = list(self.trail.get()) if self.trail.exists() else []
        # the name that counts for each row is the last one told before it or with it
        told = own["shown"].ffill()
        told = told if name is None else told.fillna(name)
        by_number = own["warship"].astype("boolean").fillna(False).astype(bool) & told.isna()
        if by_number.any():  # a warship's number shows it from its first position on
            first = (by_number & (own["kind"] == "position") & own["valid"]).idxmax()
            if by_number[first] and own["kind"][first] == "position" and own["valid"][first]:
                told[told.isna() & (told.index >= first)] = key[0]
        good = (own["kind"] == "position") & own["valid"].astype("boolean").fillna(False).astype(bool) & told.notna()
        if told.notna().any():
            self.name.update((told.dropna().iloc[-1],))
        at = own[good]
        if not len(at):
            return
        for lat, lon in zip(at["lat"].tolist(), at["lon"].tolist(), strict=True):
            if not kept or abs(kept[-1][0] - lat) >= self.step or abs(kept[-1][1] - lon) >= self.step:
                kept.append((lat, lon))
        kept = kept[-self.most :]
        self.trail.put(kept)
        newest, us = at.iloc[-1], int(at["us"].iloc[-1])
        self.last.update((us, float(newest["lat"]), float(newest["lon"])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(us // 1000 + self.expire_ms)
        yield self._row(key[0], "seen", told[at.index[-1]], us, newest["lat"], newest["lon"], kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, lat, lon = self.last.get()
        name = self.name.get()[0]
        kept = list(self.trail.get()) if self.trail.exists() else []
        self.last.clear()
        self.trail.clear()  # what shows it to be military stays known
        yield self._row(key[0], "gone", name, us, lat, lon, kept)

    @staticmethod
    def _row(number, event, ship, us, lat, lon, kept) -> pd.DataFrame:
        columns = {"number": number, "event": event, "ship": ship, "us": us, "lat": lat, "lon": lon,
            "points": len(kept)}
        return pd.DataFrame({**{c: [v] for c, v in columns.items()}, "lats": [[p[0] for p in kept]], "lons": [[p[1] for p in kept]]})

    def close(self) -> None:
        pass


def ships(messages: DataFrame, late: str = "10 minutes", most: int = 30, step: float = 0.001, expire_ms: int = 4 * HOUR_MS) -> DataFrame:
    """Ships as they are seen and as they go: one row per ship and micro-batch with its newest place and trail.

    ``messages``: number, ts, seq, kind, name, ship_type, lat, lon. Rows later than ``late`` behind the newest are left out.
    """
    name = F.trim(F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), "@+$", ""))
    military = name.rlike(SHIP_NAME) | F.coalesce(F.col("ship_type") == 35, F.lit(False))
    shown = F.when((F.col("kind") == "static") & military, F.coalesce(F.nullif(name, F.lit("")), F.col("number")))
    warship, valid = ship_number(F.col("number"))["warship"], F.coalesce(valid_position(F.col("lat"), F.col("lon")), F.lit(False))
    rows = messages.withWatermark("ts", late).select("number", "ts", F.unix_micros("ts").alias("us"), "seq", "kind", "lat", "lon", shown.alias("shown"),
        F.coalesce(warship, F.lit(False)).alias("warship"), valid.alias("valid"))
    found = rows.groupBy("number").transformWithStateInPandas(Ships(most, step, expire_ms), SHIPS, "Append", "EventTime")
    return found.select("number", "event", "ship", F.timestamp_micros("us").alias("ts"), "lat", "lon", "points", "lats", "lons")


class Seen(StatefulProcessor):
    """When a key was last let through; a row (with us_, its time) within ``life_ms`` after that is known, and so are later rows of one batch."""

    def __init__(self, life_ms: int, flag: str):
        self.life_ms, self.flag = life_ms, flag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = _one(rows, "us_", "seq")
        at, known = self.at.get()[0] if self.at.exists() else None, []
        for us in own["us_"].tolist():
            known.append(at is not None and us - at <= 1000 * self.life_ms)
            at = at if known[-1] else us
        self.at.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.life_ms + 2)
        out = own[~pd.Series(known, index=own.index)]
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        return iter(())

    def close(self) -> None:
        pass


def unseen(rows: DataFrame, late: str = "10 minutes", id_ms: int = 24 * HOUR_MS, print_ms: int = 14 * 24 * HOUR_MS) -> DataFrame:
    """Rows (id, print, ts, seq and others) whose id wasn't let through in the last day and whose fingerprint wasn't in the last 14.

    Two stores one after the other: a row that is new by its id is remembered there, and then meets the store of fingerprints.
    """
    timed = rows.withWatermark("ts", late).withColumn("us_", F.unix_micros("ts"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema)
    by_id = timed.groupBy("id").transformWithStateInPandas(Seen(id_ms, "id"), schema, "Append", "EventTime",
        eventTimeColumnName="ts")
    return by_id.groupBy("print").transformWithStateInPandas(Seen(print_ms, "print"), schema, "Append", "EventTime").drop("us_")


OUTCOME = "number long, file string, ok boolean, error string, at timestamp"


class Outcomes:
    """What became of each file of a feed, as a log of lines; a file's last line counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, number: int, files: list[str], error: str | None) -> None:
        rows = self.spark.createDataFrame([(number, f, error is None, error) for f in files],
            "number long, file string, ok boolean, error string")
        rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)

    def last(self) -> DataFrame:
        """One row a file: its newest outcome."""
        try:
            rows = self.spark.read.schema(OUTCOME).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], OUTCOME)
        newest: Column = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at"), F.desc("number")))
        return rows.withColumn("rank_", newest).where("rank_ = 1").drop("rank_")

    def failed(self) -> list[str]:
        return [r.file for r in self.last().where("not ok").orderBy("file").select("file").collect()]


def _tried(take: Callable[[DataFrame, int], None], outcomes: Outcomes, rows: DataFrame, number: int, files: list[str]) -> bool:
    try:
        take(rows, number)
    except Exception as e:
        outcomes.add(number, files, str(e)[:500] or type(e).__name__)
        return False
    outcomes.add(number, files, None)
    return True


def ingest_all(spark: SparkSession, folder: str, schema, take: Callable[[DataFrame, int], None], checkpoint: str, outcomes: Outcomes,
    files: int = 8, format: str = "parquet") -> StreamingQuery:
    """Like ``ingest``, but a batch that fails is noted and passed over, so that later ones go on; ``retry_failed`` takes it up again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(folder)
    stream = stream.select("*", F.col("_metadata.file_path").alias("file_"))

    def each(batch: DataFrame, number: int) -> None:
        names = [r.file_ for r in batch.select("file_").distinct().collect()]  # at most ``files``
        _tried(take, outcomes, batch.drop("file_"), number, names)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(spark: SparkSession, schema, take: Callable[[DataFrame, int], None], outcomes: Outcomes,
    format: str = "parquet") -> list[str]:
    """Take the files whose last outcome is a failure once more, one at a time; those that fail again."""
    still = []
    for name in outcomes.failed():
        rows = spark.read.schema(schema).format(format).load(name)
        if not _tried(take, outcomes, rows, -1, [name]):
            still.append(name)
    return still
