"""Queries that run streams over the event table to its end, and read what they wrote.

Each stream reads the files that are there, batch by batch, writes every batch's rows to a table of its own in the run's folder,
and stops; the last state of a key is that of the last batch that has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Stage
from ..streaming import reports, stores
from .shims import LAT_SQL, LON_SQL, POSITION_SQL, lat_of, lon_of, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may stand for one file, a plain path not
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All rows that the stream gives until its input ends, with ``batch``, the number of the micro-batch that gave them."""
    stage = Stage(stream.sparkSession, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{stage.path}/rows/number={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{stage.path}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema
    return stream.sparkSession.read.schema(schema).parquet(f"{stage.path}/rows/*")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("rank_", newest).where("rank_ = 1").drop("rank_", "batch")


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per kind and hour."""
    rows = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"))
    return _last(_written(reports.hourly(rows, "3650 days"), "update", "hours"), "hour", "kind")


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report of each entity and kind within the time in which late rows are taken, here all of it."""
    rows = _events(spark, sf_dir).select("ts", (F.col("user_id") % 50).alias("entity"), F.col("event_type").alias("kind"))
    return _written(reports.without_repeats(rows, ["entity", "kind"], "3650 days"), "append", "repeats").select("entity", "kind")


def stream_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 points of each entity."""
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("entity"), F.unix_micros("ts").alias("ts_us"), lat_of(k).alias("lat"), lon_of(k).alias("lon")
    )
    out = _last(_written(reports.trails(rows, idle_ms=None), "update", "trails"), "entity")
    total = lambda c: F.aggregate(F.transform(c, lambda x: F.floor(x * 100 + 0.5).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("entity", "points", "newest", total("lats").alias("lats"), total("lons").alias("lons"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ships' messages: every seventh is a static one, of a warship's name or of another."""
    k, number = F.col("event_id"), (F.col("user_id") % 40).cast("string")
    static = k % 7 == 0
    return _events(spark, sf_dir).select(
        number.alias("number"), "ts", k.alias("seq"), F.when(static, "static").otherwise("position").alias("kind"),
        F.when(static, F.when(k % 3 == 0, F.concat(F.lit("USS "), (k % 5).cast("string"), F.lit("@@"))).otherwise("TUG")).alias("name"),
        F.lit(None).cast("int").alias("ship_type"), F.when(k % 11 != 0, lat_of(k)).alias("lat"), lon_of(k).alias("lon"),
    )


def stream_ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ships shown to be military, with their last place and the number of their newest points; none goes, as none is idle for so long."""
    stores.with_state_store(spark)
    stream = stores.ships(_messages(spark, sf_dir), late="3650 days", step=0.0)
    rows = _last(_written(stream, "append", "ships").where("event = 'seen'"), "number")
    return rows.select("number", "ship", "ts", "points", F.floor(F.col("lat") * 100 + 0.5).cast("long").alias("lat"))


def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose id wasn't let through in the last day, nor their fingerprint in the last 14."""
    stores.with_state_store(spark)
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("id"), F.concat("event_type", (k % 3).cast("string")).alias("print"), "ts", k.alias("seq"))
    return _written(stores.unseen(rows, late="3650 days"), "append", "unseen").select("seq", "id", "print")


QUERIES = {f.__name__: f for f in (stream_hours, stream_repeats, stream_trails, stream_ships, stream_unseen)}

_STEP = """{to}(key, ts, seq) AS (SELECT {key}, min(ts), arg_min(seq, {{t: ts, s: seq}}) FROM {rows} GROUP BY {key} UNION ALL
  SELECT w.key, min(r.ts), arg_min(r.seq, {{t: r.ts, s: r.seq}}) FROM {to} w JOIN {rows} r ON r.{key} = w.key AND r.ts > w.ts + INTERVAL {life} GROUP BY w.key, w.ts)"""
SQL = {
    "stream_hours": "SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "stream_repeats": "SELECT DISTINCT user_id % 50 AS entity, event_type AS kind FROM events",
    "stream_trails": f"""WITH r AS (SELECT * FROM {POSITION_SQL} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, lat DESC, lon DESC) <= 30)
SELECT entity, count(*) AS points, max(ts_us) AS newest, sum(floor(lat * 100 + 0.5)::BIGINT)::BIGINT AS lats, sum(floor(lon * 100 + 0.5)::BIGINT)::BIGINT AS lons FROM r GROUP BY entity""",
    "stream_ships": f"""WITH m AS (SELECT user_id % 40 AS n, ts, event_id AS k, event_id % 7 = 0 AS static, {LAT_SQL.format(k="event_id")} AS lat, {LON_SQL.format(k="event_id")} AS lon FROM events),
t AS (SELECT *, last_value(CASE WHEN static AND k % 3 = 0 THEN 'USS ' || k % 5 END IGNORE NULLS) OVER (PARTITION BY n ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS ship FROM m),
p AS (SELECT * FROM t WHERE NOT static AND ship IS NOT NULL AND k % 11 <> 0 AND NOT (lat = 0 AND lon = 0))
SELECT n::VARCHAR AS number, arg_max(ship, {{t: ts, k: k}}) AS ship, max(ts) AS ts, least(30, count(*)) AS points, floor(arg_max(lat, {{t: ts, k: k}}) * 100 + 0.5)::BIGINT AS lat FROM p GROUP BY n""",
    "stream_unseen": f"""WITH RECURSIVE e AS (SELECT user_id % 20 AS id, event_type || event_id % 3 AS print, ts, event_id AS seq FROM events),
{_STEP.format(to="w", key="id", rows="e", life="24 HOURS")}, new AS (SELECT e.* FROM e WHERE seq IN (SELECT seq FROM w)),
{_STEP.format(to="v", key="print", rows="new", life="14 DAYS")} SELECT seq, id, print FROM new WHERE seq IN (SELECT seq FROM v)""",
}
