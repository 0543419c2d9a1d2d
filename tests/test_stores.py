"""Streams with state of their own life."""

from pyspark.sql import functions as F

from skein.streaming import stores


def feed(spark, tmp_path, stream_of, schema, batches, mode="append"):
    """Run a stream over batches of rows, one file each, and give all that it gives."""
    stores.with_state_store(spark)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).withColumn("ts",
            F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i:03d}"))
    typed = spark.createDataFrame([], schema).withColumn("ts", F.to_timestamp("ts")).schema
    rows = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = stream_of(rows).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation",
        str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return spark.table(name).collect()


MESSAGES = "number string, ts string, seq long, kind string, name string, ship_type int, lat double, lon double"


def test_ships_go_only_while_messages_arrive(spark, tmp_path):
    day = "2024-01-01 "
    batches = [
        [("1", day + "00:00:00", 1, "position", None, None, 1.0, 2.0), ("1", day + "00:01:00", 2, "static", "USS X@@", None, None, None),
            ("1", day + "00:02:00", 3, "position", None, None, 1.0, 2.0)],
        [("1", day + "00:03:00", 4, "position", None, None, 1.0004, 2.0), ("1", day + "00:04:00", 5, "position", None, None, 1.5, 2.0),
            ("1", day + "00:05:00", 6, "position", None, None, 0.0, 0.0)],
        [("9", day + "03:00:00", 7, "static", "TUG", None, None, None)],  # 4 hours aren't over
        [("9", day + "05:00:00", 8, "static", "TUG", None, None, None)],
        [("9", day + "05:30:00", 9, "static", "TUG", None, None, None)],
        [("1", day + "06:00:00", 10, "position", None, None, 3.0, 3.0)],
    ]
    rows = feed(spark, tmp_path, stores.ships, MESSAGES, batches)
    got = [(r.number, r.event, r.ship, r.points, r.lats) for r in sorted(rows, key=lambda r: (r.event == "gone", r.ts))]
    assert got == [
        ("1", "seen", "USS X", 1, [1.0]), ("1", "seen", "USS X", 2, [1.0, 1.5]), ("1", "seen", "USS X", 1, [3.0]),  # a new trail, as the old one went
        ("1", "gone", "USS X", 2, [1.0, 1.5]),
    ]


def test_a_silent_stream_keeps_its_ships(spark, tmp_path):
    rows = feed(spark, tmp_path, lambda r: stores.ships(r, expire_ms=1), MESSAGES,
        [[("1", "2024-01-01 00:00:00", 1, "static", "USS X", 35, None, None),
                ("1", "2024-01-01 00:00:01", 2, "position", None, None, 1.0, 1.0)]])
    assert [r.event for r in rows] == ["seen"]


def test_two_lives_of_what_was_seen(spark, tmp_path):
    batches = [
        [("a", "p", "2024-01-01 00:00:00", 1), ("a", "q", "2024-01-01 00:00:01", 2)],
        [("a", "r", "2024-01-02 00:00:00", 3), ("b", "p", "2024-01-02 00:00:00", 4), ("b", "s", "2024-01-02 00:00:01", 5)],  # a within a day to the second; p within 14
        [("a", "r", "2024-01-02 00:00:01", 6)],  # a's day is over
        [("c", "p", "2024-01-15 00:00:00", 7)],  # p's 14 days to the second
        [("d", "p", "2024-01-15 00:00:01", 8)],
        [("a", "r", "2024-01-20 00:00:00", 9), ("e", "t", "2024-01-20 00:00:00", 10)],
    ]
    rows = feed(spark, tmp_path, stores.unseen, "id string, print string, ts string, seq long", batches)
    assert sorted(r.seq for r in rows) == [1, 6, 8, 9, 10]


def test_failed_batches_are_retried(spark, tmp_path):
    schema, taken, broken = "v int", [], {2}

    def take(rows, number):
        values = {r.v for r in rows.collect()}
        if values & broken:
            raise ValueError("broken")
        taken.extend(sorted(values))

    for v in (1, 2, 3):
        spark.createDataFrame([(v,)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    outcomes = stores.Outcomes(spark, str(tmp_path / "outcomes"))
    assert outcomes.failed() == []
    query = stores.ingest_all(spark, str(tmp_path / "in"), schema, take, str(tmp_path / "c"), outcomes, files=1)
    assert query.awaitTermination(120)
    assert sorted(taken) == [1, 3] and len(outcomes.failed()) == 1 and outcomes.last().count() == 3
    assert len(stores.retry_failed(spark, schema, take, outcomes)) == 1
    broken.clear()
    assert stores.retry_failed(spark, schema, take, outcomes) == [] and sorted(taken) == [1, 2, 3] and outcomes.failed() == []
