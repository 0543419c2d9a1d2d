"""Day snapshots, guarded saves, appended logs, updates by key and chat lines.

All go through Spark's writers, so a failed write leaves what was there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace the days that the rows hold and leave all other days of the table as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def days(spark: SparkSession, path: str, day: str = "day") -> DataFrame:
    """The days of a snapshot table with their rows, from the newest; only partition values are read beside counts."""
    return spark.read.parquet(path).groupBy(day).agg(F.count("*").alias("n")).orderBy(F.desc(day))


class Versions:
    """A table as numbered versions in one folder; readers take the newest whole one, so replacing it is safe."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The newest version, None where there is none."""
        whole = self._whole()
        return self.spark.read.parquet(f"{self.path}/{whole[-1]}") if whole else None

    def replace(self, df: DataFrame, marks: dict | None = None) -> DataFrame:
        """Write the rows as the next version, with marks (such as how far each feed was read) that count only together with it."""
        whole = self._whole()
        number = int(whole[-1][1:13]) + 1 if whole else 0
        target = f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}"
        if marks is not None:  # before the rows, whose end makes the version whole
            self._text(f"{target}/_marks", json.dumps(marks))
        df.write.mode("append").parquet(target)
        return self.spark.read.parquet(target)

    def marks(self) -> dict:
        """The marks of the newest version, empty where it has none."""
        whole = self._whole()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{whole[-1]}/_marks") if whole else None
        if path is None or not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _text(self, path: str, text: str) -> None:
        out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def save_more(self, df: DataFrame) -> bool:
        """Replace only by rows that are some, and not fewer than those that are there; whether it was done."""
        held, n = self.read(), df.count()
        if n == 0 or held is not None and n < held.count():
            return False
        self.replace(df)
        return True

    def restore(self, written: str, as_of: Column, hours: float) -> DataFrame | None:
        """The newest version if its latest time in the column ``written`` is at most so old."""
        held = self.read()
        if held is None:
            return None
        fresh = held.agg((F.max(written) >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")).alias("ok")).first()["ok"]
        return held if fresh else None

    def patch(self, patches: DataFrame, key: str) -> DataFrame:
        """The next version: where a patch has the row's key, its other columns replace the row's, null ones too; one patch a key."""
        held = self.read()
        changed = [c for c in patches.columns if c != key]
        side = patches.select(key, F.struct(*changed).alias("patch_"))
        rows = held.join(side, key, "left").withColumns(
            {c: F.when(F.col("patch_").isNotNull(), F.col(f"patch_.{c}")).otherwise(F.col(c)) for c in changed})
        return self.replace(rows.select(*held.columns))


def append_lines(df: DataFrame, path: str) -> None:
    """Add the rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def chat_lines(turns: DataFrame, path: str, system: str | None = None) -> None:
    """One JSON line of messages for each conversation (conv_id, turn, role, text), a system message first where given."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    if system is not None:
        messages = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), messages)
    lines = turns.groupBy("conv_id").agg(messages.alias("messages")).select(F.to_json(F.struct("messages")).alias("value"))
    lines.write.mode("overwrite").text(path)
