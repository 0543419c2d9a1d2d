"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where unset a temporary one on a local master, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "skein.shared.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        spark.conf.set("skein.shared.dir", root)
    return root.rstrip("/")


#: Rows in an Arrow batch, for whole texts; a session that has set another number than Spark's own keeps it.
ROWS_PER_BATCH = 2_000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _tidied(run: Callable) -> Callable:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:  # the worker process lives on: give what this task no longer needs back to the machine
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches that are small enough for long texts."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY) == "10000":
        conf.set(_ROWS_KEY, str(ROWS_PER_BATCH))
    return df.mapInArrow(_tidied(run), schema)


class Stage:
    """One working folder of one run; ``keep`` writes a table there and reads it back.

    A written table survives the loss of any executor and is never recomputed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # results are read from it lazily, so it goes when the application ends

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
