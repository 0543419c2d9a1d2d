"""Tables that cut lineage, written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where it is unset (as in tests) a temporary folder of this session."""
    key = "skein.shared.dir"
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(key, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


class Stage:
    """The working folder of one run: ``keep`` writes a table and reads it back, so no executor's loss undoes it.

    Results are read from it lazily, so it goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
