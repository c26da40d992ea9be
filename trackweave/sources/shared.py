"""Tables kept in the folder that driver and executors share, between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch of rasters: a worker holds a batch a few times over, as 8-byte numbers.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of operators whose rows are whole rasters, and with them the Python workers' memory, whatever the number of frames.

    The two values are the session's; ones that are shorter already stay.
    """
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all runs on one machine, a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="trackweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Kept:
    """A table written to the shared folder: reading it again needs nothing that came before it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
