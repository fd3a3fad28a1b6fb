"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, if the executors run in the driver; else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return context.getCheckpointDir().get().rstrip("/")


_kept: dict[str, list[Store]] = {}


class Store:
    """A folder of Parquet tables. It goes with close(), at the end of a with block, or when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 0
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path)
        self.files.deleteOnExit(self.path)

    @staticmethod
    def kept(spark: SparkSession) -> Store:
        """A store for tables that a lazy result reads: it stays until release() is called or the application ends."""
        made = Store(spark)
        _kept.setdefault(spark.sparkContext.applicationId, []).append(made)
        return made

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return one that reads it: lineage is cut, and the rows outlive executors."""
        at, schema = f"{self.root}/{self.n}-{name}", df.schema
        self.n += 1
        df.write.parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def close(self) -> None:
        self.files.delete(self.path, True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def release(spark: SparkSession) -> int:
    """Delete the tables of all kept stores: to be called when no result of an operator is read any more. How many stores there were."""
    stores = _kept.pop(spark.sparkContext.applicationId, [])
    for s in stores:
        s.close()
    return len(stores)
