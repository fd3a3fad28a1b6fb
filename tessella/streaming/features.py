"""Windowed features over streams: the same aggregates as over tables, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder; a schema is asked for, as streams have no second look."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def windowed(df: DataFrame, time: str, value: str, by: list[str], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation and range of a value by key and tumbling or sliding window. Rows later than `late` are left out
    of a stream; in a table nothing is late."""
    t = F.col(time).cast("timestamp")
    stamped = df.withColumn("__t", t).withWatermark("__t", late)
    w = F.window("__t", length, slide) if slide else F.window("__t", length)
    out = stamped.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "min", "max")


def sessions(df: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session length in rows and seconds by key: rows less than `gap` apart are one session."""
    stamped = df.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = stamped.groupBy(*by, F.session_window("__t", gap).alias("w")).agg(F.count("*").alias("n"), F.min("__t").alias("first"), F.max("__t").alias("last"))
    return out.select(*by, F.col("first").alias("start"), F.col("last").alias("end"), "n", (F.unix_micros("last") - F.unix_micros("first")).alias("micros"))


def write_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append finished windows to a folder, once for what is there now."""
    return df.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
