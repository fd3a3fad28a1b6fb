"""Readers and writers. NaN becomes null on the way in, so that missing values are one thing."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import sheets


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes null, in one projection."""
    return df.select(*[F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def load(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", schema: T.StructType | str | None = None, sheet: str | int = 0) -> DataFrame:
    """Read CSV, Parquet, JSON, ORC or a spreadsheet (its sheet by name or number) by the path's ending."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv", "txt"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else sep).option("encoding", encoding)
        return nan_to_null((reader if schema is not None else reader.option("inferSchema", True)).csv(path))
    if kind in ("parquet", "orc"):
        return nan_to_null(getattr(reader, kind)(path))
    if kind in ("json", "jsonl", "ndjson"):
        return nan_to_null((reader.option("multiLine", True) if kind == "json" and schema is None and _is_array(spark, path) else reader).json(path))
    if kind == "xlsx":
        return nan_to_null(sheets.read(spark, path, sheet))
    if kind == "xls":
        raise ValueError("the old binary spreadsheets are not supported; save the sheet as xlsx")
    raise ValueError(f"unknown file kind {kind!r}")


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("[")


def from_dataframe(spark: SparkSession, frame: Any) -> DataFrame:
    """A pandas frame as a table."""
    return nan_to_null(spark.createDataFrame(frame))


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """Read a database table, in ranges of a column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return nan_to_null(reader.load())


def save(df: DataFrame, path: str, mode: str = "errorifexists", folder: bool = False) -> None:
    """Write CSV (with header), Parquet, JSON lines, ORC or a spreadsheet of one sheet by the path's ending. With folder a spreadsheet is
    a folder of files, so that it can have any number of rows."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind == "xlsx":
        if folder:
            sheets.write_folder(nan_to_null(df), path)
        else:
            sheets.write({"Sheet1": nan_to_null(df)}, path)
        return
    writer = nan_to_null(df).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("parquet", "orc", "json"):
        getattr(writer, kind)(path)
    elif kind in ("jsonl", "ndjson"):
        writer.json(path)
    else:
        raise ValueError(f"unknown file kind {kind!r}")


def save_report(report: dict, path: str) -> None:
    """Write a report as JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str, ensure_ascii=False)
