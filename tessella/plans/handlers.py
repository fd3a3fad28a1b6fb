"""Typed preparation of tables for classification, regression, text targets and time series."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import registry
from tessella.operators import clean, evaluate, learn, profile, series
from tessella.operators.categorical import fold_rare
from tessella.registry import OperatorError, numeric


#: Categories that are sent to every task.
FEW = 10_000


def _encode(df: DataFrame, column: str) -> DataFrame:
    """The column's categories as numbers from 0 in sort order; null stays null."""
    fitted = registry.fit(df.where(F.col(f"`{column}`").isNotNull()), "label_encode", column, out="__code")
    # A few categories go to the rows: rows that were shuffled by them would stand in as many tasks.
    if fitted.lookup is not None and fitted.lookup.limit(FEW + 1).count() <= FEW:
        fitted.lookup = F.broadcast(fitted.lookup)
    filled = fitted.transform(df)
    return filled.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.col("__code")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def prepare_classification(df: DataFrame, target: str) -> DataFrame:
    """Target and text columns become numbers; nulls stay."""
    for c in [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]:
        df = _encode(df, c)
    return df if target in clean.numeric_columns(df) else df.withColumn(target, F.col(f"`{target}`").cast("int"))


def prepare_regression(df: DataFrame, target: str, top: int = 19) -> DataFrame:
    """The target as a number; times as dates in text; texts folded to the top categories and 'Other', then 0/1 columns without the first."""
    df = df.withColumn(target, F.col(f"`{target}`").try_cast("double"))
    times = clean.time_columns(df)
    df = df.select(*[F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd").alias(c) if c in times else F.col(f"`{c}`") for c in df.columns])
    for c in [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target]:
        df = fold_rare(df, c, top)
        values = sorted(r[0] for r in df.select(c).distinct().collect())[1:]  # top + 1 values at most
        df = df.select(*[F.col(f"`{x}`") for x in df.columns if x != c], *[(F.col(f"`{c}`") == v).cast("int").alias(f"{c}_{v}") for v in values])
    return df


def prepare_text(df: DataFrame, target: str) -> DataFrame:
    """The target as text; other text columns as numbers."""
    for c in [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target]:
        df = _encode(df, c)
    return df.withColumn(target, F.coalesce(F.col(f"`{target}`").cast("string"), F.lit("")))


def find_time_column(df: DataFrame) -> str | None:
    """The first time column, else one with a telling name."""
    found = clean.time_columns(df)
    return found[0] if found else next((c for c in df.columns if c.lower() in ("date", "time", "datetime", "timestamp", "ds")), None)


def prepare_time_series(df: DataFrame, target: str, time: str | None = None, horizon: int = 1, partition_by: list[str] | None = None, tie: list[str] | None = None, windows: tuple[int, ...] = (2, 3, 5, 7, 14, 30), rows: int | None = None) -> DataFrame:
    """Calendar fields, month start and end, business hours, waves of month and weekday, lags from the horizon on (12 at most,
    fewer for short series) and means of full windows that end `horizon` rows back."""
    time = time or find_time_column(df)
    if time is None:
        raise OperatorError("there is no time column")
    rows = rows or df.count()
    w, y, t = series.spec([time, *(tie or [])], partition_by), numeric(df, target), F.col(f"`{time}`")
    two_pi = F.lit(6.283185307179586)
    made = [
        F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.weekday(t).alias("dayofweek"), F.quarter(t).alias("quarter"), F.hour(t).alias("hour"),
        (F.weekday(t) >= 5).cast("int").alias("is_weekend"), (F.dayofmonth(t) == 1).cast("int").alias("is_month_start"), (F.to_date(t) == F.last_day(t)).cast("int").alias("is_month_end"),
        (F.hour(t).between(9, 17) & (F.weekday(t) < 5)).cast("int").alias("is_business_hour"),
        F.sin(two_pi * F.month(t) / 12).alias("month_sin"), F.cos(two_pi * F.month(t) / 12).alias("month_cos"), F.sin(two_pi * F.weekday(t) / 7).alias("dayofweek_sin"), F.cos(two_pi * F.weekday(t) / 7).alias("dayofweek_cos"),
    ]
    made += [F.lag(y, k).over(w).alias(f"{target}_lag_{k}") for k in range(horizon, horizon + max(1, min(12, rows // 10)))]
    for n in windows:
        if n < rows / 5:
            frame = w.rowsBetween(-(horizon + n - 1), -horizon)
            made.append(F.when(F.count(y).over(frame) == n, F.avg(y).over(frame)).alias(f"{target}_rolling_mean_{n}"))
    return df.select("*", *made)


PREPARE = {"classification": prepare_classification, "regression": prepare_regression, "text": prepare_text, "time_series": prepare_time_series}


def score(df: DataFrame, target: str, kind: str, key: list[str], time: str | None = None) -> float:
    """A validated score from 0 to 1: accuracy, R squared over 0, or for time series that of expanding splits."""
    columns = clean.numeric_columns(df, (target, *key))
    if not columns:
        df, columns = df.withColumn("__one", F.lit(1.0)), ["__one"]
    task = "classification" if kind == "classification" else "regression"
    cv = learn.cross_validate(df, columns, target, task, key, 3, time=time if kind == "time_series" else None)
    return max(0.0, min(1.0, cv["mean"]))


def evaluate_transformations(before: DataFrame, after: DataFrame, target: str, kind: str, key: list[str]) -> dict[str, float]:
    """Scores before and after, and the gain."""
    a, b = score(before, target, kind, key), score(after, target, kind, key)
    return {"before": a, "after": b, "gain": b - a}


def properties(df: DataFrame, target: str, kind: str, time: str | None = None) -> dict[str, Any]:
    """Counts by type, moments and, for a time series, its gaps, seasons by span and stationarity."""
    kinds = profile.infer_types(df)
    out: dict[str, Any] = {"rows": df.count(), "types": {k: sum(v == k for v in kinds.values()) for k in set(kinds.values())}, "target_type": kinds.get(target)}
    if target in clean.numeric_columns(df):
        out["target"] = profile.numeric_profile(df, [target])[target]
    if kind == "classification":
        out["balance"] = evaluate.class_balance(df, target)
    if kind == "time_series" and time:
        t = profile.time_profile(df, [time])[time]
        span = t.get("span_days") or 0
        out["time"] = t | {"daily": span >= 2, "weekly": span >= 14, "monthly": span >= 60, "yearly": span >= 730}
        out["dickey_fuller"] = series.dickey_fuller(df, target, [time])
    return out
