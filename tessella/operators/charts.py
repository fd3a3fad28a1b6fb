"""The data behind charts: counts and means over all rows, never a sample. Drawing is left to the reader."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import profile
from tessella.operators.datetimes import micros, moment
from tessella.registry import OperatorError, corr, numeric, stats


def _bin(x: Column, low: float, width: float, bins: int) -> Column:
    return F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def _edges(df: DataFrame, values: list[Column], bins: int) -> list[tuple[float, float]]:
    """(low, width) of each value's bins, all in one pass; the width of a constant is 1."""
    row = stats(df, **{f"{n}{i}": f(v) for i, v in enumerate(values) for n, f in (("lo", F.min), ("hi", F.max))})
    return [(row[f"lo{i}"] or 0.0, ((row[f"hi{i}"] or 0.0) - (row[f"lo{i}"] or 0.0)) / bins or 1.0) for i in range(len(values))]


def pair_grid(df: DataFrame, columns: list[str], bins: int = 20, by: str | None = None) -> DataFrame:
    """(a, b, x, y, [class], n, low_x, low_y): rows in each cell of the joint bins of each two columns, and of each column with
    itself (x = y, the diagonal's histogram). All pairs in one aggregate; rows that lack one of a pair's values are not in it.

    A null class is a class; a constant column has one bin; repeated rows count as often as they are there.
    """
    values = [numeric(df, c) for c in columns]
    edges = _edges(df, values, bins)
    placed = df.select(*[_bin(v, low, width, bins).alias(f"b{i}") for i, (v, (low, width)) in enumerate(zip(values, edges, strict=True))], *([F.col(f"`{by}`").alias("class")] if by else []))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{i}").alias("x"), F.col(f"b{j}").alias("y")) for i in range(len(columns)) for j in range(i, len(columns))]
    keys = ["i", "j", "x", "y", *(["class"] if by else [])]
    cells = placed.select(F.explode(F.array(*pairs)).alias("p"), *(["class"] if by else [])).select("p.*", *(["class"] if by else [])).where("x is not null and y is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    name, low, width = (F.array(*[F.lit(v) for v in part]) for part in (columns, [e[0] for e in edges], [e[1] for e in edges]))
    start = lambda c, b: F.get(low, F.col(c)) + F.col(b) * F.get(width, F.col(c))
    return cells.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), "x", "y", *(["class"] if by else []), "n", start("i", "x").alias("low_x"), start("j", "y").alias("low_y"))


def effect(df: DataFrame, column: str, made: dict[str, Column], bins: int = 30, target: str | None = None) -> DataFrame:
    """(feature, bin, low, high, n, [target]): the column and what is made of it, in bins with common edges, with the target's mean.

    Values of each feature are standardised by its own mean and deviation first, so that shapes can be laid over each other; the edges
    span the standardised values of all of them. Missing values are in no bin; a constant feature is at 0.
    """
    values = {column: numeric(df, column)} | {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in made.items()}
    moments = stats(df, **{f"{n}{i}": f(v) for i, v in enumerate(values.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))})
    z = [(v - F.lit(moments[f"m{i}"] or 0.0)) / F.lit(moments[f"s{i}"] or 1.0) for i, v in enumerate(values.values())]
    spans = stats(df, **{f"{n}{i}": f(v) for i, v in enumerate(z) for n, f in (("lo", F.min), ("hi", F.max))})
    low = min((v for k, v in spans.items() if k.startswith("lo") and v is not None), default=0.0)
    width = (max((v for k, v in spans.items() if k.startswith("hi") and v is not None), default=0.0) - low) / bins or 1.0
    stacked = df.select(*([numeric(df, target).alias("y")] if target else []), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), _bin(v, low, width, bins).alias("bin")) for n, v in zip(values, z, strict=True)])).alias("s"))
    counts = stacked.where("s.bin is not null").groupBy("s.feature", "s.bin").agg(F.count("*").alias("n"), *([F.avg("y").alias(target)] if target else []))
    return counts.select("feature", "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n", *([F.col(f"`{target}`")] if target else []))


def shape_change(df: DataFrame, column: str, made: dict[str, Column], target: str | None = None) -> list[dict[str, Any]]:
    """Of the column and what is made of it: rows, share missing, skewness, excess kurtosis, and how much nearer to 0 the skewness
    came; with a target also the correlation with it. One pass."""
    values = {column: numeric(df, column)} | {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in made.items()}
    wanted = {f"{n}{i}": f(v) for i, v in enumerate(values.values()) for n, f in (("n", F.count), ("skew", F.skewness), ("kurt", F.kurtosis))}
    if target:
        wanted |= {f"corr{i}": corr(v, numeric(df, target)) for i, v in enumerate(values.values())}
    row = stats(df, rows=F.count("*"), **wanted)
    before = abs(row["skew0"] or 0.0)
    out = []
    for i, name in enumerate(values):
        told = {"feature": name, "n": row[f"n{i}"], "missing": 1 - row[f"n{i}"] / row["rows"] if row["rows"] else 0.0, "skewness": row[f"skew{i}"], "kurtosis": row[f"kurt{i}"], "gain": before - abs(row[f"skew{i}"] or 0.0)}
        out.append(told | ({"correlation": row[f"corr{i}"]} if target else {}))
    return out


def series_points(df: DataFrame, time: str, columns: list[str], points: int = 200) -> DataFrame:
    """(feature, bucket, start, n, mean, low, high): columns over time, in so many equal spans from the first time to the last. Rows
    without a time are left out, missing values do not count, and a table of one time has one span."""
    t = micros(moment(df, time))
    s = stats(df, lo=F.min(t), hi=F.max(t))
    if s["lo"] is None:
        return df.sparkSession.createDataFrame([], "feature string, bucket int, start timestamp_ntz, n bigint, mean double, low double, high double")
    width = max(1, -(-(s["hi"] - s["lo"] + 1) // points))
    bucket = F.floor((t - F.lit(s["lo"])) / F.lit(width)).cast("int")
    stacked = df.where(t.isNotNull()).select(bucket.alias("bucket"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), numeric(df, c).alias("v")) for c in columns])).alias("s"))
    told = stacked.where("s.v is not null").groupBy("s.feature", "bucket").agg(F.count("*").alias("n"), F.avg("s.v").alias("mean"), F.min("s.v").alias("low"), F.max("s.v").alias("high"))
    start = F.timestamp_add("MICROSECOND", F.lit(s["lo"]) + F.col("bucket") * F.lit(width), F.lit("1970-01-01").cast("timestamp_ntz"))
    return told.select("feature", "bucket", start.alias("start"), "n", "mean", "low", "high")


def dashboard(df: DataFrame, columns: list[str], target: str | None = None, time: str | None = None, bins: int = 20) -> dict[str, list[dict[str, Any]]]:
    """Everything that a page on a table shows, as lists of small rows: profile, histograms, pair grid, correlations and, with a time,
    series. Their sizes depend on the numbers of columns and bins alone."""
    if not columns:
        raise OperatorError("a dashboard needs columns")
    shown = [*columns, *([target] if target and target not in columns else [])]
    told = profile.numeric_profile(df, shown)
    out = {"profile": [{"feature": c, **told[c]} for c in shown], "pairs": [r.asDict() for r in pair_grid(df, shown, bins).orderBy("a", "b", "x", "y").collect()]}
    out["histograms"] = [{"feature": r["a"], "bin": r["x"], "low": r["low_x"], "n": r["n"]} for r in out["pairs"] if r["a"] == r["b"]]
    row = stats(df, **{f"r{i}_{j}": corr(numeric(df, a), numeric(df, b)) for i, a in enumerate(shown) for j, b in enumerate(shown) if i < j})
    out["correlations"] = [{"a": a, "b": b, "r": row[f"r{i}_{j}"]} for i, a in enumerate(shown) for j, b in enumerate(shown) if i < j]
    if time:
        out["series"] = [r.asDict() for r in series_points(df, time, shown).orderBy("feature", "bucket").collect()]
    return out
