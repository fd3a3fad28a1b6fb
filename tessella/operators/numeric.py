"""Numeric operators. Nulls stay null; NaN counts as null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import order
from tessella.registry import Fitted, Need, OperatorError, all_numeric, builds, declare, hit, number, numeric, register, stats


def _plain(name: str, rule) -> None:
    declare("numeric", name, lambda columns, s: rule(number(columns[0])), check=all_numeric)


_plain("square", lambda x: x * x)
_plain("cube", lambda x: x * x * x)
_plain("reciprocal", lambda x: F.try_divide(F.lit(1.0), x + F.lit(1e-10)))
_plain("sin", F.sin)
_plain("cos", F.cos)
_plain("tan", F.tan)
_plain("sigmoid", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
_plain("tanh", F.tanh)


def _with(name: str, wanted, rule) -> None:
    """An operator whose column needs one row of aggregates of the column: wanted(x) names them, rule(x, s) uses them."""
    declare("numeric", name, lambda columns, s, **params: rule(number(columns[0]), s, **params), lambda columns, **_: Need(wanted(number(columns[0]))), all_numeric)


def _or_one(v: float | None) -> float:
    return 1.0 if not v else float(v)


def _lit(v: float | None) -> Column:
    return F.lit(None if v is None else float(v)).cast("double")


def _log(x: Column, s: dict) -> Column:
    low = s["low"]
    return F.ln(x + F.lit(1.0 if low is None or low >= 0 else abs(low) + 1))


def _sqrt(x: Column, s: dict) -> Column:
    low = s["low"]
    return F.sqrt(x + F.lit(0.0 if low is None or low >= 0 else abs(low) + 0.01))


def _scale(x: Column, s: dict, min_val: float = 0.0, max_val: float = 1.0) -> Column:
    return (x - _lit(s["low"])) / F.lit(_or_one((s["high"] or 0) - (s["low"] or 0))) * F.lit(float(max_val - min_val)) + F.lit(float(min_val))


def _range(x: Column) -> dict[str, Column]:
    return {"low": F.min(x), "high": F.max(x)}


_with("log", lambda x: {"low": F.min(x)}, _log)
_with("sqrt", lambda x: {"low": F.min(x)}, _sqrt)
_with("standardize", lambda x: {"mean": F.avg(x), "std": F.stddev_pop(x)}, lambda x, s: (x - _lit(s["mean"])) / F.lit(_or_one(s["std"])))
_with("normalize", _range, lambda x, s: _scale(x, s))
_with("min_max_scale", _range, _scale)
# The other generations' variants of the same maths have names of their own.
_with("log_shift", _range, lambda x, s: F.log1p(x + F.lit(max(0.0, 1 - (s["low"] or 0)))))
_with("sqrt_shift", _range, lambda x, s: F.sqrt(x + F.lit(max(0.0, -(s["low"] or 0)))))
_with("log_gen", _range, lambda x, s: F.log1p(x - _lit(s["low"]) + 1) if (s["low"] or 0) >= 0 else F.log1p(F.abs(x)))
_with("sqrt_gen", _range, lambda x, s: F.sqrt(x - _lit(s["low"]) + F.lit(1e-8)))


@register("numeric")
def quantile_transform(df: DataFrame, column: str, out: str | None = None, n_quantiles: int = 100) -> Fitted:
    """Mean rank of equal values, less a half, over the number of non-null rows. n_quantiles is taken and not used."""
    table, total = order.ranks(df, numeric(df, column))
    table = table.select(F.col("v").alias(column), (F.col("low") + (F.col("n") - 1) / 2 + 1).alias("place"))
    return Fitted("quantile_transform", [column], out or f"quantile_transform({column})", state={"n": total}, lookup=table, on=[column])


@builds("quantile_transform")
def _quantile(columns: list[str], s: dict) -> Column:
    return (hit("place") - 0.5) / F.lit(float(s["n"] or 1))


def _sorted(name: str, places, keep, rule) -> None:
    """An operator that learns order statistics: the values at places(n, **params), and keep(n, values, **params) of them."""

    def needs(columns: list[str], **params) -> Need:
        return Need(value=number(columns[0]), places=lambda n: places(n, **params), keep=lambda n, got: keep(n, got, **params))

    declare("numeric", name, lambda columns, s, **params: rule(number(columns[0]), s, **params), needs, all_numeric)


def _quartiles(n: int, got: list, **_) -> dict:
    return dict(zip(("q1", "median", "q3"), order.between(n, got, [0.25, 0.5, 0.75]), strict=True))


def _tails(n: int, limits=(0.05, 0.05)) -> list[int]:
    return [min(n - 1, int(limits[0] * n)), max(0, n - int(limits[1] * n) - 1)] if n else [0, 0]


def _edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _bin(x: Column, s: dict, bins: int = 10) -> Column:
    places = F.lit(0)
    for e in s["edges"][1:-1]:
        places = places + (x >= F.lit(float(e))).cast("int")
    return places.cast("double")


def _outside(x: Column, s: dict, factor: float = 1.5) -> Column:
    spread = factor * ((s["q3"] or 0) - (s["q1"] or 0))
    return F.coalesce((x < _lit(s["q1"]) - spread) | (x > _lit(s["q3"]) + spread), F.lit(False)).cast("int")


# winsorize: clamp to the order statistics at int(l * n) from below and int(u * n) from above.
_sorted("winsorize", _tails, lambda n, got, **_: {"low": got[0], "high": got[1]}, lambda x, s, **_: F.when(x.isNotNull(), F.least(F.greatest(x, _lit(s["low"])), _lit(s["high"]))))
# robust_scale: (x - median) / (third - first quartile); a zero spread counts as 1.
_sorted("robust_scale", lambda n: order.around(n, [0.25, 0.5, 0.75]), _quartiles, lambda x, s: (x - _lit(s["median"])) / F.lit(_or_one((s["q3"] or 0) - (s["q1"] or 0))))
# bin: number of the quantile bin, from 0; equal edges merge, and values beyond the edges go to the outer bins.
_sorted("bin", lambda n, bins=10: order.around(n, _edges(bins)), lambda n, got, bins=10: {"edges": sorted({e for e in order.between(n, got, _edges(bins)) if e is not None})}, _bin)
# outlier_indicator: 1 beyond factor times the interquartile range, else 0; null is 0.
_sorted("outlier_indicator", lambda n, **_: order.around(n, [0.25, 0.5, 0.75]), _quartiles, _outside)
# missing_indicator: 1 if the value is missing, else 0; any type.
declare("numeric", "missing_indicator", lambda columns, s: F.col(f"`{columns[0]}`").isNull().cast("int"))


def _golden(cost, low: float, high: float, rounds: int = 5, grid: int = 33) -> float:
    """The least point of a function that is asked for many points in one pass; the grid narrows around it."""
    for _ in range(rounds):
        points = [low + (high - low) * i / (grid - 1) for i in range(grid)]
        best = min(range(grid), key=cost(points).__getitem__)
        low, high = points[max(0, best - 1)], points[min(grid - 1, best + 1)]
    return (low + high) / 2


def _power(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _box(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def _exponent(df: DataFrame, x: Column, shape, slope: Callable[[Column], Column]) -> float:
    """The exponent of greatest likelihood, from -5 to 5. Values are counted once, and each round asks for many exponents in one pass over
    the distinct values: half n ln(variance) less (exponent - 1) times the sum of log slopes."""
    v, n = F.col("v"), F.col("n")
    counts = df.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        whole = stats(counts, n=F.sum("n"), mid=F.sum(v * n) / F.sum("n"), s=F.sum(slope(v) * n))

        def cost(points: list[float]) -> list[float]:
            # Deviations from a middle value's image, so that the squares do not cancel.
            far = [shape(v, p) - shape(_lit(whole["mid"]), p) for p in points]
            row = stats(counts, **{f"s{i}": F.sum(d * n) for i, d in enumerate(far)}, **{f"q{i}": F.sum(d * d * n) for i, d in enumerate(far)})
            out = []
            for i, p in enumerate(points):
                variance = row[f"q{i}"] / whole["n"] - (row[f"s{i}"] / whole["n"]) ** 2 if whole["n"] else 0.0
                out.append(whole["n"] / 2 * math.log(variance) - (p - 1) * whole["s"] if variance > 1e-300 else math.inf)
            return out

        return _golden(cost, -5.0, 5.0)
    finally:
        counts.unpersist()


@register("numeric")
def power_transform(df: DataFrame, column: str, out: str | None = None, method: str = "yeo-johnson") -> Fitted:
    """Power transform with the exponent of greatest likelihood, then standardised. Nulls count as the median."""
    x0 = numeric(df, column)
    (median,) = order.quantiles(df, x0, [0.5])
    x = F.coalesce(x0, _lit(median))
    if method == "box-cox":
        low = stats(df, low=F.min(x))["low"]
        if low is None or low <= 0:
            raise OperatorError("box-cox needs positive values")
        shape, slope = _box, F.ln
    elif method == "yeo-johnson":
        shape, slope = _power, lambda v: F.signum(v) * F.log1p(F.abs(v))
    else:
        raise OperatorError(f"unknown method {method!r}")
    lam = _exponent(df, x, shape, slope)
    s = stats(df, mean=F.avg(shape(x, lam)), std=F.stddev_pop(shape(x, lam)))
    return Fitted("power_transform", [column], out or f"power_transform({column})", state=s | {"lambda": lam, "median": median}, params={"method": method})


@builds("power_transform")
def _powered(columns: list[str], s: dict, method: str = "yeo-johnson") -> Column:
    x = F.coalesce(number(columns[0]), _lit(s["median"]))
    return ((_box if method == "box-cox" else _power)(x, s["lambda"]) - _lit(s["mean"])) / F.lit(_or_one(s["std"]))


@register("numeric")
def boxcox(df: DataFrame, column: str, out: str | None = None) -> Fitted:
    """Box-Cox with the exponent of greatest likelihood, after a shift of |min| + 1 if there are values below or at zero."""
    x0 = numeric(df, column)
    s = stats(df, low=F.min(x0), high=F.max(x0))
    if s["low"] is None or s["low"] == s["high"]:
        raise OperatorError("boxcox needs two different values")
    shift = abs(s["low"]) + 1 if s["low"] <= 0 else 0.0
    x = x0 + F.lit(shift)
    lam = _exponent(df, x, _box, F.ln)
    return Fitted("boxcox", [column], out or f"boxcox({column})", state=s | {"lambda": lam, "shift": shift})


@builds("boxcox")
def _boxed(columns: list[str], s: dict) -> Column:
    return _box(number(columns[0]) + F.lit(s["shift"]), s["lambda"])
