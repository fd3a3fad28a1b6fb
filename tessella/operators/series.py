"""Ordered operators. Each takes order_by (with enough columns to break ties) and, for many series in a table, partition_by.

Without partition_by the table is one series. The rows of a column operator then meet in one task, as any window over a whole table
does, so a large table should name the columns that tell its series apart. Tests over one series go by chunks of it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.operators import order
from tessella.operators.datetimes import micros, moment
from tessella.registry import Fitted, Need, OperatorError, all_numeric, builds, corr, declare, number, numeric, register
from tessella.sources.store import Store


def _names(x: list[str] | str | None) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def spec(order_by: list[str] | str | None, partition_by: list[str] | str | None = None) -> WindowSpec:
    if not order_by:
        raise OperatorError("an ordered operator needs order_by")
    return Window.partitionBy(*_names(partition_by)).orderBy(*_names(order_by))


def _chunks(rows: DataFrame, y: Column, order_by: list[str] | str, reach: int, store: Store, n: int) -> tuple[DataFrame, WindowSpec]:
    """(y, own) of one series of n rows, and the window of its chunks, of order.RANGE rows each. A chunk has the `reach` rows before it
    besides, which are not its own, so that what an own row sees so far back is what it sees in the whole series."""
    spec(order_by)  # a missing order raises here
    sort, size = _names(order_by), max(order.RANGE, reach, 1)
    placed = rows.repartitionByRange(math.ceil(n / size) + 1, *sort).sortWithinPartitions(*sort)
    # Ids have the range in their high bits and the row's place in it in the low ones; stored, so that counts and rows see the same.
    ids = store.table(placed.select(y.alias("y"), F.monotonically_increasing_id().alias("id")), "sorted")
    ids = ids.select("y", F.shiftright("id", 33).cast("int").alias("b"), F.col("id").bitwiseAND(2**33 - 1).alias("i"))
    start, offsets = 0, []
    for r in ids.groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect():
        offsets.append((r.b, start))
        start += r.n
    before = rows.sparkSession.createDataFrame(offsets, "b int, start long")  # a row for each range
    p = ids.join(F.broadcast(before), "b").select("y", (F.col("start") + F.col("i")).alias("p"))
    c = F.floor(F.col("p") / size)
    there = F.when(F.col("p") % size >= size - reach, F.array(c, c + 1)).otherwise(F.array(c))
    return p.select("y", "p", c.alias("c"), F.explode(there).alias("chunk")).select("y", "p", "chunk", (F.col("c") == F.col("chunk")).alias("own")), Window.partitionBy("chunk").orderBy("p")


def _op(name: str, rule) -> None:
    def build(columns: list[str], s: dict, order_by=None, partition_by=None, **params) -> Column:
        return rule(number(columns[0]), spec(order_by, partition_by), **params)

    def needs(columns: list[str], order_by=None, partition_by=None, **params) -> Need:
        build(columns, {}, order_by, partition_by, **params)  # wrong parameters raise here
        return Need()

    declare("series", name, build, needs, all_numeric)


def _trailing(w: WindowSpec, window: int) -> WindowSpec:
    return w.rowsBetween(-(window - 1), 0)


def _median(x: Column, w: WindowSpec, window: int = 3) -> Column:
    v = F.array_sort(F.collect_list(x).over(_trailing(w, window)))  # as long as the window at most
    n = F.size(v)
    return F.when(n > 0, (F.element_at(v, ((n + 1) / 2).cast("int")) + F.element_at(v, (n / 2).cast("int") + 1)) / 2)


def _ema(x: Column, w: WindowSpec, alpha: float = 0.3) -> Column:
    """y = (1 - alpha) y + alpha x. The weights of rows further back than the frame are below double precision."""
    if not 0 < alpha < 1:
        raise OperatorError("alpha must be between 0 and 1")
    reach = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    # A null decays what was before by its place; places are kept by structs, which collect_list does not drop.
    frame = F.collect_list(F.struct(x.alias("x"))).over(w.rowsBetween(-reach, 0))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("o"))

    def fold(s: Column, r: Column) -> Column:
        v = r["x"]
        # o is the weight that the past still has: (1 - alpha) to the number of rows since the last value
        old = s["o"] * (1 - alpha)
        y = F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise((s["y"] * old + v * alpha) / (old + alpha))
        o = F.when(v.isNull(), old).otherwise(F.lit(1.0))
        return F.struct(y.alias("y"), o.alias("o"))

    return F.aggregate(frame, start, fold)["y"]


_op("lag", lambda x, w, periods=1: F.lag(x, periods).over(w))
_op("rolling_mean", lambda x, w, window=3: F.avg(x).over(_trailing(w, window)))
_op("rolling_std", lambda x, w, window=3: F.stddev_samp(x).over(_trailing(w, window)))
_op("rolling_min", lambda x, w, window=3: F.min(x).over(_trailing(w, window)))
_op("rolling_max", lambda x, w, window=3: F.max(x).over(_trailing(w, window)))
_op("rolling_median", _median)
_op("exponential_moving_average", _ema)
_op("differencing", lambda x, w, periods=1: x - F.lag(x, periods).over(w))


def _trend(x: Column, w: WindowSpec, window: int = 7) -> Column:
    return F.avg(x).over(w.rowsBetween(-(window // 2), window - window // 2 - 1))


_op("decompose_trend", _trend)
_op("decompose_seasonal", lambda x, w, window=7: x - _trend(x, w, window))
_op("rolling_mean_full", lambda x, w, window=3, shift=0: F.when(F.count(x).over(w.rowsBetween(-(shift + window - 1), -shift)) == window, F.avg(x).over(w.rowsBetween(-(shift + window - 1), -shift))))
_op("rolling_std_full", lambda x, w, window=3, shift=0: F.when(F.count(x).over(w.rowsBetween(-(shift + window - 1), -shift)) == window, F.stddev_samp(x).over(w.rowsBetween(-(shift + window - 1), -shift))))
_op("forward_fill", lambda x, w: F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _is_dated(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        moment(df, c)


def _fourier(columns: list[str], s: dict, date_column: str | None = None, period: float = 365.0, n_harmonics: int = 1, wave: str = "sin", harmonic: int = 1, order_by=None, partition_by=None) -> Column:
    t = micros(F.col(f"`{date_column}`").try_cast("timestamp_ntz")) / F.lit(86_400e6) if date_column else F.row_number().over(spec(order_by, partition_by)) - 1
    return {"sin": F.sin, "cos": F.cos}[wave](F.lit(2 * math.pi * harmonic / period) * t)


@register("series")
def fourier_features(df: DataFrame, column: str | None = None, date_column: str | None = None, out: str | None = None, period: float = 365.0, n_harmonics: int = 1, wave: str = "sin", harmonic: int = 1, order_by=None, partition_by=None) -> Fitted:
    """Wave of the time in days, or of the row number where there is no date column. harmonic and wave choose among the
    columns that fourier() makes; the default is the first sine."""
    if harmonic > n_harmonics:
        raise OperatorError("there are not as many harmonics")
    _is_dated(df, [date_column] if date_column else [])
    params = {"date_column": date_column, "period": period, "n_harmonics": n_harmonics, "wave": wave, "harmonic": harmonic, "order_by": order_by, "partition_by": partition_by}
    return Fitted("fourier_features", [c for c in (column,) if c], out or f"fourier_{wave}{harmonic}", params=params)


builds("fourier_features")(_fourier)


@register("series")
def autocorrelation(df: DataFrame, column: str, out: str | None = None, lag: int = 1, order_by=None, partition_by=None) -> Fitted:
    """Correlation of the non-null values with those `lag` places before, for every row; null for too few."""
    x = numeric(df, column)
    rows = df.where(x.isNotNull())

    def told(pairs: DataFrame):
        return pairs.agg(corr("x", "y").alias("r"), F.count("y").alias("n")).first()

    if partition_by:
        row = told(rows.select(x.alias("x"), F.lag(x, lag).over(spec(order_by, partition_by)).alias("y")))
    else:  # the pairs are the same backwards
        with Store(df.sparkSession) as store:
            series, w = _chunks(rows, x, order_by, abs(lag), store, rows.count())
            row = told(series.select(F.col("y").alias("x"), F.lag("y", abs(lag)).over(w).alias("y"), "own").where("own"))
    value = row.r if row.n > 1 and row.r is not None and not math.isnan(row.r) else None
    return Fitted("autocorrelation", [column], out or f"autocorrelation({column})", state={"r": value})


builds("autocorrelation")(lambda columns, s: F.lit(s["r"]).cast("double"))


# The published regression of the unit-root statistic's distribution (with a constant) on the normal scale.
TAU_SPLIT, TAU_LOW, TAU_HIGH = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(statistic: float) -> float:
    """The approximate p value of the Dickey-Fuller statistic with a constant."""
    if statistic > TAU_HIGH:
        return 1.0
    if statistic < TAU_LOW:
        return 0.0
    z = sum(c * statistic**i for i, c in enumerate(TAU_SMALL if statistic <= TAU_SPLIT else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _moments(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """Rows, and the matrix of mean products of the columns less their means, from one pass."""
    wanted = {f"c{i}_{j}": F.covar_pop(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i}
    r = rows.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in wanted.items()]).first()
    return r["n"], np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])


def _regressed(n: int, m: np.ndarray) -> tuple[float, float] | None:
    """(sum of squared residuals, t value of the second column's coefficient) of the first column on the others and a constant."""
    k = len(m) - 1
    x, xy = m[1:, 1:], m[1:, 0]
    if n <= k + 1 or np.linalg.matrix_rank(x) < k:
        return None
    inverse = np.linalg.inv(x)
    b = inverse @ xy
    left = max(0.0, m[0, 0] - b @ xy) * n
    error = math.sqrt(left / (n - k - 1) * inverse[0, 0] / n)
    return float(left), float(b[0] / error) if error else -math.inf


def dickey_fuller(df: DataFrame, column: str, order_by, lags: int | None = 0, most: int | None = None) -> dict[str, float | None]:
    """The Dickey-Fuller test with a constant: the t value of y[t-1] in dy = a + b y[t-1] + differences before, from one pass of sums.

    lags: how many differences before are taken; None chooses the number up to `most` (by default 12 (n / 100) ** 0.25) that has the
    least AIC over the rows that all numbers of lags have. Rows without a value are left out; too few rows, or a constant series,
    give nulls.
    """
    y, rows = numeric(df, column), df.where(numeric(df, column).isNotNull())
    n = rows.count()
    top = lags if lags is not None else min(math.ceil(12 * (n / 100) ** 0.25) if most is None else most, max(0, n // 2 - 2))
    with Store(df.sparkSession) as store:
        series, w = _chunks(rows, y, order_by, top + 1, store, n)
        whole = series.select("p", "chunk", "own", F.lag("y").over(w).alias("x"), (F.col("y") - F.lag("y").over(w)).alias("d0"))
        told = whole.select("own", "x", "d0", *[F.lag("d0", i).over(w).alias(f"d{i}") for i in range(1, top + 1)]).where("own")
        names = ["d0", "x", *(f"d{i}" for i in range(1, top + 1))]
        n, m = _moments(told.where(F.col(names[-1] if top else "x").isNotNull()), names)
        best = top
        if lags is None and n > 3:
            scores = {}
            for k in range(top + 1):
                got = _regressed(n, m[: k + 2, : k + 2])
                if got and got[0] > 0:
                    scores[k] = n * math.log(got[0] / n) + 2 * (k + 2)
            best = min(scores, key=lambda k: (scores[k], k), default=top)
            if best < top:  # on all rows that it has
                n, m = _moments(told.where(F.col(f"d{best}" if best else "x").isNotNull()), names[: best + 2])
    found = _regressed(n, m[: best + 2, : best + 2]) if n >= 4 else None
    if found is None:
        return {"statistic": None, "stationary": None, "lags": best, "p_value": None}
    return {"statistic": found[1], "stationary": found[1] < -2.86, "lags": best, "p_value": unit_root_p(found[1])}  # the 5% point with a constant
