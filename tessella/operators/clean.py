"""Cleaning: missing values, outliers, correlated and constant columns. Bounds and fills are fitted once and kept."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import order
from tessella.operators.near import nearest
from tessella.registry import OperatorError, corr, numeric, spread, stats
from tessella.sources.store import Store


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def category_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in but]


def time_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and f.name not in but]


@dataclass
class Imputer:
    """Fill values by column; missing and unseen columns are left alone."""

    fills: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        def one(f: T.StructField) -> Column:
            c = F.col(f"`{f.name}`")
            if f.name not in self.fills or self.fills[f.name] is None:
                return c
            value = F.lit(self.fills[f.name]).cast(f.dataType)
            bad = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
            return F.when(bad, value).otherwise(c).alias(f.name)

        return df.select(*[one(f) for f in df.schema.fields])


def most_frequent(df: DataFrame, column: str) -> Any:
    """The most frequent value; ties: the lowest."""
    row = df.where(F.col(f"`{column}`").isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else None


def fit_imputer(df: DataFrame, numeric_strategy: str = "median", categorical_strategy: str = "most_frequent", columns: list[str] | None = None) -> Imputer:
    """Numbers: mean, median, most_frequent or constant (0). Categories: most_frequent, else 'MISSING'. Empty columns: 0 and 'MISSING'.

    Whole-number columns take fills that fit them: a mean or median between two whole numbers is truncated.
    """
    nums = [c for c in numeric_columns(df) if columns is None or c in columns]
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    fills: dict[str, Any] = {}
    if numeric_strategy == "mean" and nums:
        row = df.agg(*[F.avg(numeric(df, c)).alias(f"m{i}") for i, c in enumerate(nums)]).first()
        fills = {c: row[f"m{i}"] for i, c in enumerate(nums)}
    elif numeric_strategy == "median":
        fills = {c: q[0] for c, q in zip(nums, order.many_quantiles(df, [numeric(df, c) for c in nums], [0.5]), strict=True)}
    elif numeric_strategy == "most_frequent":
        fills = {c: most_frequent(df, c) for c in nums}
    fills = {c: 0.0 if fills.get(c) is None else fills[c] for c in nums}
    for c in cats:
        fills[c] = (most_frequent(df, c) if categorical_strategy == "most_frequent" else None) or "MISSING"
    return Imputer(fills)


#: Searches by cells at most; with more patterns of missing columns, rows that miss something meet all rows in blocks.
SEARCHES = 64
#: Points that ask, and points that give, of a block.
ASK_BLOCK, GIVE_BLOCK = 2000, 20_000


def knn_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """(m0, m1, ..., n): the distinct rows of the columns, as numbers, and how often each is there."""
    return df.select(*[numeric(df, c).alias(f"m{i}") for i, c in enumerate(columns)]).groupBy(*[f"m{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"))


def knn_impute(df: DataFrame, columns: list[str], k: int = 5, donors: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers by the mean of the k nearest rows of all that have the value, weighted by inverse distance.

    The distance is Euclidean over the columns that both rows have, scaled up for those that they do not share; at equal
    distances smaller values come first. Rows that share no column with any other take the mean. Rows stand as distinct points, so
    copies cost nothing. donors: the rows to take values from, as knn_points(); by default those of the table itself.

    Where few columns are missing together, a search in cells runs for each two patterns that occur. With more than SEARCHES of
    them, each point that misses something is compared with every point, in blocks: as many comparisons as the product of both.
    """
    m, names = len(columns), [f"m{i}" for i in range(len(columns))]
    inner = [f"__{i}" for i in range(len(df.columns))]
    table = df.toDF(*inner)
    kinds = dict(zip(df.columns, inner, strict=True))
    table = table.select("*", *[numeric(table, kinds[c]).alias(n) for c, n in zip(columns, names, strict=True)])
    with Store(df.sparkSession) as store:
        shape = F.concat(*[F.col(n).isNull().cast("int").cast("string") for n in names])
        given = store.table((knn_points(df, columns) if donors is None else donors).withColumn("shape", shape), "given")
        asked = given if donors is None else store.table(knn_points(df, columns).withColumn("shape", shape), "asked")
        means = stats(given, **{f"a{i}": F.sum(F.col(n) * F.col("n")) / F.nullif(F.sum(F.when(F.col(n).isNotNull(), F.col("n"))), F.lit(0)) for i, n in enumerate(names)})
        asking, giving = (sorted(r["shape"] for r in t.select("shape").distinct().collect()) for t in (asked, given))
        wanted = [(q, j, p) for q in asking for j in range(m) if q[j] == "1" for p in giving if p[j] == "0" and any(a == b == "0" for a, b in zip(q, p, strict=True))]
        if not wanted:
            filled = [F.coalesce(F.col(n), F.lit(means[f"a{i}"])) for i, n in enumerate(names)]
            return table.select(*[filled[columns.index(c)].alias(c) if c in columns else F.col(i).alias(c) for c, i in kinds.items()])
        fills = _by_cells(asked, given, wanted, names, k) if len(wanted) <= SEARCHES else _by_blocks(asked, given, names, k)
        near = F.array_sort(F.flatten(F.collect_list("near")))
        # At most k rows: a point of several copies counts as often as there is room.
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

        def add(s: Column, e: Column) -> Column:
            take = F.least(e["n"], F.lit(k) - s["seen"])
            w = take / F.greatest(e["d"], F.lit(1e-12))
            return F.struct((s["seen"] + take).alias("seen"), (s["up"] + w * e["v"]).alias("up"), (s["down"] + w).alias("down"))

        value = F.aggregate(near, start, add, lambda s: s["up"] / s["down"])
        found = fills.groupBy("point", "j").agg(value.alias("fill")).groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct("j", "fill"))).alias("fills"))
        found = Store.kept(df.sparkSession).table(found, "fills")
    done = table.withColumn("point", F.to_json(F.array(*names))).join(found, "point", "left")
    filled = [F.coalesce(F.col(n), F.element_at("fills", i), F.lit(means[f"a{i}"])) for i, n in enumerate(names)]
    return done.select(*[filled[columns.index(c)].alias(c) if c in columns else F.col(i).alias(c) for c, i in kinds.items()])


def _by_cells(asked: DataFrame, given: DataFrame, wanted: list[tuple[str, int, str]], names: list[str], k: int) -> DataFrame:
    """(j, point, near): the nearest points that have column j, for each point of a pattern and each pattern of givers."""
    m, parts = len(names), []
    for q, j, p in wanted:
        both = [i for i in range(m) if q[i] == p[i] == "0"]
        ask = asked.where(F.col("shape") == q).select(*[F.col(names[i]).alias(f"x{d}") for d, i in enumerate(both)], F.lit(0.0).alias(f"x{len(both)}"), F.lit(0).cast("long").alias("don"), F.lit(True).alias("ask")).distinct()
        have = given.where(F.col("shape") == p).select(*[F.col(names[i]).alias(f"x{d}") for d, i in enumerate(both)], F.col(names[j]).alias(f"x{len(both)}"), F.col("n").alias("don"), F.lit(False).alias("ask"))
        xs = [f"x{d}" for d in range(len(both) + 1)]
        mixed = ask.unionByName(have).groupBy(*xs).agg(F.sum("don").alias("don"), F.max("ask").alias("ask"))
        got = nearest(mixed, len(xs), {"don": k}, F.col("ask"), carried=1).where(F.element_at(F.array(*xs), len(xs)) == 0)
        scale = F.lit(m / len(both))
        far = F.transform("near_don", lambda s: F.struct((F.sqrt(s["d"] * scale)).alias("d"), F.element_at(s["v"], 1).alias("v"), s["n"].alias("n")))  # noqa: B023
        got = got.select(*[F.col(f"x{d}").alias(names[i]) for d, i in enumerate(both)], far.alias("near"))
        told = asked.where(F.col("shape") == q).select(*names).distinct().join(got, [names[i] for i in both])
        parts.append(told.select(F.lit(j).alias("j"), F.to_json(F.array(*names)).alias("point"), "near"))
    return reduce(DataFrame.unionByName, parts)


def _by_blocks(asked: DataFrame, given: DataFrame, names: list[str], k: int) -> DataFrame:
    """The same from all points, a block of askers and a block of givers at a time; no more than k points of each block are passed on."""
    m = len(names)
    ask = asked.where(F.col("shape").contains("1")).select(*names, F.to_json(F.array(*names)).alias("point")).distinct()
    a, g = max(1, -(-ask.count() // ASK_BLOCK)), max(1, -(-given.count() // GIVE_BLOCK))
    h = F.xxhash64(*names)
    ask = ask.withColumn("a", F.pmod(h, F.lit(a)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    have = given.withColumn("g", F.pmod(h, F.lit(g)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

    def meet(asking, giving):
        import pandas as pd

        x, y, n = asking[names].to_numpy(float), giving[names].to_numpy(float), giving["n"].to_numpy()
        there = ~np.isnan(y)
        out = []
        for i in range(len(x) if len(y) else 0):
            both = there & ~np.isnan(x[i])
            shared = both.sum(axis=1)
            d = np.sqrt(np.where(both, (y - x[i]) ** 2, 0.0).sum(axis=1) * m / np.maximum(shared, 1))
            for j in np.flatnonzero(np.isnan(x[i])).tolist():
                at = np.flatnonzero(there[:, j] & (shared > 0))
                if len(at) > k:
                    at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
                at = at[np.lexsort((y[at, j], d[at]))[:k]]
                if len(at):
                    out.append((j, asking["point"].iloc[i], [{"d": float(d[t]), "v": float(y[t, j]), "n": int(n[t])} for t in at]))
        return pd.DataFrame(out, columns=["j", "point", "near"]).astype({"point": object, "near": object, "j": "int32"})

    return ask.groupBy("a", "g").cogroup(have.groupBy("a", "g")).applyInPandas(meet, "j int, point string, near array<struct<d double, v double, n long>>")


@dataclass
class KnnFill:
    """knn_impute for tables that come after fitting: the fitted table's distinct rows stand in a table at `path`."""

    columns: list[str]
    path: str
    k: int = 5

    @staticmethod
    def fit(df: DataFrame, columns: list[str], k: int = 5) -> KnnFill:
        """Every row that has a value gives it. The table of rows is kept until store.release(); save() copies it."""
        store = Store.kept(df.sparkSession)
        store.table(knn_points(df, columns), "givers")
        return KnnFill(columns, f"{store.root}/0-givers", k)

    def save(self, spark: SparkSession, path: str) -> KnnFill:
        spark.read.parquet(self.path).write.parquet(path)
        return KnnFill(self.columns, path, self.k)

    def transform(self, df: DataFrame) -> DataFrame:
        return knn_impute(df, self.columns, self.k, df.sparkSession.read.parquet(self.path))


@dataclass
class RegressionFill:
    """Fills from linear regressions on the other columns, whose missing numbers are at their means."""

    columns: list[str]
    means: list[float]
    bias: list[float]
    weights: list[list[float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-3) -> RegressionFill:
        """Rounds of ridge regressions of each column on the others, from sums over the table: a round is one aggregate."""
        x = [numeric(df, c) for c in columns]
        m = len(columns)
        row = stats(df, **{f"m{i}": F.avg(v) for i, v in enumerate(x)})
        means = [row[f"m{i}"] or 0.0 for i in range(m)]
        now = RegressionFill(columns, means, list(means), [[0.0] * m for _ in range(m)])
        raw = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])
        for _ in range(rounds):
            flat = raw.select("*", *[c.alias(f"z{i}") for i, c in enumerate(now._values([F.col(f"x{i}") for i in range(m)]))])
            aggs = {}
            for i in range(m):
                have = F.col(f"x{i}").isNotNull()
                aggs[f"n{i}"] = F.count_if(have)
                for a in range(m):
                    aggs[f"s{i}_{a}"] = F.sum(F.when(have, F.col(f"z{a}")))
                    for b in range(a, m):
                        aggs[f"q{i}_{a}_{b}"] = F.sum(F.when(have, F.col(f"z{a}") * F.col(f"z{b}")))
            r = stats(flat, **aggs)
            new = RegressionFill(columns, means, list(now.bias), [list(w) for w in now.weights])
            for i in range(m):
                n, others = r[f"n{i}"], [j for j in range(m) if j != i]
                if not n or not others:
                    continue
                mean = {a: r[f"s{i}_{a}"] / n for a in range(m)}
                cov = lambda a, b: r[f"q{i}_{min(a, b)}_{max(a, b)}"] / n - mean[a] * mean[b]  # noqa: B023, E731
                g = np.array([[cov(a, b) for b in others] for a in others])
                w = np.linalg.solve(g + ridge * (np.trace(g) / len(others) + 1e-12) * np.eye(len(others)), np.array([cov(a, i) for a in others]))
                for j, v in zip(others, w, strict=True):
                    new.weights[i][j] = float(v)
                new.bias[i] = mean[i] - sum(new.weights[i][j] * mean[j] for j in others)
            moved = max(abs(a - b) for a, b in zip(new.bias, now.bias, strict=True))
            now = new
            if moved < 1e-9 * (1 + max(map(abs, means))):
                break
        return now

    def _values(self, x: list[Column]) -> list[Column]:
        m = len(x)
        start = [F.coalesce(v, F.lit(float(a))) for v, a in zip(x, self.means, strict=True)]
        guess = [sum((F.lit(self.weights[i][j]) * start[j] for j in range(m) if j != i and self.weights[i][j]), F.lit(float(self.bias[i]))) for i in range(m)]
        return [F.when(v.isNull(), g).otherwise(v) for v, g in zip(x, guess, strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = dict(zip(self.columns, self._values([numeric(df, c) for c in self.columns]), strict=True))
        return df.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """Fill missing numbers by rounds of ridge regressions of each column on the others."""
    return RegressionFill.fit(df, columns, rounds, ridge).transform(df)


@dataclass
class Bounds:
    """Closed ranges by column; a row stays if each number is null or within its range, or if it is protected."""

    ranges: dict[str, tuple[float | None, float | None]]
    fills: dict[str, float] = field(default_factory=dict)
    protect: tuple[str, Any] | None = None
    strict: bool = False

    def keep(self, df: DataFrame) -> Column:
        ok: Column = F.lit(True)
        for c, (a, b) in self.ranges.items():
            if c not in df.columns or a is None or b is None:
                continue
            x = numeric(df, c)
            if c in self.fills:
                x = F.coalesce(x, F.lit(self.fills[c]))
            ok = ok & F.coalesce((x > a) & (x < b) if self.strict else x.between(a, b), F.lit(True))
        if self.protect and self.protect[0] in df.columns:
            ok = ok | F.coalesce(F.col(f"`{self.protect[0]}`") == F.lit(self.protect[1]), F.lit(False))
        return ok

    def transform(self, df: DataFrame) -> DataFrame:
        return df.where(self.keep(df))

    def clip(self, df: DataFrame) -> DataFrame:
        """Move values to the nearest bound in place of dropping rows."""
        return df.select(*[F.greatest(F.least(numeric(df, c), F.lit(self.ranges[c][1])), F.lit(self.ranges[c][0])).alias(c) if c in self.ranges and self.ranges[c][0] is not None else F.col(f"`{c}`") for c in df.columns])


def minority(df: DataFrame, target: str | None, most: int = 10, ratio: float = 0.1) -> tuple[str, Any] | None:
    """The rarest class, if the target has at most `most` values and it is rarer than `ratio` times the commonest."""
    if not target or target not in df.columns:
        return None
    rows = df.where(F.col(f"`{target}`").isNotNull()).groupBy(target).count().orderBy("count", target).limit(most + 1).collect()
    if not 2 <= len(rows) <= most or rows[0]["count"] / rows[-1]["count"] >= ratio:
        return None
    return target, rows[0][0]


def fit_outliers(df: DataFrame, method: str = "zscore", columns: list[str] | None = None, target: str | None = None, cut: float | None = None) -> Bounds:
    """Bounds by z score (median fills, population deviation, cut 4 under 10,000 rows, else 3) or by interquartile range
    (factor 3 under 10,000 rows, else 1.5). Rows of a rare class are protected. What removes over half of the rows gives way
    to wide quantile bounds, and those, if they keep under four fifths, to a z score of 10; under ten rows nothing goes."""
    columns = columns or numeric_columns(df, (target,) if target else ())
    n = df.count()
    rare = minority(df, target)
    if method == "zscore":
        z = cut if cut is not None else 4.0 if n < 10_000 else 3.0
        found = _zscore(df, columns, z, rare)
    elif method == "iqr":
        k = cut if cut is not None else 3.0 if n < 10_000 else 1.5
        q = dict(zip(columns, order.many_quantiles(df, [numeric(df, c) for c in columns], [0.25, 0.75]), strict=True))
        found = Bounds({c: (None, None) if a is None else (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items()}, protect=rare)
    else:
        raise OperatorError(f"unknown method {method!r}")
    kept = found.transform(df).count()
    if n and kept < n / 2:
        q = dict(zip(columns, order.many_quantiles(df, [numeric(df, c) for c in columns], [0.01, 0.99]), strict=True))
        found = Bounds({c: (None, None) if a is None else (a - 5 * (b - a), b + 5 * (b - a)) for c, (a, b) in q.items()}, protect=rare)
        kept = found.transform(df).count()
        if kept < 0.8 * n:
            found = _zscore(df, columns, 10.0, rare)
            kept = found.transform(df).count()
    return found if kept >= 10 else Bounds({})


def _zscore(df: DataFrame, columns: list[str], z: float, rare: tuple[str, Any] | None) -> Bounds:
    fills = {c: q[0] or 0.0 for c, q in zip(columns, order.many_quantiles(df, [numeric(df, c) for c in columns], [0.5]), strict=True)}
    x = {c: F.coalesce(numeric(df, c), F.lit(fills[c])) for c in columns}
    row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(x.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    ranges = {c: (row[f"m{i}"] - z * row[f"s{i}"], row[f"m{i}"] + z * row[f"s{i}"]) if row[f"s{i}"] else (None, None) for i, c in enumerate(x)}
    return Bounds(ranges, fills, rare, strict=True)


class IsolationForest:
    """Random trees, each grown on at most 256 rows of a bounded sample; the score is 2 ** -(mean depth / usual depth)."""

    def __init__(self, trees: int = 100, rows: int = 256, seed: int = 42):
        self.trees, self.rows, self.seed, self.grown = trees, rows, seed, []

    @staticmethod
    def usual(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def fit(self, sample: np.ndarray) -> IsolationForest:
        draw = np.random.default_rng(self.seed)
        size = min(self.rows, len(sample))
        most = int(np.ceil(np.log2(max(2, size))))
        for _ in range(self.trees):
            # A tree as flat arrays: column (-1: leaf), cut, children, depth with the usual depth of what a leaf holds.
            col, cut, left, right, depth = [], [], [], [], []

            def grow(x: np.ndarray, d: int) -> int:
                me = len(col)
                for a, v in ((col, -1), (cut, 0.0), (left, 0), (right, 0), (depth, d + self.usual(len(x)))):  # noqa: B023
                    a.append(v)
                spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
                if d < most and len(spread):
                    j = int(draw.choice(spread))
                    t = float(draw.uniform(x[:, j].min(), x[:, j].max()))
                    col[me], cut[me] = j, t  # noqa: B023
                    low = x[:, j] < t
                    left[me] = grow(x[low], d + 1)  # noqa: B023
                    right[me] = grow(x[~low], d + 1)  # noqa: B023
                return me

            grow(sample[draw.choice(len(sample), size, replace=False)], 0)
            self.grown.append(tuple(np.array(a) for a in (col, cut, left, right, depth)))
        self.scale = self.usual(size) or 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows go down a tree a level at a time, in blocks that stay near the processor; a leaf leads to itself."""
        trees = []
        for col, cut, left, right, depth in self.grown:
            own, leaf = np.arange(len(col)), col < 0
            below, levels = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1), 0
            at = np.zeros(1, np.int64)
            while not leaf[at].all():
                at, levels = np.unique(below[at]), levels + 1
            trees.append((np.where(leaf, 0, col).astype(np.int64), cut, below.ravel(), depth, levels))
        out, step = np.empty(len(x)), 2048
        for i in range(0, len(x), step):
            part = np.ascontiguousarray(x[i : i + step].T)
            n = part.shape[1]
            flat, place, total = part.ravel(), np.arange(n), np.zeros(n)
            for col, cut, below, depth, levels in trees:
                at, first = np.zeros(n, np.int64), col * n
                for _ in range(levels):
                    at = below.take(2 * at + ~(flat.take(first.take(at) + place) < cut.take(at)))
                total += depth.take(at)
            out[i : i + step] = 2 ** -(total / len(trees) / self.scale)
        return out


@dataclass
class Isolation:
    """A fitted isolation forest, as plain lists: rows that score over the cut are the most isolated."""

    columns: list[str]
    means: list[float]
    trees: list[list[list[float]]]
    usual: float
    cut: float

    @staticmethod
    def fit(df: DataFrame, columns: list[str], contamination: float | None = 0.05, sample_rows: int = 20_000, seed: int = 42, key: list[str] | None = None) -> Isolation | None:
        """Each tree is grown on rows of a bounded sample, by a hash of the key (of the whole row, without one); the cut is the exact
        quantile of the scores of all rows: the share `contamination` scores higher. Without contamination no cut is sought."""
        row = stats(df, **{f"m{i}": F.avg(numeric(df, c)) for i, c in enumerate(columns)})
        means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
        x = [F.coalesce(numeric(df, c), F.lit(a)).alias(f"x{i}") for i, (c, a) in enumerate(zip(columns, means, strict=True))]
        by = [F.col(f"`{c}`") for c in key or df.columns]
        sample = df.select(*x, F.xxhash64(*by).alias("h")).orderBy("h", *[f"x{i}" for i in range(len(x))]).limit(sample_rows).drop("h").toPandas().to_numpy(float)
        if not len(sample):
            return None
        forest = IsolationForest(seed=seed).fit(sample)
        found = Isolation(columns, means, [[a.tolist() for a in t] for t in forest.grown], float(forest.scale), 1.0)
        if contamination is None:
            return found
        found.cut = float(order.quantiles(df, found.scores(df), [1 - contamination])[0])  # type: ignore[arg-type]
        return found

    def scores(self, df: DataFrame) -> Column:
        forest = IsolationForest()
        forest.grown, forest.scale = [tuple(np.array(a) for a in t) for t in self.trees], self.usual
        sent = df.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def score(*cols):
            import pandas as pd

            return pd.Series(sent.value.score(np.column_stack([np.asarray(c, float) for c in cols])))

        return score(*[F.coalesce(numeric(df, c), F.lit(a)) for c, a in zip(self.columns, self.means, strict=True)])

    def transform(self, df: DataFrame) -> DataFrame:
        """Without the rows that score over the cut."""
        return df.withColumn("__isolated", self.scores(df)).where(F.col("__isolated") <= self.cut).drop("__isolated")


def isolation_forest(df: DataFrame, columns: list[str], contamination: float = 0.05, sample_rows: int = 20_000, out: str | None = None, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Drop the share `contamination` of the most isolated rows, or with out, add their score. Trees are grown on a bounded sample."""
    found = Isolation.fit(df, columns, None if out else contamination, sample_rows, seed, key)
    if out:
        return df.withColumn(out, found.scores(df) if found else F.lit(None).cast("double"))
    return found.transform(df) if found else df


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each two columns, nulls skipped by pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return {}
    row = df.agg(*[corr(numeric(df, a), numeric(df, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: (None if row[f"c{i}"] is None or np.isnan(row[f"c{i}"]) else row[f"c{i}"]) for i, p in enumerate(pairs)}


def correlated(df: DataFrame, columns: list[str], cut: float = 0.95) -> list[str]:
    """The later column of each pair beyond the cut."""
    return sorted({b for (_, b), r in correlations(df, columns).items() if r is not None and abs(r) > cut}, key=columns.index)


def low_variance(df: DataFrame, columns: list[str], cut: float = 0.01) -> list[str]:
    """Columns whose population variance is at most the cut."""
    if not columns:
        return []
    row = df.agg(*[F.var_pop(numeric(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (row[f"v{i}"] or 0.0) <= cut]


def replace_infinite(df: DataFrame, value: float = 1e9) -> DataFrame:
    """Infinities become plus or minus a large number."""
    inf = float("inf")
    return df.select(*[F.when(F.col(f"`{f.name}`") == inf, value).when(F.col(f"`{f.name}`") == -inf, -value).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def drop_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null, NaN or infinity in any of the columns."""
    ok: Column = F.lit(True)
    for c in columns:
        x = numeric(df, c)
        ok = ok & x.isNotNull() & (F.abs(x) != float("inf"))
    return df.where(F.coalesce(ok, F.lit(False)))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The fitted columns in their order: missing ones are 0, others go."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts stripped of all but digits, points and signs, and read as numbers."""
    return df.select(*[F.regexp_replace(F.col(f"`{c}`").cast("string"), "[^0-9.\\-]", "").try_cast("double").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[f"n{i}"]])


def drop_identifiers(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop text columns with more distinct values than that share of the rows."""
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cats)]).first()
    return df.drop(*[c for i, c in enumerate(cats) if row["n"] and row[f"d{i}"] > share * row["n"]])


def hash_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """Exactly n rows (or all), the same ones each time."""
    return df.orderBy(spread(*key), *key).limit(n)


