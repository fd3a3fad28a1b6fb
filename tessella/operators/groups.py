"""Group aggregates that come back to the rows, and column pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.registry import Need, OperatorError, corr, declare, hit, number, numeric, stats

AGGS = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp, "sum": F.sum}


def _op(name: str) -> None:
    """Aggregate of a column in the row's group; a null or unseen group gets the column's mean."""

    def needs(columns: list[str]) -> Need:
        x = number(columns[0])
        return Need({"mean": F.avg(x)}, key=F.col(f"`{columns[1]}`").cast("string"), by={"a": AGGS[name](x).cast("double")})

    declare("group", f"group_{name}", lambda columns, s: F.coalesce(hit("a"), F.lit(s["mean"]).cast("double")), needs, lambda df, columns: numeric(df, columns[0]), ("column", "by"), lambda columns: f"{columns[0]}_by_{columns[1]}_{name}")


for _name in AGGS:
    _op(_name)


def entity_aggregates(df: DataFrame, entity: str, columns: list[str], aggs: tuple[str, ...] = ("mean", "std", "min", "max", "count")) -> DataFrame:
    """Add column_agg for each column and aggregate of the row's entity, and column_diff_from_mean. Null entities get nulls.

    The aggregates meet in partial sums before the shuffle; the join back may be split where an entity is hot.
    """
    table = df.where(F.col(f"`{entity}`").isNotNull()).groupBy(F.col(f"`{entity}`").alias("__e")).agg(*[AGGS[a](numeric(df, c)).alias(f"{c}_{a}") for c in columns for a in aggs])
    joined = df.join(table, df[f"`{entity}`"] == table["__e"], "left").drop("__e")
    if "mean" in aggs:
        joined = joined.select("*", *[(numeric(df, c) - F.col(f"`{c}_mean`")).alias(f"{c}_diff_from_mean") for c in columns])
    return joined


def pair_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """A product for each two columns, named `interaction_a b`."""
    made = [(numeric(df, a) * numeric(df, b)).alias(f"interaction_{a} {b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.select("*", *made)


def full_polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and products of the columns."""
    made = [(numeric(df, a) * numeric(df, b)).alias(f"{a}^2" if a == b else f"{a} {b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.select("*", *made)


def arithmetic_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a*b, a/b, b/a, a-b and a+b for each two columns; a quotient by zero is null."""
    made = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = numeric(df, a), numeric(df, b)
            made += [(x * y).alias(f"{a}_mul_{b}"), F.try_divide(x, y).alias(f"{a}_div_{b}"), F.try_divide(y, x).alias(f"{b}_div_{a}"), (x - y).alias(f"{a}_sub_{b}"), (x + y).alias(f"{a}_add_{b}")]
    return df.select("*", *made)


def partners(df: DataFrame, column: str, candidates: list[str], target: str | None = None, most: int = 5) -> list[str]:
    """The candidates of the largest absolute correlation with the target (or the column), ties in given order."""
    base = numeric(df, target or column)
    row = stats(df, **{f"c{i}": corr(numeric(df, c), base) for i, c in enumerate(candidates)})
    order = sorted(range(len(candidates)), key=lambda i: -abs(row[f"c{i}"] or 0))
    return [candidates[i] for i in order if candidates[i] != column][:most]


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def combine(conditions: list) -> object:
    """Conjunction of conditions; none is true."""
    if not conditions:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conditions)


__all__ = ["AGGS", "OperatorError", "arithmetic_pairs", "combine", "drop_duplicates", "entity_aggregates", "full_polynomial", "pair_products", "partners"]
