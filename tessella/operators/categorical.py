"""Categorical operators: what a category maps to is a table, joined on the category; null has a rule of its own each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.registry import Need, OperatorError, declare, hit, number, numeric

MISSING = "missing"


def _text(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


# one_hot_encode: true where the category is `value`, by default the lowest; null is false. one_hot() makes all columns.
declare("categorical", "one_hot_encode", lambda columns, s, value=None: F.coalesce(_text(columns[0]) == F.lit(s["value"] if value is None else value), F.lit(False)), lambda columns, **_: Need({"value": F.min(_text(columns[0]))}))


def one_hot(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """A boolean column for each category, named column_value; more than `most` categories raise."""
    values = [r[0] for r in df.select(_text(column).alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()]
    if len(values) > most:
        raise OperatorError(f"{column!r} has more than {most} categories")
    return df.select("*", *[F.coalesce(_text(column) == v, F.lit(False)).alias(f"{column}_{v}") for v in values])


def _two(df: DataFrame, columns: list[str]) -> None:
    numeric(df, columns[1])


def _event(column: str, event: float) -> Column:
    y = number(column)
    return F.when(y == F.lit(float(event)), 1).when(y.isNotNull(), 0)


def _smoothed(columns: list[str], s: dict, smoothing: float = 10.0) -> Column:
    mean = s["mean"]
    return F.coalesce((F.coalesce(hit("total"), F.lit(0.0)) + F.lit(smoothing * (mean or 0))) / F.nullif(hit("n") + F.lit(float(smoothing)), F.lit(0.0)), F.lit(mean).cast("double"))


def _or_mean(columns: list[str], s: dict) -> Column:
    return F.coalesce(hit("m"), F.lit(s["mean"]).cast("double"))


def _evidence(columns: list[str], s: dict, event: float = 1.0) -> Column:
    def share(c: Column, total: float | None) -> Column:
        return F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), c / F.lit(float(total or 1))))

    return F.coalesce(F.ln(share(hit("e"), s["events"]) / share(hit("r"), s["rest"])), F.lit(0.0))


def _hashed(columns: list[str], s: dict, n_features: int = 8) -> Column:
    h = F.md5(F.coalesce(_text(columns[0]), F.lit("nan")))
    # Hex digits in groups of six keep the running remainder within a long.
    acc = F.lit(0).cast("long")
    for a, n in [(1, 6), (7, 6), (13, 6), (19, 6), (25, 6), (31, 2)]:
        acc = (acc * (16**n) + F.conv(F.substring(h, a, n), 16, 10).cast("long")) % n_features
    return acc


def _of_target(columns: list[str], **_) -> Need:
    y = number(columns[1])
    return Need({"mean": F.avg(y)}, key=_text(columns[0]), by={"n": F.count(y), "total": F.sum(y), "m": F.avg(y)})


def _of_events(columns: list[str], event: float = 1.0) -> Need:
    is_event = _event(columns[1], event)
    return Need({"events": F.sum(is_event), "rest": F.sum(1 - is_event)}, key=_text(columns[0]), by={"e": F.sum(is_event), "r": F.sum(1 - is_event)})


# label_encode: place of the category in sort order, from 0; null counts as the category 'missing'.
declare("categorical", "label_encode", lambda columns, s: hit("code"), lambda columns: Need(key=F.coalesce(_text(columns[0]), F.lit(MISSING)), code=True))
# target_encode: (n * category mean + smoothing * mean) / (n + smoothing); null and unseen categories get the mean.
declare("categorical", "target_encode", _smoothed, _of_target, _two, ("column", "target"))
# target_encode_raw: mean of the target in the category, unsmoothed; null and unseen categories get the mean.
declare("categorical", "target_encode_raw", _or_mean, _of_target, _two, ("column", "target"))
# count_encode: rows of the category; null stays null.
declare("categorical", "count_encode", lambda columns, s: hit("n"), lambda columns: Need(key=_text(columns[0]), by={"n": F.count("*")}))
# frequency_encode: share of the category in all rows, or in the non-null ones; null stays null.
declare(
    "categorical", "frequency_encode", lambda columns, s, of_all=True: hit("n") / F.lit(float((s["rows"] if of_all else s["filled"]) or 1)),
    lambda columns, **_: Need({"rows": F.count("*"), "filled": F.count(_text(columns[0]))}, key=_text(columns[0]), by={"n": F.count("*")}),
)
# mean_encode: mean of another column in the category; null gets the mean of all.
declare("categorical", "mean_encode", _or_mean, _of_target, _two, ("column", "numeric_column"))
# hash_encode: the MD5 of the text, as a number, modulo n_features. Null counts as the text 'nan'.
declare("categorical", "hash_encode", _hashed)
# weight_of_evidence: ln of the category's share of events over its share of the rest, shares clipped to 1e-10; null and unseen give 0.
declare("categorical", "weight_of_evidence", _evidence, _of_events, _two, ("column", "target"))


def fold_rare(df: DataFrame, column: str, top: int = 19, other: str = "Other", out: str | None = None) -> DataFrame:
    """Keep the `top` most frequent categories (ties: lowest first); the rest and nulls become `other`."""
    kept = [r[0] for r in df.select(_text(column).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(top).collect()]
    return df.withColumn(out or column, F.when(_text(column).isin(kept), _text(column)).otherwise(F.lit(other)) if kept else F.lit(other))
