"""Exact ranks, order statistics and quantiles without a sort of the table in one task.

Values are counted first, so copies meet before any shuffle, and several columns are counted in one pass. Up to RANGE distinct
values are ordered together. Beyond that, ranks are worked out in as many ranges of the values as hold about RANGE each, and
order statistics by cutting the value range, keeping the part that holds the wanted place, and cutting that again.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that are ordered in one task, about.
RANGE = 1_000_000
#: Parts into which a value range is cut at once.
CUTS = 256


def _counts(df: DataFrame, values: list[Column]) -> DataFrame:
    """(c, v, n): the number of the column, its distinct non-null values and their rows."""
    if len(values) == 1:
        stacked = df.select(F.lit(0).alias("c"), values[0].alias("v"))
    else:
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in enumerate(values)])).alias("s")).select("s.*")
    return stacked.where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))


def _running(w) -> Column:
    """The rows below each value of a window."""
    return F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")


def ranks(df: DataFrame, value: Column) -> tuple[DataFrame, int]:
    """(v, n, low, code): each distinct value, its rows, the rows below it, and its place among the values from 0; and the
    number of non-null rows."""
    counts = _counts(df, [value]).select("v", "n")
    size = counts.agg(F.count("*").alias("d"), F.sum("n").alias("n")).first()
    if size["d"] <= RANGE:
        w = Window.partitionBy(F.lit(0)).orderBy("v")
        return counts.select("v", "n", _running(w).cast("long").alias("low"), (F.row_number().over(w) - 1).cast("long").alias("code")), size["n"] or 0
    # Ranges of a sample are kept, so that the sums and the ranks see the same ones.
    ranged = counts.repartitionByRange(ceil(size["d"] / RANGE) + 1, "v").withColumn("b", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    offsets, rows, values = [], 0, 0
    for r in ranged.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("d")).orderBy("b").collect():
        offsets.append((r.b, rows, values))
        rows, values = rows + r.n, values + r.d
    before = df.sparkSession.createDataFrame(offsets, "b int, rows long, vals long")  # a row for each range
    w = Window.partitionBy("b").orderBy("v")
    out = ranged.join(F.broadcast(before), "b").select("v", "n", (F.col("rows") + _running(w)).cast("long").alias("low"), (F.col("vals") + F.row_number().over(w) - 1).cast("long").alias("code"))
    return out, rows


def _place(cuts: list[Column], low: int, high: int) -> Column:
    """How many of the sorted cuts are at or below the value: a tree of comparisons, of which a value meets a few."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(F.col("v") < cuts[mid], _place(cuts, low, mid)).otherwise(_place(cuts, mid + 1, high))


def _narrow(counts: DataFrame, offset: int, wanted: list[int], found: dict[int, Any]) -> None:
    """Put the values at the wanted places into found. offset: the rows below all of the counts."""
    kind = counts.schema["v"].dataType
    cuts = sorted(r.v for r in counts.orderBy(F.xxhash64("v"), "v").limit(CUTS - 1).select("v").collect())
    parts = counts.withColumn("b", _place([F.lit(c).cast(kind) for c in cuts], 0, len(cuts)))
    near: dict[int, tuple[int, int, list[int]]] = {}
    for r in parts.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("d")).orderBy("b").collect():
        if mine := [p for p in wanted if offset <= p < offset + r.n]:
            near[r.b] = offset, r.d, mine
        offset += r.n
    for b, (start, d, mine) in near.items():
        inside = parts.where(F.col("b") == b).select("v", "n")
        if d > RANGE:
            _narrow(inside, start, mine, found)
        else:
            _pick(inside.withColumn("c", F.lit(0)), {0: [p - start for p in mine]}, lambda c, p, v, start=start: found.__setitem__(p + start, v))


def _pick(counts: DataFrame, wanted: dict[int, list[int]], put: Callable[[int, int, Any], None]) -> None:
    """Give put() the values at the wanted places of each column; a column's values are ordered together."""
    places = F.create_map(*[x for c, ps in wanted.items() for x in (F.lit(c), F.array(*[F.lit(p).cast("long") for p in sorted(set(ps))]))])
    low = counts.where(F.col("c").isin(list(wanted))).withColumn("low", _running(Window.partitionBy("c").orderBy("v")))
    for r in low.withColumn("p", F.explode(F.element_at(places, F.col("c")))).where("p >= low and p < low + n").select("c", "p", "v").collect():
        put(r.c, r.p, r.v)


def many_ranks(counts: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(c, v, n, low, code): ranks() for the values of several columns at once, from their counts (c, v, n).

    Columns of any size are worked out together, in as many ranges of (c, v) as hold about RANGE values each. The ranges must
    stay as they are: keep(table, name) stores them, else they are cached.
    """
    total = counts.count()
    if total <= RANGE:
        w = Window.partitionBy("c").orderBy("v")
        return counts.select("c", "v", "n", _running(w).cast("long").alias("low"), (F.row_number().over(w) - 1).cast("long").alias("code"))
    ranged = counts.repartitionByRange(ceil(total / RANGE) + 1, "c", "v").withColumn("b", F.spark_partition_id())
    ranged = keep(ranged, "ranges") if keep else ranged.persist(StorageLevel.MEMORY_AND_DISK)
    below: dict[int, tuple[int, int]] = {}
    offsets = []
    for r in ranged.groupBy("b", "c").agg(F.sum("n").alias("n"), F.count("*").alias("d")).orderBy("b", "c").collect():
        rows, values = below.get(r.c, (0, 0))
        offsets.append((r.b, r.c, rows, values))
        below[r.c] = rows + r.n, values + r.d
    before = counts.sparkSession.createDataFrame(offsets, "b int, c int, rows long, vals long")  # a row for each range and column
    w = Window.partitionBy("b", "c").orderBy("v")
    found = ranged.join(F.broadcast(before), ["b", "c"])
    return found.select("c", "v", "n", (F.col("rows") + _running(w)).cast("long").alias("low"), (F.col("vals") + F.row_number().over(w) - 1).cast("long").alias("code"))


def many_order_statistics(df: DataFrame, values: list[Column], places: Callable[[int], list[int]] | list[Callable[[int], list[int]]]) -> list[tuple[int, list]]:
    """For each column its number of non-null rows, and the values at places(that number) of its sorted non-null values; nulls
    where there are none. places: one function for all columns, or one for each."""
    if not values:
        return []
    places = places if isinstance(places, list) else [places] * len(values)
    counts = _counts(df, values).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r.c: (r.d, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
        wanted = {c: places[c](n) for c, (_, n) in sizes.items()}
        found: dict[int, dict[int, Any]] = {c: {} for c in sizes}
        if small := {c: p for c, p in wanted.items() if sizes[c][0] <= RANGE and p}:
            _pick(counts, small, lambda c, p, v: found[c].__setitem__(p, v))
        for c, p in wanted.items():
            if c not in small and p:
                _narrow(counts.where(F.col("c") == c).select("v", "n"), 0, p, found[c])
        return [(sizes[c][1], [found[c][p] for p in wanted[c]]) if c in sizes else (0, [None] * len(places[c](0))) for c in range(len(values))]
    finally:
        counts.unpersist()


def order_statistics(df: DataFrame, value: Column, places) -> list:
    """The values at places 0, 1, ... of the sorted non-null values. places: a list, or a function of the number of rows."""
    return many_order_statistics(df, [value], places if callable(places) else lambda n: list(places))[0][1]


def many_quantiles(df: DataFrame, values: list[Column], at: list[float]) -> list[list[float | None]]:
    """Exact quantiles of several columns, in one pass, with linear interpolation; nulls for no rows."""

    return [between(n, got, at) for n, got in many_order_statistics(df, values, lambda n: around(n, at))]


def around(n: int, at: list[float]) -> list[int]:
    """The places of n sorted values between which the quantiles lie, two for each."""
    return [p for q in at for p in (floor(q * (n - 1)), ceil(q * (n - 1)))] if n else [0] * (2 * len(at))


def between(n: int, got: list, at: list[float]) -> list[float | None]:
    """The quantiles from the values at these places."""
    out: list[float | None] = []
    for i, q in enumerate(at):
        a, b, x = got[2 * i], got[2 * i + 1], q * (n - 1)
        out.append(None if a is None else a + (b - a) * (x - floor(x)))
    return out


def quantiles(df: DataFrame, value: Column, at: list[float]) -> list[float | None]:
    """Exact quantiles of one column: see many_quantiles."""
    return many_quantiles(df, [value], at)[0]
