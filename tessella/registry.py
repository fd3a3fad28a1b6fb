"""Registry of column operators.

A declared operator says what it must know of a table (Need), and makes its column from that (build). So many operators are fitted
together in a fixed number of passes, what they learn is plain state (numbers as JSON, tables of categories as Parquet), and
an operator comes back from its name, columns, parameters and state alone. An operator may also be a function
fit(df, column, **params) -> Fitted, registered with register(); it fits by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("numeric", "categorical", "datetime", "text", "series", "interaction", "group")
#: The struct of what was looked up for a row; null where its key is unknown.
HIT = "__hit"


class OperatorError(ValueError):
    """An operator cannot be applied: unknown name, missing column, or a column of the wrong type."""


@dataclass
class Need:
    """What an operator learns from a table.

    aggs: aggregates over all rows. value, places, keep: the values at places(n) of the n sorted non-null values, and the state
    that keep(n, values) makes of them. key, by, code: a table with a row for each key, its aggregates by name and, with
    code, the key's place in order.
    """

    aggs: dict[str, Column] = field(default_factory=dict)
    value: Column | None = None
    places: Callable[[int], list[int]] | None = None
    keep: Callable[[int, list], dict[str, Any]] | None = None
    key: Column | None = None
    by: dict[str, Column] = field(default_factory=dict)
    code: bool = False


@dataclass
class Fitted:
    """A fitted operator. build makes the new column (by default from the operator's declaration); lookup, if there, is a table
    whose columns `on` are matched with the row's key, and whose other columns build finds by hit()."""

    op: str
    columns: list[str]
    out: str
    build: Callable[[], Column] | None = None
    state: dict[str, Any] = field(default_factory=dict)
    lookup: DataFrame | None = None
    on: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)

    def column(self) -> Column:
        if self.build is not None:
            return self.build()
        if self.op not in _builders:
            raise OperatorError(f"{self.op!r} cannot be built from its state")
        return _builders[self.op](self.columns, self.state, **self.params)

    def keys(self) -> list[Column]:
        if self.on:
            return [F.col(f"`{c}`") for c in self.on]
        return [_declared[self.op].needs(self.columns, **self.params).key]  # type: ignore[list-item]

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with the new column; one of that name is replaced."""
        for c in self.columns:
            if c not in df.columns:
                raise OperatorError(f"no column {c!r}")
        keep = [c for c in df.columns if c.lower() != self.out.lower()]
        if self.lookup is None:
            return df.select(*[F.col(f"`{c}`") for c in keep], self.column().alias(self.out))
        keys = self.keys()
        names = [c for c in self.lookup.columns if c not in (self.on or ["key"])]
        there = self.on or ["key"]
        table = self.lookup.select(*[F.col(f"`{c}`").alias(f"__key{i}") for i, c in enumerate(there)], F.struct(*[F.col(f"`{c}`") for c in names]).alias(HIT))
        mine = df.select("*", *[k.alias(f"__mine{i}") for i, k in enumerate(keys)])
        match = [F.col(f"__mine{i}") == F.col(f"__key{i}") for i in range(len(keys))]
        return mine.join(table, match, "left").select(*[F.col(f"`{c}`") for c in keep], self.column().alias(self.out))


def hit(name: str) -> Column:
    """A looked-up value of the row."""
    return F.col(HIT)[name]


@dataclass(frozen=True)
class _Declared:
    needs: Callable[..., Need]
    check: Callable[[DataFrame, list[str]], Any]
    named: tuple[str, ...]
    label: Callable[..., str]


_ops: dict[str, tuple[str, Callable[..., Fitted]]] = {}
_declared: dict[str, _Declared] = {}
_builders: dict[str, Callable[..., Column]] = {}


def register(category: str, name: str | None = None) -> Callable:
    """Decorator for fit functions; users add their own operators with it."""
    if category not in CATEGORIES:
        raise OperatorError(f"unknown category {category!r}")

    def add(fit: Callable[..., Fitted]) -> Callable[..., Fitted]:
        _ops[name or fit.__name__] = (category, fit)
        return fit

    return add


def builds(name: str) -> Callable:
    """Decorator for build(columns, state, **params) -> Column of a registered fit function: its operators can then be saved."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        _builders[name] = build
        return build

    return add


def declare(category: str, name: str, build: Callable[..., Column], needs: Callable[..., Need] | None = None, check: Callable[[DataFrame, list[str]], Any] | None = None, named: tuple[str, ...] = ("column",), label: Callable[..., str] | None = None) -> None:
    """Register an operator by what it needs, needs(columns, **params) -> Need, and build(columns, state, **params) -> Column.

    named: the names of its columns, in order; check(df, columns) raises where the table does not fit; label names the result."""
    _declared[name] = _Declared(needs or (lambda columns, **_: Need()), check or (lambda df, columns: None), named, label or (lambda columns, **_: f"{name}({columns[0]})"))
    _builders[name] = build

    def fit(df: DataFrame, *columns: str, out: str | None = None, **params: Any) -> Fitted:
        return fit_many(df, [(name, list(columns), out, params)])[0]  # type: ignore[return-value]

    fit.__name__ = name
    register(category, name)(fit)


def _load() -> None:
    """The package's own operators register when their modules are imported."""
    for module in ("numeric", "categorical", "datetimes", "texts", "series", "interactions", "groups"):
        import_module(f"tessella.operators.{module}")


def names(category: str | None = None) -> list[str]:
    _load()
    return [n for n, (c, _) in _ops.items() if category in (None, c)]


def category_of(name: str) -> str:
    _load()
    return _ops[name][0]


def fit(df: DataFrame, op: str, *columns: str, **params: Any) -> Fitted:
    _load()
    if op not in _ops:
        raise OperatorError(f"unknown operator {op!r}")
    for c in columns:
        if c not in df.columns:
            raise OperatorError(f"no column {c!r}")
    return _ops[op][1](df, *columns, **params)


def apply(df: DataFrame, op: str, *columns: str, on_error: str = "raise", **params: Any) -> DataFrame:
    """Fit on a table and transform it. With on_error="skip" a table that the operator cannot take comes back as it is."""
    try:
        return fit(df, op, *columns, **params).transform(df)
    except OperatorError:
        if on_error == "skip":
            return df
        raise


#: An operator, its columns, the name of the result (None: the operator's own) and its parameters.
Step = tuple[str, list[str], str | None, dict[str, Any]]


@dataclass
class Categories:
    """Aggregates of all keys of many operators: a row (c, key, ...) for each key of each column of keys, null keys included."""

    table: DataFrame
    numbers: dict[int, int]  # c by the place of the step
    columns: dict[int, dict[str, str]]  # column by name, by the place of the step


def fit_many(df: DataFrame, steps: Iterable[Step], on_error: str = "raise", keep: Callable[[DataFrame, str], DataFrame] | None = None, beside: dict[str, Column] | None = None) -> list[Fitted | None]:
    """Fit operators on one table: all aggregates in one pass, all order statistics in one, all tables of keys in one.

    Operators that are not declared fit by themselves. With on_error="skip" what cannot be fitted is None. keep(table, name), if
    given, stores the aggregates of keys, so that they are worked out once; `beside` has further aggregates of each key. The
    result's attribute `categories` tells where they stand.
    """
    _load()
    out = _Fits()
    needs: dict[int, Need] = {}
    for i, (op, columns, name, params) in enumerate(steps):
        try:
            if op not in _ops:
                raise OperatorError(f"unknown operator {op!r}")
            if op not in _declared:
                out.append(_ops[op][1](df, *columns, **params, **({"out": name} if name else {})))
                continue
            d, params = _declared[op], dict(params)
            columns = [*columns, *(params.pop(n) for n in d.named[len(columns) :] if n in params)]
            if len(columns) != len(d.named):
                raise OperatorError(f"{op!r} takes the columns {', '.join(d.named)}")
            for c in columns:
                if c not in df.columns:
                    raise OperatorError(f"no column {c!r}")
            d.check(df, columns)
            needs[i] = d.needs(columns, **params)
            out.append(Fitted(op, columns, name or d.label(columns, **params), params=params))
        except OperatorError:
            if on_error != "skip":
                raise
            out.append(None)
    _aggregates(df, needs, out)
    _sorted_values(df, needs, out)
    _tables(df, needs, out, keep, beside or {})
    return out


class _Fits(list):
    categories: Categories | None = None


def _distinct(columns: Iterable[Column]) -> tuple[list[Column], list[int]]:
    """Each different expression once, and the place of every one among them."""
    seen: dict[str, int] = {}
    kept: list[Column] = []
    at = []
    for c in columns:
        if str(c) not in seen:
            seen[str(c)] = len(kept)
            kept.append(c)
        at.append(seen[str(c)])
    return kept, at


def _aggregates(df: DataFrame, needs: dict[int, Need], out: list[Fitted | None]) -> None:
    wanted = [(i, n, c) for i, need in needs.items() for n, c in need.aggs.items()]
    if wanted:
        kept, at = _distinct(c for *_, c in wanted)
        row = stats(df, **{f"a{k}": c for k, c in enumerate(kept)})
        for (i, n, _), k in zip(wanted, at, strict=True):
            out[i].state[n] = row[f"a{k}"]  # type: ignore[union-attr]


def _sorted_values(df: DataFrame, needs: dict[int, Need], out: list[Fitted | None]) -> None:
    from tessella.operators import order

    wanted = [i for i, need in needs.items() if need.value is not None]
    if not wanted:
        return
    kept, at = _distinct(needs[i].value for i in wanted)  # type: ignore[misc]
    mine = [[i for i, k in zip(wanted, at, strict=True) if k == place] for place in range(len(kept))]
    places = [lambda n, who=who: [p for i in who for p in needs[i].places(n)] for who in mine]  # type: ignore[misc]
    for who, (n, found) in zip(mine, order.many_order_statistics(df, kept, places), strict=True):
        left = list(found)
        for i in who:
            size = len(needs[i].places(n))  # type: ignore[misc]
            out[i].state |= needs[i].keep(n, left[:size])  # type: ignore[misc,union-attr]
            left = left[size:]


def _tables(df: DataFrame, needs: dict[int, Need], out: _Fits, keep: Callable[[DataFrame, str], DataFrame] | None, beside: dict[str, Column]) -> None:
    from tessella.operators import order

    wanted = [i for i, need in needs.items() if need.key is not None]
    if not wanted:
        return
    keys, number = _distinct(needs[i].key for i in wanted)  # type: ignore[misc]
    aggs, at = _distinct([c for i in wanted for c in needs[i].by.values()])
    place = iter(at)
    columns = {i: {n: f"a{next(place)}" for n in needs[i].by} for i in wanted}
    numbers = dict(zip(wanted, number, strict=True))
    if len(keys) == 1:
        stacked = df.select("*", F.lit(0).alias("__c"), keys[0].alias("__k"))
    else:
        stacked = df.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), k.alias("k")) for c, k in enumerate(keys)])).alias("__s")).select("*", F.col("__s.c").alias("__c"), F.col("__s.k").alias("__k"))
    first = F.count("*").alias("rows")
    table = stacked.groupBy(F.col("__c").alias("c"), F.col("__k").alias("key")).agg(first, *[c.alias(f"a{k}") for k, c in enumerate(aggs)], *[c.alias(n) for n, c in beside.items()])
    if keep is not None:
        table = keep(table, "categories")
        coded = sorted({numbers[i] for i in wanted if needs[i].code})
        if coded:
            ranked = order.many_ranks(table.where(F.col("key").isNotNull() & F.col("c").isin(coded)).select("c", F.col("key").alias("v"), F.col("rows").alias("n")), keep)
            code = keep(ranked, "codes").select(F.col("c").alias("__c"), F.col("v").alias("__v"), "code")
            table = keep(table.join(code, (F.col("c") == F.col("__c")) & (F.col("key") == F.col("__v")), "left").drop("__c", "__v"), "coded")
        out.categories = Categories(table, numbers, columns)
    for i in wanted:
        f, need = out[i], needs[i]
        mine = table.where((F.col("c") == numbers[i]) & F.col("key").isNotNull())
        if need.code and keep is None:
            ranked, _ = order.ranks(df, need.key)  # type: ignore[arg-type]
            f.lookup = ranked.select(F.col("v").alias("key"), "code")  # type: ignore[union-attr]
            continue
        f.lookup = mine.select("key", *[F.col(a).alias(n) for n, a in columns[i].items()], *(["code"] if need.code else []))  # type: ignore[union-attr]


def numeric(df: DataFrame, column: str) -> Column:
    """The column as double with NaN as null; other types raise."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise OperatorError(f"{column!r} is not numeric")
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c), c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c


def number(column: str) -> Column:
    """numeric() of a column whose type was checked before."""
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c), c)


def all_numeric(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        numeric(df, c)


#: spread() gives numbers below this.
SPREAD = 2**40


def spread(*parts: Column | str | int) -> Column:
    """A number from 0 to 2 ** 40 for each row: the first ten hex digits of the MD5 of the parts' texts, joined by bars. Any engine
    gives the same one, so what is chosen by it can be checked elsewhere."""
    texts = [F.lit(str(p)) if isinstance(p, int) else (F.col(f"`{p}`") if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 10), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """spread() as a number between 0 and 1."""
    return (spread(*parts) + F.lit(0.5)) / F.lit(float(SPREAD))


def lenient(column: str) -> Column:
    """The column as double where it can be read as one, else null."""
    c = F.col(f"`{column}`").try_cast("double")
    return F.when(~F.isnan(c), c)


def stats(df: DataFrame, **wanted: Column) -> dict[str, Any]:
    """One row of aggregates, in one pass."""
    return df.agg(*[c.alias(n) for n, c in wanted.items()]).first().asDict()


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows where both are there; null, not an error, where one of them is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))  # least and greatest pass over nulls
