"""Operators on two columns, read as numbers where they can be."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.registry import declare, lenient


def _op(name: str, rule) -> None:
    declare("interaction", name, lambda columns, s, **params: rule(*map(lenient, columns), **params), named=("column1", "column2"), label=lambda columns, **_: f"{name}({','.join(columns)})")


_op("sum", lambda a, b: a + b)
_op("difference", lambda a, b: a - b)
_op("product", lambda a, b: a * b)
_op("ratio", lambda a, b: F.try_divide(a, b + F.lit(1e-10)))
_op("polynomial", lambda a, b, degree=2: a * a + b * b + a * b if degree == 2 else F.pow(a + b, F.lit(float(degree))))
