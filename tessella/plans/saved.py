"""Chains of fitted operators that are kept: fit on one table, save, load in another session, transform other tables.

A saved chain is a folder: `steps`, a row of JSON for each operator (name, columns, parameters, state), and `tables`, a Parquet
table for each operator that looks values up. Operators are rebuilt by name; what was fitted is not fitted again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import registry
from tessella.registry import Fitted, OperatorError, Step

VERSION = 1


class Chain:
    """Fitted operators in order; each may use the columns of those before it."""

    def __init__(self, steps: Iterable[Fitted] = ()):
        self.steps = list(steps)

    @staticmethod
    def fit(df: DataFrame, steps: Iterable[Step], keep=None) -> Chain:
        """Fit steps (operator, columns, result's name or None, parameters) on a table. Steps whose columns are all there are fitted
        together; the next ones on the table with their results. keep(table, name) stores what they look up."""
        out, left = Chain(), list(steps)
        while left:
            now = [s for s in left if all(c in df.columns for c in s[1])]
            if not now:
                raise OperatorError(f"no column {next(c for c in left[0][1] if c not in df.columns)!r}")
            fitted = registry.fit_many(df, now, keep=keep)
            for f in fitted:
                df = f.transform(df)  # type: ignore[union-attr]
            out.steps += fitted  # type: ignore[arg-type]
            left = [s for s in left if s not in now]
        return out

    @property
    def inputs(self) -> list[str]:
        """The columns that a table must have."""
        made: set[str] = set()
        need: dict[str, None] = {}
        for f in self.steps:
            need |= dict.fromkeys(c for c in f.columns if c not in made)
            made.add(f.out)
        return list(need)

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with the new columns. Categories that fitting has not seen are treated as each operator says."""
        if gone := [c for c in self.inputs if c not in df.columns]:
            raise OperatorError(f"no column {gone[0]!r}")
        for f in self.steps:
            df = f.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the chain to a folder that does not exist, of any file system that Spark knows."""
        rows = []
        for i, f in enumerate(self.steps):
            if f.op not in registry._builders:
                raise OperatorError(f"{f.op!r} cannot be built from its state")
            body = {"version": VERSION, "op": f.op, "columns": f.columns, "out": f.out, "params": f.params, "state": f.state, "on": f.on, "lookup": None}
            if f.lookup is not None:
                there = f.on or ["key"]
                names = [*there, *(c for c in f.lookup.columns if c not in there)]
                # Names of columns may hold marks that files do not take.
                f.lookup.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).write.parquet(f"{path}/tables/{i}")
                body["lookup"] = names
            rows.append((i, json.dumps(body, default=_plain)))
        spark.createDataFrame(rows, "place int, step string").coalesce(1).write.json(f"{path}/steps")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Chain:
        registry._load()
        out = Chain()
        for r in spark.read.schema("place int, step string").json(f"{path}/steps").orderBy("place").collect():
            s = json.loads(r.step)
            if s["version"] != VERSION:
                raise OperatorError(f"a chain of version {s['version']} cannot be read")
            table = None
            if s["lookup"] is not None:
                read = spark.read.parquet(f"{path}/tables/{r.place}")
                table = read.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(s["lookup"])])
            out.steps.append(Fitted(s["op"], s["columns"], s["out"], state=s["state"], lookup=table, on=s["on"], params=s["params"]))
        return out


def _plain(value: Any) -> Any:
    """JSON for numbers that a database gives as decimals, and for times."""
    return float(value) if hasattr(value, "as_tuple") else str(value)
