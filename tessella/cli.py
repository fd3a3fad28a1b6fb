"""Command line: read a table, find features, write it back.

spark-submit -m tessella.cli --data t.parquet --target y --key id --output out.parquet [--type ...] [--time ...] [--report r.txt]
    [--save-transformations folder]
spark-submit -m tessella.cli --data other.parquet --apply folder --output out.parquet
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tessella.plans.explorer import FeatureEngine
from tessella.plans.handlers import PREPARE
from tessella.plans.saved import Chain
from tessella.sources import io


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("--data", required=True)
    p.add_argument("--target")
    p.add_argument("--key", nargs="*", default=[])
    p.add_argument("--type", choices=sorted(PREPARE))
    p.add_argument("--time")
    p.add_argument("--config", help="JSON file of settings: clean_first, history")
    p.add_argument("--output")
    p.add_argument("--report")
    p.add_argument("--save-transformations", help="folder for the fitted operators; the tree goes to folder.json")
    p.add_argument("--apply", help="folder of fitted operators: they are applied to the data, and nothing is fitted")
    a = p.parse_args(argv)
    if not (a.target or a.apply):
        p.error("--target or --apply is needed")
    if a.apply:
        spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
        out = Chain.load(spark, a.apply).transform(io.load(spark, a.data))
        if a.output:
            io.save(out, a.output)
        return 0
    settings = {"clean_first": True, "history": None}
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            settings |= json.load(f)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    df = io.load(spark, a.data)
    if a.type == "classification":
        df = PREPARE["classification"](df, a.target)
    task = {"classification": "classification", "regression": "regression"}.get(a.type or "")
    engine = FeatureEngine(a.target, a.key, task, a.time, settings["history"])
    out = engine.fit_transform(df, settings["clean_first"])
    if a.output:
        io.save(out, a.output)
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(engine.report())
    if a.save_transformations:
        engine.chain.save(spark, a.save_transformations)
        engine.tree.save(f"{a.save_transformations.rstrip('/')}.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
