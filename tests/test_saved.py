"""Every operator comes back from its saved state, in another session, and transforms another table as before."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessella import cli, registry
from tessella.plans.saved import Chain
from tessella.registry import Fitted, OperatorError

BY = {"order_by": ["id"], "partition_by": ["g"]}
STEPS = [
    *((op, ["x"], None, {}) for op in registry.names("numeric") if op != "half_for_test"),
    ("power_transform", ["x"], "boxed", {"method": "box-cox"}), ("min_max_scale", ["x"], "wide", {"min_val": -1.0, "max_val": 3.0}), ("winsorize", ["x"], "cut", {"limits": [0.2, 0.1]}),
    *((op, ["g"], None, {}) for op in ("one_hot_encode", "label_encode", "count_encode", "frequency_encode", "hash_encode")),
    *((op, ["g", "y"], None, {}) for op in ("target_encode", "target_encode_raw", "mean_encode", "weight_of_evidence")),
    *((op, ["t"], None, {}) for op in registry.names("datetime") if op != "time_to_event"), ("time_to_event", ["t"], None, {"event_date": "2024-05-01"}),
    *((op, ["s"], None, {}) for op in registry.names("text")),
    *((op, ["x"], None, BY) for op in registry.names("series") if op != "fourier_features"), ("fourier_features", ["x"], None, {"date_column": "t", "period": 7.0}),
    *((op, ["x", "y"], None, {}) for op in registry.names("interaction")), *((op, ["x", "g"], None, {}) for op in registry.names("group")),
    ("square", ["log(x)"], None, {}), ("count_encode", ["bin(x)"], "rows of the bin", {}),
]


def make(spark, n, shift):
    return spark.range(n).select(
        "id", (F.col("id") % 13 + shift + 1.5).alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") * (1 + shift) % 7).cast("string"))).alias("g"),
        F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int), {shift}, 0, 0)").alias("t"), F.concat(F.lit("Some good words, number "), F.col("id").cast("string")).alias("s"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_operators_come_back(spark, tmp_path):
    a, b = make(spark, 90, 0), make(spark, 60, 3)
    chain = Chain.fit(a, STEPS)
    assert {f.op for f in chain.steps} == set(registry.names()) - {"half_for_test"} and len(chain.steps) == len(STEPS)
    path = str(tmp_path / "chain")
    chain.save(spark, path)
    back = Chain.load(spark, path)
    assert back.inputs == chain.inputs
    for df in (a, b):
        mine, theirs = chain.transform(df), back.transform(df)
        assert mine.schema == theirs.schema and rows(mine) == rows(theirs)
    again = str(tmp_path / "again")
    back.save(spark, again)
    assert rows(Chain.load(spark, again).transform(b)) == rows(chain.transform(b))


def test_another_session_applies_it(spark, tmp_path):
    chain = Chain.fit(make(spark, 90, 0), [("standardize", ["x"], "z", {}), ("target_encode", ["g", "y"], "e", {}), ("square", ["z"], "zz", {})])
    path, data, out = (str(tmp_path / n) for n in ("chain", "data.parquet", "out.parquet"))
    chain.save(spark, path)
    other = make(spark, 30, 5)
    other.write.parquet(data)
    code = "import sys; from tessella import cli; sys.exit(cli.main(sys.argv[1:]))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, "--data", data, "--apply", path, "--output", out], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert rows(spark.read.parquet(out).select("id", "z", "e", "zz")) == rows(chain.transform(other).select("id", "z", "e", "zz"))


def test_what_cannot_be_kept(spark, tmp_path):
    df = make(spark, 20, 0)
    with pytest.raises(OperatorError, match="no column"):
        Chain.fit(df, [("log", ["nothing"], None, {})])
    chain = Chain.fit(df, [("log", ["x"], None, {})])
    with pytest.raises(OperatorError, match="no column 'x'"):
        chain.transform(df.drop("x"))
    own = Chain([Fitted("own", ["x"], "o", lambda: F.col("x") + 1)])
    assert own.transform(df).first().o == 2.5
    with pytest.raises(OperatorError, match="cannot be built"):
        own.save(spark, str(tmp_path / "own"))
    os.makedirs(tmp_path / "old/steps")
    (tmp_path / "old/steps/a.json").write_text(json.dumps({"place": 0, "step": json.dumps({"version": 0})}))
    with pytest.raises(OperatorError, match="version 0"):
        Chain.load(spark, str(tmp_path / "old"))


def test_clashing_and_unseen(spark):
    """Looked-up values do not clash with columns of their names; unseen and null categories follow each operator's rule."""
    a = spark.createDataFrame([("u", 1.0, 5), ("u", 0.0, 6), ("v", 1.0, 7), (None, 1.0, 8)], "g string, y double, n int")
    chain = Chain.fit(a, [("count_encode", ["g"], "c", {}), ("target_encode", ["g", "y"], "e", {"smoothing": 0.0}), ("label_encode", ["g"], "l", {})])
    b = spark.createDataFrame([("u", 1), ("w", 2), (None, 3)], "g string, n int").withColumn("y", F.lit(0.0))
    assert sorted((r.n, r.c, r.e, r.l) for r in chain.transform(b).collect()) == [(1, 2, 0.5, 1), (2, None, 0.75, None), (3, None, 0.75, 0)]


def test_engine_saves_what_it_found(spark, tmp_path):
    data, out, path, again, config = (str(tmp_path / n) for n in ("t.parquet", "out.parquet", "chain", "again.parquet", "config.json"))
    spark.range(300).select("id", F.exp(F.col("id") % 50 / 10).alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 50 * 1.0).alias("y")).write.parquet(data)
    (tmp_path / "config.json").write_text(json.dumps({"clean_first": False}))
    assert cli.main(["--data", data, "--target", "y", "--key", "id", "--output", out, "--save-transformations", path, "--config", config], spark) == 0
    assert cli.main(["--data", data, "--apply", path, "--output", again], spark) == 0
    first, second = spark.read.parquet(out), spark.read.parquet(again)
    made = [c for c in first.columns if c not in ("id", "x", "z", "y")]
    assert made and set(made) <= set(second.columns)
    assert rows(first.select("id", *[f"`{c}`" for c in made])) == rows(second.select("id", *[f"`{c}`" for c in made]))
