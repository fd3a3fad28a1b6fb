"""Validation with confidence, recommendations and their quality, and recovery."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate, profile
from tessella.plans import search, validate


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.gauss(0, 1), rng.gauss(0, 1), float("nan") if i % 17 == 0 else 2.718 ** rng.gauss(0, 1), int(x + rng.gauss(0, 0.4) > 0), int(rng.random() < 0.06)) for i in range(240)]
    return spark.createDataFrame(rows, "id int, x double, z double, skewed double, label int, rare int")


def test_bootstrap_is_out_of_bag(table):
    drawn = validate.draws(table, ["id"], 3, 0.8)
    n = drawn.agg(F.sum("drawn").alias("n"), F.count_if(F.col("drawn") == 0).alias("out")).first()
    assert 140 < n.n < 240 and 70 < n.out < 150
    got = validate.bootstrap_evaluate(table, ["x", "z"], "label", "classification", ["id"], 2)
    assert len(got["scores"]) == 2 and got["low"] <= got["median"] <= got["high"] and got["median"] > 0.65
    again = validate.bootstrap_evaluate(table.repartition(7, "z"), ["x", "z"], "label", "classification", ["id"], 2)
    assert again["scores"] == pytest.approx(got["scores"])
    # The draws are Poisson by the key's hash: counts of rows drawn so often are near their means.
    many = validate.draws(table.sparkSession.range(40_000), ["id"], 5, 0.8).groupBy("drawn").count().collect()
    for r in many:
        p = 2.718281828**-0.8 * 0.8**r.drawn / math.factorial(r.drawn)
        assert abs(r["count"] - 40_000 * p) < 5 * (40_000 * p) ** 0.5 + 1


def test_confidence_by_size(table, monkeypatch):
    """How often folds are drawn follows the number of rows; the interval is that of the mean of all folds."""
    seeds = []

    def folds(*args, seed=42, **more):
        seeds.append(seed)
        return {"folds": [0.8, 0.9], "metrics": {}, "overfit": 0.0, "grade": "low", "splitter": "stratified"}

    monkeypatch.setattr(validate.learn, "cross_validate", folds)
    got = validate.evaluate_with_confidence(table, ["x", "z"], "label", ["id"])
    assert got["method"] == "repeated" and len(set(seeds)) == 3 and got["mean"] == pytest.approx(0.85)
    assert got["high"] - got["mean"] == pytest.approx(1.96 * 0.05 / 6**0.5)
    assert validate.evaluate_with_confidence(table, ["x"], "label", ["id"], method="cv")["scores"] == [0.8, 0.9]
    assert validate.evaluate_with_confidence(table.where("id < 60"), ["x"], "label", ["id"], rounds=1)["method"] == "bootstrap"


def test_report(table):
    text = validate.create_validator(table, "label", ["id"], method="cv", rounds=2).report(table, table.withColumn("x", F.col("x") + 5))
    assert "## confidence" in text and "drifted" in text and "| x |" in text


def test_imbalanced_scores_and_presets(table):
    got = validate.evaluate_transformation_imbalanced(table.select("id", "x", "z", "rare"), "rare", "classification", ["id"], 2)
    assert {"imb_f1", "imb_g_mean", "overall"} <= set(got)
    assert not any(k.startswith("imb_") for k in validate.evaluate_transformation_imbalanced(table.select("id", "x", "label"), "label", "classification", ["id"], 2))
    assert validate.imbalance_presets(0.5) == {} and "under" in validate.imbalance_presets(0.1) and "over" in validate.imbalance_presets(0.01)
    m = validate.minority_metrics([(0, 0, 8), (0, 1, 2), (1, 1, 3), (1, 0, 1)], 1)
    assert m["balanced_accuracy"] == pytest.approx(0.775) and m["precision"] == 0.6 and m["recall"] == 0.75


def test_recommendation_quality(table):
    found = search.recommendation_quality(table.where("not isnan(skewed)"), {"skewed": ["log", "standardize", "no_such"], "x": ["word_count"]})
    by = dict(found["skewed"])
    assert by["log"] > by["standardize"] == pytest.approx(0.5) and "no_such" not in by


def test_meta_model_learns_from_history(spark, table):
    mark = search.fingerprint(table.drop("id"), "label")
    other = {k: v * 3 + 1 for k, v in mark.items()}
    history = [{"fingerprint": mark, "gains": {"log": 0.4, "sqrt": 0.0}}, {"fingerprint": other, "gains": {"log": 0.0, "sqrt": 0.4}}] * 6
    assert search.MetaModel(spark, history).predict(table.drop("id"), "label")[0][0] == "log"
    assert search.MetaModel(spark, [{"fingerprint": mark, "gains": {"log": 0.4}}]).predict(table, "label") == [("log", 0.01)]


def test_search_by_ranks(table):
    df = table.select("x", "z", F.exp("x").alias("e"), "label")
    tree = search.Tree(1)
    for c in ("x", "z"):
        tree.root(c)
        tree.add(c, "cube")
    found = search.search(df, "label", tree, {"max_depth": 1, "min_gain": -9.0, "max_redundancy": 1.1, "measures": "rank"})
    by = {f["feature"]: f for f in found}
    assert by["cube(x)"]["redundancy"] == pytest.approx(1.0) and by["cube(x)"]["importance"] > by["cube(z)"]["importance"]
    assert by["cube(x)"]["importance"] == pytest.approx(evaluate.mutual_information(df.withColumn("c", F.col("x") ** 3), "c", "label"))


def test_safe_explore_always_gives_a_state(table):
    states, told = validate.safe_explore(table.select("id", "x", "z", "rare"), "rare", ["id"], "classification", most=2)
    assert states and told["succeeded"] == len(states) and told["best"] == states[0].name


def test_modal_gap_over_many_gaps(spark):
    """One gap stands most often although fifty others do too."""
    t, rows = 0, []
    for i in range(400):
        t += 7 if i % 3 == 0 else 1000 + i
        rows.append((t,))
    df = spark.createDataFrame(rows, "s long").select(F.timestamp_seconds("s").alias("t"))
    assert profile.time_profile(df, ["t"])["t"]["modal_gap_seconds"] == 7


def test_lost_classes_come_back_and_repeats_stay(spark):
    from tessella.plans import explorer

    before = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 0), (2.0, 1), (3.0, 1), (3.0, 1)], "x double, y int")
    assert explorer.recover_classes(before, before, "y").count() == 6
    got = explorer.recover_classes(before, before.where("y = 0"), "y")
    assert sorted(map(tuple, got.collect())) == [(1.0, 0)] * 3 + [(2.0, 1), (3.0, 1)]
