"""Small checks against pandas and numpy, and of edge cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import registry
from tessella.operators import balance, categorical, clean, evaluate, groups, learn, near, order, profile, series, texts
from tessella.plans import explorer, handlers, preprocessor, search
from tessella.registry import Fitted, OperatorError
from tessella.sources import io
from tessella.streaming import features
from tests.helpers import same_rows


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    n = 300
    frame = pd.DataFrame({"id": range(n), "age": rng.integers(18, 80, n).astype(float), "income": rng.lognormal(10, 1, n), "region": rng.choice(["North", "South", "East"], n)})
    frame["target"] = (frame.age + rng.normal(0, 10, n) > 50).astype(int)
    frame.loc[::17, "age"] = np.nan
    frame.loc[::23, "region"] = None
    return io.from_dataframe(spark, frame)


def test_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=2000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    at = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert np.allclose(order.quantiles(df, F.col("x"), at), [pd.Series(v).quantile(q) for q in at])
    table, n = order.ranks(df, F.col("x"))
    got = {r.v: r.low + (r.n + 1) / 2 for r in table.collect()}
    assert n == 2000 and all(math.isclose(got[a], b) for a, b in zip(v, pd.Series(v).rank()))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert order.quantiles(df, F.col("x"), [0.5]) == [None]


@pytest.mark.parametrize("op", registry.names("numeric"))
def test_numeric_operators_take_nulls_and_constants(spark, op):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0), (5, float("nan"))], "id int, x double")
    out = registry.apply(df, op, "x", out="y")
    assert out.count() == 5
    flat = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, x double")
    if op != "boxcox":
        assert all(r.y is None or not math.isnan(r.y) for r in registry.apply(flat, op, "x", out="y").collect())


def test_moving_average_equals_pandas(spark):
    v = [1.0, None, 3.0, 4.0, None, None, 2.0, 8.0]
    df = spark.createDataFrame(list(enumerate(v)), "i int, x double")
    out = registry.apply(df, "exponential_moving_average", "x", out="y", order_by="i").orderBy("i").toPandas()
    assert np.allclose(out.y.astype(float), pd.Series(v).ewm(alpha=0.3, adjust=False).mean())


def test_ordered_operators_ask_for_an_order(spark):
    with pytest.raises(OperatorError):
        registry.apply(spark.range(3).select(F.col("id").cast("double").alias("x")), "lag", "x")


def test_power_transform_is_standard(spark):
    v = np.random.default_rng(3).lognormal(0, 0.7, 1500)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    f = registry.fit(df, "power_transform", "x", out="y")
    out = f.transform(df).toPandas().y
    assert abs(out.mean()) < 1e-6 and abs(out.std(ddof=0) - 1) < 1e-6 and abs(pd.Series(out).skew()) < 0.2
    lam = registry.fit(df, "boxcox", "x", out="y").state["lambda"]
    assert abs(lam) < 0.15  # the logarithm makes it normal


def test_unknown_operator_and_skip(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(OperatorError):
        registry.fit(df, "no_such", "s")
    assert registry.apply(df, "log", "s", on_error="skip").columns == ["s"]


def test_users_add_operators(spark):
    @registry.register("numeric", "half_for_test")
    def half(df, column, out=None):
        return Fitted("half_for_test", [column], out or "h", lambda: F.col(column) / 2)

    assert registry.apply(spark.createDataFrame([(4.0,)], "x double"), "half_for_test", "x").first().h == 2.0


def test_fitted_statistics_are_kept(spark):
    a = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    b = spark.createDataFrame([(20.0,)], "x double")
    assert registry.fit(a, "normalize", "x", out="y").transform(b).first().y == 2.0


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "")], "i int, t string")
    out, terms = texts.tfidf_columns(df, "t", 2)
    assert terms == ["blue", "red"] and texts.count_columns(df, "t", 2)[0].orderBy("i").first().term_1 == 2
    out = out.select("i", F.col("term_0").alias("blue"), F.col("term_1").alias("red")).orderBy("i").toPandas()
    b, r = math.log(4 / 3) + 1, 2 * (math.log(4 / 2) + 1)
    assert math.isclose(out.blue[0], b / math.hypot(b, r)) and out.red[1] == 0 and out.blue[2] == 0


def test_fold_and_one_hot(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "s string")
    assert sorted(r.s for r in categorical.fold_rare(df, "s", 2).collect()) == ["Other", "Other", "a", "a", "b"]
    assert categorical.one_hot(df, "s").columns == ["s", "s_a", "s_b", "s_c"]


def test_imputers(spark, mixed):
    for how in ("mean", "median", "most_frequent", "constant"):
        done = clean.fit_imputer(mixed, how).transform(mixed)
        assert done.where("age is null or region is null").count() == 0
    assert clean.knn_impute(mixed, ["age", "income"]).where("age is null").count() == 0
    assert clean.iterative_impute(mixed, ["age", "income"], 3).where("age is null").count() == 0


def test_outliers_protect_rare_classes(spark):
    df = spark.createDataFrame([(i, float(i % 10), 0) for i in range(200)] + [(999, 5000.0, 1)], "id int, x double, y int")
    bounds = clean.fit_outliers(df, "iqr", ["x"], "y")
    assert bounds.transform(df).where("y = 1").count() == 1
    assert clean.fit_outliers(df, "iqr", ["x"]).transform(df).where("y = 1").count() == 0
    scored = clean.isolation_forest(df, ["x"], out="s")
    assert scored.orderBy(F.desc("s")).first().id == 999


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.6)], "y int, p int, s double")
    m = evaluate.classification(df, "y", "p")
    assert m["accuracy"] == 0.5 and m["mcc"] == 0
    assert evaluate.ranking(df, "y", "s")["roc_auc"] == 0.75
    assert evaluate.correlation_p(0.5, 12) == pytest.approx(0.0979, abs=2e-3)
    assert evaluate.kolmogorov(1.0, 50, 50) < 1e-6


def test_drift(spark):
    a = spark.range(500).select(F.randn(1).alias("x"))
    b = spark.range(500).select((F.randn(2) + 2).alias("x"))
    assert evaluate.drift(a, b)["dataset_drift"] and not evaluate.drift(a, a)["dataset_drift"]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"))
    b = evaluate.bootstrap(df, ["id"], F.col("x"), 40)
    assert b["low"] < df.agg(F.avg("x")).first()[0] < b["high"]


def test_balancing(spark, mixed):
    rare = mixed.withColumn("target", (F.col("id") % 10 == 0).cast("int"))
    for how in ("random_over", "smote", "adasyn"):
        b = evaluate.class_balance(balance.balance(rare, "target", ["age", "income"], ["id"], how), "target")
        assert b["ratio"] == 1.0
    assert balance.balance(mixed, "target", ["age"], ["id"], "random_under", ratio=0.0).count() == mixed.count()


def test_preprocessor_keeps_statistics(spark, mixed, tmp_path):
    model, out = preprocessor.fit_transform(mixed, {"generate": "maths", "scale": "minmax", "encode": "ordinal"}, "target", ["id"])
    assert out.where("num__age is null").count() == 0 and "cat__region" in out.columns
    model.save(str(tmp_path / "m.json"))
    again = preprocessor.PreprocessorModel.load(str(tmp_path / "m.json"))
    one = spark.createDataFrame([(1, 30.0, 1000.0, "Mars", 0)], mixed.schema)
    assert again.transform(one).first() == model.transform(one).first() and model.transform(one).first()["cat__region"] == -1
    _, comps = preprocessor.fit_transform(mixed, "components", "target", ["id"])
    assert "PC1" in comps.columns


def test_profile_and_recommendations(spark, mixed):
    r = profile.analyze(mixed.drop("id"), "target")
    s = mixed.toPandas()
    assert r["numeric"]["income"]["skewness"] == pytest.approx(s.income.skew()) and r["numeric"]["income"]["kurtosis"] == pytest.approx(s.income.kurt())
    steps = profile.recommend(r, "target")
    assert {"fill_missing", "transform_skewed"} <= {x["id"] for x in steps}
    done = profile.apply_recommendations(mixed, steps, "target", ["id"])
    assert done.where("age is null").count() == 0 and "income_log" in done.columns
    assert len(profile.image(mixed, "age", "target")) == 30


def test_search_and_engine(spark, mixed, tmp_path):
    df = mixed.select("id", F.coalesce("age", F.lit(40.0)).alias("age"), "income", (F.log("income") + 0.01 * F.col("id")).alias("y"))
    engine = explorer.FeatureEngine("y", ["id"], "regression", history=str(tmp_path / "h.jsonl"))
    out = engine.fit_transform(df, clean_first=False)
    assert any("log" in f["chain"] for f in engine.found) and {f["feature"] for f in engine.found} <= set(out.columns)
    assert engine.feature_importance()[0][1] > 0.5 and "log" in engine.report()
    t = search.Tree.from_dict(json.loads(json.dumps(engine.tree.to_dict())))
    assert [n.op for n in t.lineage("log(income)")] == ["log"] and "digraph" in t.to_dot()
    assert engine.history.similar(df.drop("id"), "y")[0][0] == pytest.approx(1.0)


def test_beam_search_and_recovery(spark, mixed):
    states = explorer.beam_search(mixed, "target", ["id"], "classification", {"plain": {}, "robust": {"scale": "robust"}}, depth=1)
    assert [s.error for s in states] == [None, None] and states[0].score >= states[1].score > 0
    some = mixed.where("target = 1")
    assert explorer.lost_classes(mixed, some, "target") == [0.0] and explorer.recover_classes(mixed, some, "target", 5).where("target = 0").count() == 5


def test_handlers(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d} 10:00:00", float(i)) for i in range(28)], "i int, t string, y double").withColumn("t", F.col("t").cast("timestamp"))
    out = handlers.prepare_time_series(df, "y", horizon=2, windows=(3,))
    row = out.where("i = 10").first()
    assert row.y_lag_2 == 8 and row.y_rolling_mean_3 == 7 and row.is_business_hour == 1
    assert handlers.properties(df, "y", "time_series", "t")["time"]["frequency"] == "day"


def test_group_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (1, 4.0, 0.0), (None, 1.0, 1.0)], "k int, a double, b double")
    out = groups.entity_aggregates(df, "k", ["a"]).orderBy("a").collect()
    assert out[1].a_mean == 3 and out[0].a_mean is None and out[1].a_diff_from_mean == -1
    assert groups.arithmetic_pairs(df, ["a", "b"]).where("b = 0").first()["a_div_b"] is None


def test_selection(spark, mixed):
    df = clean.fit_imputer(mixed).transform(mixed).withColumn("one", F.lit(1.0))
    assert learn.select(df, ["age", "one"], None, "variance") == ["age"]
    for how in ("mutual_info", "anova", "rfe"):
        assert learn.select(df, ["age", "income", "one"], "target", how, 1) == ["age"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, float("nan"), None)], "i int, x double, s string")
    for kind in ("parquet", "csv", "json", "orc"):
        io.save(df, str(tmp_path / f"t.{kind}"))
        assert io.load(spark, str(tmp_path / f"t.{kind}")).where("x is null").count() == 1
    with pytest.raises(ValueError):
        io.load(spark, "t.xls")


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 3.0), (1, "2024-01-01 05:00:00", 5.0)], "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = features.windowed(features.read_stream(spark, str(tmp_path / "in"), "k int, t timestamp, v double"), "t", "v", ["k"])
    features.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.n, r["mean"]) for r in got][0] == (2, 2.0)  # the last window is still open


def test_dickey_fuller(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=200))], "i int, x double")
    assert series.dickey_fuller(df, "x", ["i"])["stationary"]


def slow_neighbours(x, y, k):
    """Each row's k nearest others: (squared distance, of another class, row), rows of the same class first at equal distances."""
    out = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        o = np.lexsort((y != y[i], d))[:k]
        out.append([(d[j], y[j] != y[i], j) for j in o])
    return out


def crowd(spark, n, width, seed):
    """A third of the rows is one point; the rare class is a tenth."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)) * width
    x[rng.random(n) < 0.33] = (1.0, 2.0)
    y = (rng.random(n) < 0.1).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)], "id long, a double, b double, y int")
    return df, x / x.std(axis=0), y


def test_cells_are_cut_by_a_few_points_that_no_task_sorts(spark):
    points = spark.range(20_000).select((F.col("id") * 1.0).alias("x0"), F.sqrt("id").alias("x1"))
    some = near._some(points, 640, 20_000)
    assert 500 < some.count() < 800
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan
    assert near._some(points, 640, 320).count() == 20_000


def test_nearest_over_cells_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 15)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40, (500, 2)).astype(float), rng.integers(0, 2, 500)
    both: dict = {}
    for p, c in zip(x.tolist(), y, strict=True):
        both.setdefault(tuple(p), [0, 0])[c] += 1
    df = spark.createDataFrame([(*p, *n) for p, n in both.items()], "x0 double, x1 double, own long, oth long")
    for r in near.nearest(df, 2, {"own": 4, "oth": 3}, F.lit(True)).collect():
        for kind, k, c in (("own", 4, 0), ("oth", 3, 1)):
            want = sorted((round((p[0] - r.x0) ** 2 + (p[1] - r.x1) ** 2, 9), p, n[c]) for p, n in both.items() if n[c])[:k]
            got = [(round(s.d, 9), tuple(s.v), s.n) for s in r[f"near_{kind}"]]
            assert [g[0] for g in got] == [w[0] for w in want] and all(both[g[1]][c] == g[2] for g in got)


def test_clean_borders_sees_every_row(spark):
    """More rows than the bounded sample of earlier versions held."""
    df, x, y = crowd(spark, 6500, 300, 2)
    near3 = slow_neighbours(x, y, 3)
    want = {i for i in range(len(x)) if y[i] or sum(f for _, f, _ in near3[i]) <= 1}
    assert {r.id for r in balance.clean_borders(df, "y", ["a", "b"], "enn").select("id").collect()} == want


def test_tomek_links_are_mutual(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 2))
    y = (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(400)], "id long, a double, b double, y int")
    first = [n[0] for n in slow_neighbours(x / x.std(axis=0), y, 1)]
    links = {i for i in range(400) if not y[i] and first[i][1] and first[first[i][2]][2] == i}
    assert 0 < len(links) < sum(first[i][1] for i in range(400) if not y[i])
    assert {r.id for r in balance.clean_borders(df, "y", ["a", "b"], "tomek").select("id").collect()} == set(range(400)) - links
    # NearMiss-3: the shortlist of each rare row's three nearest, then the farthest of it.
    z = x / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    big, rare = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    short = sorted({int(big[j]) for i in rare for j in np.argsort(d[i, big])[:3]})
    mean = {i: np.sort(d[i, rare])[:3].mean() for i in short}
    stay = set(sorted(short, key=lambda i: -mean[i])[: len(rare)])
    assert {r.id for r in balance.clean_borders(df, "y", ["a", "b"], "nearmiss").where("y = 0").select("id").collect()} == stay


def test_smote_makes_rows_between_true_neighbours(spark):
    df, x, y = crowd(spark, 600, 50, 4)
    raw = np.array([(r.a, r.b) for r in df.where("y = 1").collect()])
    z = raw / raw.std(axis=0)
    near5 = [[j for _, _, j in n] for n in slow_neighbours(z, np.zeros(len(z)), 5)]
    radius = {tuple(raw[i]): max(((z[i] - z[j]) ** 2).sum() for j in near5[i]) for i in range(len(z))}
    made = balance.smote(df, "y", ["a", "b"]).where("id is null").collect()
    assert len(made) == (y == 0).sum() - (y == 1).sum()
    for r in made[:200]:
        p = np.array((r.a, r.b))
        ok = False
        for u in radius:
            for v in radius:
                u_, v_ = np.array(u), np.array(v)
                gap = np.linalg.norm(p - u_) + np.linalg.norm(v_ - p) - np.linalg.norm(v_ - u_)
                ok |= abs(gap) < 1e-6 and (((u_ - v_) / raw.std(axis=0)) ** 2).sum() <= radius[u] + 1e-9
        assert ok


def test_kendall_over_all_rows(spark):
    """More rows than the sample of earlier versions; a third of them is one pair."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 900, 7000).astype(float)
    y = np.round(x * 0.3 + rng.normal(0, 150, 7000))
    x[:2300], y[:2300] = 100.0, 3.0
    s = n_a = n_b = 0
    for i in range(len(x) - 1):
        da, db = np.sign(x[i + 1 :] - x[i]), np.sign(y[i + 1 :] - y[i])
        s, n_a, n_b = s + int((da * db).sum()), n_a + int(np.abs(da).sum()), n_b + int(np.abs(db).sum())
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": y}))
    assert evaluate.kendall(df, "a", "b") == pytest.approx(s / math.sqrt(n_a * n_b), abs=1e-12)
    assert evaluate.kendall(df.where("a = 100"), "a", "a") is None and evaluate.kendall(df.limit(1), "a", "b") is None


@pytest.mark.parametrize("times", [1, 6])
def test_kendall_ranks_no_table(spark, monkeypatch, times):
    """Cuts come from one pass over the rows, not from sorted tables of all values; any cuts give the same, and copies count."""

    def no_ranks(*_):
        raise AssertionError("a table of ranks is made")

    monkeypatch.setattr(order, "ranks", no_ranks)
    monkeypatch.setattr(order, "CUTS", 8)
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=600), rng.normal(size=600)
    y = np.where(rng.random(600) < 0.3, 0.0, y + 0.5 * x)  # a hot value
    x = np.where(rng.random(600) < 0.5, np.round(x, 1), x)
    x, y = np.tile(x, times), np.tile(y, times)
    da, db = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (da * db).sum() / math.sqrt(np.abs(da).sum() * np.abs(db).sum())
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": y})).union(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (3.0, None)], "a double, b double"))
    assert evaluate.kendall(df, "a", "b") == pytest.approx(want, abs=1e-12)
    assert evaluate.kendall(df, "b", "a") == pytest.approx(want, abs=1e-12)


def test_augmented_dickey_fuller(spark):
    """Statistic, chosen lags and p value against least squares on whole matrices."""
    import random

    import numpy as np

    from tessella.operators import series

    rng = random.Random(6)
    walks = {"walk": [0.0], "mean": [0.0, 0.0]}
    for _ in range(260):
        walks["walk"].append(walks["walk"][-1] + rng.gauss(0, 1))
        walks["mean"].append(0.5 * walks["mean"][-1] - 0.4 * walks["mean"][-2] + rng.gauss(0, 1))
    for name, y in walks.items():
        y = np.array(y)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(9999, None)], "i int, y double")

        def fit(k, start):
            d = np.diff(y)
            rows = np.arange(start, len(d))
            x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - j] for j in range(1, k + 1)]])
            b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
            left = ((d[rows] - x @ b) ** 2).sum()
            error = np.sqrt(left / (len(rows) - k - 2) * np.linalg.inv(x.T @ x)[1, 1])
            return b[1] / error, len(rows) * np.log(left / len(rows)) + 2 * (k + 2)

        for k in (0, 1, 3):
            assert series.dickey_fuller(df, "y", ["i"], k)["statistic"] == pytest.approx(fit(k, k)[0], rel=1e-6)
        got = series.dickey_fuller(df, "y", ["i"], None, 6)
        best = min(range(7), key=lambda k: fit(k, 6)[1])
        assert got["lags"] == best and got["statistic"] == pytest.approx(fit(best, best)[0], rel=1e-6)
        assert got["stationary"] == (name == "mean") == (got["p_value"] < 0.05)
    assert series.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.002) and series.unit_root_p(-3.43) == pytest.approx(0.01, abs=0.001)
    flat = spark.range(20).select("id", F.lit(1.0).alias("y"))
    assert series.dickey_fuller(flat, "y", "id", None)["statistic"] is None and series.dickey_fuller(flat.limit(0), "y", "id")["p_value"] is None


def test_one_series_goes_by_chunks(spark, monkeypatch):
    """Statistics of a series in many small chunks are those of one chunk, and no task holds the whole of it."""
    rng = np.random.default_rng(8)
    y = [0.0]
    for e in rng.normal(size=119):
        y.append(0.9 * y[-1] + float(e))
    rows = [(int(i), y[i]) for i in rng.permutation(120)]
    df = spark.createDataFrame([*rows, (-1, None), (9999, float("nan"))], "i int, y double")
    tests = [lambda: series.dickey_fuller(df, "y", "i", 4)["statistic"], lambda: series.dickey_fuller(df, "y", ["i"], None, 3)["statistic"]]
    tests += [lambda lag=lag: registry.fit(df, "autocorrelation", "y", lag=lag, order_by=["i"]).state["r"] for lag in (1, -1)]
    want = [t() for t in tests]
    assert want[2:] == pytest.approx([np.corrcoef(y[1:], y[:-1])[0, 1]] * 2, abs=1e-9)
    most, moments = [], series._moments

    def watched(told, names):
        most.append(max(r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()))
        return moments(told, names)

    monkeypatch.setattr(series, "_moments", watched)
    monkeypatch.setattr(order, "RANGE", 3)  # fewer than the lags
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [t() for t in tests] == pytest.approx(want, rel=1e-9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(most) < 100


def test_six_places_are_those_of_the_sql(spark, duck):
    from tessella.plans.catalog import real

    duck.execute("create or replace temp table halves as select i, (i * 2 + 1) / 2000000 as v, i / 16 / 1000 as w, -(i * 2 + 1) / 2000000 as u from range(500000, 520000) r(i)")
    df = spark.range(500000, 520000).selectExpr("id as i", "(id * 2 + 1) / 2000000D as v", "id / 16D / 1000 as w", "-(id * 2 + 1) / 2000000D as u")
    same_rows(df.select("i", *[real(c).alias(c) for c in "vwu"]), duck, "select i, round(v, 6) + 0.0 as v, round(w, 6) + 0.0 as w, round(u, 6) + 0.0 as u from halves")


def test_exponents_are_sought_over_counted_values(spark, monkeypatch):
    from tessella.operators import numeric

    df = spark.range(4000).selectExpr("if(id % 50 = 7, null, exp((id % 40) / 10D) * if(id % 3 = 0, -1, 1)) as x", "exp((id % 40) / 10D) + id % 2 as y")
    f = df.toPandas()
    asked = []
    tell = numeric.stats
    monkeypatch.setattr(numeric, "stats", lambda t, **k: (asked.append(t.count()) if "s0" in k else None, tell(t, **k))[1])
    for column, method, shape in (("x", "yeo-johnson", yeo), ("y", "box-cox", lambda v, p: np.log(v) if abs(p) < 1e-12 else (v**p - 1) / p)):
        v = f[column].fillna(f[column].median()).to_numpy()
        slope = (np.sign(v) * np.log1p(np.abs(v)) if column == "x" else np.log(v)).sum()
        cost = lambda p: len(v) / 2 * np.log(np.var(shape(v, p))) - (p - 1) * slope  # noqa: B023, E731
        found = registry.fit(df, "power_transform", column, method=method).state["lambda"]
        assert cost(found) <= min(cost(p) for p in np.linspace(-2, 4, 601)) + 1e-6
    assert asked and max(asked) <= 121  # distinct values, not rows


def yeo(v, p):
    up = np.log1p(np.maximum(v, 0)) if abs(p) < 1e-12 else ((np.maximum(v, 0) + 1) ** p - 1) / p
    down = -np.log1p(np.maximum(-v, 0)) if abs(p - 2) < 1e-12 else -((np.maximum(-v, 0) + 1) ** (2 - p) - 1) / (2 - p)
    return np.where(v >= 0, up, down)


def test_scores_of_a_forest_seek_no_cut_and_are_those_of_a_walk(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "sin(id) * (id % 7) as a", "id % 11 as b")
    model = clean.Isolation.fit(df, ["a", "b"], key=["id"])
    x = df.toPandas()[["a", "b"]].to_numpy(float)

    def walk(row, tree):
        col, cut, left, right, depth = tree
        at = 0
        while col[at] >= 0:
            at = int(left[at] if row[int(col[at])] < cut[at] else right[at])
        return depth[at]

    monkeypatch.setattr(order, "quantiles", lambda *_: pytest.fail("a cut is sought"))
    got = clean.isolation_forest(df, ["a", "b"], out="s", key=["id"]).toPandas()["s"].to_numpy()
    want = [2 ** -(sum(walk(r, t) for t in model.trees) / len(model.trees) / model.usual) for r in x[:50]]
    assert np.allclose(got[:50], want, rtol=1e-12)


def test_terms_are_counted_without_a_shuffle_by_row(spark, monkeypatch):
    monkeypatch.setattr(texts.F, "monotonically_increasing_id", lambda: pytest.fail("rows are numbered"))
    df = spark.createDataFrame([("ab cd ab",), ("cd ab ef",), (None,), ("the ab cd",)], "t string")
    assert texts.vocabulary(df, "t", 3, ["the"], 2) == ([("ab", 3), ("ab cd", 2), ("cd", 3)], 4)


@pytest.mark.parametrize("few", [0, 1000])
def test_frequent_groups_are_found_among_frequent_words(spark, monkeypatch, few):
    from collections import Counter

    monkeypatch.setattr(texts, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [" ".join(rng.choice(["aa", "bb", "cc", "dd ee", "ff", "gg hh ii"], int(n), p=[0.1, 0.1, 0.1, 0.4, 0.1, 0.2])) for n in rng.integers(0, 12, 60)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for most, n in ((1, 2), (4, 2), (9, 3), (500, 2)):
        total, have = Counter(), Counter()
        for r in rows:
            w = r.split()
            ts = [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
            total.update(ts)
            have.update(set(ts))
        top = sorted(total, key=lambda t: (-total[t], t))[:most]
        assert texts.vocabulary(df, "t", most, None, n) == (sorted((t, have[t]) for t in top), 60)


def test_rows_are_not_shuffled_by_a_few_categories(spark):
    df = spark.range(40).selectExpr("id", "concat('text ', id) as t", "if(id = 3, null, concat('l', id % 3)) as lang")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = handlers.prepare_text(df, "t")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.id, r.lang) for r in got.collect()} == {(i, None if i == 3 else i % 3) for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_correlations_go_by_counted_rows(spark):
    """Columns of few values go on as few rows, and each counts as often as it is there."""
    x = np.random.default_rng(4).integers(0, 4, (3000, 3)).astype(float)
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    stored = {}

    def keep(table, name):
        stored[name] = table.persist()
        return stored[name]

    got = evaluate.many_rank_correlations(df, ["c"], ["a", "b"], keep)
    want = pd.DataFrame(x, columns=list("abc")).corr("spearman")
    assert all(math.isclose(got["c", o], want.loc["c", o], abs_tol=1e-9) for o in "ab")
    assert stored["rows"].count() == len(np.unique(x, axis=0)) < 100


def test_rounds_over_points_do_not_work_out_the_table_again(spark, monkeypatch):
    df, _, _ = crowd(spark, 300, 7, 2)
    df = df.where(F.udf(lambda a: True, "boolean")("a"))
    plans, plain = [], balance.clusters
    monkeypatch.setattr(balance, "clusters", lambda points, *a: plans.append(points._jdf.queryExecution().executedPlan().toString()) or plain(points, *a))
    balance.smote(df, "y", ["a", "b"], "kmeans").count()
    assert plans and not any("EvalPython" in p for p in plans)
