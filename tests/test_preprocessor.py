"""Every setting of the preprocessor changes what transform gives, in fitting and afterwards, also from a saved model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import clean, near, order
from tessella.plans import preprocessor
from tessella.plans.preprocessor import PreprocessorModel


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = rng.gauss(0, 1)
        y, z = 2 * x + rng.gauss(0, 0.1), rng.gauss(5, 2)
        rows.append((i, x, None if i % 9 == 0 else y, None if i % 11 == 0 else z, rng.choice(["a", "b", "c", None]), i % 2, f"2024-0{1 + i % 9}-1{i % 9} 0{i % 10}:00:00"))
    rows += [(900, 60.0, -90.0, 400.0, "a", 1, "2024-01-01 00:00:00")]
    return spark.createDataFrame(rows, "id int, x double, y double, z double, g string, label int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))


def y_of(model, df):
    done = model.transform(df.where("y is null"), keep=("id",)).toPandas().sort_values("id")
    a, b = model.scales["y"]
    return done["num__y"].to_numpy() * b + a


def test_fills_differ_and_regression_is_near(table):
    got, table = {}, table.where("id < 900")
    for how in ("mean", "median", "knn", "iterative"):
        got[how] = y_of(preprocessor.fit(table, {"missing": how, "correlation": None}, "label", ["id"]), table)
    for a in got:
        assert all(a == b or not np.allclose(got[a], got[b]) for b in got)
    truth = 2 * table.where("y is null").orderBy("id").toPandas().x.to_numpy()
    error = {k: np.abs(v - truth).mean() for k, v in got.items()}
    assert error["iterative"] < 0.3 and error["knn"] < 0.6 * error["median"]


def test_isolation_forest_drops_rows_it_is_told_of(table):
    model = preprocessor.fit(table, {"outliers": "isolation_forest", "correlation": None}, "label", ["id"])
    kept = model.transform(table, drop_rows=True, keep=("id",))
    assert kept.count() < table.count() and kept.where("id = 900").count() == 0
    assert model.transform(table, keep=("id",)).count() == table.count()


def test_dates_and_target_means(table):
    model = preprocessor.fit(table, {"dates": True, "target_means": True, "scale": "none", "correlation": None}, "label", ["id"])
    out = model.transform(table, keep=("id",))
    r = out.where("id = 4").first()
    assert (r["num__t_year"], r["num__t_month"], r["num__t_day"], r["num__t_hour"], r["num__t_dayofweek"], r["num__t_is_weekend"]) == (2024, 5, 14, 4, 1, 0)
    means = {r.g: r.m for r in table.groupBy("g").agg(F.avg("label").alias("m")).collect()}
    g = table.where("id = 4").first().g
    if g is not None:
        assert abs(r["num__g_target_mean"] - means[g]) < 1e-9
    assert preprocessor.fit(table.withColumn("label", F.col("x")), {"target_means": True}, "label", ["id"]).target_means == {}
    assert model.transform(table.drop("t"), keep=("id",)).count() == table.count()


@pytest.mark.parametrize("config", [{"missing": "knn", "outliers": "isolation_forest"}, {"missing": "iterative", "dates": True, "target_means": True, "generate": "all", "select": "variance", "reduce": "pca"}])
def test_saved_models_transform_alike(table, tmp_path, config):
    model = preprocessor.fit(table, config, "label", ["id"])
    model.save(str(tmp_path / "m.json"))
    again = PreprocessorModel.load(str(tmp_path / "m.json"))
    a, b = (m.transform(table, drop_rows=True, keep=("id",)).toPandas().sort_values("id").reset_index(drop=True) for m in (model, again))
    assert list(a.columns) == list(b.columns) and np.allclose(a.select_dtypes("number"), b.select_dtypes("number"), equal_nan=True)


def test_categories_beyond_the_cap_are_one_column(table):
    model = preprocessor.fit(table, {"max_categories": 2}, "label", ["id"])
    out = model.transform(table, keep=("id",))
    other = [c for c in out.columns if c.endswith("__other")]
    assert len(other) == 1 and out.agg(F.sum(f"`{other[0]}`")).first()[0] > 0


def near_fill(x: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """x with missing numbers filled from its k nearest rows of d."""
    out = x.copy()
    have = ~np.isnan(d)
    means = np.array([d[have[:, j], j].mean() if have[:, j].any() else 0.0 for j in range(d.shape[1])])
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        seen = ~np.isnan(x[i])
        diff = d[:, seen] - x[i, seen]
        n = (~np.isnan(diff)).sum(axis=1)
        dist = np.sqrt(np.where(n > 0, np.nansum(diff**2, axis=1) * x.shape[1] / np.maximum(n, 1), np.inf))
        for j in np.flatnonzero(~seen):
            at = np.flatnonzero(have[:, j] & np.isfinite(dist))
            if not len(at):
                out[i, j] = means[j]
                continue
            best = at[np.lexsort((d[at, j], dist[at]))[:k]]
            w = 1 / np.maximum(dist[best], 1e-12)
            out[i, j] = (d[best, j] * w).sum() / w.sum()
    return out


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("cell", [2000, 20])
def test_knn_over_all_rows_by_brute_force(spark, monkeypatch, cell, blocks):
    monkeypatch.setattr(near, "CELL", cell)
    if blocks:
        for n, v in (("SEARCHES", 0), ("ASK_BLOCK", cell), ("GIVE_BLOCK", 5 * cell)):
            monkeypatch.setattr(clean, n, v)
    rng = random.Random(8)
    rows = [tuple(None if rng.random() < 0.15 else round(rng.uniform(0, 9), rng.choice([0, 2])) for _ in range(3)) for _ in range(220)]
    rows += [(None, None, None), (1.0, None, None)] + [(5.0, 5.0, 5.0)] * 30 + [(5.0, 5.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double")
    got = clean.knn_impute(df, ["a", "b", "c"]).toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    assert np.allclose(got, near_fill(x, x, 5))


@pytest.mark.parametrize("size", [40])
def test_order_beyond_one_range(spark, monkeypatch, size):
    """Small ranges give the ranks and quantiles of one range."""
    monkeypatch.setattr(order, "RANGE", size)
    monkeypatch.setattr(order, "CUTS", 5)
    rng = random.Random(size)
    data = [(rng.choice([None, 7.0, 7.0, round(rng.gauss(0, 50), 1)]), float(rng.randrange(400))) for _ in range(900)]
    df = spark.createDataFrame(data, "a double, b double")
    for i, c in enumerate("ab"):
        v = np.sort([r[i] for r in data if r[i] is not None])
        assert np.allclose(order.quantiles(df, F.col(c), [0, 0.1, 0.5, 0.77, 1]), np.quantile(v, [0, 0.1, 0.5, 0.77, 1]))
        table, n = order.ranks(df, F.col(c))
        u, k = np.unique(v, return_counts=True)
        rows = table.orderBy("v").toPandas()
        assert n == len(v) and rows.v.tolist() == u.tolist() and rows.n.tolist() == k.tolist()
        assert rows.low.tolist() == (np.cumsum(k) - k).tolist() and rows.code.tolist() == list(range(len(u)))
    assert order.many_quantiles(df, [F.col("a"), F.col("b"), F.lit(None).cast("double")], [0.5])[2] == [None]


@pytest.mark.parametrize("reduce", [None, "pca"])
def test_clashing_names_of_made_columns(table, reduce):
    """A column that has the name of a date part or a target mean stays a feature of its own."""
    df = table.where("id < 900").withColumn("t_year", F.col("x") * 3).withColumn("G_target_mean", F.lit("u"))
    model = preprocessor.fit(df, {"dates": True, "target_means": True, "reduce": reduce, "scale": "none", "correlation": None}, "label", ["id"])
    out = model.transform(df, keep=("id",))
    assert model.renamed == {"t_year": "t_year_", "g_target_mean": "g_target_mean_"}
    if reduce:
        assert [c for c in out.columns if c.startswith("PC")] and out.count() == 300
        return
    r = out.where("id = 4").first()
    x = df.where("id = 4").first().x
    assert r["num__t_year_"] == 2024 and abs(r["num__t_year"] - 3 * x) < 1e-9 and r["cat__G_target_mean_u"] == 1.0
    plain = preprocessor.fit(table, {"dates": True, "scale": "none", "correlation": None}, "label", ["id"])
    assert plain.transform(table.withColumn("t_month", F.lit(-5.0)), keep=("id",)).where("id = 4").first()["num__t_month"] == 5


def test_the_forest_cuts_over_all_rows(spark):
    """Scores equal a walk down each tree, and the cut is the quantile of the scores of all rows, beyond the sample too."""
    df = spark.range(3000).select("id", F.sin("id").alias("a"), (F.cos(F.col("id") * 3) * F.when(F.col("id") % 97 == 0, 9).otherwise(1)).alias("b"))
    found = clean.Isolation.fit(df, ["a", "b"], 0.03, 400, key=["id"])
    rows = df.orderBy("id").toPandas()

    def depth(tree, p):
        col, cut, left, right, end = tree
        at = 0
        while col[at] >= 0:
            at = int(left[at] if p[int(col[at])] < cut[at] else right[at])
        return end[at]

    want = [2 ** -(np.mean([depth(t, p) for t in found.trees]) / found.usual) for p in rows[["a", "b"]].to_numpy()]
    got = df.select("id", found.scores(df).alias("s")).orderBy("id").toPandas().s.to_numpy()
    assert np.allclose(got, want) and found.cut == pytest.approx(np.quantile(want, 0.97))
    assert found.transform(df).count() == int((got <= found.cut).sum())


def test_knn_of_ten_columns_with_random_nulls_ends(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 9, (400, 10)), 1)
    x[rng.random((400, 10)) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"c{i} double" for i in range(10)))
    names = [f"c{i}" for i in range(10)]
    got = clean.knn_impute(df, names).toPandas().sort_values("id")[names].to_numpy()
    assert np.allclose(got, near_fill(x, x, 5))


def test_knn_of_later_tables_takes_values_from_all_fitted_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 9, (3000, 3))
    y = rng.uniform(0, 9, (40, 3))
    y[rng.random((40, 3)) < 0.3] = np.nan
    table = lambda v: spark.createDataFrame([(i, *(None if np.isnan(a) else float(a) for a in r)) for i, r in enumerate(v)], "id int, a double, b double, c double")
    model = preprocessor.fit(table(x), {"missing": "knn", "scale": "none", "correlation": None}, key=["id"])
    model.save(str(tmp_path / "m.json"))
    for m in (model, PreprocessorModel.load(str(tmp_path / "m.json"))):
        got = m.transform(table(y), keep=("id",)).toPandas().sort_values("id")[["num__a", "num__b", "num__c"]].to_numpy()
        assert np.allclose(got, near_fill(y, x, 5))


def test_kept_tables_go_when_released(spark):
    from tessella.sources.store import Store, release

    store = Store.kept(spark)
    store.table(spark.range(5), "t")
    assert release(spark) >= 1 and release(spark) == 0
    assert not store.files.exists(store.path)


def test_neighbours_far_from_their_cell(spark, monkeypatch):
    """Kinds of which a cell holds few or none, lines of copies and lone points: as by comparing all."""
    monkeypatch.setattr(near, "CELL", 8)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(30, 0.1, (60, 2)), [[100.0, 100.0], [-80.0, 3.0]]])
    kind = np.concatenate([np.zeros(150), np.ones(60), [0, 1]]).astype(int)
    points = spark.createDataFrame([(float(a), float(b), int(k == 0), int(k == 1)) for (a, b), k in zip(x, kind, strict=True)], "x0 double, x1 double, p long, q long")
    got = near.nearest(points, 2, {"p": 4, "q": 3}, F.lit(True)).collect()
    assert len(got) == len(x)
    for r in got:
        d = ((x - [r.x0, r.x1]) ** 2).sum(axis=1)
        for name, k, n in (("near_p", 0, 4), ("near_q", 1, 3)):
            assert np.allclose([s.d for s in r[name]], np.sort(d[kind == k])[:n])


def test_entities_are_learned_in_fitting(spark, tmp_path):
    """Later rows get what fitting has seen of their entity; new and missing entities get all rows'."""
    df = spark.createDataFrame([(i, f"e{i % 4}", float(i), None if i % 7 == 0 else float(i * i)) for i in range(40)], "id int, who string, x double, z double")
    model = preprocessor.fit(df, {"entity": "who", "scale": "none", "correlation": None, "encode": "ordinal"}, key=["id"])
    model.save(str(tmp_path / "m.json"))
    later = spark.createDataFrame([(100, "e1", 7.0, 2.0), (101, "new", 7.0, None), (102, None, 7.0, 3.0)], "id int, who string, x double, z double")
    e1, every = [float(i) for i in range(40) if i % 4 == 1], [float(i) for i in range(40)]
    for m in (model, PreprocessorModel.load(str(tmp_path / "m.json"))):
        got = {r.id: r for r in m.transform(later, keep=("id",)).collect()}
        assert (got[100]["num__x_by_who_mean"], got[100]["num__x_by_who_max"], got[100]["num__x_by_who_count"]) == (np.mean(e1), 37.0, 10.0)
        assert got[100]["num__x_by_who_std"] == pytest.approx(np.std(e1, ddof=1)) and got[100]["num__x_diff_from_mean"] == 7.0 - np.mean(e1)
        assert got[101]["num__x_by_who_mean"] == np.mean(every) and got[101]["num__x_diff_from_mean"] == 7.0 - np.mean(every)
