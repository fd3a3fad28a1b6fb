"""The search measures a level in a fixed number of jobs, and as one candidate at a time would."""

import random

import pytest
from pyspark.sql import functions as F

from tessella import registry
from tessella.operators import clean, evaluate, order
from tessella.plans import search
from tessella.registry import corr, numeric, stats
from tessella.sources.store import Store


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        x, g = rng.gauss(3, 1), rng.choice(["a", "b", "c", "d", None])
        rows.append((x, None if i % 7 == 0 else abs(rng.gauss(0, 2)), float(rng.randrange(6)), g, f"k{i % 23}", x * x + len(g or "") + rng.gauss(0, 0.3)))
    return spark.createDataFrame(rows, "x double, z double, few double, g string, k string, y double")


def one_by_one(df, name, op, parent, target, base):
    wide = registry.fit(df, op, parent, out=name).transform(df)
    x = F.col(f"`{name}`").cast("double")
    row = stats(wide, i=corr(x, numeric(wide, target)), **{f"d{j}": corr(x, numeric(wide, c)) for j, c in enumerate(base)})
    return abs(row["i"] or 0.0), max(abs(row[f"d{j}"] or 0.0) for j in range(len(base)))


def test_level_equals_one_by_one(table):
    tree = search.Tree(1)
    for c in table.columns[:-1]:
        tree.root(c)
    for c in ("x", "z", "few"):
        for op in ("log", "sqrt", "square", "standardize", "robust_scale", "winsorize", "bin", "outlier_indicator", "quantile_transform"):
            tree.add(c, op)
    for c in ("g", "k"):
        for op in ("label_encode", "count_encode", "frequency_encode", "hash_encode", "one_hot_encode", "word_count"):
            tree.add(c, op)
        tree.add(c, "target_encode", target="y")
    tree.add("g", "log")  # cannot be fitted
    search.search(table, "y", tree, {"max_depth": 1})
    base = clean.numeric_columns(table, ("y",))
    for n in tree.level(1):
        if n.name == "log(g)":
            assert n.importance == 0.0
        elif n.op == "target_encode":
            wide = registry.fit(table, n.op, n.parent, target="y", out="t").transform(table)
            assert n.importance == pytest.approx(abs(stats(wide, r=corr("t", "y"))["r"]))
        else:
            assert (n.importance, n.redundancy) == pytest.approx(one_by_one(table, n.name, n.op, n.parent, "y", base)), n.name


def jobs(spark, run):
    """How many jobs a function starts."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("measures", ["linear", "rank"])
def test_jobs_do_not_grow_with_candidates(spark, measures):
    wide = spark.range(300).select(*[(F.sin(F.col("id") * (i + 2)) * 10).alias(f"x{i}") for i in range(12)], (F.col("id") % 17).cast("double").alias("y"))

    def level(columns, ops):
        tree = search.Tree(1)
        for i in range(columns):
            tree.root(f"x{i}")
            for op in ops:
                tree.add(f"x{i}", op)
        return lambda: search.search(wide, "y", tree, {"max_depth": 1, "min_gain": 9.0, "measures": measures})

    few, many = level(1, ["square", "standardize", "winsorize", "robust_scale", "bin"]), level(10, ["square", "standardize", "winsorize", "robust_scale", "bin"])
    assert jobs(spark, few) == jobs(spark, many)


def test_level_works_out_a_candidate_once_in_each_pass(table, monkeypatch):
    """An expression that stands in the code again and again makes it too long to be compiled."""
    plans, there = [], type(table).mapInPandas
    monkeypatch.setattr(type(table), "mapInPandas", lambda self, *a, **b: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or there(self, *a, **b))
    tree = search.Tree(1)
    tree.root("z")
    tree.add("z", "log")
    search.search(table, "y", tree, {"max_depth": 1})
    assert [p.lower().count("ln(") for p in plans] == [1]


def test_correlations_leave_out_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 9.0), (2.0, 3.5), (None, 1.0), (5.0, float("nan")), (4.0, 4.0), (7.0, 1.0)], "x double, y double")
    clean_rows = df.where("not isnan(x) and not isnan(y) and x is not null")
    got = evaluate.many_correlations(df, {"a": F.col("x")}, {"b": F.col("y")})[("a", "b")]
    assert got == pytest.approx(stats(clean_rows, r=corr("x", "y"))["r"], abs=1e-12)


def test_rank_measures_equal_one_by_one(table):
    tree = search.Tree(1)
    for c in ("x", "z", "few", "g"):
        tree.root(c)
    for c, op in (("x", "square"), ("z", "log"), ("few", "sqrt"), ("g", "one_hot_encode"), ("g", "count_encode")):
        tree.add(c, op)
    search.search(table, "y", tree, {"max_depth": 1, "measures": "rank"})
    filled = table.fillna({"z": order.quantiles(table, F.col("z"), [0.5])[0]})
    for n in tree.level(1):
        wide = registry.fit(table, n.op, n.parent, out="v").transform(table)
        assert n.importance == pytest.approx(evaluate.mutual_information(wide, "v", "y"))
        if n.op == "one_hot_encode":
            assert n.redundancy == pytest.approx(max(evaluate.cramers_v(wide, "v", c) for c in ("g", "k")))
        elif n.parent != "g":
            wide = registry.fit(table, n.op, n.parent, out="v").transform(filled)
            assert n.redundancy == pytest.approx(max(abs(evaluate.rank_correlation(wide, "v", c)) for c in ("x", "z", "few")))


def test_ranks_of_many_columns_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE", 50)
    df = spark.range(500).select((F.col("id") % 83).cast("double").alias("a"), F.sin("id").alias("b"), F.lit(1.0).alias("c"))
    counts = order._counts(df, [F.col("a"), F.col("b"), F.col("c")])
    with Store(spark) as store:
        got = {(r.c, r.v): (r.low, r.code) for r in order.many_ranks(counts, store.table).collect()}
    for i, c in enumerate("abc"):
        values = sorted(r[0] for r in df.select(c).collect())
        assert {(i, v): (values.index(v), k) for k, v in enumerate(sorted(set(values)))} == {k: v for k, v in got.items() if k[0] == i}


def test_edges_of_the_measures(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, "a", 2.0), (3.0, "b", None)], "x double, g string, y double")
    tree = search.Tree(1)
    for c, op in (("x", "log"), ("g", "count_encode")):
        tree.root(c)
        tree.add(c, op)
    for measures in ("linear", "rank"):
        assert search.search(df, "y", search.Tree.from_dict(tree.to_dict()), {"measures": measures, "min_gain": -9.0, "max_redundancy": 2.0}) is not None
        assert search.search(df.limit(0), "y", search.Tree.from_dict(tree.to_dict()), {"measures": measures}) == []
