"""The embedding keeps neighbours together, and its parts equal plain versions."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import embed, near
from tessella.plans import catalog, catalog_more
from tessella.registry import OperatorError
from tessella.sources.store import Store
from tests.conftest import SF


def recall(x, y, k=10):
    """The share of a point's k nearest that are among its k nearest in the picture."""
    of = lambda p: np.argsort(((p[:, None] - p[None]) ** 2).sum(axis=2) + np.eye(len(p)) * 1e18, axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(of(x), of(y), strict=True)])


def test_neighbours_stay_together(spark):
    """Six clusters on the axes of six dimensions: two components lay some over each other, the picture does not."""
    rng = np.random.default_rng(5)
    label = np.repeat(np.arange(6), 40)
    x = rng.normal(0, 0.35, (240, 6)) + 4 * np.eye(6)[label]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"c{i} double" for i in range(6)))
    names = [f"c{i}" for i in range(6)]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    start = embed.embed(df, names, rounds=0).orderBy("id").toPandas()[["U1", "U2"]].to_numpy()
    got = embed.embed(df, names, rounds=25).orderBy("id").toPandas()[["U1", "U2"]].to_numpy()
    same = lambda y: np.mean([np.mean(label[np.argsort(((y - p) ** 2).sum(axis=1))[1:11]] == label[i]) for i, p in enumerate(y)])
    print("recall", recall(z, start), recall(z, got), "own cluster", same(start), same(got))
    assert same(got) > 0.97 and recall(z, got) > max(0.35, recall(z, start))


def test_graph_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2))
    points = spark.createDataFrame([(i, float(a), float(b), 1) for i, (a, b) in enumerate(x)], "id long, x0 double, x1 double, n long")
    w = np.zeros((90, 90))
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = np.argsort(d)[1:7]
        w[i, order] = embed.strengths(d[order], 6)
        assert w[i, order[0]] == 1 and w[i].sum() == pytest.approx(np.log2(6), abs=1e-4)
    w = w + w.T - w * w.T
    with Store(spark) as store:
        got = np.zeros((90, 90))
        for r in embed.graph(points, 2, 6, store).collect():
            got[r.i, r.j] = r.w
    assert np.allclose(got, w)


def test_push_is_the_mean_of_pairs():
    rng = np.random.default_rng(1)
    y, others = rng.normal(size=(7, 2)), rng.normal(size=(5, 2))
    for i in range(7):
        one = []
        for o in others:
            d = y[i] - o
            q = d @ d
            one.append(np.clip(2 * embed.B / ((0.001 + q) * (1 + embed.A * q**embed.B)) * d, -4, 4))
        assert np.allclose(embed.push(y, others)[i], np.mean(one, axis=0))


def test_edges_of_the_embedding(spark):
    df = spark.createDataFrame([(1, 1.0, None, "u"), (2, 1.0, None, "v"), (3, float("nan"), 2.0, None)], "id int, a double, b double, U1 string")
    got = {r.id: (r.U1, r.U2) for r in embed.embed(df, ["a", "b"]).collect()}
    assert len(got) == 3 and got[1] == got[2]
    assert embed.embed(df.limit(0), ["a", "b"]).count() == 0
    same = embed.embed(spark.range(40).select("id", F.lit(1.0).alias("a"), (F.col("id") % 8).cast("double").alias("b")), ["a", "b"], rounds=2).collect()
    assert len(same) == 40 and len({(r.U1, r.U2) for r in same}) == 8
    with pytest.raises(OperatorError):
        embed.embed(df, [])


def test_places_do_not_depend_on_cells_of_edges(spark, monkeypatch):
    """Cells get the places beyond them that their edges lead to, and no others: a round moves fewer rows than there are edges."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 2)))], "id int, a double, b double")
    got, sent = [], []
    table = Store.table

    def seen(self, df, name):
        done = table(self, df, name)
        if name in ("beyond", "graph"):
            sent.append(done.count())
        return done

    monkeypatch.setattr(Store, "table", seen)
    for size in (10_000, 50):
        monkeypatch.setattr(embed, "BLOCK", size)
        got.append(embed.embed(df, ["a", "b"], rounds=2, k=5).orderBy("id").toPandas()[["U1", "U2"]].to_numpy())
    assert np.allclose(got[0], got[1], atol=1e-6)
    (edges, none), (same, beyond) = sent[:2], sent[2:]
    assert edges == same and none == 0 and 0 < beyond < edges / 4


def test_the_query_goes_through_all_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(embed, "_laid_out", lambda now, edges, rounds, seed, store: (asked.append(rounds), now.select("id", "y0", "y1"))[1])
    assert catalog.QUERIES["embedding"] is catalog_more.embedding
    catalog.QUERIES["embedding"](spark, SF)
    assert asked == [inspect.signature(embed.embed).parameters["rounds"].default] == [50]
