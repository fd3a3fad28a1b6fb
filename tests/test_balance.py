"""Balancing row by row, against numpy versions of each method's rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import balance
from tessella.registry import OperatorError

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    big = rng.normal(0, 1, (160, 2))
    few = np.concatenate([rng.normal(2.0, 0.6, (30, 2)), rng.normal(-2.5, 0.3, (14, 2))])
    x = np.concatenate([big, few, few[:3]]) * [3.0, 1.0]
    rows = [(i, float(p), float(q), int(i >= 160)) for i, (p, q) in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, y int")


@pytest.fixture(scope="module")
def frame(table):
    return table.toPandas()


def scaled(frame, label=1):
    scale = frame[frame.y == label][COLUMNS].std(ddof=0).to_numpy()
    return frame[COLUMNS].to_numpy() / scale, frame.y.to_numpy(), scale


def neighbours(x, i, among, k):
    """The k nearest of `among`, i left out."""
    among = among[among != i]
    return among[np.argsort(((x[among] - x[i]) ** 2).sum(axis=1), kind="stable")[:k]]


def made(table, **how):
    out = balance.smote(table, "y", COLUMNS, **how)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    new = out.where("id is null").toPandas()
    assert (new.y == 1).all() and counts[0] == 160
    return new[COLUMNS].to_numpy(), counts


def on_lines(p, x, starts, k, own, low, high):
    """The starts from which a made point lies on the way to one of their k neighbours, by a part between low and high."""
    found = set()
    for i in starts:
        for j in neighbours(x, i, own, k):
            d = x[j] - x[i]
            n = d @ d
            t = (p - x[i]) @ d / n if n else 0.0
            if low - 1e-9 <= t <= high + 1e-9 and np.abs(x[i] + t * d - p).max() < 1e-7:
                found.add(int(i))
    return found


def hardness(x, y, i, m):
    """Of the m nearest rows, those of the other class; at equal distances the own class comes first."""
    d = ((x - x[i]) ** 2).sum(axis=1)
    order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], y[j] != y[i]))[:m]
    return sum(y[j] != y[i] for j in order)


@pytest.mark.parametrize("method", ["smote", "borderline", "adasyn"])
def test_starts_and_lines(table, frame, method):
    x, y, scale = scaled(frame)
    own = np.flatnonzero(y == 1)
    m = 5 if method == "adasyn" else 10
    hard = {i: hardness(x, y, i, m) / m for i in own}
    weight = {i: {"smote": 1.0, "borderline": float(0.5 <= h < 1), "adasyn": h}[method] for i, h in hard.items()}
    points, counts = made(table, method=method)
    assert counts[1] == 160
    starts = [i for i in own if weight[i] > 0]
    used = [on_lines(p / scale, x, starts, 5, own, 0, 1) for p in points]
    assert all(used)
    if method == "adasyn":  # shares follow the weights: a row or so more or less for each bucket
        sure = [next(iter(u)) for u in used if len(u) == 1]
        heavy = [i for i in starts if weight[i] >= 0.8]
        assert abs(sum(i in heavy for i in sure) / len(sure) - sum(weight[i] for i in heavy) / sum(weight.values())) < 0.25


def test_support_vectors_and_steps(table, frame):
    x, y, scale = scaled(frame)
    own = np.flatnonzero(y == 1)
    # The separator of least hinge loss, found apart: full-batch sub-gradient steps on the same objective.
    sign = np.where(y == 1, 1.0, -1.0)
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = x / std
    w, b, avg_w, avg_b = np.zeros(2), 0.0, np.zeros(2), 0.0
    for t in range(1, 60001):
        bad = sign * (z @ w + b) < 1
        step = 1.0 / np.sqrt(t)
        w -= step * (-(sign[bad, None] * z[bad]).sum(axis=0) / len(z) + 1e-3 * w)
        b -= step * (-sign[bad].sum() / len(z))
        if t > 30000:
            avg_w, avg_b = avg_w + w / 30000, avg_b + b / 30000
    margin = z @ avg_w + avg_b
    hard = {i: hardness(x, y, i, 10) for i in own}
    close = {i for i in own if abs(margin[i] - 1) < 0.05}  # either side of the margin, as rounding goes
    support = [i for i in own if (margin[i] <= 1 or i in close) and hard[i] < 10]
    danger, safe = [i for i in support if hard[i] >= 5], [i for i in support if hard[i] < 5]
    assert danger and safe and mean is not None
    points, counts = made(table, method="svm")
    assert counts[1] == 160
    between = [bool(on_lines(p / scale, x, danger, 5, own, 0, 1)) for p in points]
    away = [bool(on_lines(p / scale, x, safe, 5, own, -0.5, 0)) for p in points]
    assert all(a or b for a, b in zip(between, away, strict=True))
    share = np.random.default_rng(42).beta(10, 10)
    assert abs(sum(between) - share * len(points)) <= 0.15 * len(points)


def test_clusters_and_their_allotment(spark, table, frame):
    x, y, scale = scaled(frame)
    points = balance._points(table, "y", COLUMNS, 1, scale.tolist())
    place = balance.clusters(points, ["x0", "x1"], F.col("own") + F.col("oth"), 4)
    got = {(round(r.x0, 9), round(r.x1, 9)): r.i for r in points.select("x0", "x1", place.alias("i")).collect()}
    label = np.array([got[round(p, 9), round(q, 9)] for p, q in x])
    centres = np.array([x[label == i].mean(axis=0) for i in range(4)])
    assert (((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all()  # Lloyd's fixed point
    need, k = 160 - 47, 2
    sparse = {}
    for i in range(4):
        mine = x[(label == i) & (y == 1)]
        if len(mine) / (label == i).sum() >= need / len(x) / 2 and len(mine) > k:
            pairs = ((mine[:, None] - mine[None]) ** 2).sum(axis=2)
            mean = np.sqrt(pairs.sum() / (len(mine) * (len(mine) - 1)))
            sparse[i] = mean ** (np.emath.logn(1.6, len(x)) ** 1.8 * 0.16) / len(mine)
    want = {i: v / sum(sparse.values()) for i, v in sparse.items()}
    sizes = [{"i": i, "rows": int((label == i).sum()), "own": int(((label == i) & (y == 1)).sum()), "spread": float(x[(label == i) & (y == 1)].var(axis=0).sum()) if ((label == i) & (y == 1)).any() else 0.0} for i in range(4)]
    assert balance.allotment(sizes, need, len(x), 2, k) == pytest.approx(want) and 0 < len(want) < 4
    new, counts = made(table, method="kmeans", groups=4)
    assert counts[1] == 160
    made_in = {i: 0 for i in want}
    for p in new / scale:
        homes = {int(label[s]) for i in want for s in on_lines(p, x, np.flatnonzero((label == i) & (y == 1)), k, np.flatnonzero((label == i) & (y == 1)), 0, 1)}
        assert homes
        made_in[min(homes)] += 1
    assert all(abs(made_in[i] - want[i] * need) <= 3 for i in want)
    assert balance.allotment([{"i": 0, "rows": 10, "own": 1, "spread": 1.0}], 5, 10, 2) == {}
    thin = table.where("y = 0 or id % 9 = 0")  # the class has a share of no cluster
    got = balance.smote(thin, "y", COLUMNS, "kmeans", groups=2)
    assert got.where("y = 1").count() == 160


def test_random_methods_row_by_row(table, frame):
    under = balance.random_under(table, "y", ["id"]).toPandas()
    assert (under.y == 1).sum() == 47 == (under.y == 0).sum() and under.id.is_unique
    u = {r.id: r.u for r in table.where("y = 0").select("id", balance._rank_within(table, "y", ["id"], 42).alias("u")).collect()}
    assert sorted(under[under.y == 0].id) == sorted(sorted(u, key=lambda i: (u[i], i))[:47])
    over = balance.random_over(table, "y", ["id"]).toPandas()
    times = over[over.y == 1].id.value_counts()
    assert len(times) == 47 and times.sum() == 160 and set(times) <= {3, 4} and (over.y == 0).sum() == 160


def test_near_minority(table, frame):
    x, y, _ = scaled(frame.assign(y=0), 0)
    y = frame.y.to_numpy()
    big, few = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    mean = {i: np.sort(np.sqrt(((x[few] - x[i]) ** 2).sum(axis=1)))[:3].mean() for i in big}
    kept = balance.near_minority(table, "y", COLUMNS, 60).toPandas()
    assert sorted(kept[kept.y == 0].id) == sorted(sorted(big, key=mean.get)[:60]) and (kept.y == 1).sum() == 47
    assert balance.near_minority(table, "y", COLUMNS, 500).count() == table.count()


def test_hybrid_mix(table):
    """The smaller class grows to half of the largest, then the largest is cut to that over 0.7."""
    out = balance.balance(table, "y", COLUMNS, ["id"], "hybrid_mix")
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {1: 80, 0: int(80 / 0.7)}


def test_self_paced(table):
    assert balance.self_paced_wants({"a": 100, "b": 25, "c": 60, "d": 1}) == {"b": 65, "d": 73}
    out = balance.balance(table, "y", COLUMNS, ["id"], "self_paced")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 160, 1: min(int(47 + 160 * (1 - (47 / 160) ** 0.5) * 0.8), 159)}


def test_hardness_quota():
    sizes, means = [50, 20, 0, 5], [0.1, 0.4, 0.0, 0.9]
    w = np.array([1 / 0.3, 1 / 0.6, 0.0, 1 / 1.1])
    plain = [min(n, int(30 * v / w.sum())) for n, v in zip(sizes, w, strict=True)]
    plain[0] += 30 - sum(plain)
    assert balance.hardness_quota(sizes, means, 0.2, 30) == plain
    assert balance.hardness_quota([3, 2], [0.5, 0.5], 1.0, 10) == [3, 2] and balance.hardness_quota([0, 0], [0.0, 0.0], 1.0, 4) == [0, 0]


def test_self_paced_under_by_bins(table, frame, monkeypatch):
    """Rows of each bin in the last round equal a plain version that is given the same models."""
    seen = []
    whole = balance._logistic
    monkeypatch.setattr(balance, "_logistic", lambda df, x, one: seen.append(whole(df, x, one)) or seen[-1])
    out = balance.self_paced_under(table, "y", COLUMNS, ["id"], rounds=3, bins=5).toPandas()
    assert (out.y == 1).sum() == 47 == (out.y == 0).sum() and out.id.is_unique
    scores = table.where("y = 0").select("id", *[s.alias(f"s{i}") for i, s in enumerate(seen)], balance._rank_within(table, "y", ["id"], 45).alias("u")).toPandas()
    hard = 1 - scores[["s0", "s1", "s2"]].mean(axis=1)
    place = np.minimum(4, np.floor((hard - hard.min()) / (hard.max() - hard.min()) * 5)).astype(int)
    sizes = [int((place == b).sum()) for b in range(5)]
    # In the last round every bin that has rows gets the same share.
    quota = balance.hardness_quota(sizes, [hard[place == b].mean() if n else 0.0 for b, n in enumerate(sizes)], 1e300, 47)
    want = [i for b in range(5) for i in scores[place == b].sort_values(["u", "id"]).id[: quota[b]]]
    assert sorted(out[out.y == 0].id) == sorted(want)
    with pytest.raises(OperatorError):
        balance.self_paced_under(table.withColumn("y", F.col("id") % 3), "y", COLUMNS, ["id"])


def test_self_paced_under_works_its_table_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(300).selectExpr("id", "sin(id) + if(id % 5 = 0, 1, 0) as a", "cos(id * 3) as b", "cast(id % 5 = 0 as int) as y").mapInPandas(tell, "id long, a double, b double, y int")
    got = balance.self_paced_under(df, "y", COLUMNS, ["id"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 60, 1: 60} and seen.value == 300
