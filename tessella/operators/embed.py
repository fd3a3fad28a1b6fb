"""A two-dimensional picture of a table that keeps neighbours together: a neighbour graph, laid out by attraction and repulsion.

Distinct points are joined to their exact nearest ones (near.py). The graph's edges pull; a bounded sample of points, another one
each round, pushes. Edges lie in cells of near points and stay where they are: a round sends each cell the places of its own points
and of the few in other cells that its edges lead to. The places of each round stand in a table, so a lost executor costs one round.
No task sees more than some cells, beside the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import learn
from tessella.operators.near import CELLS, dealer, nearest
from tessella.registry import OperatorError, numeric, spread, stats
from tessella.sources.store import Store

#: The curve 1 / (1 + A * d ** (2 * B)) of how near two places count, for a least distance of 0.1.
A, B = 1.577, 0.895
#: Points that push in a round, and how many of them each unit of an edge's weight asks for.
SAMPLE, NEGATIVES = 256, 5
STEP = 0.35
#: Points of a cell whose edges are worked on together, about.
BLOCK = 20_000


def strengths(d: np.ndarray, k: int) -> np.ndarray:
    """Weights of a point's neighbours at distances d (sorted, itself left out): 1 for the nearest, falling off so that they add up to
    log2(k)."""
    if not len(d):
        return np.zeros(0)
    rho = d[0]
    want, low, high, sigma = np.log2(max(2, min(k, len(d) + 1))), 0.0, np.inf, 1.0
    for _ in range(50):
        total = np.exp(-(d - rho) / sigma).sum()
        if abs(total - want) < 1e-6:
            break
        low, high = (low, sigma) if total > want else (sigma, high)
        sigma = 2 * sigma if np.isinf(high) else (low + high) / 2
    return np.exp(-(d - rho) / max(sigma, 1e-3 * (d.mean() or 1.0)))


def push(y: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The mean repulsion of each place from the others."""
    out = np.zeros_like(y)
    for i in range(0, len(y), 4096):
        d = y[i : i + 4096, None] - others[None]
        q = (d**2).sum(axis=2, keepdims=True)
        out[i : i + 4096] = np.clip(2 * B / ((0.001 + q) * (1 + A * q**B)) * d, -4, 4).mean(axis=1)
    return out


def graph(points: DataFrame, dims: int, k: int, store: Store) -> DataFrame:
    """(cell, i, j, w): the symmetric neighbour graph of points (id, cell, x0, x1, ..., n), with the cell of i. A weight is a + b - a * b
    of the two directions'. Points without a cell are in one."""
    points = points if "cell" in points.columns else points.withColumn("cell", F.lit(0).cast("long"))
    xs = [f"x{d}" for d in range(dims)]
    found = nearest(points.select(*xs, "n"), dims, {"n": k + 1}, F.lit(True))

    def weigh(batches):
        for b in batches:
            b["w"] = [strengths(np.sqrt([s["d"] for s in near[1:]]), k).tolist() for near in b["near_n"]]
            b["v"] = [[list(s["v"]) for s in near[1:]] for near in b["near_n"]]
            yield b[[*xs, "v", "w"]]

    told = found.select(*xs, "near_n").mapInPandas(weigh, ", ".join(f"{x} double" for x in xs) + ", v array<array<double>>, w array<double>")
    far = told.select(*xs, F.explode(F.arrays_zip("v", "w")).alias("s")).select(*xs, F.col("s.v").alias("v"), F.col("s.w").alias("w"))
    ends = points.select(F.col("id").alias("j"), F.col("cell").alias("there"), F.array(*xs).alias("v"))
    one = store.table(far.join(points.select("id", "cell", *xs), xs).join(ends, "v").select("cell", F.col("id").alias("i"), "there", "j", "w"), "directed")
    both = one.select("cell", "i", "j", "w").unionByName(one.select(F.col("there").alias("cell"), F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return store.table(both.groupBy("cell", "i", "j").agg((F.sum("w") - (F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).alias("w")), "graph")


def embed(df: DataFrame, columns: list[str], rounds: int = 50, k: int = 15, prefix: str = "U", seed: int = 42) -> DataFrame:
    """Add U1 and U2, places in a plane where rows that are near in `columns` are near.

    Numbers are standardised, missing ones count as the mean, and equal rows share a place. The start is the first two principal
    components. The same table gives the same places but for the order of sums. Fewer than three distinct points lie on a line by
    their first column; an empty table stays empty. Clashing columns are replaced.
    """
    if not columns:
        raise OperatorError("an embedding needs columns")
    names, dims, spark = [f"{prefix}1", f"{prefix}2"], len(columns), df.sparkSession
    keep = [c for c in df.columns if c not in names]
    row = stats(df, **{f"{n}{i}": f(numeric(df, c)) for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))})
    scaled = [((F.coalesce(numeric(df, c), F.lit(row[f"m{i}"] or 0.0)) - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0) + F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(columns)]
    placed = df.select(*[F.col(f"`{c}`") for c in keep], *scaled)
    mine, xs = [f"__x{i}" for i in range(dims)], [f"x{i}" for i in range(dims)]
    result = Store(spark)  # the result reads it; it goes when the application ends
    with Store(spark) as store:
        points = placed.groupBy(*[F.col(m).alias(x) for m, x in zip(mine, xs, strict=True)]).agg(F.count("*").alias("n"))
        points = store.table(points.withColumn("id", F.monotonically_increasing_id()), "points")
        many = points.count()
        _, place = dealer(points, xs, min(CELLS, many // BLOCK), many)
        points = store.table(place(points), "dealt")
        now = _start(points, xs) if many > 2 else points.select("id", F.col("x0").alias("y0"), F.lit(0.0).alias("y1"))
        if many > 2 and rounds:
            now = _laid_out(now.join(points.select("id", "cell"), "id"), graph(points, dims, min(k, many - 1), store), rounds, seed, store)
        done = result.table(points.join(now, "id").select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(xs)], F.col("y0").alias(names[0]), F.col("y1").alias(names[1])), "places")
    return placed.join(done, [F.col(m) == F.col(f"__k{i}") for i, m in enumerate(mine)], "left").select(*[F.col(f"`{c}`") for c in keep], *names)


def _start(points: DataFrame, xs: list[str]) -> DataFrame:
    """(id, y0, y1): the first two principal components, so scaled that the farthest is at 10."""
    if len(xs) == 1:
        return points.select("id", F.col("x0").alias("y0"), F.lit(0.0).alias("y1"))
    told, _ = learn.pca(points, xs, components=2, prefix="__p")
    top = stats(told, top=F.max(F.greatest(F.abs("__p1"), F.abs("__p2"))))["top"] or 1.0
    return told.select("id", (F.col("__p1") * F.lit(10.0 / top)).alias("y0"), (F.col("__p2") * F.lit(10.0 / top)).alias("y1"))


def _move(others: np.ndarray, step: float):
    def move(e, t):
        """The next places of a cell's own points (those with a degree), from its edges and all places that these lead to."""
        t = t.sort_values("id")
        y, i, j = t[["y0", "y1"]].to_numpy(float), *(np.searchsorted(t["id"].to_numpy(), e[c].to_numpy()) for c in "ij")
        d = y[i] - y[j]
        q = np.maximum((d * d).sum(axis=1), 1e-6)
        g = -2 * A * B * q ** (B - 1) / (1 + A * q**B) * e["w"].to_numpy(float)
        pulled = np.stack([np.bincount(i, g * d[:, k], len(y)) for k in (0, 1)], axis=1)
        own = t["degree"].notna().to_numpy()
        y, pulled, t = y[own], pulled[own], t[own]
        y = y + step * np.clip(pulled / t["degree"].to_numpy(float)[:, None] + NEGATIVES * push(y, others), -4, 4)
        return t.assign(y0=y[:, 0], y1=y[:, 1])[["cell", "id", "y0", "y1", "degree"]]

    return move


def _laid_out(now: DataFrame, edges: DataFrame, rounds: int, seed: int, store: Store) -> DataFrame:
    """Places (id, y0, y1) after all rounds, from those at the start (id, cell, y0, y1)."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("degree"))
    now = store.table(now.join(degree, F.col("id") == F.col("i"), "left").select("cell", "id", "y0", "y1", F.greatest(F.coalesce("degree", F.lit(1.0)), F.lit(1e-6)).alias("degree")), "start")
    beyond = edges.select("cell", F.col("j").alias("id")).distinct()
    beyond = store.table(beyond.join(now.select("cell", "id"), ["cell", "id"], "left_anti"), "beyond")
    # A fixed number of parts by cell, in memory or on the executors' disks: no round moves the edges.
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for r in range(rounds):
            others = np.array([(p.y0, p.y1) for p in now.orderBy(spread("id", seed, r), "id").limit(SAMPLE).select("y0", "y1").collect()], float)
            sent = beyond.join(now.select("id", "y0", "y1"), "id").select("cell", "id", "y0", "y1", F.lit(None).cast("double").alias("degree"))
            met = edges.groupBy("cell").cogroup(now.unionByName(sent).groupBy("cell"))
            now = store.table(met.applyInPandas(_move(others, STEP * (1 - r / rounds)), "cell long, id long, y0 double, y1 double, degree double"), f"round{r}")
    finally:
        edges.unpersist()
    return now.select("id", "y0", "y1")
