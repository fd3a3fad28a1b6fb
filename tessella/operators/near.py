"""Exact nearest neighbours over all rows: distinct points in cells of a k-d tree, with bounds that say which cells to look into.

Copies of a point are one point with counts, so a value that holds many rows costs no more than another. Each point is first
compared with its own cell; it goes to another cell only if that cell's box is nearer than its k-th neighbour so far. Which cells
these are is found from the root of the tree down: a branch whose box is too far is not entered, so a task looks at the cells near
its own and not at all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.store import Store

#: Distinct points of a cell, about, and cells at most; points of each cell that its cuts are chosen from.
CELL = 2000
CELLS = 65_536
SAMPLED = 16


def _splits(x: np.ndarray, cells: int) -> list:
    """A k-d tree as nested [dimension, cut, below, at or above]; leaves are numbers."""
    leaves = [0]

    def grow(part: np.ndarray, want: int):
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        dim = int(spread.argmax())
        cut = float(np.median(part[:, dim])) if want > 1 and spread[dim] > 0 else None
        if cut is not None and not (part[:, dim] < cut).any():
            cut = float(part[:, dim][part[:, dim] > cut].min())
        if cut is None:
            leaves[0] += 1
            return leaves[0] - 1
        low = part[:, dim] < cut
        return [dim, cut, grow(part[low], want // 2), grow(part[~low], want - want // 2)]

    return grow(x, cells)


def _some(points: DataFrame, want: int, many: int) -> DataFrame:
    """About `want` of so many distinct points, chosen by hash. No order is asked for: each task would send the driver as many points."""
    return points.where(F.pmod(F.xxhash64(*points.columns), F.lit(1 << 32)) < F.lit(int(min(1.0, want / many) * (1 << 32))))


def dealer(points: DataFrame, xs: list[str], cells: int, many: int, near: int | None = None):
    """A k-d tree of about so many cells of the distinct points, by the first `near` of their numbers, and what adds the column cell."""
    tree = _splits(_some(points.select(*xs), SAMPLED * 4 * cells if cells < 4096 else SAMPLED * cells, many).toPandas().to_numpy(float)[:, :near], cells) if cells > 1 else 0

    def place(batches):
        for b in batches:
            yield b.assign(cell=_leaf(tree, b[xs[:near]].to_numpy(float)))

    return tree, lambda df: df.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", cell long")


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree)
    out = np.empty(len(x), np.int64)
    low = x[:, tree[0]] < tree[1]
    out[low], out[~low] = _leaf(tree[2], x[low]), _leaf(tree[3], x[~low])
    return out


def closest(q: np.ndarray, r: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the squared distances and places of its k nearest rows of r; ties: the first place."""
    if not len(r):
        return [(np.zeros(0), np.zeros(0, int))] * len(q)
    out = []
    step = max(1, 2_000_000 // len(r))
    for i in range(0, len(q), step):
        d = np.zeros((len(q[i : i + step]), len(r)))
        for j in range(r.shape[1]):
            d += (q[i : i + step, j, None] - r[None, :, j]) ** 2
        cut = np.partition(d, min(k, len(r)) - 1, axis=1)[:, min(k, len(r)) - 1]
        row, col = np.nonzero(d <= cut[:, None])
        o = np.lexsort((col, d[row, col], row))
        row, col = row[o], col[o]
        at = np.searchsorted(row, np.arange(len(d) + 1))
        out += [(d[a, col[s : min(e, s + k)]], col[s : min(e, s + k)]) for a, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True))]
    return out


class Tree:
    """The boxes of cells and of all branches above them, with how many points of each kind they hold."""

    def __init__(self, tree, low: np.ndarray, high: np.ndarray, have: dict[str, np.ndarray], ids: np.ndarray):
        at = {int(c): i for i, c in enumerate(ids)}
        dims = low.shape[1]
        self.low, self.high, self.have, self.down, self.up = [], [], {n: [] for n in have}, [], {}
        self.leaf: dict[int, int] = {}

        def add(node, above: int) -> int:
            me = len(self.low)
            self.up[me] = above
            for part in (self.low, self.high, self.down, *self.have.values()):
                part.append(None)
            if isinstance(node, int):
                i = at.get(node)
                self.low[me], self.high[me] = (np.full(dims, np.inf), np.full(dims, -np.inf)) if i is None else (low[i], high[i])
                for n in have:
                    self.have[n][me] = 0 if i is None else int(have[n][i])
                self.down[me] = (node,)
                self.leaf[node] = me
                return me
            a, b = add(node[2], me), add(node[3], me)
            self.down[me] = (a, b)
            self.low[me], self.high[me] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
            for n in have:
                self.have[n][me] = self.have[n][a] + self.have[n][b]
            return me

        add(tree, -1)

    def reach(self, cell: int, at: np.ndarray, kind: str, k: int) -> np.ndarray:
        """A squared distance within which each point of a cell has k of a kind: to the far corner of the least branch with as many."""
        node = self.leaf[cell]
        while node >= 0 and self.have[kind][node] < k:
            node = self.up[node]
        if node < 0:
            return np.full(len(at), np.inf)
        return (np.maximum(np.abs(self.low[node] - at), np.abs(self.high[node] - at)) ** 2).sum(axis=1)

    def within(self, at: np.ndarray, bound: np.ndarray, kind: str) -> list[tuple[int, np.ndarray]]:
        """(cell, places of the points that have to look into it)."""
        out, todo = [], [(0, np.arange(len(at)))]
        while todo:
            node, who = todo.pop()
            if not self.have[kind][node]:
                continue
            p = at[who]
            who = who[(np.maximum(np.maximum(self.low[node] - p, p - self.high[node]), 0) ** 2).sum(axis=1) <= bound[who] * (1 + 1e-9)]
            if len(who):
                below = self.down[node]
                if len(below) == 1:
                    out.append((below[0], who))
                else:
                    todo += [(b, who) for b in below]
        return out


def nearest(points: DataFrame, dims: int, kinds: dict[str, int], asks: Column, carried: int = 0) -> DataFrame:
    """For each point that `asks`, its nearest points of each kind: near_<kind>, an array of (d, v, n) by distance and then by v.

    points: distinct x0, x1, ... with a count for each kind; kinds: how many points to find of each. A point of a kind (count
    above 0) is among its own neighbours, at distance 0. The last `carried` numbers of a point have no part in distances; they
    come first in v, so at equal distances they decide. The result stands in a table (see store.release); what it was made from goes.
    """
    xs, names, near = [f"x{i}" for i in range(dims)], list(kinds), dims - carried
    told = xs[near:] + xs[:near]
    spark = points.sparkSession
    found = ", ".join(f"near_{n} array<struct<d double, v array<double>, n long>>" for n in names)
    head = ", ".join(f"{x} double" for x in xs)

    def lists(q: np.ndarray, part, n: str) -> list:
        r = part[part[n] > 0].sort_values(told)
        v, m, at = r[told].to_numpy(float), r[n].to_numpy(), r[xs[:near]].to_numpy(float)
        return [[{"d": float(d), "v": v[j].tolist(), "n": int(m[j])} for d, j in zip(*pair, strict=True)] for pair in closest(q[:, :near], at, kinds[n])]

    with Store(spark) as store:
        points = store.table(points.select(*xs, *names, asks.alias("asks")), "points")
        many = points.count()
        cells = min(CELLS, many // CELL)
        tree, place = dealer(points, xs, cells, many, near)
        dealt = store.table(place(points), "dealt")
        box = dealt.groupBy("cell").agg(*[f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(n) > 0).alias(n) for n in names]).orderBy("cell").toPandas()
        boxes = Tree(tree, box[[f"lo{x}" for x in xs[:near]]].to_numpy(float), box[[f"hi{x}" for x in xs[:near]]].to_numpy(float), {n: box[n].to_numpy() for n in names}, box["cell"].to_numpy())

        def home(part):
            import pandas as pd

            mine = part[part["asks"]]
            q = mine[xs].to_numpy(float)
            out = mine[xs + names].copy()
            go: list[set[int]] = [set() for _ in range(len(q))]
            cell = int(part["cell"].iloc[0]) if len(part) else -1
            for n in names:
                out[f"near_{n}"] = pd.Series(lists(q, part, n), index=out.index, dtype=object)
                if cells < 2 or not len(q):
                    continue
                last = np.array([got[-1]["d"] if len(got) == kinds[n] else np.inf for got in out[f"near_{n}"]])
                for other, who in boxes.within(q[:, :near], np.minimum(last, boxes.reach(cell, q[:, :near], n, kinds[n])), n):
                    for i in who.tolist() if other != cell else ():
                        go[i].add(other)
            out["others"] = pd.Series([sorted(g) for g in go], index=out.index, dtype=object)
            return out

        first = dealt.groupBy("cell").applyInPandas(home, f"{head}, {', '.join(f'{n} long' for n in names)}, {found}, others array<long>")
        if cells < 2:
            return Store.kept(spark).table(first.drop("others"), "nearest")
        first = store.table(first, "home")

        def away(asked, part):
            import pandas as pd

            out = asked[xs].copy()
            q = out.to_numpy(float)
            for n in names:
                # A cell that no point asks for gives no rows: its empty column has to be of objects too.
                out[f"near_{n}"] = pd.Series(lists(q, part, n), index=out.index, dtype=object)
            return out

        asked = first.select(*xs, F.explode("others").alias("cell"))
        more = asked.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInPandas(away, f"{head}, {found}")
        both = first.drop("others").unionByName(more.select(*xs, *[F.lit(None).cast("long").alias(n) for n in names], *[f"near_{n}" for n in names]))
        merged = both.groupBy(*xs).agg(
            *[F.max(n).alias(n) for n in names],
            *[F.slice(F.array_sort(F.flatten(F.collect_list(f"near_{n}"))), 1, kinds[n]).alias(f"near_{n}") for n in names],
        )
        return Store.kept(spark).table(merged, "nearest")
