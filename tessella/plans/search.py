"""Search for features: a tree of candidate expressions, evaluated a level at a time, then refined.

Nodes hold operators, not data. A level's candidates are one projection, and their scores a few aggregates over it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import registry
from tessella.operators import clean, evaluate, learn, profile
from tessella.registry import Fitted, OperatorError, corr, numeric, stats
from tessella.sources.store import Store

#: Search limits and cuts.
LIMITS = {"max_depth": 3, "max_per_level": 30, "min_gain": 0.01, "max_redundancy": 0.95, "timeout": 3600.0, "measures": "linear"}

#: How readable an operator's result is, from 0 to 1.
READABLE = {"log": 0.8, "sqrt": 0.8, "square": 0.8, "cube": 0.7, "standardize": 0.7, "min_max_scale": 0.8, "reciprocal": 0.6, "sum": 0.9, "difference": 0.9, "product": 0.7, "ratio": 0.8, "polynomial": 0.4, "label_encode": 0.7, "frequency_encode": 0.8, "target_encode": 0.6, "hash_encode": 0.2, "word_count": 1.0, "char_count": 1.0, "lag": 0.9, "rolling_mean": 0.8}

DEFAULTS = {
    "numeric": ["log", "sqrt", "square", "standardize", "min_max_scale", "robust_scale", "winsorize"], "categorical": ["label_encode", "frequency_encode", "count_encode", "hash_encode"],
    "datetime": ["extract_month", "extract_dayofweek", "is_weekend", "extract_hour"], "text": ["word_count", "char_count", "sentiment_score", "readability_score"], "boolean": [],
}


@dataclass
class Node:
    """A candidate: an operator applied to its parent's column."""

    name: str
    op: str | None = None
    parent: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    depth: int = 0
    importance: float = 0.0
    gain: float = 0.0
    redundancy: float = 0.0
    selected: bool = False
    explored: bool = False


class Tree:
    """Nodes by name; a name that is there already is not added again."""

    def __init__(self, max_depth: int = 3):
        self.nodes: dict[str, Node] = {}
        self.max_depth = max_depth

    def root(self, column: str) -> Node:
        return self.nodes.setdefault(column, Node(column, explored=True))

    def add(self, parent: str, op: str, **params: Any) -> Node | None:
        above, name = self.nodes[parent], f"{op}({parent})"
        if above.depth >= self.max_depth or name in self.nodes:
            return None
        self.nodes[name] = Node(name, op, parent, params, above.depth + 1)
        return self.nodes[name]

    def build(self, df: DataFrame, recommended: dict[str, list[str]] | None = None, target: str | None = None) -> Tree:
        """Roots and first candidates: recommended operators, or those of the column's type. The target is no root."""
        for c, kind in profile.infer_types(df).items():
            if c == target or kind == "other":
                continue
            self.root(c)
            for op in (recommended or {}).get(c) or DEFAULTS.get(kind, []):
                self.add(c, op)
        return self

    def lineage(self, name: str) -> list[Node]:
        """From the first operator to the node."""
        out: list[Node] = []
        node = self.nodes[name]
        while node.op is not None:
            out.insert(0, node)
            node = self.nodes[node.parent]  # type: ignore[index]
        return out

    def level(self, depth: int) -> list[Node]:
        return [n for n in self.nodes.values() if n.depth == depth]

    def best(self, k: int = 10, least: float = 0.0) -> list[Node]:
        return sorted((n for n in self.nodes.values() if n.op and n.importance >= least), key=lambda n: (-n.importance, n.name))[:k]

    def prune(self, max_redundancy: float = 0.95) -> list[str]:
        """Remove candidates that are too redundant, with what grows from them."""
        gone = {n.name for n in self.nodes.values() if n.op and n.redundancy > max_redundancy}
        for n in sorted(self.nodes.values(), key=lambda n: n.depth):
            if n.parent in gone:
                gone.add(n.name)
        for g in gone:
            del self.nodes[g]
        return sorted(gone)

    def to_dict(self) -> dict[str, Any]:
        return {"max_depth": self.max_depth, "nodes": [asdict(n) for n in self.nodes.values()]}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Tree:
        t = Tree(d["max_depth"])
        t.nodes = {n["name"]: Node(**n) for n in d["nodes"]}
        return t

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f)

    @staticmethod
    def load(path: str) -> Tree:
        with open(path, encoding="utf-8") as f:
            return Tree.from_dict(json.load(f))

    def to_dot(self) -> str:
        """The tree in the DOT language."""
        lines = [f'  "{n.parent}" -> "{n.name}" [label="{n.op}"];' for n in self.nodes.values() if n.parent]
        return "digraph features {\n" + "\n".join(lines) + "\n}"


def apply_chain(df: DataFrame, chain: list[Node]) -> DataFrame:
    """Add the columns of a lineage that are not there yet."""
    for n in chain:
        if n.name not in df.columns:
            df = registry.fit(df, n.op, n.parent, out=n.name, **n.params).transform(df)  # type: ignore[arg-type]
    return df


def _as_number(df: DataFrame, column: str):
    kind = dict(df.dtypes)[column]
    return F.col(f"`{column}`").cast("double") if kind == "boolean" else numeric(df, column)


Measured = tuple[float, float]


class _Level:
    """Measures of a level's fitted candidates against the target and the base columns."""

    def __init__(self, df: DataFrame, target: str, base: list[str], categories: list[str], store: Store):
        self.target, self.base, self.categories, self.store = target, base, categories, store
        self.whole = {c: _as_number(df, c) for c in [target, *base]}
        means = stats(df, **{f"m{i}": F.avg(x) for i, x in enumerate(self.whole.values())})
        self.centred = [x - F.lit(means[f"m{i}"] or 0.0) for i, x in enumerate(self.whole.values())]

    def beside(self) -> dict[str, Column]:
        """What must be known of each key besides: rows, sum and squares of the target and of each base column."""
        return {f"{n}{i}": f(x) for i, x in enumerate(self.centred) for n, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))}

    def linear(self, wide: DataFrame, fitted: list[Fitted], categories: registry.Categories | None, at: list[int]) -> list[Measured]:
        """(importance, redundancy) by correlations: columns made from the row in one pass over the rows, those looked up by key in one
        pass over the aggregates of the keys."""
        looked = {i for i, f in enumerate(fitted) if f.lookup is not None and categories is not None and at[i] in categories.columns}
        plain = [i for i in range(len(fitted)) if i not in looked]
        for i in plain:
            if fitted[i].lookup is not None:
                wide = fitted[i].transform(wide)
        r: dict[tuple[int, int], float] = {}
        if plain:
            columns = {i: F.col(f"`{fitted[i].out}`") if fitted[i].lookup is not None else fitted[i].column() for i in plain}
            kinds = dict(wide.select(*[c.alias(f"c{i}") for i, c in columns.items()]).dtypes)
            x = {i: F.lit(None).cast("double") if kinds[f"c{i}"] == "string" else c for i, c in columns.items()}
            got = evaluate.many_correlations(wide, {str(i): c for i, c in x.items()}, {str(j): y for j, y in enumerate(self.whole.values())})
            r |= {(int(i), int(j)): abs(v or 0.0) for (i, j), v in got.items()}
        if looked:
            parts = []
            for i in sorted(looked):
                names = categories.columns[at[i]]  # type: ignore[union-attr]
                there = [F.col(a).alias(n) for n, a in names.items()] + ([F.col("code")] if "code" in categories.table.columns else [])  # type: ignore[union-attr]
                mine = categories.table.where(F.col("c") == categories.numbers[at[i]])  # type: ignore[union-attr]
                mine = mine.withColumn(registry.HIT, F.when(F.col("key").isNotNull(), F.struct(*there)))
                parts.append(mine.select(F.lit(i).alias("i"), fitted[i].column().cast("double").alias("x"), *[f"{n}{j}" for j in range(len(self.whole)) for n in "nsq"]))
            rows = reduce(DataFrame.unionByName, parts).where("x is not null")
            sums = [g.alias(f"{n}{j}") for j in range(len(self.whole)) for n, g in (("n", F.sum(f"n{j}")), ("x", F.sum(F.col("x") * F.col(f"n{j}"))), ("y", F.sum(f"s{j}")), ("a", F.sum(F.col("x") * F.col("x") * F.col(f"n{j}"))), ("b", F.sum(f"q{j}")), ("p", F.sum(F.col("x") * F.col(f"s{j}"))))]
            for row in rows.groupBy("i").agg(*sums).collect():
                r |= {(row["i"], j): abs(evaluate.pearson(*(row[f"{n}{j}"] or 0.0 for n in "nxyabp")) or 0.0) for j in range(len(self.whole))}
        return [(r.get((i, 0), 0.0), max((r.get((i, j), 0.0) for j in range(1, len(self.whole))), default=0.0)) for i in range(len(fitted))]

    def ranked(self, wide: DataFrame, names: list[str]) -> list[Measured]:
        """(importance, redundancy) by mutual information and by ranks or Cramer's V, all candidates together."""
        keep = self.store.table
        mi = evaluate.many_mutual_information(wide, names, self.target, keep=keep)
        told = rank_redundancies(wide, names, self.base, self.categories, keep)
        return [(mi[n], told[n]) for n in names]


def search(df: DataFrame, target: str, tree: Tree | None = None, limits: dict[str, Any] | None = None, heuristic: Callable[[DataFrame, str, str], float] | None = None) -> list[dict[str, Any]]:
    """Explore the tree level by level. A candidate's importance is the absolute correlation with the target, its gain that over
    its root's, its redundancy the largest absolute correlation with a column of the input. Candidates over the gain and under
    the redundancy cut are selected, the best first, and grow the next level. With the limit measures="rank", importance is mutual
    information in nats, and redundancy is the largest absolute Spearman correlation with a number (missing values count as the
    median), or for texts Cramer's V with a category; over half of the values missing is full redundancy.

    A level's candidates are fitted together and measured together, so the number of passes does not depend on theirs. Only
    selected candidates become columns of the table."""
    limits = LIMITS | (limits or {})
    tree = tree or Tree(limits["max_depth"]).build(df, recommend(df, target), target)
    base, categories = clean.numeric_columns(df, (target,)), clean.category_columns(df, (target,))
    began, wide, ranked = time.time(), df, limits["measures"] == "rank"
    picked: list[Node] = []
    with Store(df.sparkSession) as store:
        level = _Level(df, target, base, categories, store)
        if ranked:
            known = evaluate.many_mutual_information(df, [*base, *categories], target, keep=store.table)
        else:
            row = stats(df, **{f"r{i}": corr(numeric(df, c), level.whole[target]) for i, c in enumerate(base)}) if base else {}
            known = {c: abs(row.get(f"r{i}") or 0.0) for i, c in enumerate(base)}
        for depth in range(1, limits["max_depth"] + 1):
            todo = [n for n in tree.level(depth) if not n.explored and n.parent in wide.columns]
            if not todo or time.time() - began > limits["timeout"]:
                break
            for n in todo:
                n.explored = True
            fits = registry.fit_many(wide, [(n.op, [n.parent], n.name, n.params) for n in todo], "skip", store.table, level.beside())  # type: ignore[list-item]
            at = [i for i, f in enumerate(fits) if f is not None]
            ready, fitted = [todo[i] for i in at], [fits[i] for i in at]
            if ranked:
                full = wide
                for f in fitted:
                    full = f.transform(full)
                found = level.ranked(full, [n.name for n in ready]) if ready else []
            else:
                found = level.linear(wide, fitted, fits.categories, at)  # type: ignore[attr-defined,arg-type]
            for n, f, (importance, redundancy) in zip(ready, fitted, found, strict=True):
                n.importance = heuristic(f.transform(wide), n.name, target) if heuristic else importance
                n.gain = n.importance - known.get(tree.lineage(n.name)[0].parent, 0.0)  # type: ignore[arg-type]
                n.redundancy = redundancy
            good = sorted((n for n in ready if n.gain > limits["min_gain"] and n.redundancy < limits["max_redundancy"]), key=lambda n: (-n.gain * (1 - n.redundancy) * max(n.importance, 1e-9), n.name))[: limits["max_per_level"]]
            by = {n.name: f for n, f in zip(ready, fitted, strict=True)}
            for n in good:
                n.selected = True
                picked.append(n)
                wide = by[n.name].transform(wide)
                for op in DEFAULTS["numeric"][:3]:
                    tree.add(n.name, op)
    return [{"feature": n.name, "importance": n.importance, "gain": n.gain, "redundancy": n.redundancy, "chain": [x.op for x in tree.lineage(n.name)]} for n in picked]


def rank_redundancies(df: DataFrame, columns: list[str], numbers: list[str], categories: list[str], keep: evaluate.Keep) -> dict[str, float]:
    """Of each column, the largest absolute Spearman correlation with one of the numbers, or for texts and booleans Cramer's V with
    one of the categories; over half of the values missing is 1. All columns together."""
    if not columns:
        return {}
    kinds = dict(df.dtypes)
    missing = stats(df, **{f"m{i}": F.avg(F.col(f"`{c}`").isNull().cast("double")) for i, c in enumerate(columns)})
    there = [c for i, c in enumerate(columns) if (missing[f"m{i}"] or 0.0) <= 0.5]
    texts = [c for c in there if kinds[c] in ("string", "boolean")]
    pairs = [(c, d) for c in texts for d in categories if c != d]
    v = dict(zip(pairs, evaluate.many_cramers_v(df, pairs, keep), strict=True))
    r = evaluate.many_rank_correlations(df, [c for c in there if c not in texts], numbers, keep)
    found = {c: 1.0 for c in columns} | {c: 0.0 for c in there}
    for (c, _), x in [*v.items(), *r.items()]:
        found[c] = max(found[c], abs(x or 0.0))
    return found


def rank_redundancy(df: DataFrame, column: str, numbers: list[str], categories: list[str]) -> float:
    """rank_redundancies() of one column."""
    with Store(df.sparkSession) as store:
        return rank_redundancies(df, [column], numbers, categories, store.table)[column]


def recommendation_quality(df: DataFrame, recommended: dict[str, list[str]]) -> dict[str, list[tuple[str, float]]]:
    """Each recommended operator's score from 0 to 1, best first: 0.5, and for numbers 0.7 of the share of skewness that goes less
    0.3 of the share of values that go missing. Operators that fail, or give nothing but nulls, are left out."""
    out: dict[str, list[tuple[str, float]]] = {}
    for c, ops in recommended.items():
        scores = []
        for op in ops:
            try:
                done = registry.fit(df, op, c, out="__made").transform(df)
            except OperatorError:
                continue
            kind = dict(done.dtypes)["__made"]
            row = stats(done, n=F.count("*"), there=F.count("__made"), was=F.count(F.col(f"`{c}`")))
            if not row["there"]:
                continue
            score = 0.5
            if kind not in ("string", "boolean") and not kind.startswith(("array", "date", "timestamp")):
                shape = profile.numeric_profile(done.select(F.col("__made").cast("double").alias("m"), *([numeric(df, c).alias("o")] if c in clean.numeric_columns(df) else [])))
                after = abs(shape["m"]["skewness"] or 0.0)
                before = abs(shape["o"]["skewness"] or 0.0) if "o" in shape else float("inf")
                gain = max(0.0, min(1.0, 1.0 if before == float("inf") else (before - after) / max(1.0, before)))
                score = max(0.0, min(1.0, 0.7 * gain - 0.3 * max(0.0, (row["was"] - row["there"]) / row["n"]) + 0.5))
            scores.append((op, score))
        if scores:
            out[c] = sorted(scores, key=lambda s: (-s[1], s[0]))
    return out


class MetaModel:
    """What an operator is likely to gain on a table, learned from a history: a forest over the table's fingerprint beside one
    number for each operator, 0 or 1."""

    def __init__(self, spark: SparkSession, history: list[dict[str, Any]], trees: int = 50, seed: int = 42):
        self.spark, self.seed = spark, seed
        self.features = sorted({k for h in history for k in h["fingerprint"]})
        self.ops = sorted({op for h in history for op in h["gains"]})
        rows = [[*self._row(h["fingerprint"], op), float(g)] for h in history for op, g in h["gains"].items()]
        self.model = None
        if len(rows) > 1:
            df = self._frame(rows, [*self._names(), "gain"])
            self.model = learn.forest("regression", trees, seed=seed).fit(learn.vectors(df, self._names(), "gain"))

    def _names(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.features) + len(self.ops))]

    def _row(self, mark: dict[str, float], op: str) -> list[float]:
        return [*(float(mark.get(k, 0.0)) for k in self.features), *(float(op == o) for o in self.ops)]

    def _frame(self, rows: list[list[float]], names: list[str]) -> DataFrame:
        return self.spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))

    def predict(self, df: DataFrame, target: str | None = None, k: int = 5, default: float = 0.01) -> list[tuple[str, float]]:
        """The k operators of the largest expected gain; each has `default` where there is too little history."""
        if self.model is None:
            return [(op, default) for op in self.ops[:k]]
        mark = fingerprint(df, target)
        rows = self._frame([[*self._row(mark, op), float(i)] for i, op in enumerate(self.ops)], [*self._names(), "op"])
        got = self.model.transform(learn.vectors(rows, self._names())).select("op", "prediction").collect()
        return sorted(((self.ops[int(r["op"])], float(r["prediction"])) for r in got), key=lambda x: (-x[1], x[0]))[:k]


def recommend(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Operators by type and skew, three for a number at most: a long upper tail of positives asks for log and sqrt, a long
    lower tail for square and reciprocal."""
    kinds, number = profile.infer_types(df), profile.numeric_profile(df)
    out = {}
    for c, kind in kinds.items():
        if c == target:
            continue
        if kind == "numeric":
            v, ops = number[c], []
            if (v["skewness"] or 0) > 1 and (v["min"] or 0) > 0:
                ops += ["log", "sqrt"]
            elif (v["skewness"] or 0) < -1:
                ops += ["square", "reciprocal"]
            out[c] = [*ops, "standardize", "min_max_scale"][:3]
        elif kind in DEFAULTS:
            out[c] = DEFAULTS[kind][:3]
    return out


def recommend_by_history(df: DataFrame, history: list[dict[str, Any]], target: str | None = None, least: float = 0.7, most: int = 5) -> dict[str, list[str]]:
    """Operators that gained on similar tables (similarity times gain of at least `least` of the best), else the defaults."""
    mine, score = fingerprint(df, target), {}
    for h in history:
        s = similarity(mine, h["fingerprint"])
        for op, gain in h["gains"].items():
            score[op] = max(score.get(op, 0.0), s * gain)
    if not score:
        return recommend(df, target)
    best = max(score.values())
    good = [op for op in sorted(score, key=lambda o: (-score[o], o)) if score[op] >= least * best][:most]
    return {c: [op for op in good if op in registry.names() and registry.category_of(op) == kind] or recommend(df.select(c))[c] for c, kind in profile.infer_types(df).items() if c != target and kind in DEFAULTS}


def refine(df: DataFrame, target: str, found: list[dict[str, Any]], task: str = "regression", cut: float = 0.95, top: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> list[dict[str, Any]]:
    """Drop features correlated beyond the cut with a better one, order the rest by gain, importance and readability, and keep
    the top ones by mutual information with the target."""
    names = [f["feature"] for f in found]
    corr = clean.correlations(df, [n for n in names if n in clean.numeric_columns(df)])
    kept: list[dict[str, Any]] = []
    for f in sorted(found, key=lambda f: (-f["importance"], f["feature"])):
        if all(abs(corr.get((f["feature"], k["feature"])) or corr.get((k["feature"], f["feature"])) or 0.0) < cut for k in kept):
            kept.append(f)
    for f in kept:
        plain = sum(READABLE.get(op, 0.5) for op in f["chain"]) / len(f["chain"]) / len(f["chain"])
        f["score"] = weights[0] * f["gain"] + weights[1] * f["importance"] + weights[2] * plain
    kept.sort(key=lambda f: (-f["score"], f["feature"]))
    if len(kept) > top:
        mi = evaluate.many_mutual_information(df, [f["feature"] for f in kept], target)
        chosen = set(sorted(mi, key=lambda n: (-mi[n], n))[:top])
        kept = [f for f in kept if f["feature"] in chosen]
    return kept


def fingerprint(df: DataFrame, target: str | None = None) -> dict[str, float]:
    """Sizes, shares of types, missing share and mean shape of a table's numbers."""
    kinds = profile.infer_types(df)
    number = profile.numeric_profile(df)
    mean = lambda k: sum(abs(v[k] or 0.0) for v in number.values()) / len(number) if number else 0.0
    rows = df.count()
    out = {"rows": float(rows), "columns": float(len(kinds)), "missing": mean("missing_share"), "skewness": mean("skewness"), "kurtosis": mean("kurtosis"), "outliers": mean("outlier_share")}
    out |= {f"share_{k}": sum(v == k for v in kinds.values()) / max(1, len(kinds)) for k in ("numeric", "categorical", "text", "datetime")}
    if target:
        out["classes"] = float(df.select(target).distinct().count())
    return out


def similarity(a: dict[str, float], b: dict[str, float]) -> float:
    """1 / (1 + root mean square of relative differences) over what both have."""
    both = [k for k in a if k in b]
    if not both:
        return 0.0
    rel = [abs(a[k] - b[k]) / max(abs(a[k]), abs(b[k]), 1e-9) for k in both]
    return 1 / (1 + (sum(r * r for r in rel) / len(rel)) ** 0.5)


class History:
    """Append-only store of table fingerprints and what operators gained on them, as JSON lines."""

    def __init__(self, path: str):
        self.path = path

    def add(self, df: DataFrame, target: str | None, gains: dict[str, float]) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"fingerprint": fingerprint(df, target), "gains": gains}) + "\n")

    def read(self) -> list[dict[str, Any]]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return [json.loads(x) for x in f]
        except FileNotFoundError:
            return []

    def similar(self, df: DataFrame, target: str | None = None, k: int = 5) -> list[tuple[float, dict[str, Any]]]:
        mine = fingerprint(df, target)
        return sorted(((similarity(mine, h["fingerprint"]), h) for h in self.read()), key=lambda x: -x[0])[:k]


def greedy(df: DataFrame, target: str, task: str, key: list[str], ops: list[str] | None = None, columns: int = 10, least: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Try operators on the strongest columns and keep those that raise the validated score by `least`, relatively; at most
    min(100, three times the columns) are added."""
    nums = clean.numeric_columns(df, (target, *key))
    row = stats(df, **{f"r{i}": corr(numeric(df, c), numeric(df, target)) for i, c in enumerate(nums)})
    strong = sorted(nums, key=lambda c: (-abs(row[f"r{nums.index(c)}"] or 0.0), nums.index(c)))[:columns]
    now, best, kept = list(nums), learn.cross_validate(df, nums, target, task, key, 3)["mean"], []
    for op in ops or ["log_shift", "sqrt_shift", "square"]:
        for c in strong:
            if len(kept) >= min(100, 3 * len(nums)):
                return df, kept
            name = f"{op}({c})"
            wide = registry.apply(df, op, c, out=name, on_error="skip")
            if name not in wide.columns:
                continue
            score = learn.cross_validate(wide, [*now, name], target, task, key, 3)["mean"]
            if score > best * (1 + least) if best > 0 else score > best:
                df, now, best = wide, [*now, name], score
                kept.append(name)
    return df, kept
