"""Beam search over preprocessing configurations, scoring of tables, error recovery, reports and the facade."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import clean, evaluate, learn, profile
from tessella.plans import preprocessor, saved, search
from tessella.registry import OperatorError
from tessella.sources.store import Store

#: Weights of the overall score.
WEIGHTS = {"accuracy": 0.25, "f1": 0.25, "balanced": 0.2, "entropy": 0.1, "completeness": 0.1, "independence": 0.1}


@dataclass
class State:
    """A configuration, what it came from, and its score."""

    name: str
    config: dict[str, Any]
    parent: str | None = None
    score: float = 0.0
    metrics: dict[str, float] = field(default_factory=dict)
    error: str | None = None


def table_score(df: DataFrame, target: str, task: str, key: list[str]) -> dict[str, float]:
    """Validated model scores with the table's completeness, independence of columns and balance of classes."""
    columns = clean.numeric_columns(df, (target, *key))
    if not columns:
        return {"overall": 0.0}
    cv = learn.cross_validate(df, columns, target, task, key, 3)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    full = sum(row[f"c{i}"] for i in range(len(columns))) / max(1, row["n"] * len(columns))
    corr = [abs(r) for r in clean.correlations(df, columns).values() if r is not None]
    out = {"completeness": full, "independence": 1 - sum(corr) / len(corr) if corr else 1.0}
    if task == "classification":
        out |= {"accuracy": cv["metrics"]["accuracy"]["mean"], "f1": cv["metrics"]["weighted_f1"]["mean"], "balanced": (cv["metrics"]["mcc"]["mean"] + 1) / 2, "entropy": evaluate.class_balance(df, target)["entropy"]}
    else:
        r2 = max(0.0, cv["mean"])
        out |= {"accuracy": r2, "f1": r2, "balanced": r2, "entropy": 1.0}
    return out | {"overall": sum(WEIGHTS[k] * out[k] for k in WEIGHTS)}


def adaptive_configs(report: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Configurations that a profile calls for, beside the plain one."""
    out: dict[str, dict[str, Any]] = {"plain": {}}
    n = report["rows"] or 1
    if any(m / n > 0.05 for m in report["missing"].values()):
        out |= {"mean_fill": {"missing": "mean"}} | ({"knn_fill": {"missing": "knn"}} if n < 10_000 else {})
    if any(v["has_outliers"] for v in report["numeric"].values()):
        out["robust"] = {"outliers": "iqr", "scale": "robust"}
    if any(v["skewed"] for v in report["numeric"].values()):
        out["maths"] = {"generate": "maths", "select": "variance"}
    if len(report["numeric"]) > 2:
        out["interactions"] = {"generate": "products", "select": "variance"}
    if (report.get("target") or {}).get("imbalanced"):
        out["over"] = {"balance": "random_over"}
    return out


def beam_search(df: DataFrame, target: str, key: list[str], task: str, configs: dict[str, dict[str, Any]] | None = None, depth: int = 2, width: int = 3, most: int = 20) -> list[State]:
    """Combine configurations level by level and keep the best ones. Every combination is fitted on the raw table, so nothing
    is preprocessed twice; equal combinations are tried once, and one that fails has its error noted."""
    configs = configs or adaptive_configs(profile.analyze(df.drop(*key), target))
    seen, done = set(), []
    frontier = [State("raw", {})]
    for _ in range(depth):
        level = []
        for s in frontier:
            for name, c in configs.items():
                config = s.config | c
                mark = json.dumps(config, sort_keys=True)
                if mark in seen or len(level) >= most:
                    continue
                seen.add(mark)
                state = State(name if s.name == "raw" else f"{s.name}+{name}", config, s.name)
                try:
                    _, out = preprocessor.fit_transform(df, config, target, key, task)
                    lost = validate(df, out, target, task)
                    if lost:
                        raise OperatorError("; ".join(lost))
                    state.metrics = table_score(out, target, task, key)
                    state.score = state.metrics["overall"]
                except OperatorError as e:
                    state.error = str(e)
                level.append(state)
        done += level
        frontier = sorted((s for s in level if s.error is None), key=lambda s: (-s.score, s.name))[:width]
        if not frontier:
            break
    return sorted(done, key=lambda s: (-s.score, s.name))


def validate(before: DataFrame, after: DataFrame, target: str, task: str, loss: float = 0.9) -> list[str]:
    """What went wrong between two tables: over nine tenths of the rows lost, or classes lost."""
    a, b = before.count(), after.count()
    out = [f"{1 - b / a:.0%} of the rows were lost"] if a and b < (1 - loss) * a else []
    if task == "classification" and target in after.columns:
        gone = lost_classes(before, after, target)
        out += [f"classes were lost: {gone}"] if gone else []
    return out


def lost_classes(before: DataFrame, after: DataFrame, target: str) -> list[Any]:
    t = F.col(f"`{target}`").cast("double")
    return sorted(r[0] for r in before.select(t).where(t.isNotNull()).distinct().subtract(after.select(t).distinct()).collect())


def recover_classes(before: DataFrame, after: DataFrame, target: str, rows: int = 50) -> DataFrame:
    """Bring back up to `rows` rows of each class that was lost, each row once; both tables have the same columns. Rows that are
    there stay as they are."""
    for c in lost_classes(before, after, target):
        after = after.unionByName(before.where(F.col(f"`{target}`").cast("double") == c).orderBy(F.xxhash64(*before.columns)).limit(rows).dropDuplicates())
    return after


def safe_fit(df: DataFrame, config: dict[str, Any], target: str | None, key: list[str], task: str = "classification") -> tuple[preprocessor.PreprocessorModel, list[str]]:
    """Fit with a ladder of simpler configurations, and what each failure was."""
    errors: list[str] = []
    for c in (config, config | {"generate": "none", "reduce": None}, {"outliers": None, "generate": "none", "select": "none"}, {}):
        try:
            return preprocessor.fit(df, c, target, key, task), errors
        except (OperatorError, ValueError, ArithmeticError, PySparkException) as e:
            errors.append(f"{type(e).__name__}: {e}")
    raise OperatorError("; ".join(errors))


def post_process(df: DataFrame, target: str, task: str, key: list[str], variance: float = 0.01, importance: float = 0.05, correlation: float = 0.95, least: int = 5) -> tuple[DataFrame, dict[str, Any]]:
    """Drop near-constant, unimportant (five stay) and correlated features (the weaker one), and grade the table from 0 to 10."""
    nums = clean.numeric_columns(df, (target, *key))
    gone = clean.low_variance(df, nums, variance)
    kept = [c for c in nums if c not in gone]
    score = learn.importances(df, kept, target, task, trees=20) if kept else {}
    order = sorted(kept, key=lambda c: (-score[c], c))
    kept = [c for i, c in enumerate(order) if i < least or score[c] >= importance]
    strong: list[str] = []
    corr = clean.correlations(df, kept)
    for c in kept:
        if all(abs(corr.get((c, k)) or corr.get((k, c)) or 0.0) <= correlation for k in strong):
            strong.append(c)
    out = df.drop(*[c for c in nums if c not in strong])
    return out, {"kept": strong, "dropped": [c for c in nums if c not in strong], "importances": score, "grade": grade(out, target, task, len(nums), len(strong))}


def grade(df: DataFrame, target: str, task: str, before: int, after: int) -> float:
    """From 0 to 10, starting at 5: rows, missing values, balance and the share of features that were worth keeping count."""
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = row["n"]
    miss = 1 - sum(row[f"c{i}"] for i in range(len(df.columns))) / max(1, n * len(df.columns))
    g = 5.0 + (1 if n >= 1000 else -1 if n < 100 else 0) + (1 if miss < 0.01 else -1 if miss > 0.2 else 0) + (1 if before and after / before >= 0.5 else 0)
    if task == "classification":
        ratio = evaluate.class_balance(df, target)["ratio"] or 0.0
        g += 1 if ratio > 0.5 else -1 if ratio < 0.1 else 0
    return max(0.0, min(10.0, g))


def report(result: dict[str, Any]) -> str:
    """A text report of nested results."""
    lines: list[str] = []

    def put(x: Any, depth: int) -> None:
        pad = "  " * depth
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, (dict, list)) and v:
                    lines.append(f"{pad}{k}:")
                    put(v, depth + 1)
                else:
                    lines.append(f"{pad}{k}: {round(v, 6) if isinstance(v, float) else v}")
        elif isinstance(x, list):
            for v in x[:50]:
                if isinstance(v, dict):
                    lines.append(f"{pad}-")
                    put(v, depth + 1)
                else:
                    lines.append(f"{pad}- {v}")
        else:
            lines.append(f"{pad}{x}")

    put(result, 0)
    return "\n".join(lines)


class FeatureEngine:
    """Profile, clean, search, refine and apply, in one object."""

    def __init__(self, target: str, key: list[str], task: str | None = None, time_column: str | None = None, history: str | None = None):
        self.target, self.key, self.task, self.time, self.history = target, key, task, time_column, search.History(history) if history else None
        self.found: list[dict[str, Any]] = []
        self.tree: search.Tree | None = None
        self.chain = saved.Chain()
        self.profile: dict[str, Any] = {}

    def preprocess(self, df: DataFrame) -> DataFrame:
        self.profile = profile.analyze(df.drop(*self.key), self.target)
        steps = [s for s in profile.recommend(self.profile, self.target) if s["id"] not in ("balance_classes", "transform_target")]
        return profile.apply_recommendations(df, steps, self.target, self.key, [self.time] if self.time else None)

    def fit_transform(self, df: DataFrame, clean_first: bool = True) -> DataFrame:
        """The cleaned table with the features that were worth it."""
        task = self.task or profile.problem_type(df, self.target, self.time)
        out = self.preprocess(df) if clean_first else df
        body = out.drop(*self.key)
        past = self.history.read() if self.history else []
        wanted = search.recommend_by_history(body, past, self.target) if past else search.recommend(body, self.target)
        self.tree = search.Tree().build(body, wanted, self.target)
        self.found = search.search(body, self.target, self.tree)
        chain = self._chained(out)
        wide = chain.transform(out)
        self.found = search.refine(wide, self.target, self.found, task)
        kept = {f["feature"] for f in self.found}
        needed = {n.name for f in self.found for n in self.tree.lineage(f["feature"])}
        self.chain = saved.Chain(f for f in chain.steps if f.out in needed)
        if self.history:
            gains: dict[str, float] = {}
            for f in self.found:
                for op in f["chain"]:
                    gains[op] = max(gains.get(op, 0.0), f["gain"])
            self.history.add(body, self.target, gains)
        return wide.select(*[F.col(f"`{c}`") for c in wide.columns if c in out.columns or c in kept])

    def _chained(self, df: DataFrame) -> saved.Chain:
        """The operators of all features that were found, fitted."""
        nodes = {n.name: n for f in self.found for n in self.tree.lineage(f["feature"])}  # type: ignore[union-attr]
        return saved.Chain.fit(df, [(n.op, [n.parent], n.name, n.params) for n in nodes.values()], Store.kept(df.sparkSession).table)

    def feature_importance(self) -> list[tuple[str, float]]:
        return sorted(((f["feature"], f["importance"]) for f in self.found), key=lambda x: (-x[1], x[0]))

    def report(self) -> str:
        return report({"profile": self.profile, "features": self.found})


def balanced_share(df: DataFrame, target: str) -> float:
    """Rows of the smallest class over those of the largest."""
    return evaluate.class_balance(df, target)["ratio"] or 0.0
