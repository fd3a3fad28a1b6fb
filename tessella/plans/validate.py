"""Validation with confidence: out-of-bag bootstrap, repeated folds, reports, and scores for classes of unequal size."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import clean, evaluate, learn, profile
from tessella.plans import explorer
from tessella.registry import uniform

#: Partitions of a table that a model is fitted on, where its result has to be repeatable.
PARTS = 64
#: Share of the largest class under which a table counts as imbalanced.
IMBALANCED = 0.2


def sanitise(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rows with a target; infinities and missing numbers become the column's median."""
    big = clean.replace_infinite(df.where(F.col(f"`{target}`").isNotNull()), 1e18)
    plain = big.select(*[F.when(F.abs(F.col(f"`{c}`")) < 1e18, F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in big.columns])
    return clean.fit_imputer(plain, "median", columns=columns).transform(plain)


def draws(df: DataFrame, key: list[str], number: int, share: float = 1.0, seed: int = 42, out: str = "drawn") -> DataFrame:
    """Add how often a bootstrap round draws each row: Poisson with mean `share`, from a hash of the key. Rows drawn 0 times are
    out of the bag."""
    u = uniform(*key, seed, number)
    n, p, total = F.lit(0), float(np.exp(-share)), 0.0
    for k in range(12):
        total += p
        n = n + (u > F.lit(total)).cast("int")
        p *= share / (k + 1)
    return df.withColumn(out, n)


def bootstrap_evaluate(df: DataFrame, columns: list[str], target: str, task: str, key: list[str], rounds: int = 100, share: float = 0.8, level: float = 0.95, seed: int = 42) -> dict[str, Any]:
    """Models of bootstrap draws, each scored on its out-of-bag rows: the scores, their median and percentile interval."""
    # Partitions and their order follow the key, so that a forest draws the same rows whatever the table's own partitions are.
    by = [F.col(f"`{k}`") for k in key]
    data = learn.vectors(sanitise(df, columns, target), columns, target).repartition(PARTS, *by).sortWithinPartitions(*by).persist()
    scores = []
    try:
        for i in range(rounds):
            drawn = draws(data, key, i, share, seed)
            bag, out = drawn.where("drawn > 0"), drawn.where("drawn = 0")
            if bag.isEmpty() or out.isEmpty():
                continue
            model = learn.forest(task, 20, seed=seed, weight="drawn").fit(bag.withColumn("drawn", F.col("drawn").cast("double")))
            scores.append(learn._score(model.transform(out), task))
    finally:
        data.unpersist()
    edge = (1 - level) / 2
    low, high = (float(np.quantile(scores, q)) for q in (edge, 1 - edge)) if scores else (0.0, 0.0)
    return {"method": "bootstrap", "scores": scores, "mean": float(np.mean(scores)) if scores else 0.0, "std": float(np.std(scores)) if scores else 0.0, "median": float(np.median(scores)) if scores else 0.0, "low": low, "high": high, "level": level}


def evaluate_with_confidence(df: DataFrame, columns: list[str], target: str, key: list[str], task: str | None = None, method: str = "auto", level: float = 0.95, seed: int = 42, rounds: int = 100) -> dict[str, Any]:
    """Scores with an interval. auto: bootstrap under 100 rows, three times repeated folds under 500, else folds once; also
    'cv', 'repeated', 'bootstrap' and 'nested_cv' by name. Intervals of folds are normal ones of their mean."""
    task = task or profile.problem_type(df, target)
    ready = sanitise(df, columns, target)
    if method == "auto":
        n = ready.count()
        method = "bootstrap" if n < 100 else "repeated" if n < 500 else "cv"
    if method == "bootstrap":
        return bootstrap_evaluate(ready, columns, target, task, key, rounds, level=level, seed=seed) | {"task": task}
    if method == "nested_cv":
        found = learn.nested_cross_validate(ready, columns, target, task, key, [{}], seed=seed)
        scores, more = found["scores"], {"params": found["params"]}
    else:
        runs = [learn.cross_validate(ready, columns, target, task, key, seed=seed + 100 * i) for i in range(3 if method == "repeated" else 1)]
        scores = [s for r in runs for s in r["folds"]]
        more = {"metrics": runs[0]["metrics"], "overfit": float(np.mean([r["overfit"] for r in runs])), "grade": runs[0]["grade"], "splitter": runs[0]["splitter"]}
    mean, sd = (float(np.mean(scores)), float(np.std(scores))) if scores else (0.0, 0.0)
    z = {0.9: 1.6449, 0.95: 1.96, 0.99: 2.5758}.get(level, 1.96)
    half = z * sd / max(1, len(scores)) ** 0.5
    return {"method": method, "task": task, "scores": scores, "mean": mean, "std": sd, "median": float(np.median(scores)) if scores else 0.0, "low": mean - half, "high": mean + half, "level": level} | more


def create_report(df: DataFrame, columns: list[str], target: str, key: list[str], task: str | None = None, test: DataFrame | None = None, rounds: int = 30) -> dict[str, Any]:
    """Everything about a table's use for a target: its sizes, scores with confidence, importances, and drift to a test table."""
    task = task or profile.problem_type(df, target)
    ready = sanitise(df, columns, target)
    found: dict[str, Any] = {
        "table": {"rows": df.count(), "features": len(columns), "target": target, "task": task}, "confidence": evaluate_with_confidence(ready, columns, target, key, task, rounds=rounds),
        "importances": dict(sorted(learn.importances(ready, columns, target, task, trees=20).items(), key=lambda x: (-x[1], x[0]))),
    }
    if task == "classification":
        found["balance"] = evaluate.class_balance(df, target)
    if test is not None:
        found["drift"] = evaluate.drift(df, test, columns)
    found["advice"] = _advice(found)
    return found


def _advice(found: dict[str, Any]) -> list[str]:
    c, out = found["confidence"], []
    if c["high"] - c["low"] > 0.2:
        out.append("the interval is wide: more rows or fewer features")
    if c.get("overfit", 0.0) > 0.15:
        out.append("training scores are far above test scores: a simpler model or fewer features")
    if (found.get("balance") or {}).get("ratio", 1.0) < IMBALANCED:
        out.append("classes are of very unequal size: balance them, or weigh them")
    if (found.get("drift") or {}).get("dataset_drift"):
        out.append("the test table has drifted from the training table")
    return out


def markdown(found: dict[str, Any]) -> str:
    """A report as Markdown: a heading and a table for each part."""
    lines = ["# Validation report"]
    for part, values in found.items():
        lines += ["", f"## {part}"]
        if isinstance(values, dict):
            lines += ["", "| what | value |", "|-|-|"]
            lines += [f"| {k} | {round(v, 4) if isinstance(v, float) else v if not isinstance(v, (dict, list)) else len(v)} |" for k, v in values.items()]
        else:
            lines += [f"* {v}" for v in values] or ["* nothing"]
    return "\n".join(lines) + "\n"


class Validator:
    """The settings of a validation, to be used for several tables."""

    def __init__(self, target: str, key: list[str], task: str | None = None, method: str = "auto", seed: int = 42, rounds: int = 30):
        self.target, self.key, self.task, self.method, self.seed, self.rounds = target, key, task, method, seed, rounds

    def columns(self, df: DataFrame) -> list[str]:
        return clean.numeric_columns(df, (self.target, *self.key))

    def evaluate(self, df: DataFrame) -> dict[str, Any]:
        return evaluate_with_confidence(df, self.columns(df), self.target, self.key, self.task, self.method, seed=self.seed, rounds=self.rounds)

    def report(self, df: DataFrame, test: DataFrame | None = None) -> str:
        return markdown(create_report(df, self.columns(df), self.target, self.key, self.task, test, self.rounds))


def create_validator(df: DataFrame, target: str, key: list[str], **settings: Any) -> Validator:
    """A validator with the task that the target asks for."""
    return Validator(target, key, settings.pop("task", None) or profile.problem_type(df, target), **settings)


def quick_validate(df: DataFrame, target: str, key: list[str]) -> dict[str, Any]:
    """Three folds of a small forest: the mean score, its deviation and the overfit grade."""
    v = create_validator(df, target, key)
    found = learn.cross_validate(sanitise(df, v.columns(df), target), v.columns(df), target, v.task, key, 3)  # type: ignore[arg-type]
    return {k: found[k] for k in ("mean", "std", "overfit", "grade", "metrics")}


def minority_metrics(counts: list[tuple[Any, Any, int]], rare: Any) -> dict[str, float]:
    """From counts of (label, predicted): balanced accuracy, geometric mean of recalls, and precision, recall and F1 of a class."""
    labels = {a for a, _, _ in counts}
    hit = {c: sum(n for a, b, n in counts if a == b == c) for c in labels}
    true = {c: sum(n for a, _, n in counts if a == c) for c in labels}
    recalls = [hit[c] / true[c] for c in labels if true[c]]
    said = sum(n for _, b, n in counts if b == rare)
    p, r = (hit.get(rare, 0) / said if said else 0.0), (hit.get(rare, 0) / true[rare] if true.get(rare) else 0.0)
    return {"balanced_accuracy": float(np.mean(recalls)) if recalls else 0.0, "g_mean": float(np.prod(recalls)) ** (1 / len(recalls)) if recalls else 0.0, "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def evaluate_transformation_imbalanced(df: DataFrame, target: str, task: str, key: list[str], k: int = 5, seed: int = 42) -> dict[str, float]:
    """The table's scores; for classes of very unequal size (ratio under IMBALANCED) also those of its rarest class, from
    cross-validated predictions of a forest in which each class weighs the same."""
    scores = explorer.table_score(df, target, task, key)
    balance = evaluate.class_balance(df, target) if task == "classification" else {}
    if not balance or (balance["ratio"] or 1.0) >= IMBALANCED:
        return scores
    columns = clean.numeric_columns(df, (target, *key))
    ready = evaluate.stratified(sanitise(df, columns, target), key, target, min(k, max(2, min(balance["counts"].values()))), seed)
    data = learn.vectors(evaluate.balanced_weights(ready, target), columns, target).persist()
    counts: dict[tuple[Any, Any], int] = {}
    try:
        for i in range(min(k, max(2, min(balance["counts"].values())))):
            train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
            if train.isEmpty() or test.isEmpty():
                continue
            done = learn.forest(task, 50, seed=seed, weight="weight").fit(train).transform(test)
            for a, b, n in evaluate.confusion(done, "label", "prediction"):
                counts[a, b] = counts.get((a, b), 0) + n
    finally:
        data.unpersist()
    rows = [(a, b, n) for (a, b), n in counts.items()]
    sizes: dict[Any, int] = {}
    for a, _, n in rows:
        sizes[a] = sizes.get(a, 0) + n
    return scores | {f"imb_{n}": v for n, v in minority_metrics(rows, min(sizes, key=lambda c: (sizes[c], str(c)))).items()}


def imbalance_presets(ratio: float | None) -> dict[str, dict[str, Any]]:
    """Configurations for a table whose smallest class has that share of the largest: none from IMBALANCED up."""
    if ratio is None or ratio >= IMBALANCED:
        return {}
    found = {"smote": {"balance": "smote"}, "borderline": {"balance": "borderline"}, "adasyn": {"balance": "adasyn"}, "smotetomek": {"balance": "smotetomek"}}
    return found | ({"under": {"balance": "random_under"}} if ratio > 0.05 else {"over": {"balance": "random_over"}})


def safe_explore(df: DataFrame, target: str, key: list[str], task: str, depth: int = 1, width: int = 3, most: int = 20) -> tuple[list[explorer.State], dict[str, Any]]:
    """Beam search over what a profile calls for, with presets for classes of unequal size, that always gives a state: and what
    was tried, what failed and why."""
    configs = explorer.adaptive_configs(profile.analyze(df.drop(*key), target))
    if task == "classification":
        configs |= imbalance_presets(explorer.balanced_share(df, target))
    states = explorer.beam_search(df, target, key, task, configs, depth, width, most)
    failed = {s.name: s.error for s in states if s.error}
    good = [s for s in states if not s.error]
    if not good:
        model, errors = explorer.safe_fit(df, {}, target, key, task)
        good = [explorer.State("recovered", model.config, None)]
        failed |= {f"recovery {i}": e for i, e in enumerate(errors)}
    return good, {"tried": len(states), "succeeded": len(good), "failed": failed, "best": good[0].name}
