"""Models and projections on Spark ML: importances, selection, components, clusters, cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import clean, evaluate
from tessella.registry import OperatorError, corr, numeric, spread, stats, uniform


def vectors(df: DataFrame, columns: list[str], label: str | None = None, centre: bool = False, scale: bool = False) -> DataFrame:
    """Add `features`, numbers with missing ones as the mean, and `label` as double."""
    row = stats(df, **{f"m{i}": F.avg(numeric(df, c)) for i, c in enumerate(columns)}, **{f"s{i}": F.stddev_pop(numeric(df, c)) for i, c in enumerate(columns)})

    def one(i: int, c: str) -> Column:
        m = row[f"m{i}"] or 0.0
        x = F.coalesce(numeric(df, c), F.lit(m)) - F.lit(m if centre else 0.0)
        return x / F.lit(row[f"s{i}"] or 1.0) if scale else x

    made_here = {"features", *(["label"] if label else [])}  # these replace columns of the same name
    ready = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made_here], *[one(i, c).alias(f"__f{i}") for i, c in enumerate(columns)], *([numeric(df, label).alias("label")] if label else []))
    if label:
        ready = ready.where("label is not null")
    made = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(columns))], outputCol="features").transform(ready)
    return made.drop(*[f"__f{i}" for i in range(len(columns))])


def forest(task: str, trees: int = 50, depth: int = 6, seed: int = 42, weight: str | None = None) -> Any:
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    model = kind(numTrees=trees, maxDepth=depth, seed=seed)
    return model.setWeightCol(weight) if weight else model


def importances(df: DataFrame, columns: list[str], target: str, task: str, trees: int = 50, seed: int = 42) -> dict[str, float]:
    """Importance of each column in a random forest. Class labels must be numbers from 0 up."""
    model = forest(task, trees, seed=seed).fit(vectors(df, columns, target))
    return dict(zip(columns, (float(x) for x in model.featureImportances.toArray()), strict=True))


def permutation_importance(model: Model, df: DataFrame, columns: list[str], target: str, task: str, key: list[str], rounds: int = 5, seed: int = 42) -> dict[str, float]:
    """Loss of the score when a column is exchanged between rows, as shares of the sum of losses.

    Rows give their value to the next row in hash order within hash buckets, so no table is sorted in one task.
    """
    from pyspark.sql import Window

    score = lambda t: _score(model.transform(vectors(t, columns, target)), task)
    base, lost = score(df), {}
    for c in columns:
        total = 0.0
        for r in range(rounds):
            h = spread(*key, seed * 100 + r)
            w = Window.partitionBy(F.pmod(h, F.lit(64))).orderBy(h, *key)
            total += base - score(df.withColumn(c, F.coalesce(F.lead(c).over(w), F.first(c).over(w))))
        lost[c] = max(0.0, total / rounds)
    whole = sum(lost.values())
    return {c: v / whole if whole else 0.0 for c, v in lost.items()}


def _score(done: DataFrame, task: str) -> float:
    if task == "classification":
        return stats(done, a=F.avg((F.col("prediction") == F.col("label")).cast("double")))["a"] or 0.0
    return evaluate.regression(done, "label", "prediction")["r2"] or 0.0


def select(df: DataFrame, columns: list[str], target: str | None = None, method: str = "variance", top: int = 20, task: str = "classification", cut: float = 0.01) -> list[str]:
    """variance: above the cut; mutual_info: the top ones; model_based: importance at least the mean; rfe: drop the weakest
    until `top` are left; anova: the top ones by F value; k_best: four fifths by F value."""
    if method == "variance":
        gone = set(clean.low_variance(df, columns, cut))
        return [c for c in columns if c not in gone] or columns[:1]
    if target is None:
        raise OperatorError(f"{method} needs a target")
    if method == "mutual_info":
        score = evaluate.many_mutual_information(df, columns, target)
        return sorted(columns, key=lambda c: (-score[c], columns.index(c)))[:top]
    if method == "model_based":
        score = importances(df, columns, target, task)
        mean = sum(score.values()) / len(score)
        return [c for c in columns if score[c] >= mean]
    if method == "rfe":
        left = list(columns)
        while len(left) > top:
            score = importances(df, left, target, task, trees=20)
            left.remove(min(left, key=lambda c: (score[c], -left.index(c))))
        return left
    if method in ("anova", "k_best"):
        score = f_values(df, columns, target, task)
        n = top if method == "anova" else max(1, round(0.8 * len(columns)))
        kept = sorted(columns, key=lambda c: (-score[c], columns.index(c)))[:n]
        return [c for c in columns if c in kept]
    raise OperatorError(f"unknown method {method!r}")


def f_values(df: DataFrame, columns: list[str], target: str, task: str) -> dict[str, float]:
    """F value of each column: between and within classes, or of the correlation with the target."""
    if task == "regression":
        row = stats(df, n=F.count("*"), **{f"r{i}": corr(numeric(df, c), numeric(df, target)) for i, c in enumerate(columns)})
        return {c: (lambda r: math.inf if abs(r) >= 1 else r * r / (1 - r * r) * (row["n"] - 2))(row[f"r{i}"] or 0.0) for i, c in enumerate(columns)}
    out = {}
    known = df.where(F.col(target).isNotNull())
    mean = stats(known, **{f"m{i}": F.avg(numeric(df, c)) for i, c in enumerate(columns)})
    aggs = {f"{a}{i}": f(numeric(df, c)) for i, c in enumerate(columns) for a, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))}
    by_class = known.groupBy(target).agg(*[v.alias(k) for k, v in aggs.items()])
    sums = {}
    for i in range(len(columns)):
        n, m, v = (F.col(f"{a}{i}") for a in "nmv")
        sums |= {f"n{i}": F.sum(n), f"k{i}": F.count_if(n > 0), f"w{i}": F.sum(n * v), f"b{i}": F.sum(n * (m - F.lit(mean[f"m{i}"])) * (m - F.lit(mean[f"m{i}"])))}
    row = stats(by_class, **sums)
    for i, c in enumerate(columns):
        n, k, within, between = row[f"n{i}"] or 0, row[f"k{i}"], row[f"w{i}"], row[f"b{i}"]
        if k < 2 or n <= k:
            out[c] = 0.0
            continue
        out[c] = 0.0 if between == 0 else math.inf if within == 0 else between / (k - 1) / (within / (n - k))
    return out


def pca(df: DataFrame, columns: list[str], variance: float = 0.95, components: int | None = None, prefix: str = "PC") -> tuple[DataFrame, list[float]]:
    """Add components of the centred columns until they explain `variance`, two at least and one less than columns at most.
    The largest loading of a component is positive."""
    top = max(2, len(columns) - 1) if components is None else components
    data = vectors(df, columns, centre=True)
    model = PCA(k=min(top, len(columns)), inputCol="features", outputCol="__pc").fit(data)
    explained = [float(x) for x in model.explainedVariance]
    k = components or max(min(2, len(explained)), int(np.searchsorted(np.cumsum(explained), variance) + 1))
    loads = model.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(loads.shape[1])])
    arr = vector_to_array("__pc")
    made = model.transform(data)
    k = min(k, len(explained))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], *[(arr[i] * float(signs[i])).alias(f"{prefix}{i + 1}") for i in range(k)]), explained[:k]


def svd(df: DataFrame, columns: list[str], components: int = 2, prefix: str = "SVD") -> DataFrame:
    """Add coordinates on the leading right singular vectors of the columns as they are, from the matrix of their products."""
    x = [F.coalesce(numeric(df, c), F.lit(0.0)) for c in columns]
    row = stats(df, **{f"q{i}_{j}": F.sum(a * b) for i, a in enumerate(x) for j, b in enumerate(x) if j >= i})
    m = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    _, v = np.linalg.eigh(m)
    v = v[:, ::-1][:, :components]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return df.select("*", *[sum((a * float(v[i, k]) for i, a in enumerate(x)), F.lit(0.0)).alias(f"{prefix}{k + 1}") for k in range(v.shape[1])])


def kmeans(df: DataFrame, columns: list[str], k: int | None = None, seed: int = 42) -> DataFrame:
    """Add the cluster and the distance to each centre, over standardised columns; k is 5, or less for few rows."""
    k = k or max(2, min(5, int(math.sqrt(df.count() / 2))))
    data = vectors(df, columns, centre=True, scale=True)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    a = vector_to_array("features")
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    dist = [F.sqrt(sum(((a[i] - c[i]) * (a[i] - c[i]) for i in range(len(c))), F.lit(0.0))).alias(f"cluster_distance_{j}") for j, c in enumerate(centres)]
    return model.transform(data).select(*[F.col(f"`{c}`") for c in df.columns], "cluster", *dist)


def cross_validate(df: DataFrame, columns: list[str], target: str, task: str, key: list[str], k: int = 5, make: Callable[[], Any] | None = None, splitter: str | None = None, group: str | None = None, time: str | None = None, seed: int = 42) -> dict[str, Any]:
    """Scores of each fold, their mean and deviation, reliability (1 - mean of deviation over mean) and the overfit ratio."""
    splitter = splitter or ("group" if group else "time" if time else "stratified" if task == "classification" else "kfold")
    folded = {
        "group": lambda: evaluate.group_kfold(df, group, k, seed), "time": lambda: evaluate.time_blocks(df, time, k), "stratified": lambda: evaluate.stratified(df, key, target, k, seed), "kfold": lambda: evaluate.kfold(df, key, k, seed),
    }[splitter]()
    data = vectors(folded, columns, target).persist()
    train_scores, test_scores, details = [], [], []
    try:
        for i in range(1 if splitter == "time" else 0, k):
            train = data.where(F.col("fold") < i) if splitter == "time" else data.where(F.col("fold") != i)
            test = data.where(F.col("fold") == i)
            if train.isEmpty() or test.isEmpty():
                continue
            model = (make or (lambda: forest(task, 20, seed=seed)))().fit(train)
            done = model.transform(test)
            train_scores.append(_score(model.transform(train), task))
            test_scores.append(_score(done, task))
            if task == "classification":
                m = evaluate.classification(done, "label", "prediction")
                details.append({x: m[x] for x in ("accuracy", "weighted_f1", "weighted_precision", "weighted_recall", "mcc")})
            else:
                details.append({x: v for x, v in evaluate.regression(done, "label", "prediction").items() if x in ("mse", "mae", "r2")})
    finally:
        data.unpersist()
    mean, sd = (float(np.mean(test_scores)), float(np.std(test_scores))) if test_scores else (0.0, 0.0)
    gap = (float(np.mean(train_scores)) - mean) / max(1e-9, abs(float(np.mean(train_scores)))) if train_scores else 0.0
    metrics = {x: {"mean": float(np.mean([d[x] for d in details])), "std": float(np.std([d[x] for d in details]))} for x in (details[0] if details else {})}
    return {"splitter": splitter, "folds": test_scores, "mean": mean, "std": sd, "metrics": metrics, "reliability": max(0.0, 1 - abs(sd / mean)) if mean else 0.0, "overfit": gap, "grade": "low" if gap < 0.05 else "moderate" if gap < 0.15 else "high"}


def nested_cross_validate(df: DataFrame, columns: list[str], target: str, task: str, key: list[str], grid: list[dict[str, Any]], outer: int = 3, inner: int = 3, seed: int = 42) -> dict[str, Any]:
    """Inner folds choose among the grid's parameters, outer folds score the choice; with the choice most often made."""
    folded = evaluate.kfold(df, key, outer, seed, out="outer_fold")
    scores, chosen = [], []
    for i in range(outer):
        train, test = folded.where(F.col("outer_fold") != i), folded.where(F.col("outer_fold") == i)
        best = max(grid or [{}], key=lambda p: cross_validate(train, columns, target, task, key, inner, lambda p=p: forest(task, seed=seed, **p), seed=seed + 1)["mean"])
        model = forest(task, seed=seed, **best).fit(vectors(train, columns, target))
        scores.append(_score(model.transform(vectors(test, columns, target)), task))
        chosen.append(best)
    return {"scores": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores)), "params": max(chosen, key=chosen.count), "agreement": max(chosen.count(c) for c in chosen) / len(chosen)}


def learning_curve(df: DataFrame, columns: list[str], target: str, task: str, key: list[str], sizes: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 42) -> dict[str, Any]:
    """Train and test scores by share of the training rows, with a diagnosis."""
    parts = evaluate.split(df, key, 0.2, seed=seed)
    u = uniform(*key, seed + 9)
    test, points = vectors(parts["test"], columns, target), []
    for s in sizes:
        train = vectors(parts["train"].where(u <= s), columns, target)
        model = forest(task, 20, seed=seed).fit(train)
        points.append({"share": s, "train": _score(model.transform(train), task), "test": _score(model.transform(test), task)})
    gap, last = points[-1]["train"] - points[-1]["test"], points[-1]
    slope = points[-1]["test"] - points[-2]["test"] if len(points) > 1 else 0.0
    word = "overfitting" if gap > 0.1 else "underfitting" if last["train"] < 0.7 and last["test"] < 0.7 else "more data helps" if slope > 0.01 else "good fit"
    return {"points": points, "diagnosis": word}


def partial_dependence(model: Model, df: DataFrame, columns: list[str], column: str, points: int = 50) -> list[tuple[float, float]]:
    """Mean prediction over the table with a column set to each point of a grid, in one pass: the grid is a column of each row."""
    s = stats(df, lo=F.min(numeric(df, column)), hi=F.max(numeric(df, column)))
    grid = [s["lo"] + (s["hi"] - s["lo"]) * i / max(1, points - 1) for i in range(points)]
    many = df.withColumn("__g", F.explode(F.array(*[F.lit(i) for i in range(points)]))).withColumn(column, F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("__g") + 1))
    done = model.transform(vectors(many, columns)).groupBy("__g").agg(F.avg("prediction").alias("p")).collect()
    return [(grid[r["__g"]], r.p) for r in sorted(done, key=lambda r: r["__g"])]


def linear(task: str) -> Any:
    return LogisticRegression(maxIter=50) if task == "classification" else LinearRegression(regParam=1e-6)
