"""Splits, metrics, drift, calibration, feature scores and resampling checks. Everything that reads rows is an aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import clean, order
from tessella.registry import OperatorError, corr, numeric, spread, stats, uniform

CLASSIFICATION_METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")
REGRESSION_METRICS = ("mse", "mae", "r2")


# Splits


def _hash(key: list[str], seed: int) -> Column:
    return spread(*key, seed)


def kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """A fold from 0 to k - 1 by a hash of the key, the same for a row whatever the table."""
    return df.withColumn(out, F.pmod(_hash(key, seed), F.lit(k)).cast("int"))


def stratified(df: DataFrame, key: list[str], label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds that share out each class, so that their sizes differ by one at most.

    Rows of a class are dealt to buckets by hash first, and numbered within a bucket after the buckets before it are
    counted: a class with most of the rows does not stand in one task.
    """
    b = F.pmod(_hash(key, seed + 1), F.lit(256)).cast("int")
    rows = df.withColumn("__b", b)
    sizes = rows.groupBy(F.col(f"`{label}`").alias("__l"), "__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__l", F.col("__b").alias("__b2"), F.coalesce("__before", F.lit(0)).alias("__before"))
    w = Window.partitionBy(label, "__b").orderBy(_hash(key, seed), *key)
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1)
    joined = numbered.join(before, F.col(f"`{label}`").eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__b2")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], ((F.col("__i") + F.col("__before")) % k).cast("int").alias(out))


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn(out, F.pmod(_hash([group], seed), F.lit(k)).cast("int"))


def time_blocks(df: DataFrame, column: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Blocks of about equal size in time order; train on the blocks before one and test on it."""
    t = F.unix_micros(F.col(f"`{column}`").cast("timestamp")).cast("double")
    cuts = order.quantiles(df, t, [i / k for i in range(1, k)])
    block = F.lit(0)
    for c in cuts:
        if c is not None:
            block = block + (t > F.lit(c)).cast("int")
    return df.withColumn(out, block)


def choose_splitter(n: int, smallest_share: float | None = None, has_groups: bool = False, has_time: bool = False) -> tuple[str, int]:
    """(kind, folds): groups and time come first, then size and the share of the smallest class."""
    if has_groups:
        return "group", 5
    if has_time:
        return "time", 5
    if n < 100:
        return ("stratified", 3) if smallest_share is not None else ("repeated", 3)
    if n < 1000:
        return ("repeated_stratified" if smallest_share is not None and smallest_share < 0.1 else "stratified" if smallest_share is not None else "repeated", 5)
    return ("stratified" if smallest_share is not None else "kfold", 5)


def split(df: DataFrame, key: list[str], test: float = 0.2, validation: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """Train, test and validation by a hash of the key."""
    u = F.pmod(_hash(key, seed), F.lit(1_000_000)) / 1_000_000
    out = {"train": df.where(u >= test + validation), "test": df.where(u < test)}
    return out | ({"validation": df.where((u >= test) & (u < test + validation))} if validation else {})


# Metrics


def confusion(df: DataFrame, label: str, predicted: str) -> list[tuple[Any, Any, int]]:
    """(label, prediction, rows), at most the square of the classes."""
    rows = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    return sorted(((r.l, r.p, r.n) for r in rows.collect()), key=lambda x: (str(x[0]), str(x[1])))


def classification(df: DataFrame, label: str, predicted: str) -> dict[str, Any]:
    """Accuracy, per-class and averaged precision, recall, F1, specificity, g-mean, balanced accuracy and Matthews correlation."""
    cells = confusion(df, label, predicted)
    n = sum(c for _, _, c in cells)
    classes = sorted({x for a, b, _ in cells for x in (a, b)}, key=str)
    per: dict[Any, dict[str, float]] = {}
    for k in classes:
        tp = sum(c for a, b, c in cells if a == k and b == k)
        fn = sum(c for a, b, c in cells if a == k and b != k)
        fp = sum(c for a, b, c in cells if a != k and b == k)
        tn = n - tp - fn - fp
        p, r, s = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0, tn / (tn + fp) if tn + fp else 0.0
        per[k] = {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "specificity": s, "g_mean": math.sqrt(r * s), "support": tp + fn}
    have = [v for v in per.values() if v["support"]]
    out: dict[str, Any] = {"classes": per, "rows": n, "accuracy": sum(c for a, b, c in cells if a == b) / n if n else 0.0}
    for m in ("precision", "recall", "f1"):
        out[f"macro_{m}"] = sum(v[m] for v in per.values()) / len(per) if per else 0.0
        out[f"weighted_{m}"] = sum(v[m] * v["support"] for v in per.values()) / n if n else 0.0
    out["balanced_accuracy"] = sum(v["recall"] for v in have) / len(have) if have else 0.0
    true, pred = {k: sum(c for a, _, c in cells if a == k) for k in classes}, {k: sum(c for _, b, c in cells if b == k) for k in classes}
    right = sum(c for a, b, c in cells if a == b)
    top = right * n - sum(true[k] * pred[k] for k in classes)
    low = math.sqrt((n * n - sum(v * v for v in pred.values())) * (n * n - sum(v * v for v in true.values())))
    out["mcc"] = top / low if low else 0.0
    return out


def ranking(df: DataFrame, label: str, score: str, positive: Any = 1) -> dict[str, float | None]:
    """Area under the ROC curve (mean ranks for ties) and average precision, from counts by score."""
    y = (F.col(label) == F.lit(positive)).cast("int")
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(y.alias("y"), F.col(score).cast("double").alias("s"))
    table, _ = order.ranks(rows, F.col("s"))
    by = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("all"))
    j = by.join(table, by["s"] == table["v"])
    total = stats(by, p=F.sum("pos"), n=F.sum("all"))
    p, n = total["p"] or 0, total["n"] or 0
    if not p or p == n:
        return {"roc_auc": None, "average_precision": None}
    ranksum = stats(j, r=F.sum(F.col("pos") * (F.col("low") + (F.col("n") + 1) / 2)))["r"]
    # Positives at or above a score: the same places over the positives alone.
    pos, _ = order.ranks(rows.where("y = 1"), F.col("s"))
    above = pos.select(F.col("v").alias("pv"), (F.lit(p) - F.col("low")).alias("tp")).join(table, F.col("pv") == F.col("v"))
    with_n = above.join(by.select(F.col("s").alias("bs"), "pos"), F.col("bs") == F.col("pv"))
    ap = stats(with_n, a=F.sum(F.col("pos") * F.col("tp") / (F.lit(n) - F.col("low"))))["a"] / p
    return {"roc_auc": (ranksum - p * (p + 1) / 2) / (p * (n - p)), "average_precision": ap}


def regression(df: DataFrame, label: str, predicted: str) -> dict[str, float | None]:
    """Mean squared, absolute and relative errors, their root, and R squared; rows with a null are skipped."""
    y, p = numeric(df, label), numeric(df, predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    e = y - p
    r = stats(rows, mse=F.avg(e * e), mae=F.avg(F.abs(e)), mape=F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))), var=F.var_pop(y), n=F.count("*"))
    return {"mse": r["mse"], "rmse": None if r["mse"] is None else math.sqrt(r["mse"]), "mae": r["mae"], "mape": r["mape"], "r2": 1 - r["mse"] / r["var"] if r["var"] else None}


# Drift and calibration


def kolmogorov(d: float, n: int, m: int) -> float:
    """The asymptotic two-sided probability of a two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> tuple[float | None, int, int]:
    """The largest difference of two cumulative shares, from counts by value; the numbers of values."""
    x = a.select(numeric(a, column).alias("x"), F.lit(1).alias("a")).unionByName(b.select(numeric(b, column).alias("x"), F.lit(0).alias("a"))).where("x is not null")
    n = stats(x, a=F.sum("a"), n=F.count("*"))
    na, nb = n["a"] or 0, (n["n"] or 0) - (n["a"] or 0)
    if not na or not nb:
        return None, na, nb
    ra, _ = order.ranks(x.where("a = 1"), F.col("x"))
    rx, _ = order.ranks(x, F.col("x"))
    # At a value of a: rows of a and of all at or below it, and below it, give b's; the extremes are at such places.
    j = ra.select(F.col("v").alias("av"), F.col("n").alias("an"), F.col("low").alias("al")).join(rx, F.col("av") == F.col("v"))
    at = F.abs((F.col("al") + F.col("an")) / na - (F.col("low") + F.col("n") - F.col("al") - F.col("an")) / nb)
    below = F.abs(F.col("al") / na - (F.col("low") - F.col("al")) / nb)
    return stats(j, d=F.max(F.greatest(at, below)))["d"], na, nb


def drift(train: DataFrame, test: DataFrame, columns: list[str] | None = None, p_cut: float = 0.05, score_cut: float = 0.3) -> dict[str, Any]:
    """Drift of each number between two tables: half the KS statistic, three tenths of the shift of the mean and two tenths of
    the largest shift of a quartile, in pooled deviations. A column drifts under p_cut and over score_cut; the table drifts
    if over a tenth of its columns do; the global score is the mean of the top three tenths."""
    columns = columns or [c for c in clean.numeric_columns(train) if c in test.columns]
    out: dict[str, Any] = {}
    for c in columns:
        d, n, m = ks_statistic(train, test, c)
        if d is None:
            continue
        a, b = (stats(t, m=F.avg(numeric(t, c)), s=F.stddev_pop(numeric(t, c))) for t in (train, test))
        sd = math.sqrt(((a["s"] or 0) ** 2 + (b["s"] or 0) ** 2) / 2) or 1.0
        qa, qb = (order.quantiles(t, numeric(t, c), [0.25, 0.5, 0.75]) for t in (train, test))
        p = kolmogorov(d, n, m)
        score = 0.5 * d + 0.3 * min(1.0, abs(a["m"] - b["m"]) / sd) + 0.2 * min(1.0, max(abs(x - y) for x, y in zip(qa, qb, strict=True)) / sd)
        out[c] = {"ks": d, "p_value": p, "mean_shift": abs(a["m"] - b["m"]) / sd, "score": score, "drifted": p < p_cut and score > score_cut}
    scores = sorted((v["score"] for v in out.values()), reverse=True)
    top = scores[: max(1, math.ceil(0.3 * len(scores)))]
    share = sum(v["drifted"] for v in out.values()) / len(out) if out else 0.0
    return {"columns": out, "drifted_share": share, "dataset_drift": share > 0.1, "global_score": sum(top) / len(top) if top else 0.0}


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> dict[str, Any]:
    """Bins of the score with mean score and share of ones, Brier score, expected calibration error and its direction."""
    y, s = numeric(df, label), numeric(df, score)
    rows = df.where(y.isNotNull() & s.isNotNull()).select(y.alias("y"), s.alias("s"))
    b = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("int")
    table = sorted((r.asDict() for r in rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("share"), F.avg((F.col("s") - F.col("y")) ** 2).alias("brier")).collect()), key=lambda r: r["bin"])
    n = sum(r["n"] for r in table)
    if not n:
        return {"bins": [], "brier": None, "ece": None, "label": None}
    ece = sum(r["n"] * abs(r["mean_score"] - r["share"]) for r in table) / n
    lean = sum(r["n"] * (r["mean_score"] - r["share"]) for r in table) / n
    word = "well calibrated" if ece < 0.05 else "moderate" if ece < 0.1 else "poor"
    return {"bins": table, "brier": sum(r["n"] * r["brier"] for r in table) / n, "ece": ece, "label": word, "direction": "over-confident" if lean > 0.02 else "under-confident" if lean < -0.02 else "balanced"}


# Scores of features


#: Stores a table that is read more than once: keep(table, name) -> table. By default it is cached.
Keep = Callable[[DataFrame, str], DataFrame]


def _cached(df: DataFrame, name: str) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def many_mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16, keep: Keep = _cached) -> dict[str, float]:
    """Mutual information with the target in nats, of all columns together; numbers with over `bins` values are cut into quantile bins."""
    if not columns:
        return {}
    every = [*columns, target]
    nums = set(clean.numeric_columns(df))
    sizes = stats(df, **{f"d{i}": F.approx_count_distinct(F.col(f"`{c}`")) for i, c in enumerate(every) if c in nums}) if nums & set(every) else {}
    cut = [i for i, c in enumerate(every) if c in nums and sizes[f"d{i}"] > bins]
    values = {i: F.col(f"`{c}`").cast("string") for i, c in enumerate(every)}
    for i, got in zip(cut, order.many_quantiles(df, [numeric(df, every[i]) for i in cut], [j / bins for j in range(1, bins)]), strict=True):
        x = numeric(df, every[i])
        v = F.lit(0)
        for q in sorted({q for q in got if q is not None}):
            v = v + (x > F.lit(q)).cast("int")
        values[i] = F.when(x.isNotNull(), v).cast("string")
    stacked = df.select(values[len(columns)].alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), values[i].alias("a")) for i in range(len(columns))])).alias("s")).select("s.i", "s.a", "b")
    joint = keep(stacked.where("a is not null and b is not null").groupBy("i", "a", "b").agg(F.count("*").alias("n")), "joint")
    a, b = (joint.groupBy("i", c).agg(F.sum("n").alias(f"m{c}")) for c in ("a", "b"))
    whole = joint.groupBy("i").agg(F.sum("n").alias("t"))
    rows = joint.join(a, ["i", "a"]).join(b, ["i", "b"]).join(F.broadcast(whole), "i")  # whole: a row for each column
    found = {r.i: r.mi for r in rows.groupBy("i").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ma") * F.col("mb")))).alias("mi")).collect()}
    if keep is _cached:
        joint.unpersist()
    return {c: max(0.0, found.get(i, 0.0)) for i, c in enumerate(columns)}


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 16) -> float:
    """Mutual information in nats; numbers with over `bins` values are cut into quantile bins."""
    return many_mutual_information(df, [column], target, bins)[column]


def many_cramers_v(df: DataFrame, pairs: list[tuple[str, str]], keep: Keep = _cached) -> list[float]:
    """Cramer's V with the bias correction, of all pairs of columns together, from counts of pairs and margins."""
    if not pairs:
        return []
    two = [F.struct(F.lit(i).alias("i"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for i, (a, b) in enumerate(pairs)]
    stacked = df.select(F.explode(F.array(*two)).alias("s")).select("s.*").where("a is not null and b is not null")
    joint = keep(stacked.groupBy("i", "a", "b").agg(F.count("*").alias("n")), "pairs")
    ma, mb = (joint.groupBy("i", c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    # The sum of n * n / (na * nb) is one more than chi squared over the rows; the inverse margins add up to the number of values.
    rows = joint.join(ma, ["i", "a"]).join(mb, ["i", "b"])
    told = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("x"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k")).collect()
    found = {r.i: _v(r.n, r.r, r.k, r.x - 1) for r in told}
    if keep is _cached:
        joint.unpersist()
    return [found.get(i, 0.0) for i in range(len(pairs))]


def _v(n: int, r: int, k: int, phi: float) -> float:
    if n < 2 or r < 2 or k < 2:
        return 0.0
    phi = max(0.0, phi - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)
    return math.sqrt(phi / min(kc - 1, rc - 1)) if min(kc - 1, rc - 1) > 0 else 0.0


def cramers_v(df: DataFrame, a: str, b: str) -> float:
    """Cramer's V with the bias correction, from counts of pairs and margins."""
    return many_cramers_v(df, [(a, b)])[0]


def many_rank_correlations(df: DataFrame, columns: list[str], others: list[str], keep: Keep) -> dict[tuple[str, str], float | None]:
    """Spearman's correlation of each column with each of the others, mean ranks for ties, all columns in one stacked shuffle.

    Missing values count as the column's median, so that each column is ranked once; null where a column is constant or
    empty.
    """
    every = list(dict.fromkeys([*columns, *others]))
    if not columns or not others:
        return {}
    medians = [q[0] for q in order.many_quantiles(df, [numeric(df, c) for c in every], [0.5])]
    values = [F.coalesce(numeric(df, c), F.lit(m).cast("double")) + F.lit(0.0) for c, m in zip(every, medians, strict=True)]
    # Equal rows are one with a count, so columns of few values go on as few rows.
    names = [f"v{i}" for i in range(len(every))]
    rows = keep(df.select(*[v.alias(n) for v, n in zip(values, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "rows")
    stacked = rows.select("id", "times", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("s")).select("id", "times", "s.c", "s.v").where("v is not null")
    counts = keep(stacked.groupBy("c", "v").agg(F.sum("times").alias("n")), "counts")
    ranks = keep(order.many_ranks(counts, keep).select("c", "v", (F.col("low") + (F.col("n") + 1) / 2).alias("r")), "ranked")
    wide = stacked.join(ranks, ["c", "v"]).groupBy("id").agg(F.max("times").alias("times"), *[F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"r{i}") for i in range(len(every))])
    at = {c: i for i, c in enumerate(every)}
    side = lambda names: {c: F.col(f"r{at[c]}") for c in names}
    found = many_correlations(wide, side(columns), side(others), F.col("times"))
    return {p: r for p, r in found.items() if p[0] != p[1]}


def many_correlations(df: DataFrame, left: dict[str, Column], right: dict[str, Column], times: Column | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson's correlation of each left column with each right one, over rows where both are there; null where one of them is
    constant. A row counts `times` times, else once. Each task works out matrix products of its rows, so that many columns cost no more aggregates; only these
    products, one number for each two columns, are added up across tasks."""
    if not left or not right:
        return {}
    # nanvl() writes each column's expression once; when() and isnan() wrote it twice at each level, into code too long to be compiled.
    columns = [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in (*left.values(), *right.values())]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], (F.lit(1.0) if times is None else times.cast("double")).alias("times"))
    means = stats(rows, **{f"m{i}": F.sum(F.col(f"c{i}") * F.col("times")) / F.nullif(F.sum(F.when(F.col(f"c{i}").isNotNull(), F.col("times"))), F.lit(0.0)) for i in range(len(columns))})
    middle, m = np.array([means[f"m{i}"] or 0.0 for i in range(len(columns))]), len(left)

    def products(batches):
        import pandas as pd

        total = np.zeros((6, m, len(middle) - m))
        for b in batches:
            w = b.pop("times").to_numpy(float)[:, None]
            v = b.to_numpy(float) - middle
            there = ~np.isnan(v)
            v[~there] = 0.0
            x, y, p, q = v[:, :m], v[:, m:], there[:, :m].astype(float), there[:, m:].astype(float)
            x, xx, p = x * w, x * x * w, p * w
            total += np.stack([p.T @ q, x.T @ q, p.T @ y, xx.T @ q, p.T @ (y * y), x.T @ y])
        i, j = np.indices(total.shape[1:])
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel()} | {f"s{k}": total[k].ravel() for k in range(6)})

    sums = rows.mapInPandas(products, "i int, j int, " + ", ".join(f"s{k} double" for k in range(6))).groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    names, others, out = list(left), list(right), {}
    for r in sums.collect():
        out[names[r.i], others[r.j]] = pearson(*(r[f"s{k}"] for k in range(6)))
    return {(a, b): out.get((a, b)) for a in names for b in others}


def pearson(n: float, sx: float, sy: float, qx: float, qy: float, xy: float) -> float | None:
    """The correlation from rows, sums, sums of squares and the sum of products of centred numbers."""
    if n < 1:
        return None
    a, b = qx - sx * sx / n, qy - sy * sy / n
    if a <= 1e-14 * qx or b <= 1e-14 * qy:
        return None
    return max(-1.0, min(1.0, (xy - sx * sy / n) / math.sqrt(a * b)))


def rank_correlation(df: DataFrame, a: str, b: str) -> float | None:
    """Spearman's correlation over rows where both are there, mean ranks for ties."""
    rows = df.select(numeric(df, a).alias("a"), numeric(df, b).alias("b")).where("a is not null and b is not null")
    for c in ("a", "b"):
        t, _ = order.ranks(rows, F.col(c))
        rows = rows.join(t.select(F.col("v").alias(f"v{c}"), (F.col("low") + (F.col("n") + 1) / 2).alias(f"r{c}")), F.col(c) == F.col(f"v{c}")).drop(f"v{c}")
    r = stats(rows, r=corr("ra", "rb"))["r"]
    return None if r is None or math.isnan(r) else r


def _signed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs of rows at points (a, b) that stand n times; ties in either do not count.

    Pairs are split by the highest bit in which the codes of a differ: within a group of equal higher bits, each point with
    the bit meets those without it, counted below and above it in b. Points are sorted by b once; a bit parts each group in two
    whose points stay in their order.
    """
    if not len(a):
        return 0
    x, y = np.unique(a, return_inverse=True)[1].ravel(), np.unique(b, return_inverse=True)[1].ravel()
    key = y * (int(x.max()) + 1) + x
    o = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[o][1:] != key[o][:-1]))
    x, y, w = x[o][first], y[o][first], np.add.reduceat(np.asarray(n, np.int64)[o], first)
    total, at = 0, np.arange(len(x))
    for bit in range(int(x.max()).bit_length() - 1, -1, -1):
        g, high = x >> (bit + 1), ((x >> bit) & 1) == 1
        c = np.append(0, np.cumsum(np.where(high, 0, w)))
        lows = np.append(0, np.cumsum(~high))
        new_g = np.append(True, g[1:] != g[:-1])
        new_y = new_g | np.append(True, y[1:] != y[:-1])

        def ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            start = np.flatnonzero(new)
            i = np.cumsum(new) - 1
            return start[i], np.append(start[1:], len(new))[i]

        (g0, g1), (y0, y1) = ends(new_g), ends(new_y)
        # Each product is below the square of the rows; their sum is taken in two halves of their bits.
        parts = np.where(high, w * ((c[y0] - c[g0]) - (c[g1] - c[y1])), 0)
        total += (int((parts >> 32).sum()) << 32) + int((parts & 0xFFFFFFFF).sum())
        before = lows[at] - lows[g0]
        to = np.where(high, at + lows[g1] - lows[g0] - before, g0 + before)
        for v in (x, y, w):
            v[to] = v.copy()
    return total


def _range(cuts: np.ndarray):
    @F.pandas_udf("int")
    def place(v):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, v.to_numpy(), "left") + np.searchsorted(cuts, v.to_numpy(), "right"))

    return place


def _within(x: str, y: str, tied: str):
    def one(part):
        import pandas as pd

        n = part["n"].to_numpy()
        same = part.groupby(tied)["n"].sum().to_numpy()
        return pd.DataFrame({"s": [str(_signed(part[x].to_numpy(), part[y].to_numpy(), n))], "t": [str(int((same * (same - 1) // 2).sum()))]})

    return one


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall's tau-b over all complete rows.

    Both value ranges are cut at about their quantiles, which are told in one pass; a cut value is a range by itself, and any cuts
    give the same counts. Pairs of rows that differ in both ranges are counted from the grid of ranges, those in one range of a within
    it, and those in one range of b but different ranges of a within that, as are ties. A range that is one value needs no look
    inside, so a hot value stands in no one task. Where most rows are copies, these are counted first.
    """
    rows = df.select(numeric(df, a).alias("a"), numeric(df, b).alias("b")).where("a is not null and b is not null")
    at = F.array(*[F.lit(i / order.CUTS) for i in range(1, order.CUTS)])
    told = stats(rows, n=F.count("*"), pairs=F.approx_count_distinct(F.xxhash64("a", "b")), **{c: F.percentile_approx(c, at, 10_000) for c in ("a", "b")})
    if told["n"] < 2:
        return None
    copies = 4 * told["pairs"] < told["n"]
    points = rows.groupBy("a", "b").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK) if copies else rows.withColumn("n", F.lit(1).cast("long"))
    try:
        # Even ranges are open, odd ones are the cut value itself.
        placed = points.select("*", *[_range(np.unique(told[c]))(F.col(c)).alias(f"g{c}") for c in ("a", "b")])
        grid = placed.groupBy("ga", "gb").agg(F.sum("n").alias("n")).toPandas()
        total, ties = _signed(*(grid[x].to_numpy() for x in ("ga", "gb", "n"))), {}
        for g, x, y in (("ga", "a", "b"), ("gb", "ga", "b")):
            inside = placed.where(F.col(g) % 2 == 0).select(g, "n", *(c for c in (x, y) if c != g)).groupBy(g)
            found = inside.applyInPandas(_within(x, y, g[1]), "s string, t string").collect()
            total += sum(int(r.s) for r in found)
            one_value = grid[grid[g] % 2 == 1].groupby(g)["n"].sum()
            ties[g] = sum(int(r.t) for r in found) + sum(int(n) * (int(n) - 1) // 2 for n in one_value)
    finally:
        if copies:
            points.unpersist()
    every = told["n"] * (told["n"] - 1) // 2
    under = (every - ties["ga"]) * (every - ties["gb"])
    return total / math.sqrt(under) if under else None


def correlation_p(r: float, n: int) -> float:
    """Two-sided probability of a correlation, from the t distribution by numeric integration."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    v = n - 2
    t = abs(r) * math.sqrt(v / (1 - r * r))
    if v > 400:
        return math.erfc(t / math.sqrt(2))
    const = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    x = np.linspace(0, t, 4001)
    y = const * (1 + x * x / v) ** (-(v + 1) / 2)
    return max(0.0, 1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()))


def redundant_pairs(df: DataFrame, columns: list[str], cut: float = 0.95, p_cut: float = 0.05) -> list[tuple[str, str, float]]:
    """Pairs beyond the cut that chance does not explain, the strongest first."""
    n = df.count()
    found = [(a, b, r) for (a, b), r in clean.correlations(df, columns).items() if r is not None and abs(r) >= cut and correlation_p(r, n) <= p_cut]
    return sorted(found, key=lambda x: (-abs(x[2]), x[0], x[1]))


def correlated_groups(df: DataFrame, columns: list[str], cut: float = 0.9) -> list[list[str]]:
    """Groups of columns that correlations beyond the cut join."""
    up = {c: c for c in columns}

    def root(c: str) -> str:
        while up[c] != c:
            c = up[c]
        return c

    for (a, b), r in clean.correlations(df, columns).items():
        if r is not None and abs(r) > cut:
            x, y = root(a), root(b)
            up[max(x, y, key=columns.index)] = min(x, y, key=columns.index)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(root(c), []).append(c)
    return [g for g in groups.values() if len(g) > 1]


def class_balance(df: DataFrame, target: str) -> dict[str, Any]:
    """Counts by class, the smallest over the largest, and the entropy over its greatest."""
    rows = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(1001).collect()
    if len(rows) > 1000:
        raise OperatorError(f"{target!r} has too many classes")
    n = sum(r.n for r in rows)
    h = -sum(r.n / n * math.log(r.n / n) for r in rows)
    return {"counts": {r.c: r.n for r in rows}, "ratio": rows[-1].n / rows[0].n if rows else None, "entropy": h / math.log(len(rows)) if len(rows) > 1 else 0.0}


def balanced_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Add n / (classes * rows of the class); null targets get null."""
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").alias("__c")).agg(F.count("*").alias("__n"))
    s = stats(counts, n=F.sum("__n"), k=F.count("*"))
    return df.join(counts, df[f"`{target}`"] == counts["__c"], "left").select(*[df[f"`{c}`"] for c in df.columns if c != out], (F.lit(float(s["n"] or 0)) / (F.lit(s["k"]) * F.col("__n"))).alias(out))


def bootstrap(df: DataFrame, key: list[str], value: Column, rounds: int = 100, seed: int = 42) -> dict[str, float | None]:
    """Percentile interval of a mean: each row's weight in each round is a Poisson draw from a hash of its key, so that one
    pass does all rounds."""
    u = lambda i: uniform(*key, seed * 1000 + i)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def weight(i: int) -> Column:
        w = F.lit(0)
        for c in cuts:
            w = w + (u(i) > F.lit(float(c))).cast("int")
        return w

    means: list[float] = []
    for start in range(0, rounds, 20):
        part = df.select(value.alias("v"), *[weight(i).alias(f"w{i}") for i in range(start, min(rounds, start + 20))]).where("v is not null")
        r = stats(part, **{f"m{i}": F.sum(F.col("v") * F.col(f"w{i}")) / F.nullif(F.sum(f"w{i}"), F.lit(0)) for i in range(start, min(rounds, start + 20))})
        means += [v for v in r.values() if v is not None]
    if not means:
        return {"median": None, "low": None, "high": None}
    return {"median": float(np.median(means)), "low": float(np.percentile(means, 2.5)), "high": float(np.percentile(means, 97.5))}
