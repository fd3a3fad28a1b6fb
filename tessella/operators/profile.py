"""Table profile, cleaning recommendations and their application, feature images, and the data behind charts."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import registry
from tessella.operators import categorical, clean, evaluate, order
from tessella.operators.clean import category_columns, numeric_columns, time_columns
from tessella.operators.datetimes import micros
from tessella.registry import corr, numeric, stats, spread


def adjusted_skewness(g1: float | None, n: int) -> float | None:
    """Sample skewness from the population one."""
    return None if g1 is None or n < 3 or math.isnan(g1) else g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(g2: float | None, n: int) -> float | None:
    """Sample excess kurtosis from the population one."""
    return None if g2 is None or n < 4 or math.isnan(g2) else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def infer_types(df: DataFrame, long_text: float = 10.0) -> dict[str, str]:
    """numeric, datetime, boolean, text or categorical by column; texts are longer than long_text on average."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = df.agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(f"l{i}") for i, c in enumerate(strings)]).first() if strings else {}
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "datetime"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = "boolean"
        elif f.name in strings:
            out[f.name] = "text" if (row[f"l{strings.index(f.name)}"] or 0) > long_text else "categorical"
        else:
            out[f.name] = "other"
    return out


def problem_type(df: DataFrame, target: str | None, time_column: str | None = None, classes: int = 10) -> str:
    if time_column:
        return "time_series"
    if not target:
        return "unsupervised"
    if isinstance(df.schema[target].dataType, T.StringType):
        return "text" if infer_types(df.select(target), 20.0)[target] == "text" else "classification"
    return "classification" if df.select(target).distinct().limit(classes + 1).count() <= classes else "regression"


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict[str, Any]]:
    """Moments, quartiles, distinct values, nulls and the share beyond 1.5 interquartile ranges, by column."""
    columns = columns if columns is not None else numeric_columns(df)
    if not columns:
        return {}
    aggs: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = numeric(df, c)
        aggs += [f(x).alias(f"{n}{i}") for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("skew", F.skewness), ("kurt", F.kurtosis), ("distinct", F.approx_count_distinct))]
    row = df.agg(*aggs).first()
    quart = dict(zip(columns, order.many_quantiles(df, [numeric(df, c) for c in columns], [0.25, 0.5, 0.75]), strict=True))
    beyond = []
    for i, c in enumerate(columns):
        q1, _, q3 = quart[c]
        x = numeric(df, c)
        beyond.append((F.count_if((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))) if q1 is not None else F.lit(0)).alias(f"b{i}"))
    out_of = df.agg(*beyond).first()
    result = {}
    for i, c in enumerate(columns):
        n = row[f"count{i}"]
        skew = adjusted_skewness(row[f"skew{i}"], n)
        result[c] = {
            "count": n, "missing": row["rows"] - n, "missing_share": (row["rows"] - n) / row["rows"] if row["rows"] else 0.0, "mean": row[f"mean{i}"], "std": row[f"std{i}"], "min": row[f"min{i}"], "max": row[f"max{i}"],
            "q1": quart[c][0], "median": quart[c][1], "q3": quart[c][2], "skewness": skew, "kurtosis": adjusted_kurtosis(row[f"kurt{i}"], n), "distinct": row[f"distinct{i}"],
            "outliers": out_of[f"b{i}"], "outlier_share": out_of[f"b{i}"] / n if n else 0.0, "has_outliers": bool(n) and out_of[f"b{i}"] / n > 0.05, "skewed": skew is not None and abs(skew) > 1,
        }
    return result


def category_profile(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> dict[str, dict[str, Any]]:
    """Distinct values, the commonest ones with their shares, and whether one of them has over nine tenths."""
    out = {}
    for c in columns if columns is not None else category_columns(df):
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"))
        s = stats(counts, d=F.count("*"), n=F.sum("n"))
        n = s["n"] or 0
        first = [(r.v, r.n / n) for r in counts.orderBy(F.desc("n"), "v").limit(top).collect()]
        out[c] = {"distinct": s["d"], "count": n, "top": first, "dominant": bool(first) and first[0][1] > 0.9}
    return out


def time_profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict[str, Any]]:
    """Range and span in days, and the commonest gap between successive distinct times with its name."""
    out = {}
    for c in columns if columns is not None else time_columns(df):
        t = micros(F.col(f"`{c}`"))
        s = stats(df, lo=F.min(t), hi=F.max(t), n=F.count(t))
        if s["lo"] is None:
            out[c] = {"count": 0}
            continue
        # Successive times within ranges of the span, and the step from one range to the next, so that no task has all.
        width = max(1, (s["hi"] - s["lo"]) // 256 + 1)
        times = df.select(t.alias("t")).where("t is not null").distinct().withColumn("b", F.floor((F.col("t") - F.lit(s["lo"])) / F.lit(width)))
        inner = times.select((F.lead("t").over(Window.partitionBy("b").orderBy("t")) - F.col("t")).alias("gap")).where("gap is not null")
        edges = times.groupBy("b").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("b").collect()  # 257 rows at most
        steps = df.sparkSession.createDataFrame([(b.lo - a.hi,) for a, b in zip(edges, edges[1:], strict=False)], "gap long")
        first = inner.unionByName(steps).groupBy("gap").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap").first()
        gap = first["gap"] if first else None
        out[c] = {"count": s["n"], "min_micros": s["lo"], "max_micros": s["hi"], "span_days": (s["hi"] - s["lo"]) / 86_400e6, "modal_gap_seconds": None if gap is None else gap / 1e6, "frequency": gap_name(gap)}
    return out


def gap_name(gap: int | None) -> str | None:
    """second, minute, hour, day, week, month or year: the largest that the gap (microseconds) reaches."""
    if gap is None:
        return None
    for name, seconds in (("year", 365 * 86400), ("month", 28 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60)):
        if gap >= seconds * 1e6:
            return name
    return "second"


def analyze(df: DataFrame, target: str | None = None) -> dict[str, Any]:
    """The whole profile of a table, with warnings; no sampling."""
    nums, cats, times = numeric_columns(df), category_columns(df), time_columns(df)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = row["n"]
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    duplicates = n - df.select(*[F.col(f"`{c}`") for c in flat]).distinct().count() if n else 0
    features = [c for c in nums if c != target]
    number, category = numeric_profile(df, nums), category_profile(df, cats)
    corr = {p: r for p, r in clean.correlations(df, features).items() if r is not None and abs(r) > 0.9}
    report: dict[str, Any] = {
        "rows": n, "columns": len(df.columns), "types": infer_types(df), "missing": {c: n - row[f"c{i}"] for i, c in enumerate(df.columns)}, "duplicate_rows": duplicates,
        "numeric": number, "categorical": category, "datetime": time_profile(df, times), "correlated": [(a, b, r) for (a, b), r in corr.items()], "correlated_groups": evaluate.correlated_groups(df, features),
        "high_cardinality": [c for c, v in category.items() if v["distinct"] > 20 and v["distinct"] < 0.5 * n], "identifier_like": [c for c, v in category.items() if n and v["distinct"] >= 0.5 * n],
        "low_variance": [c for c, v in number.items() if c != target and (v["min"] == v["max"]) and (v["count"] == 0 or v["missing"] == 0)],
    }
    if target:
        report["target"] = target_profile(df, target, features)
    report["warnings"] = _warnings(report)
    return report


def target_profile(df: DataFrame, target: str, features: list[str], top: int = 10) -> dict[str, Any]:
    """Classes and their balance, or moments; and the features with the strongest correlation or mutual information."""
    kind = problem_type(df, target)
    out: dict[str, Any] = {"column": target, "type": kind}
    if kind == "classification":
        out |= evaluate.class_balance(df, target)
        n = sum(out["counts"].values())
        out["imbalanced"] = bool(n) and max(out["counts"].values()) / n > 0.75
        scores = evaluate.many_mutual_information(df, features, target)
    else:
        out["moments"] = numeric_profile(df, [target])[target] if target in numeric_columns(df) else {}
        row = stats(df, **{f"r{i}": corr(numeric(df, c), numeric(df, target)) for i, c in enumerate(features)}) if features and target in numeric_columns(df) else {}
        scores = {c: abs(row.get(f"r{i}") or 0.0) for i, c in enumerate(features)}
    out["top_features"] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
    return out


def _warnings(r: dict[str, Any]) -> list[str]:
    out = [f"{c}: {m / r['rows']:.0%} missing" for c, m in r["missing"].items() if r["rows"] and m / r["rows"] > 0.15]
    out += [f"{c}: many outliers" for c, v in r["numeric"].items() if v["has_outliers"]]
    out += [f"{c}: skewed" for c, v in r["numeric"].items() if v["skewed"]]
    if r["rows"] < 100:
        out.append("fewer than 100 rows")
    counts = (r.get("target") or {}).get("counts")
    if counts and min(counts.values()) / sum(counts.values()) < 0.1:
        out.append("a class has less than a tenth of the rows")
    return out


#: Rank of the cleaning steps: they are applied in this order.
STEPS = ("remove_high_missing", "fill_missing", "handle_outliers", "remove_correlated", "remove_low_variance", "reduce_cardinality", "extract_datetime", "transform_skewed", "balance_classes", "transform_target", "create_lag_features")
EFFECT = {"remove_high_missing": ("high", "low"), "fill_missing": ("high", "medium"), "handle_outliers": ("medium", "medium"), "remove_correlated": ("medium", "low"), "remove_low_variance": ("medium", "low"), "reduce_cardinality": ("medium", "medium"), "extract_datetime": ("high", "low"), "transform_skewed": ("medium", "low"), "balance_classes": ("high", "high"), "transform_target": ("medium", "low"), "create_lag_features": ("high", "medium")}


def recommend(report: dict[str, Any], target: str | None = None) -> list[dict[str, Any]]:
    """Cleaning steps that the profile calls for, each with its columns, impact, effort and priority."""
    n = report["rows"] or 1
    share = {c: m / n for c, m in report["missing"].items() if c != target}
    number = {c: v for c, v in report["numeric"].items() if c != target}
    gone = [c for c, s in share.items() if s > 0.5]
    later = {b for _, b, _ in report["correlated"]} - {target}
    t = report.get("target") or {}
    found = {
        "remove_high_missing": gone, "fill_missing": [c for c, s in share.items() if 0 < s <= 0.5], "handle_outliers": [c for c, v in number.items() if v["has_outliers"]],
        "remove_correlated": [c for c in number if c in later and c not in gone], "remove_low_variance": [c for c in report["low_variance"] if c not in gone],
        "reduce_cardinality": [c for c in report["high_cardinality"] if c != target], "extract_datetime": list(report["datetime"]), "transform_skewed": [c for c, v in number.items() if v["skewed"] and c not in gone],
        "balance_classes": [target] if t.get("imbalanced") else [], "transform_target": [target] if abs((t.get("moments") or {}).get("skewness") or 0) > 1 else [],
        "create_lag_features": [c for c in number if c not in gone] if report["datetime"] and t.get("type") in (None, "regression") else [],
    }
    return [{"id": s, "columns": found[s], "impact": EFFECT[s][0], "effort": EFFECT[s][1], "priority": i + 1} for i, s in enumerate(STEPS) if found[s]]


def apply_recommendations(df: DataFrame, steps: list[dict[str, Any]], target: str | None = None, key: list[str] | None = None, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Apply recommended steps by priority. Balancing needs the key, lags need order_by; without them those two are left out."""
    from tessella.operators import balance

    for step in sorted(steps, key=lambda s: s["priority"]):
        name, columns = step["id"], [c for c in step["columns"] if c in df.columns]
        if not columns:
            continue
        if name in ("remove_high_missing", "remove_correlated", "remove_low_variance"):
            df = df.drop(*[c for c in columns if c != target])
        elif name == "fill_missing":
            df = clean.fit_imputer(df, columns=columns).transform(df)
        elif name == "handle_outliers":
            df = clean.fit_outliers(df, "iqr", columns, target, 1.5).clip(df)
        elif name == "reduce_cardinality":
            for c in columns:
                df = categorical.fold_rare(df, c, 19, "Other")
        elif name == "extract_datetime":
            df = expand_times(df, columns)
        elif name == "transform_skewed":
            df = unskew(df, columns)
        elif name == "transform_target":
            df = registry.apply(df, "log", columns[0], out=f"{columns[0]}_log")
        elif name == "balance_classes" and key:
            df = balance.random_under(df, columns[0], key)
        elif name == "create_lag_features" and order_by:
            for c in columns:
                df = registry.apply(df, "lag", c, out=f"{c}_lag1", order_by=order_by, partition_by=partition_by)
    return df


def expand_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year, month, day and day of the week of each time, and hour and minute if any hour is not midnight."""
    hours = stats(df, **{f"h{i}": F.max(F.hour(F.col(f"`{c}`"))) for i, c in enumerate(columns)})
    made = []
    for i, c in enumerate(columns):
        t = F.col(f"`{c}`")
        made += [F.year(t).alias(f"{c}_year"), F.month(t).alias(f"{c}_month"), F.dayofmonth(t).alias(f"{c}_day"), F.weekday(t).alias(f"{c}_dayofweek")]
        if hours[f"h{i}"]:
            made += [F.hour(t).alias(f"{c}_hour"), F.minute(t).alias(f"{c}_minute")]
    return df.select("*", *made)


def unskew(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column with a long upper tail gains its shifted logarithm, one with a long lower tail its square."""
    row = stats(df, **{f"s{i}": F.skewness(numeric(df, c)) for i, c in enumerate(columns)}, **{f"m{i}": F.min(numeric(df, c)) for i, c in enumerate(columns)})
    made = []
    for i, c in enumerate(columns):
        x = numeric(df, c)
        if (row[f"s{i}"] or 0) > 0:
            made.append(F.log1p(x - F.lit(float(min(0.0, row[f"m{i}"])))).alias(f"{c}_log"))
        else:
            made.append((x * x).alias(f"{c}_squared"))
    return df.select("*", *made)


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """(bin, low, high, n), with the class where one is given; the last bin is closed."""
    x = numeric(df, column)
    s = stats(df, lo=F.min(x), hi=F.max(x))
    lo, hi = s["lo"] or 0.0, s["hi"] or 0.0
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")] + ([F.col(f"`{by}`").alias("class")] if by else [])
    counts = df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.select("bin", *(["class"] if by else []), (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def image(df: DataFrame, column: str, target: str | None = None, size: int = 30) -> list[list[float]]:
    """A size x size picture of a feature: row 0 its density over the greatest, rows 1 and 2 the target's mean and deviation by
    bin, brought to 0 to 1. Categories and texts are binned by hash, times by their place in their range."""
    kind = infer_types(df.select(column))[column]
    if kind == "numeric":
        x = numeric(df, column)
    elif kind == "datetime":
        x = micros(F.col(f"`{column}`")).cast("double")
    elif kind == "text":
        x = F.length(F.col(f"`{column}`")).cast("double")
    else:
        x = F.pmod(spread(column), F.lit(size)).cast("double")
    s = stats(df, lo=F.min(x), hi=F.max(x))
    out = [[0.0] * size for _ in range(size)]
    if s["lo"] is None:
        return out
    width = (s["hi"] - s["lo"]) / size or 1.0
    b = F.least(F.floor((x - F.lit(s["lo"])) / F.lit(width)), F.lit(size - 1)).cast("int")
    y = numeric(df, target) if target and target in numeric_columns(df) else F.lit(None).cast("double")
    rows = df.where(x.isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.stddev_samp(y).alias("s")).collect()
    top = max(r.n for r in rows)
    for r in rows:
        out[0][r.b] = r.n / top
    for line, name in ((1, "m"), (2, "s")):
        got = {r.b: r[name] for r in rows if r[name] is not None}
        if got:
            low, high = min(got.values()), max(got.values())
            for k, v in got.items():
                out[line][k] = (v - low) / (high - low) if high > low else 0.5
    return out


def feature_quality(df: DataFrame, columns: list[str], target: str | None = None) -> list[dict[str, Any]]:
    """Profile rows of features with a quality from 0 to 1: penalties for missing values, outliers and skew."""
    out = []
    for c, v in numeric_profile(df, columns).items():
        q = 1.0 - min(0.5, v["missing_share"]) - min(0.3, v["outlier_share"]) - (0.1 if v["skewed"] else 0.0) - (0.3 if v["min"] == v["max"] else 0.0)
        out.append({"feature": c, "missing_share": v["missing_share"], "outlier_share": v["outlier_share"], "skewness": v["skewness"], "quality": max(0.0, q)})
    if target and target in numeric_columns(df):
        row = stats(df, **{f"r{i}": corr(numeric(df, c), numeric(df, target)) for i, c in enumerate(columns)})
        for i, r in enumerate(out):
            r["target_correlation"] = row[f"r{i}"]
    return out
