"""Class balancing. Rows are chosen by hash, so a run can be repeated; neighbours are exact, over all rows."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import order
from tessella.operators.evaluate import class_balance
from tessella.operators.near import nearest
from tessella.registry import OperatorError, numeric, stats, uniform
from tessella.sources.store import Store

#: Groups that starting points of made rows are dealt to, and made rows of a point that are made together.
BUCKETS = 256
SPAN = 1000


def _rank_within(df: DataFrame, target: str, key: list[str], seed: int) -> Column:
    """A number from 0 to 1 for each row, by hash."""
    return uniform(*key, seed)


def random_under(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly as many rows of each class as the smallest has, chosen by hash. Null classes go."""
    counts = class_balance(df, target)["counts"]
    u = _rank_within(df, target, key, seed)
    return _first(df.where(F.col(f"`{target}`").isNotNull()), target, u, key, dict.fromkeys(counts, min(counts.values())))


def _first(df: DataFrame, target: str, by: Column, key: list[str], wanted: dict) -> DataFrame:
    """Of each class the wanted number of rows with the smallest `by` (ties: by key). Cuts are order statistics,
    so no class is sorted in one task; only rows that tie with a cut are numbered."""
    classes = [c for c, n in wanted.items() if n]
    is_class = {c: F.col(f"`{target}`") == F.lit(c) for c in classes}
    told = order.many_order_statistics(df, [F.when(is_class[c], by) for c in classes], [lambda n, w=wanted[c]: [min(n, w) - 1] if n else [] for c in classes])
    cuts = {c: v[0] for c, (_, v) in zip(classes, told, strict=True) if v}
    if not cuts:
        return df.where("false")
    n = stats(df, **{f"below{i}": F.count_if(is_class[c] & (by < F.lit(v))) for i, (c, v) in enumerate(cuts.items())}, **{f"at{i}": F.count_if(is_class[c] & (by == F.lit(v))) for i, (c, v) in enumerate(cuts.items())})
    room = {c: wanted[c] - n[f"below{i}"] for i, c in enumerate(cuts)}
    # Where all that tie with a cut have room, they stay; else they are numbered.
    whole = [c for i, c in enumerate(cuts) if n[f"at{i}"] <= room[c]]
    stays = F.lit(False)
    for c, v in cuts.items():
        stays = stays | (is_class[c] & (by <= F.lit(v) if c in whole else by < F.lit(v)))
    out = df.where(stays)
    for c in cuts.keys() - set(whole):
        out = out.unionByName(df.where(is_class[c] & (by == F.lit(cuts[c]))).orderBy(*key).limit(room[c]))
    return out


def random_over(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Repeat rows of the smaller classes until each has as many as the largest, as evenly as can be. Null classes stay once."""
    counts = class_balance(df, target)["counts"]
    most = max(counts.values())
    times = F.lit(1)
    for c, n in counts.items():
        times = F.when(F.col(f"`{target}`") == F.lit(c), F.lit(most // n)).otherwise(times)
    whole = df.withColumn("__k", F.explode(F.sequence(F.lit(1), times))).drop("__k")
    out = whole
    u = _rank_within(df, target, key, seed)
    rest = {c: most % n for c, n in counts.items() if most % n}
    return out.unionByName(_first(df, target, u, key, rest)) if rest else out


def _points(df: DataFrame, target: str, columns: list[str], c, scale: list[float]) -> DataFrame:
    """(x0, x1, ..., own, oth): the distinct scaled points, with their rows of class c and of other classes. Missing numbers count as 0."""
    mine = F.col(f"`{target}`") == F.lit(c)
    x = df.where(F.col(f"`{target}`").isNotNull()).select(*[(F.coalesce(numeric(df, k), F.lit(0.0)) / F.lit(s) + F.lit(0.0)).alias(f"x{i}") for i, (k, s) in enumerate(zip(columns, scale, strict=True))], mine.alias("mine"))
    return x.groupBy(*[f"x{i}" for i in range(len(columns))]).agg(F.count_if("mine").alias("own"), F.count_if(~F.col("mine")).alias("oth"))


def _scale(df: DataFrame, columns: list[str]) -> list[float]:
    row = stats(df, **{f"s{i}": F.stddev_pop(F.coalesce(numeric(df, c), F.lit(0.0))) for i, c in enumerate(columns)})
    return [row[f"s{i}"] or 1.0 for i in range(len(columns))]


def _others(k: int) -> Column:
    """How many of the k nearest rows of a row of the class are of others, itself left out; at equal distances its own class comes
    first."""
    # Own points lose the row itself, which is the first of them.
    own = F.transform("near_own", lambda s, i: F.struct(s["d"].alias("d"), F.lit(0).alias("o"), (s["n"] - F.when(i == 0, 1).otherwise(0)).alias("n")))
    oth = F.transform("near_oth", lambda s: F.struct(s["d"].alias("d"), F.lit(1).alias("o"), s["n"].alias("n")))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("oth"))

    def add(acc: Column, s: Column) -> Column:
        take = F.least(s["n"], F.lit(k) - acc["seen"])
        return F.struct((acc["seen"] + take).alias("seen"), (acc["oth"] + F.when(s["o"] == 1, take).otherwise(0)).alias("oth"))

    return F.aggregate(F.array_sort(F.concat(own, oth)), start, add)["oth"]


def _shares(xs: list[str], spans: dict[int, tuple[int, int]]):
    def share(part):
        """The made rows, from start up to stop, of each point of a bucket, by weight."""
        part = part.sort_values(xs)
        a, b = spans[part["bucket"].iloc[0]]
        w = np.cumsum(part["weight"].to_numpy(float))
        stop = np.round(a + w / w[-1] * (b - a)).astype(int)
        part = part.assign(start=np.concatenate([[a], stop[:-1]]), stop=stop)
        return part.loc[part["stop"] > part["start"], [*xs, "own", "near", "step", "start", "stop"]]

    return share


def _svm_bases(df: DataFrame, target: str, columns: list[str], c, scale: list[float], points: DataFrame, k: int, m: int, seed: int) -> DataFrame:
    """(xs, own, near, w, step): the class's support vectors. Those of whose m neighbours half or more are of others are in danger: rows
    are made between them and their neighbours (step 1), a share of all that is drawn from Beta(10, 10). From the others rows
    are made away from their neighbours (step -0.5). Those with others alone around them are noise."""
    xs = [f"x{i}" for i in range(len(columns))]
    others = _others(m)
    found = nearest(points, len(xs), {"own": max(k, m) + 1, "oth": m}, (F.col("own") > 0) & support(points, xs)).withColumn("others", others).where(F.col("others") < m)
    found = found.withColumn("danger", F.col("others") >= m / 2)
    sizes = found.groupBy("danger").agg(F.sum("own").alias("n")).collect()
    share = float(np.random.default_rng(seed).beta(10, 10)) if len(sizes) == 2 else 1.0
    each = {r["danger"]: (share if r["danger"] or len(sizes) < 2 else 1 - share) / r["n"] for r in sizes}
    weight = F.when(F.col("danger"), F.lit(each.get(True, 0.0))).otherwise(F.lit(each.get(False, 0.0)))
    return found.select(*xs, "own", weight.alias("w"), F.slice("near_own", 1, k + 1).alias("near"), F.when(F.col("danger"), 1.0).otherwise(-0.5).alias("step"))


def hardness(df: DataFrame, target: str, columns: list[str], c, scale: list[float], m: int) -> DataFrame:
    """(xs, own, oth, near_own, near_oth, others): the points of class c, and how many of the m nearest rows of each are of others."""
    found = nearest(_points(df, target, columns, c, scale), len(columns), {"own": m + 1, "oth": m}, F.col("own") > 0)
    return found.withColumn("others", _others(m))


def support(points: DataFrame, xs: list[str]) -> Column:
    """Whether a point is on or within the margin of a hinge-loss separator of own from other rows: margin of one or less."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    both = F.array(F.struct(F.lit(1.0).alias("y"), F.col("own").alias("n")), F.struct(F.lit(0.0).alias("y"), F.col("oth").alias("n")))
    rows = points.select(*xs, F.explode(both).alias("s")).where("s.n > 0").select(*xs, F.col("s.y").alias("y"), F.col("s.n").cast("double").alias("n"))
    fitted = LinearSVC(featuresCol="f", labelCol="y", weightCol="n", maxIter=100, regParam=1e-3, tol=1e-6).fit(VectorAssembler(inputCols=xs, outputCol="f").transform(rows))
    margin = F.lit(float(fitted.intercept))
    for x, w in zip(xs, fitted.coefficients.toArray(), strict=True):
        margin = margin + F.col(x) * F.lit(float(w))
    return margin <= 1.0


def clusters(points: DataFrame, xs: list[str], rows: Column, k: int = 8, rounds: int = 20) -> Column:
    """The nearest of k centres (ties: the first), found by Lloyd's rounds over all rows from k points that a hash chooses."""
    centres = [tuple(float(v) for v in r) for r in points.select(*xs).orderBy(F.xxhash64(*xs), *xs).limit(k).collect()]

    def place(at: list[tuple[float, ...]]) -> Column:
        far = [sum((F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v)) for x, v in zip(xs, c, strict=True)) for c in at]
        return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]

    for _ in range(rounds):
        sums = points.groupBy(place(centres).alias("i")).agg(F.sum(rows).alias("n"), *[F.sum(F.col(x) * rows).alias(x) for x in xs]).collect()
        moved = list(centres)
        for r in sums:
            moved[r["i"]] = tuple(round(r[x] / r["n"], 12) for x in xs)
        if moved == centres:
            break
        centres = moved
    return place(centres)


def allotment(sizes: list[dict], need: int, total: int, columns: int, k: int = 2) -> dict[int, float]:
    """The share of the made rows by cluster. sizes: of each cluster its number i, its rows, its rows of the class (own), and the sum
    of the variances of the class's columns in it (spread).

    A cluster counts if the class has at least need / total / 2 of its rows and more than k rows in it. Its weight is its
    sparsity: the root mean square distance of two of its rows of the class, to a power that grows with the table, over their number.
    """
    power = np.log(max(total, 2)) / np.log(1.6)
    power = power**1.8 * 0.16
    sparse = {}
    for s in sizes:
        if s["own"] / s["rows"] >= need / total / 2 and s["own"] > k:
            sparse[s["i"]] = float(np.sqrt(2 * s["spread"] * s["own"] / (s["own"] - 1)) ** power / s["own"])
    whole = sum(sparse.values())
    return {i: v / whole if whole else 1 / len(sparse) for i, v in sparse.items()}


def _cluster_bases(points: DataFrame, xs: list[str], need: int, k: int, groups: int) -> DataFrame:
    """(xs, own, near, w, step): rows of the class in clusters that it has a share of; neighbours are of the same cluster. A cluster's
    weight is that of allotment(), shared evenly by its rows. Where no cluster has enough rows of the class, the table is one."""
    every = F.col("own") + F.col("oth")
    placed = points.withColumn("i", clusters(points, xs, every, groups)).persist(StorageLevel.MEMORY_AND_DISK)
    spread = sum(F.sum(F.col("own") * F.col(x) * F.col(x)) / F.sum("own") - F.pow(F.sum(F.col("own") * F.col(x)) / F.sum("own"), 2) for x in xs)
    sizes = placed.groupBy("i").agg(F.sum(every).alias("rows"), F.sum("own").alias("own"), F.greatest(F.lit(0.0), F.when(F.sum("own") > 0, spread)).alias("spread")).collect()
    share = allotment([r.asDict() for r in sizes], need, sum(r["rows"] for r in sizes), len(xs), k)
    if not share:
        return nearest(points, len(xs), {"own": k + 1}, F.col("own") > 0).select(*xs, "own", F.lit(1.0).alias("w"), F.col("near_own").alias("near"), F.lit(1.0).alias("step"))
    own = {r["i"]: r["own"] for r in sizes}
    row = stats(placed, **{f"{n}{x}": f(x) for x in xs for n, f in (("lo", F.min), ("hi", F.max))})
    apart = 4 * (1 + sum((row[f"hi{x}"] - row[f"lo{x}"]) for x in xs))  # farther than any two rows
    wide = placed.where(F.col("i").isin(list(share))).withColumn(f"x{len(xs)}", F.col("i") * F.lit(float(apart)))
    found = nearest(wide.select(*xs, f"x{len(xs)}", "own"), len(xs) + 1, {"own": k + 1}, F.col("own") > 0)
    w = F.lit(0.0)
    for i, v in share.items():
        w = F.when(F.round(F.col(f"x{len(xs)}") / apart) == i, F.lit(v / own[i])).otherwise(w)
    near = F.transform("near_own", lambda s: F.struct(s["d"].alias("d"), F.slice(s["v"], 1, len(xs)).alias("v"), s["n"].alias("n")))
    return found.select(*xs, "own", w.alias("w"), near.alias("near"), F.lit(1.0).alias("step"))


def smote(df: DataFrame, target: str, columns: list[str], method: str = "smote", k: int = 5, seed: int = 42, wanted: dict | None = None, groups: int = 8) -> DataFrame:
    """Add made rows of the smaller classes until each has as many as the largest, or as `wanted` says by class: points between a row
    and one of its k nearest neighbours of the class. Numbers of `columns` are made, the class is set, other columns are null.

    method: smote; borderline starts from rows most of whose neighbours, of all classes, are of others; adasyn starts from rows by
    the share of such neighbours; svm starts from support vectors of a linear separator (see _svm_bases); kmeans makes rows
    within clusters, more in sparse ones (see allotment; k is 2 there, as in its `groups` clusters). Neighbours are exact,
    over all rows (copies are neighbours); starting rows are taken evenly by weight from the rows in the order of their points.
    """
    if method not in ("smote", "borderline", "svm", "kmeans", "adasyn"):
        raise OperatorError(f"unknown method {method!r}")
    counts = class_balance(df, target)["counts"]
    most, draw, out, d = max(counts.values()), np.random.default_rng(seed), df, len(columns)
    xs = [f"x{i}" for i in range(d)]
    k = min(k, 2) if method == "kmeans" else k
    for c, n in sorted(counts.items(), key=lambda x: str(x[0])):
        need = (most if wanted is None else wanted.get(c, n)) - n
        if need <= 0 or n < 2:
            continue
        scale = _scale(df.where(F.col(f"`{target}`") == F.lit(c)), columns)
        m = k if method == "adasyn" else 2 * k
        points = _points(df, target, columns, c, scale)
        if method in ("svm", "kmeans"):
            # Read in each of the separator's or the centres' rounds: the table is worked out once.
            points = Store.kept(df.sparkSession).table(points, "points")
        if method == "svm":
            base = _svm_bases(df, target, columns, c, scale, points, k, m, seed)
        elif method == "kmeans":
            base = _cluster_bases(points, xs, need, k, groups)
        else:
            found = nearest(points, d, {"own": k + 1}, F.col("own") > 0) if method == "smote" else hardness(df, target, columns, c, scale, m)
            hard = F.lit(1.0) if method == "smote" else F.col("others") / F.lit(float(m))
            weigh = {"smote": F.lit(1.0), "borderline": ((hard >= 0.5) & (hard < 1)).cast("double"), "adasyn": hard}[method]
            base = found.select(*xs, "own", weigh.alias("w"), F.slice("near_own", 1, k + 1).alias("near"), F.lit(1.0).alias("step"))
        out = out.unionByName(_made(df, base, target, columns, c, need, k, scale, int(draw.integers(2**31))))
    return out


def _made(df: DataFrame, base: DataFrame, target: str, columns: list[str], c, need: int, k: int, scale: list[float], begin: int) -> DataFrame:
    """`need` rows of class c from starting points (xs, own, w, near, step), each a share by own * w of them, or by own where no w is
    above 0. A made row lies at a random part of `step` on the way to one of the point's k neighbours."""
    xs = [f"x{i}" for i in range(len(columns))]
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    weight = F.col("own") * F.col("w") if stats(base, w=F.sum("w"))["w"] else F.col("own").cast("double")
    # Buckets of points by hash: their weights give each its share of the made rows, and no order spans the table.
    base = base.withColumn("weight", weight).where("weight > 0").withColumn("bucket", F.pmod(F.xxhash64(*xs), F.lit(BUCKETS)))
    sums = base.groupBy("bucket").agg(F.sum("weight").alias("w")).orderBy("bucket").collect()
    if not sums:
        return df.where(F.lit(False))
    ends = np.cumsum([r["w"] for r in sums])
    ends = np.round(ends / ends[-1] * need).astype(int).tolist()
    spans = {r["bucket"]: (a, b) for r, a, b in zip(sums, [0, *ends[:-1]], ends, strict=True)}

    near_type = base.schema["near"].dataType.simpleString()
    dealt = base.groupBy("bucket").applyInPandas(_shares(xs, spans), f"{', '.join(f'{x} double' for x in xs)}, own long, near {near_type}, step double, start long, stop long")
    spread = dealt.withColumn("at", F.explode(F.expr(f"sequence(start, stop - 1, {SPAN})"))).withColumn("end", F.least(F.col("at") + SPAN, F.col("stop"))).repartition("at")

    def make(batches):
        import pandas as pd

        for b in batches:
            for row in b.itertuples(index=False):
                v = np.array([getattr(row, x) for x in xs])
                # The k nearest rows, itself left out: its copies come first.
                near = [np.asarray(s["v"], float) for i, s in enumerate(row.near) for _ in range(min(k, int(s["n"]) - (i == 0)))][:k] or [v]
                ids = np.arange(row.at, row.end, dtype=np.uint64)
                h = [(lambda z: ((z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(11))((ids + np.uint64(begin + j)) * np.uint64(0x9E3779B97F4A7C15)).astype(float) / 2.0**53 for j in (7, 13)]
                to = np.array(near)[np.minimum((h[0] * len(near)).astype(int), len(near) - 1)]
                yield pd.DataFrame((v + (to - v) * row.step * h[1][:, None]) * np.array(scale), columns=xs)

    made = spread.select(*xs, "near", "step", "at", "end").mapInPandas(make, ", ".join(f"{x} double" for x in xs))
    fields = {f.name: f.dataType for f in df.schema.fields}
    row = [F.lit(c).cast(fields[f]).alias(f) if f == target else F.col(f"x{columns.index(f)}").cast(fields[f]).alias(f) if f in columns else F.lit(None).cast(fields[f]).alias(f) for f in df.columns]
    return made.select(*row)


def near_minority(df: DataFrame, target: str, columns: list[str], keep: int, k: int = 3) -> DataFrame:
    """NearMiss-1: of the largest class the `keep` rows with the least mean distance to their k nearest rows of other classes
    (ties: by point); other rows stay."""
    counts = class_balance(df, target)["counts"]
    big = max(counts, key=lambda c: (counts[c], str(c)))
    if keep >= counts[big]:
        return df
    xs = [f"x{i}" for i in range(len(columns))]
    scale = _scale(df.where(F.col(f"`{target}`").isNotNull()), columns)
    far = nearest(_points(df, target, columns, big, scale), len(xs), {"oth": k}, F.col("own") > 0)
    rows = F.slice(F.flatten(F.transform("near_oth", lambda s: F.array_repeat(F.sqrt(s["d"]), F.least(s["n"], F.lit(k)).cast("int")))), 1, k)
    mean = far.select(*[F.col(x).alias(f"__{x}") for x in xs], (F.aggregate(rows, F.lit(0.0), lambda t, x: t + x) / F.size(rows)).alias("__mean"))
    is_big = F.coalesce(F.col(f"`{target}`") == F.lit(big), F.lit(False))
    placed = df.where(is_big).select("*", *[(F.coalesce(numeric(df, c), F.lit(0.0)) / F.lit(s) + F.lit(0.0)).alias(f"__x{i}") for i, (c, s) in enumerate(zip(columns, scale, strict=True))])
    keys = [f"__x{i}" for i in range(len(columns))]
    kept = _first(placed.join(mean, keys), target, F.col("__mean"), [*keys, *[f"`{c}`" for c in df.columns]], {big: keep})
    return df.where(~is_big).unionByName(kept.select(*df.columns))


def self_paced_wants(counts: dict) -> dict:
    """How many rows each class is to have: one under half of the largest grows by 0.8 of it times one less the root of its share,
    to one row less than the largest at most."""
    most = max(counts.values())
    return {c: min(int(n + most * (1 - (n / most) ** 0.5) * 0.8), most - 1) for c, n in counts.items() if n < most * 0.5}


def hardness_quota(sizes: list[int], means: list[float], alpha: float, want: int) -> list[int]:
    """How many rows to take of each hardness bin: shares by 1 / (mean hardness + alpha), no more than a bin has, the rest to the
    next bins from the easiest."""
    w = [1 / (h + alpha) if n else 0.0 for n, h in zip(sizes, means, strict=True)]
    quota = [min(n, int(want * x / sum(w))) for n, x in zip(sizes, w, strict=True)] if sum(w) else [0] * len(sizes)
    left = min(want, sum(sizes)) - sum(quota)
    for i, n in enumerate(sizes):
        more = min(left, n - quota[i])
        quota[i], left = quota[i] + more, left - more
    return quota


def self_paced_under(df: DataFrame, target: str, columns: list[str], key: list[str], rounds: int = 5, bins: int = 10, seed: int = 42) -> DataFrame:
    """Self-paced under-sampling of the larger of two classes to the size of the smaller.

    Each round fits a logistic model to the rows chosen so far. A row's hardness is the mean, over all models, of how far its
    score is from its class; the next rows are drawn from bins of equal width, hard bins less often at first (alpha is small),
    evenly in the end. Rows of a bin are chosen by hash. Rows without a class go.
    """
    # The table is worked out once, not in each of the rounds' jobs.
    df = Store.kept(df.sparkSession).table(df, "rows")
    counts = class_balance(df, target)["counts"]
    if len(counts) != 2:
        raise OperatorError("self-paced under-sampling needs two classes")
    big = max(counts, key=lambda c: (counts[c], str(c)))
    want = min(counts.values())
    is_big = F.col(f"`{target}`") == F.lit(big)
    scale = _scale(df, columns)
    rows = df.where(F.col(f"`{target}`").isNotNull())
    x = [F.coalesce(numeric(df, c), F.lit(0.0)) / F.lit(s) for c, s in zip(columns, scale, strict=True)]
    chosen = random_under(rows, target, key, seed)
    scores: list[Column] = []
    for i in range(1, rounds + 1):
        scores.append(_logistic(chosen, x, is_big))
        hard = 1 - sum(scores) / len(scores)  # of the larger class, whose score should be 1
        span = stats(rows.where(is_big), lo=F.min(hard), hi=F.max(hard))
        width = (span["hi"] - span["lo"]) or 1.0
        place = F.least(F.lit(bins - 1), F.floor((hard - F.lit(span["lo"])) / F.lit(width) * bins)).cast("int")
        told = {r["b"]: (r["n"], r["h"]) for r in rows.where(is_big).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.avg(hard).alias("h")).collect()}
        sizes, means = [told.get(b, (0, 0.0))[0] for b in range(bins)], [told.get(b, (0, 0.0))[1] for b in range(bins)]
        alpha = float(np.tan(np.pi / 2 * (i / rounds))) if i < rounds else 1e300
        quota = hardness_quota(sizes, means, alpha, want)
        placed = rows.where(is_big).withColumn("__bin", place)
        picked = _first(placed, "__bin", _rank_within(rows, target, key, seed + i), key, dict(enumerate(quota)))
        chosen = rows.where(~is_big).unionByName(picked.drop("__bin"))
    return chosen


def _logistic(df: DataFrame, x: list[Column], is_one: Column) -> Column:
    """The score of a logistic model of is_one, as an expression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = [f"x{i}" for i in range(len(x))]
    rows = df.select(*[c.alias(n) for c, n in zip(x, names, strict=True)], is_one.cast("double").alias("y"))
    fitted = LogisticRegression(featuresCol="f", labelCol="y", maxIter=100, regParam=1e-4, tol=1e-9).fit(VectorAssembler(inputCols=names, outputCol="f").transform(rows))
    z = F.lit(float(fitted.intercept))
    for c, w in zip(x, fitted.coefficients.toArray(), strict=True):
        z = z + c * F.lit(float(w))
    return 1 / (1 + F.exp(-z))


def clean_borders(df: DataFrame, target: str, columns: list[str], method: str = "enn", k: int = 3) -> DataFrame:
    """Drop rows of the largest class, by exact neighbours over all rows (copies are neighbours, a row is not its own).

    enn: those whose k nearest rows are mostly of other classes. tomek: those that are in a Tomek link, a pair of rows of
    different classes of which each is the other's nearest; at equal distances rows of the same class are nearer. nearmiss
    (version 3): each row of the others puts its k nearest rows on a shortlist; of it, as many rows stay as the smallest class
    has, those with the largest mean distance to their k nearest rows of the others.
    """
    counts = class_balance(df, target)["counts"]
    if len(counts) < 2:
        return df
    big = max(counts, key=lambda c: (counts[c], str(c)))
    xs = [f"x{i}" for i in range(len(columns))]
    scale = _scale(df.where(F.col(f"`{target}`").isNotNull()), columns)
    points = _points(df, target, columns, big, scale)
    is_big = F.coalesce(F.col(f"`{target}`") == F.lit(big), F.lit(False))
    placed = df.select("*", *[F.when(is_big, F.coalesce(numeric(df, c), F.lit(0.0)) / F.lit(s) + F.lit(0.0)).alias(f"__x{i}") for i, (c, s) in enumerate(zip(columns, scale, strict=True))])
    keys = [f"__x{i}" for i in range(len(columns))]
    named = lambda t, *more: t.select(*[F.col(x).alias(f"__{x}") for x in xs], *more)
    v = F.array(*xs)
    if method == "enn":
        gone = nearest(points, len(xs), {"own": k + 1, "oth": k}, F.col("own") > 0).where(_others(k) > k / 2)
        return placed.join(named(gone), keys, "left_anti").select(*df.columns)
    if method == "tomek":
        found = nearest(points, len(xs), {"own": 2, "oth": 2}, F.lit(True)).persist(StorageLevel.MEMORY_AND_DISK)
        single = found.where(F.col("own") + F.col("oth") == 1)
        first = lambda s, i: F.try_element_at(F.col(s), F.lit(i))
        # The nearest of the other class is nearer than the next of the same class, which is second to the row itself.
        ahead = lambda mine, other: first(other, 1).isNotNull() & (first(mine, 2).isNull() | (first(other, 1)["d"] < first(mine, 2)["d"]))
        a = single.where((F.col("own") == 1) & ahead("near_own", "near_oth")).select(*xs, v.alias("a"), first("near_oth", 1)["v"].alias("b"))
        b = single.where((F.col("oth") == 1) & ahead("near_oth", "near_own")).select(v.alias("b"), first("near_own", 1)["v"].alias("a"))
        gone = a.join(b, ["a", "b"], "left_semi").select(*xs).unionByName(found.where("own = 1 and oth = 1").select(*xs))
        return placed.join(named(gone), keys, "left_anti").select(*df.columns)
    # A point of others puts at most as many copies of a point on the list as are left of its k.
    asked = nearest(points, len(xs), {"own": k}, F.col("oth") > 0)
    taken = asked.select(F.posexplode("near_own").alias("i", "s"), F.expr(f"aggregate(slice(near_own, 1, {k}), array(0L), (c, s) -> concat(c, array(element_at(c, -1) + s.n)))").alias("before"))
    listed = taken.select(F.col("s.v").alias("v"), F.least(F.col("s.n"), F.lit(k) - F.element_at("before", F.col("i") + 1)).alias("m")).where("m > 0").groupBy("v").agg(F.max("m").alias("m"))
    far = nearest(points, len(xs), {"oth": k}, F.col("own") > 0)
    rows = F.slice(F.flatten(F.transform("near_oth", lambda s: F.array_repeat(F.sqrt(s["d"]), F.least(s["n"], F.lit(k)).cast("int")))), 1, k)
    mean = F.aggregate(rows, F.lit(0.0), lambda t, x: t + x) / F.size(rows)
    short = far.select(*xs, v.alias("v"), mean.alias("__mean")).join(listed, "v")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    near = placed.where(is_big).join(named(short, "__mean", F.col("m").alias("__m")), keys)
    near = near.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(whole))).where(F.col("__i") <= k).where("__i <= __m")
    kept = _first(near, target, -F.col("__mean"), [*keys, "__i"], {big: min(counts.values())})
    return df.where(~is_big).unionByName(kept.select(*df.columns))


def balance(df: DataFrame, target: str, columns: list[str], key: list[str], method: str = "smote", ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Balance by a named method; a table whose smallest class has `ratio` of the largest already stays."""
    if (class_balance(df, target)["ratio"] or 1.0) >= ratio:
        return df
    if method == "random_over":
        return random_over(df, target, key, seed)
    if method == "random_under":
        return random_under(df, target, key, seed)
    if method in ("tomek", "nearmiss"):
        return clean_borders(df, target, columns, method)
    if method in ("smoteenn", "smotetomek"):
        return clean_borders(smote(df, target, columns, seed=seed), target, columns, method[5:])
    if method == "hybrid_mix":
        # Up to five times, or half of the largest; then the largest is cut to the rest's smallest class over 0.7.
        counts = class_balance(df, target)["counts"]
        few, most = min(counts.values()), max(counts.values())
        grown = smote(df, target, columns, seed=seed, wanted={c: int(most * min(0.5, few / most * 5)) for c in counts if counts[c] < most})
        now = class_balance(grown, target)["counts"]
        return near_minority(grown, target, columns, int(min(now.values()) / 0.7))
    if method == "self_paced":
        return smote(df, target, columns, seed=seed, wanted=self_paced_wants(class_balance(df, target)["counts"]))
    if method == "self_paced_under":
        return self_paced_under(df, target, columns, key, seed=seed)
    return smote(df, target, columns, method, seed=seed)
