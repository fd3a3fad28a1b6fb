"""Config-driven preprocessing: fit once, keep the statistics, transform any table with them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import balance, clean, learn
from tessella.operators.clean import Bounds, Imputer
from tessella.plans.saved import Chain
from tessella.registry import OperatorError, corr, numeric, stats
from tessella.sources.store import Store

#: Settings and their defaults.
DEFAULTS: dict[str, Any] = {
    "missing": "median", "categorical_missing": "most_frequent", "outliers": None, "correlation": 0.95, "generate": "none", "select": "none", "max_features": 20,
    "scale": "standard", "encode": "onehot", "max_categories": 50, "reduce": None, "variance": 0.95, "balance": None, "entity": None, "dates": False, "target_means": False,
}

PRESETS: dict[str, dict[str, Any]] = {
    "plain": {}, "robust": {"outliers": "iqr", "scale": "robust"}, "minmax": {"scale": "minmax"}, "clean": {"outliers": "zscore", "correlation": 0.9}, "interactions": {"generate": "products", "select": "variance"},
    "maths": {"generate": "maths", "select": "variance"}, "full": {"generate": "all", "select": "variance", "outliers": "iqr"}, "informed": {"generate": "products", "select": "mutual_info"}, "modelled": {"generate": "products", "select": "model_based"},
    "components": {"reduce": "pca"}, "ordinal": {"encode": "ordinal"}, "mean_fill": {"missing": "mean"}, "knn_fill": {"missing": "knn"}, "iterative_fill": {"missing": "iterative"},
    "smote": {"balance": "smote"}, "borderline": {"balance": "borderline"}, "adasyn": {"balance": "adasyn"}, "over": {"balance": "random_over"}, "under": {"balance": "random_under"}, "smoteenn": {"balance": "smoteenn"}, "smotetomek": {"balance": "smotetomek"},
}


@dataclass
class PreprocessorModel:
    """Everything that was fitted, as JSON-able state."""

    config: dict[str, Any]
    target: str | None
    inputs: list[str]
    fills: dict[str, Any]
    ranges: dict[str, Any] = field(default_factory=dict)
    range_fills: dict[str, float] = field(default_factory=dict)
    strict: bool = False
    protect: list | None = None
    dropped: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    generated: list[str] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    scales: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    made: dict[str, dict[str, float]] = field(default_factory=dict)
    knn: dict[str, Any] | None = None
    regression: dict[str, Any] | None = None
    isolation: dict[str, Any] | None = None
    times: list[str] = field(default_factory=list)
    target_means: dict[str, dict[str, float]] = field(default_factory=dict)
    #: The names of columns that fitting makes (date parts, target means), where they are not those of the rule.
    renamed: dict[str, str] = field(default_factory=dict)
    #: What was learned of each entity: its column, the numbers, and the folder of the fitted operators.
    entity: dict[str, Any] | None = None

    def _base(self, df: DataFrame, drop_rows: bool) -> DataFrame:
        for c in self.inputs:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(0.0))
        df = self._filled(df)
        if drop_rows and self.isolation:
            df = clean.Isolation(**self.isolation).transform(df)
        if drop_rows and self.ranges:
            df = Bounds({c: tuple(r) for c, r in self.ranges.items()}, self.range_fills, tuple(self.protect) if self.protect else None, self.strict).transform(df)
        return df.drop(*[c for c in self.dropped if c != self.target])

    def _filled(self, df: DataFrame) -> DataFrame:
        """Dates and target means are columns, and nothing that was fitted is missing."""
        for c in (*self.times, *self.target_means):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("timestamp_ntz" if c in self.times else "string"))
        parts = [p.alias(self.renamed.get(n, n)) for c in self.times for n, p in _date_parts(df, c).items()]
        means = []
        for c, known in self.target_means.items():
            code = F.lit(None).cast("double")
            for v, m in known.items():
                code = F.when(F.col(f"`{c}`").cast("string") == v, F.lit(m)).otherwise(code)
            n = f"{c}_target_mean"
            means.append(code.alias(self.renamed.get(n, n)))
        # A column of such a name that fitting has not seen is no feature, and goes.
        made = {self.renamed.get(n, n).lower() for n in _made_names(self)}
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made], *parts, *means)
        if self.knn:
            df = clean.KnnFill(**self.knn).transform(df)
        if self.regression:
            df = clean.RegressionFill(**self.regression).transform(df)
        return self._of_entities(Imputer(self.fills).transform(df))

    def _of_entities(self, df: DataFrame) -> DataFrame:
        """Aggregates of the row's entity as fitting has seen it, and how far the row is from its mean. An entity that is new, or
        missing, has those of all rows."""
        if not self.entity:
            return df
        by = self.entity["by"]
        if by not in df.columns:
            df = df.withColumn(by, F.lit(None).cast("string"))
        df = Chain.load(df.sparkSession, self.entity["path"]).transform(df)
        far = [(numeric(df, c) - F.col(f"`{c}_by_{by}_mean`")).alias(f"{c}_diff_from_mean") for c in self.entity["columns"]]
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {f"{n}_diff_from_mean" for n in self.entity["columns"]}], *far)

    def _values(self, df: DataFrame) -> dict[str, Column]:
        """Each numeric feature as an expression, generated ones with fitted statistics."""
        out = {c: numeric(df, c) for c in self.numbers}
        for name in self.generated:
            s = self.made[name]
            kind = s["kind"]
            x = out.get(s.get("a")) if s.get("a") else None
            if kind == "product":
                out[name] = out[s["a"]] * out[s["b"]]
            elif kind == "zscore":
                out[name] = (x - F.lit(s["mean"])) / F.lit(s["std"] or 1.0)
            elif kind == "log":
                out[name] = F.log1p(F.greatest(x - F.lit(s["min"]) + 1, F.lit(0.0))) if s["min"] >= 0 else F.log1p(F.abs(x))
            elif kind == "sqrt":
                out[name] = F.sqrt(F.greatest(x - F.lit(s["min"]) + F.lit(1e-8), F.lit(0.0)))
        return out

    def transform(self, df: DataFrame, drop_rows: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        """num__x and cat__x_value columns, then the target, and any columns to keep. Rows only go with drop_rows."""
        return self._features(self._base(df, drop_rows), keep)

    def _features(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The features of a table in which nothing is missing."""
        values = self._values(df)
        cols = []
        for c in self.selected:
            a, b = self.scales.get(c, (0.0, 1.0))
            cols.append(((values[c] - F.lit(a)) / F.lit(b)).alias(f"num__{c}"))
        for c, cats in self.categories.items():
            x = F.col(f"`{c}`").cast("string")
            if self.config["encode"] == "ordinal":
                code = F.lit(-1)
                for i, v in enumerate(cats):
                    code = F.when(x == v, i).otherwise(code)
                cols.append(code.cast("double").alias(f"cat__{c}"))
            else:
                cols += [F.coalesce((x == v).cast("double"), F.lit(0.0)).alias(f"cat__{c}_{v}") for v in cats]
                if len(cats) >= self.config["max_categories"]:  # the rest, and what fitting has not seen
                    cols.append(F.coalesce((~x.isin(cats)).cast("double"), F.lit(0.0)).alias(f"cat__{c}__other"))
        kept = [F.col(f"`{c}`") for c in dict.fromkeys((*keep, *([self.target] if self.target and self.target in df.columns else [])))]
        out = df.select(*cols, *kept)
        if self.config["reduce"]:
            loads = self.made["__pca"]
            names = loads["columns"]
            comps = [sum((F.col(f"`{n}`") - F.lit(loads["means"][i])) * F.lit(loads["w"][k][i]) for i, n in enumerate(names)).alias(f"PC{k + 1}") for k in range(len(loads["w"]))]
            out = out.select(*comps, *kept)
        return out

    def save(self, path: str) -> None:
        """Write JSON on the driver. Rows that knn fills take values from go to a table at path.rows, and aggregates of entities to
        path.entities, where executors must be able to read them."""
        state = asdict(self)
        if self.knn:
            state["knn"] = asdict(clean.KnnFill(**self.knn).save(SparkSession.active(), f"{path}.rows"))
        if self.entity:
            Chain.load(SparkSession.active(), self.entity["path"]).save(SparkSession.active(), f"{path}.entities")
            state["entity"] = self.entity | {"path": f"{path}.entities"}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(state, f, default=str)

    @staticmethod
    def load(path: str) -> PreprocessorModel:
        with open(path, encoding="utf-8") as f:
            return PreprocessorModel(**json.load(f))


def fit(df: DataFrame, config: dict[str, Any] | str | None = None, target: str | None = None, key: list[str] | None = None, task: str = "classification") -> PreprocessorModel:
    """Fill, bound, drop correlated, generate, select, encode and scale, in that order. The key's columns are no features."""
    config = DEFAULTS | (PRESETS[config] if isinstance(config, str) else config or {})
    skip = tuple(x for x in ((target,) if target else ()) + tuple(key or ()))
    features = [c for c in (*clean.numeric_columns(df, skip), *clean.category_columns(df, skip))]
    model = PreprocessorModel(config, target, list(features), {})
    if config["dates"]:
        model.times = [c for c in clean.time_columns(df, skip)]
    if config["target_means"] and target:
        model.target_means = _target_means(df, target, skip)
    there = {c.lower() for c in df.columns}
    for n in _made_names(model):
        free = n
        while free.lower() in there:
            free += "_"
        there.add(free.lower())
        if free != n:
            model.renamed[n] = free
    df = model._filled(df)  # nothing is filled yet
    nums = clean.numeric_columns(df, skip)
    if config["missing"] == "knn" and nums:
        model.knn = asdict(clean.KnnFill.fit(df, nums))
        df = clean.KnnFill(**model.knn).transform(df)
    elif config["missing"] == "iterative" and len(nums) > 1:
        model.regression = asdict(clean.RegressionFill.fit(df, nums))
        df = clean.RegressionFill(**model.regression).transform(df)
    strategy = config["missing"] if config["missing"] in ("mean", "median", "most_frequent", "constant") else "median"
    imputer = clean.fit_imputer(df, strategy, config["categorical_missing"], [*features, *nums])
    model.fills = imputer.fills
    df = imputer.transform(df)
    if config["entity"]:
        _learn_entities(model, df, config["entity"], [c for c in nums if c != config["entity"]][:5])
        df = model._of_entities(df)
        nums = clean.numeric_columns(df, skip)
    if config["outliers"] == "isolation_forest":
        forest = clean.Isolation.fit(df, nums)
        if forest:
            model.isolation = asdict(forest)
            df = forest.transform(df)
    elif config["outliers"]:
        b = clean.fit_outliers(df, config["outliers"], nums, target)
        model.ranges, model.range_fills, model.strict = {c: list(r) for c, r in b.ranges.items()}, b.fills, b.strict
        model.protect = list(b.protect) if b.protect else None
        df = b.transform(df)
    model.dropped = clean.correlated(df, nums, config["correlation"]) if config["correlation"] and len(nums) > 1 else []
    model.numbers = [c for c in nums if c not in model.dropped]
    _generate(model, df, target)
    values = model._values(df)
    wide = df.select(*[v.alias(c) for c, v in values.items()], *([F.col(f"`{target}`")] if target else []))
    names = list(values)
    model.selected = names if config["select"] == "none" or not names else learn.select(wide, names, target, config["select"], config["max_features"], task)
    _scale(model, wide)
    for c in clean.category_columns(df, skip):
        cats = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(config["max_categories"]).collect()
        model.categories[c] = sorted(r.v for r in cats)
    if config["reduce"]:
        if config["reduce"] not in ("pca", "tsne", "umap"):
            raise OperatorError(f"unknown reduction {config['reduce']!r}")
        _components(model, df)
    return model


def _learn_entities(model: PreprocessorModel, df: DataFrame, by: str, columns: list[str]) -> None:
    """Aggregates of up to five numbers by entity, in one pass; they stand in a table."""
    if by not in df.columns:
        raise OperatorError(f"no column {by!r}")
    store = Store.kept(df.sparkSession)
    steps = [(f"group_{a}", [c, by], f"{c}_by_{by}_{a}", {}) for c in columns for a in ("mean", "std", "min", "max", "count")]
    Chain.fit(df, steps).save(df.sparkSession, f"{store.root}/entities")
    model.entity = {"by": by, "columns": columns, "path": f"{store.root}/entities"}


def _date_parts(df: DataFrame, column: str) -> dict[str, Column]:
    """Year, month, day, weekday from Monday as 0, weekend and hour (-1 for dates without a time)."""
    t = F.col(f"`{column}`")
    hour = F.lit(-1) if dict(df.dtypes)[column] == "date" else F.hour(t)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "hour": hour}
    return {f"{column}_{n}": p.cast("double") for n, p in parts.items()}


def _made_names(model: PreprocessorModel) -> list[str]:
    """The names of date parts and target means, before any is changed."""
    return [f"{c}_{n}" for c in model.times for n in ("year", "month", "day", "dayofweek", "is_weekend", "hour")] + [f"{c}_target_mean" for c in model.target_means]


def _target_means(df: DataFrame, target: str, skip: tuple[str, ...], classes: int = 10, categories: int = 50) -> dict[str, dict[str, float]]:
    """The target's mean by category, of text columns with fewer than `categories` values, if the target is a number with fewer
    than `classes`. Categories not seen in fitting have none."""
    if target not in clean.numeric_columns(df) or len(df.select(target).distinct().limit(classes).collect()) >= classes:
        return {}
    out = {}
    for c in clean.category_columns(df, skip):
        v = F.col(f"`{c}`").cast("string").alias("v")
        rows = df.where(F.col(f"`{c}`").isNotNull()).groupBy(v).agg(F.avg(numeric(df, target)).alias("m")).orderBy("v").limit(categories).collect()
        if len(rows) < categories:
            out[c] = {r.v: r.m for r in rows if r.m is not None}
    return out


def _generate(model: PreprocessorModel, df: DataFrame, target: str | None, widest: int = 10, top: int = 20) -> None:
    how, nums = model.config["generate"], model.numbers
    if how == "none" or not nums:
        return
    row = stats(df, **{f"{n}{i}": f(numeric(df, c)) for i, c in enumerate(nums) for n, f in (("v", F.var_samp), ("lo", F.min), ("m", F.avg), ("s", F.stddev_pop))})
    base = sorted(nums, key=lambda c: (-(row[f"v{nums.index(c)}"] or 0.0), nums.index(c)))[:widest]
    base = [c for c in nums if c in base]
    made: dict[str, dict[str, Any]] = {}
    if how in ("products", "all"):
        made |= {f"interaction_{a} {b}": {"kind": "product", "a": a, "b": b} for i, a in enumerate(base) for b in base[i + 1 :]}
    if how in ("maths", "all"):
        for c in nums:
            i = nums.index(c)
            made[f"{c}_zscore"] = {"kind": "zscore", "a": c, "mean": row[f"m{i}"] or 0.0, "std": row[f"s{i}"] or 1.0}
            made[f"{c}_log"] = {"kind": "log", "a": c, "min": row[f"lo{i}"] or 0.0}
            made[f"{c}_sqrt"] = {"kind": "sqrt", "a": c, "min": row[f"lo{i}"] or 0.0}
    model.made, model.generated = made, list(made)
    if len(made) > 2 * len(nums) and target and target in clean.numeric_columns(df):
        values = model._values(df)
        y = numeric(df, target)
        r = stats(df, **{f"r{i}": corr(values[c], y) for i, c in enumerate(made)})
        best = sorted(made, key=lambda c: (-abs(r[f"r{list(made).index(c)}"] or 0.0), list(made).index(c)))[:top]
        model.generated = [c for c in made if c in best]


def _scale(model: PreprocessorModel, wide: DataFrame) -> None:
    how, names = model.config["scale"], model.selected
    if how in (None, "none") or not names:
        return
    if how == "robust":
        from tessella.operators import order

        for c, (a, m, b) in zip(names, order.many_quantiles(wide, [F.col(f"`{c}`").cast("double") for c in names], [0.25, 0.5, 0.75]), strict=True):
            model.scales[c] = [m or 0.0, (b or 0.0) - (a or 0.0) or 1.0]
        return
    if how not in ("standard", "minmax"):
        raise OperatorError(f"unknown scaling {how!r}")
    f, g = (F.avg, F.stddev_pop) if how == "standard" else (F.min, F.max)
    row = stats(wide, **{f"{n}{i}": h(F.col(f"`{c}`")) for i, c in enumerate(names) for n, h in (("a", f), ("b", g))})
    for i, c in enumerate(names):
        a, b = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
        model.scales[c] = [a, (b if how == "standard" else b - a) or 1.0]


def _components(model: PreprocessorModel, df: DataFrame) -> None:
    import numpy as np

    how, model.config = model.config, model.config | {"reduce": None}
    plain = model._features(df)
    model.config = how
    names = [c for c in plain.columns if c.startswith(("num__", "cat__"))]
    x = [F.col(f"`{c}`").cast("double") for c in names]
    row = stats(plain, **{f"m{i}": F.avg(c) for i, c in enumerate(x)}, **{f"c{i}_{j}": F.covar_pop(a, b) for i, a in enumerate(x) for j, b in enumerate(x) if j >= i})
    m = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    w, v = np.linalg.eigh(m)
    w, v = w[::-1], v[:, ::-1]
    share = np.cumsum(w) / max(1e-300, w.sum())
    # Pictures of a table (embed.py) place the rows that they are made of; for tables that come later, two components stand for them.
    k = min(max(2, int(np.searchsorted(share, how["variance"]) + 1)), max(1, len(names) - 1)) if how["reduce"] == "pca" else min(2, len(names))
    v = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(axis=0), np.arange(k)])
    model.made["__pca"] = {"columns": names, "means": [row[f"m{i}"] or 0.0 for i in range(len(x))], "w": v.T.tolist()}


def fit_transform(df: DataFrame, config: dict[str, Any] | str | None = None, target: str | None = None, key: list[str] | None = None, task: str = "classification") -> tuple[PreprocessorModel, DataFrame]:
    """Fit, transform without the bounded rows, and balance if the config says so."""
    model = fit(df, config, target, key, task)
    out = model.transform(df, drop_rows=True, keep=tuple(key or ()))
    if model.config["balance"] and target:
        columns = [c for c in out.columns if c != target and c not in (key or ())]
        out = balance.balance(out, target, columns, key or columns, model.config["balance"])
    return model, out
