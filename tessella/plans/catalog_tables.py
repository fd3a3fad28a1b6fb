"""Registered queries of the table-level operators: profiles, cleaning, splits, metrics, drift, balancing, preparation, search."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import balance, clean, evaluate, groups, learn, profile, texts
from tessella.plans import explorer, handlers, preprocessor, search, validate
from tessella.plans.catalog import ORACLES, query, read, real, source, source_sql, whole
from tessella.sources import io
from tessella.streaming import features

EVENTS_N = source_sql("events")
ORDERS = source_sql("orders")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A small result of the driver as a table, doubles rounded."""
    df = spark.createDataFrame(data, schema)
    return df.select(*[real(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql() -> str:
    one = "select '{c}' as feature, count({c})::bigint as n, round(avg({c}), 6) + 0.0 as mean, round(stddev_samp({c}), 6) + 0.0 as std, round(min({c}), 6) + 0.0 as low, round(max({c}), 6) + 0.0 as high, round(quantile_cont({c}, 0.25), 6) + 0.0 as q1, round(quantile_cont({c}, 0.5), 6) + 0.0 as median, round(quantile_cont({c}, 0.75), 6) + 0.0 as q3, round(skewness({c}), 6) + 0.0 as skewness, round(kurtosis({c}), 6) + 0.0 as kurtosis from lineitem"
    return " union all ".join(one.format(c=c) for c in NUMS)


@query("describe", _describe_sql())
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.numeric_profile(read(spark, sf_dir, "lineitem"), NUMS)
    return rows(spark, [(c, v["count"], v["mean"], v["std"], v["min"], v["max"], v["q1"], v["median"], v["q3"], v["skewness"], v["kurtosis"]) for c, v in p.items()], "feature string, n bigint, mean double, std double, low double, high double, q1 double, median double, q3 double, skewness double, kurtosis double")


@query("outlier_share", "with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) select 'value' as feature, count(*) filter (value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a))::bigint as outliers from events, q")
def outlier_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.numeric_profile(read(spark, sf_dir, "events"), ["value"])["value"]
    return rows(spark, [("value", p["outliers"])], "feature string, outliers bigint")


@query("missing_counts", f"select 'priority_n' as feature, count(*) - count(priority_n) as missing from {ORDERS} union all select 'o_totalprice', count(*) - count(o_totalprice) from orders")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.analyze(source(spark, sf_dir, "orders").select("priority_n", "o_totalprice"))
    return rows(spark, [(c, r["missing"][c]) for c in ("priority_n", "o_totalprice")], "feature string, missing bigint")


@query("duplicate_rows", "select (count(*) - count(distinct (l_orderkey, l_linenumber)))::bigint as duplicates from lineitem")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.analyze(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    return rows(spark, [(r["duplicate_rows"],)], "duplicates bigint")


@query("value_counts", "select o_orderpriority as value, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from orders group by 1 order by count(*) desc, 1 limit 5")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.category_profile(read(spark, sf_dir, "orders"), ["o_orderpriority"])["o_orderpriority"]
    return rows(spark, p["top"], "value string, share double")


@query("time_profile", "with t as (select distinct ts from events), g as (select epoch_us(lead(ts) over (order by ts)) - epoch_us(ts) as gap from t), m as (select gap from g where gap is not null group by gap order by count(*) desc, gap limit 1) select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high, round((select gap / 1e6 from m), 6) + 0.0 as gap_seconds from events")
def time_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.time_profile(read(spark, sf_dir, "events"), ["ts"])["ts"]
    return rows(spark, [(p["min_micros"], p["max_micros"], p["modal_gap_seconds"])], "low bigint, high bigint, gap_seconds double")


@query("correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as r from lineitem" for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(a, b, r) for (a, b), r in clean.correlations(read(spark, sf_dir, "lineitem"), NUMS).items()], "a string, b string, r double")


@query("correlated_columns", "select 'double_quantity' as feature where (select abs(corr(l_quantity, 2 * l_quantity + 1)) from lineitem) > 0.95")
def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("double_quantity", 2 * F.col("l_quantity") + 1)
    return rows(spark, [(c,) for c in clean.correlated(df, [*NUMS, "double_quantity"])], "feature string")


@query("correlated_groups", "select 'l_quantity' as a, 'double_quantity' as b")
def correlated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("double_quantity", 2 * F.col("l_quantity") + 1)
    return rows(spark, [tuple(g) for g in evaluate.correlated_groups(df, ["l_quantity", "l_discount", "double_quantity"])], "a string, b string")


def _rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


@query("spearman", f"select round(corr(a, b), 6) + 0.0 as r from (select {_rank('l_quantity')} as a, {_rank('l_extendedprice')} as b from lineitem)")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(evaluate.rank_correlation(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"),)], "r double")


#: Pairs of rows that agree less those that do not, from running counts by level of the first column.
_KENDALL = """
with r as (select l_quantity as a, l_extendedprice as b, count(*) as n from lineitem group by 1, 2),
levels as (select distinct a as level from r),
c as (select r.a, r.b, r.n, level, coalesce(sum(case when a = level then n else 0 end) over (partition by level order by b groups between unbounded preceding and 1 preceding), 0) as below,
  coalesce(sum(case when a = level then n else 0 end) over (partition by level order by b groups between 1 following and unbounded following), 0) as above from r, levels),
s as (select sum(case when level < a then n::hugeint * (below - above) else 0 end)::double as s from c),
t as (select sum(n)::double as n from r), ta as (select sum(x * (x - 1) / 2)::double as t from (select sum(n)::double as x from r group by a)), tb as (select sum(x * (x - 1) / 2)::double as t from (select sum(n)::double as x from r group by b))
select round(s / sqrt((t.n * (t.n - 1) / 2 - ta.t) * (t.n * (t.n - 1) / 2 - tb.t)), 6) + 0.0 as r from s, t, ta, tb
"""


@query("kendall", _KENDALL)
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(evaluate.kendall(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"),)], "r double")


@query("redundant_pairs", "select 'l_quantity' as a, 'double_quantity' as b, round(corr(l_quantity, 2 * l_quantity + 1), 6) + 0.0 as r from lineitem")
def redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("double_quantity", 2 * F.col("l_quantity") + 1)
    return rows(spark, evaluate.redundant_pairs(df, ["l_quantity", "l_discount", "double_quantity"]), "a string, b string, r double")


_V = "with j as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by 1, 2), m as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from j), s as (select sum(n * n / (na * nb)) - 1 as phi, max(t) as t, count(distinct a) as r, count(distinct b) as k from m)"


@query("cramers_v", f"{_V} select round(sqrt(greatest(0, phi - (k - 1) * (r - 1) / (t - 1)) / least(k - (k - 1) * (k - 1) / (t - 1) - 1, r - (r - 1) * (r - 1) / (t - 1) - 1)), 6) + 0.0 as v from s")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(evaluate.cramers_v(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"),)], "v double")


@query("mutual_information", "with j as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by 1, 2), m as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from j) select round(greatest(0, sum(n / t * ln(n * t / (na * nb)))), 6) + 0.0 as mi from m")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(evaluate.mutual_information(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"),)], "mi double")


_MI = f"""
with o as (select o_totalprice as x, event::varchar as y from {ORDERS}),
q as (select list_distinct([quantile_cont(x, j / 16.0) for j in range(1, 16)]) as cuts from o)
""".replace("[quantile_cont(x, j / 16.0) for j in range(1, 16)]", "[" + ", ".join(f"quantile_cont(x, {j / 16})" for j in range(1, 16)) + "]") + """,
v as (select len([c for c in cuts if x > c]) as x, y from o, q), j as (select x, y, count(*)::double as n from v group by 1, 2), t as (select sum(n) as n from j),
m as (select j.n, sum(j.n) over (partition by x) as a, sum(j.n) over (partition by y) as b from j)
select round(greatest(0, sum(m.n / t.n * ln(m.n * t.n / (a * b)))), 6) + 0.0 as mi from m, t
"""


@query("mutual_information_binned", _MI)
def mutual_information_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(evaluate.mutual_information(source(spark, sf_dir, "orders"), "o_totalprice", "event"),)], "mi double")


@query("class_balance", "with c as (select o_orderstatus as s, count(*) as n from orders group by 1) select round(min(n) / max(n), 6) + 0.0 as ratio, round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) + 0.0 as entropy from c, (select sum(n) as t from c) group by t")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluate.class_balance(read(spark, sf_dir, "orders"), "o_orderstatus")
    return rows(spark, [(b["ratio"], b["entropy"])], "ratio double, entropy double")


@query("class_weights", "select o_orderkey, round(count(*) over () / ((select count(distinct o_orderstatus) from orders) * count(*) over (partition by o_orderstatus)), 6) + 0.0 as weight from orders")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.balanced_weights(read(spark, sf_dir, "orders"), "o_orderstatus").select("o_orderkey", real("weight").alias("weight"))


# Cleaning

for _how, _sql in (("mean", "avg(value_n) over ()"), ("median", f"(select quantile_cont(value_n, 0.5) from {EVENTS_N})")):

    def _impute(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        df = source(spark, sf_dir, "events").select("event_id", "value_n")
        return clean.fit_imputer(df, how, columns=["value_n"]).transform(df).select("event_id", real("value_n").alias("value"))

    query(f"impute_{_how}", f"select event_id, round(coalesce(value_n, {_sql}), 6) + 0.0 as value from {EVENTS_N}")(_impute)


@query("impute_mode", f"select o_orderkey, coalesce(priority_n, (select priority_n from {ORDERS} where priority_n is not null group by 1 order by count(*) desc, 1 limit 1)) as value from {ORDERS}")
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").select("o_orderkey", "priority_n")
    return clean.fit_imputer(df, columns=["priority_n"]).transform(df).select("o_orderkey", F.col("priority_n").alias("value"))


_KNN = f"""
with t as (select event_id, case when event_id % 17 = 0 then null else user_id::double end as u, hour(ts)::double + minute(ts)::double / 60.0::double as h, value_n as v from {EVENTS_N}),
p as (select q.event_id, d.v, sqrt((coalesce((q.u - d.u) * (q.u - d.u), 0) + (q.h - d.h) * (q.h - d.h)) * (3.0::double / (1 + (q.u is not null and d.u is not null)::int))) as dist
  from t q, t d where q.v is null and d.v is not null),
r as (select *, row_number() over (partition by event_id order by dist, v) as i from p),
f as (select event_id, sum(v / greatest(dist, 1e-12::double)) / sum(1 / greatest(dist, 1e-12::double)) as filled from r where i <= 5 group by event_id)
select event_id, round(coalesce(v, filled), 6) + 0.0 as value from t left join f using (event_id)
"""


@query("impute_knn", _KNN)
def impute_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 17 = 0 then null else cast(user_id as double) end as u", "cast(hour(ts) as double) + cast(minute(ts) as double) / 60.0D as h", "value_n")
    return clean.knn_impute(df, ["u", "h", "value_n"]).select("event_id", real("value_n").alias("value"))


@query("impute_iterative")
def impute_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("double").alias("u"), "value_n")
    return clean.iterative_impute(df, ["u", "value_n"], 3).select("event_id", real("value_n").alias("value"))


@query("outliers_iqr", "with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem) select l_orderkey, l_linenumber from lineitem, q where l_extendedprice between a - 0.1 * (b - a) and b + 0.1 * (b - a)")
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return clean.fit_outliers(df, "iqr", ["l_extendedprice"], cut=0.1).transform(df).select("l_orderkey", "l_linenumber")


@query("outliers_zscore", "with s as (select avg(value) as m, stddev_pop(value) as d from events) select event_id from events, s where value > m - 1.5 * d and value < m + 1.5 * d")
def outliers_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return clean.fit_outliers(df, "zscore", ["value"], cut=1.5).transform(df).select("event_id")


@query("outliers_clip", "with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) select event_id, round(least(greatest(value, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) + 0.0 as value from events, q")
def outliers_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return clean.fit_outliers(df, "iqr", ["value"], cut=0.5).clip(df).select("event_id", real("value").alias("value"))


@query("isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.isolation_forest(read(spark, sf_dir, "lineitem"), NUMS, out="score", key=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", real("score").alias("score"))


@query("low_variance", "select 'one' as feature union all select 'l_tax' where (select var_pop(l_tax) from lineitem) <= 0.01 union all select 'l_discount' where (select var_pop(l_discount) from lineitem) <= 0.01")
def low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return rows(spark, [(c,) for c in clean.low_variance(df, [*NUMS, "one"])], "feature string")


@query("replace_infinite", "select event_id, case when event_id % 5 = 0 then 1e9 when event_id % 5 = 1 then -1e9 else round(value, 6) + 0.0 end::double as value from events")
def replace_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    inf = F.lit(float("inf"))
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, inf).when(F.col("event_id") % 5 == 1, -inf).otherwise(F.col("value")).alias("value"))
    return clean.replace_infinite(df).select("event_id", real("value").alias("value"))


@query("drop_invalid", f"select event_id from {EVENTS_N} where value_n is not null")
def drop_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_invalid(source(spark, sf_dir, "events"), ["value_n"]).select("event_id")


@query("text_to_number", "select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9.\\-]', '', 'g') as double) as value from part")
def text_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_numbers(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("value")), ["value"])


@query("drop_duplicates", "select distinct l_returnflag, l_linestatus from lineitem")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.drop_duplicates(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("identifier_columns", "select 'c_mktsegment' as feature")
def identifier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_identifiers(read(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return rows(spark, [(c,) for c in kept.columns], "feature string")


@query("column_types", "select 'text' as feature, case when avg(length(text)) > 10 then 'text' else 'categorical' end as kind from documents union all select 'lang', case when avg(length(lang)) > 10 then 'text' else 'categorical' end from documents union all select 'doc_id', 'numeric'")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = profile.infer_types(read(spark, sf_dir, "documents").select("text", "lang", "doc_id"))
    return rows(spark, list(kinds.items()), "feature string, kind string")


# Splits and metrics


_CUT = "(select quantile_cont(epoch_us(ts)::double, {}) from events)"


@query("time_blocks", "select event_id, (" + " + ".join(f"case when epoch_us(ts) > {_CUT.format(i / 5)} then 1 else 0 end" for i in range(1, 5)) + ")::int as fold from events")
def time_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("ts", F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")))
    return evaluate.time_blocks(df, "ts").select("event_id", "fold")


_PRED = "(select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as y, case when o_totalprice > 150000 then 1 else 0 end as p, o_totalprice / 500000 as s from orders)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("p"), (F.col("o_totalprice") / 500000).alias("s"))


@query("classification_metrics", f"with c as (select count(*) filter (y = 1 and p = 1)::double as tp, count(*) filter (y = 1 and p = 0)::double as fn, count(*) filter (y = 0 and p = 1)::double as fp, count(*) filter (y = 0 and p = 0)::double as tn from {_PRED}) select round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 as accuracy, round(tp / (tp + fp), 6) + 0.0 as \"precision\", round(tp / (tp + fn), 6) + 0.0 as recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 as f1, round(tn / (tn + fp), 6) + 0.0 as specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0.0 as balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 as mcc from c")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.classification(_predictions(spark, sf_dir), "y", "p")
    one = m["classes"][1]
    return rows(spark, [(m["accuracy"], one["precision"], one["recall"], one["f1"], one["specificity"], m["balanced_accuracy"], m["mcc"])], "accuracy double, precision double, recall double, f1 double, specificity double, balanced_accuracy double, mcc double")


@query("ranking_metrics", f"with r as (select y, s, {_rank('s')} as k, count(*) over (order by s desc) as n, sum(y) over (order by s desc) as tp from {_PRED}), t as (select sum(y) as p, count(*) as n from {_PRED}) select round((sum(r.k) filter (y = 1) - max(t.p) * (max(t.p) + 1) / 2) / (max(t.p) * (max(t.n) - max(t.p))), 6) + 0.0 as roc_auc, round(sum(y * r.tp / r.n) / max(t.p), 6) + 0.0 as average_precision from r, t")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.ranking(_predictions(spark, sf_dir), "y", "s")
    return rows(spark, [(m["roc_auc"], m["average_precision"])], "roc_auc double, average_precision double")


@query("regression_metrics", "with e as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem) select round(sqrt(avg((y - p) * (y - p))), 4) + 0.0 as rmse, round(avg(abs(y - p)), 4) + 0.0 as mae, round(avg(abs((y - p) / y)), 6) + 0.0 as mape, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) + 0.0 as r2 from e")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.regression(read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p")
    return rows(spark, [(round(m["rmse"], 4), round(m["mae"], 4), m["mape"], m["r2"])], "rmse double, mae double, mape double, r2 double")


@query("calibration", f"select least(floor(s * 10), 9)::int as bin, count(*) as n, round(avg(s), 6) + 0.0 as mean_score, round(avg(y), 6) + 0.0 as share from {_PRED} group by 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.calibration(_predictions(spark, sf_dir), "y", "s")
    return rows(spark, [(b["bin"], b["n"], b["mean_score"], b["share"]) for b in c["bins"]], "bin int, n bigint, mean_score double, share double")


_HALF = "ts < timestamp '2024-01-16'"


@query("drift_ks", f"with e as (select value, {_HALF} as a from events), v as (select value, sum(count(*) filter (a)) over (order by value) / (select count(*) from e where a) as fa, sum(count(*) filter (not a)) over (order by value) / (select count(*) from e where not a) as fb from e group by value) select round(max(abs(fa - fb)), 6) + 0.0 as ks from v")
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    d, _, _ = evaluate.ks_statistic(df.where("ts < timestamp_ntz'2024-01-16'"), df.where("ts >= timestamp_ntz'2024-01-16'"), "value")
    return rows(spark, [(d,)], "ks double")


_DRIFT = """
with x as (select 'value' as feature, value as v, ts < timestamp '2024-01-16' as a from events union all select 'user', user_id::double, ts < timestamp '2024-01-16' from events),
c as (select feature, v, count(*) filter (a)::double as na, count(*) filter (not a)::double as nb from x group by 1, 2),
t as (select feature, count(*) filter (a)::double as n, count(*) filter (not a)::double as m, avg(v) filter (a) as ma, avg(v) filter (not a) as mb, stddev_pop(v) filter (a) as sa, stddev_pop(v) filter (not a) as sb,
  quantile_cont(v, [0.25, 0.5, 0.75]) filter (a) as qa, quantile_cont(v, [0.25, 0.5, 0.75]) filter (not a) as qb from x group by 1),
d as (select feature, max(abs(fa / n - fb / m)) as ks from (select c.feature, n, m, sum(na) over w as fa, sum(nb) over w as fb from c join t using (feature) window w as (partition by c.feature order by v)) group by 1),
s as (select *, sqrt((sa * sa + sb * sb) / 2) as sd, ks * sqrt(n * m / (n + m)) as z from d join t using (feature)),
p as (select *, case when z < 0.2 then 1.0 else greatest(0.0, least(1.0, 2 * list_sum([power(-1.0, k - 1) * exp(-2.0 * k * k * z * z) for k in range(1, 101)]))) end as p_value,
  0.5 * ks + 0.3 * least(1.0, abs(ma - mb) / sd) + 0.2 * least(1.0, greatest(abs(qa[1] - qb[1]), abs(qa[2] - qb[2]), abs(qa[3] - qb[3])) / sd) as score from s)
select feature, round(ks::double, 6) + 0.0 as ks, round(p_value::double, 6) + 0.0 as p_value, round(score::double, 6) + 0.0 as score, p_value < 0.05 and score > 0.3 as drifted from p
"""


@query("drift", _DRIFT)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("ts", "value", F.col("user_id").cast("double").alias("user"))
    d = evaluate.drift(df.where("ts < timestamp_ntz'2024-01-16'"), df.where("ts >= timestamp_ntz'2024-01-16'"), ["value", "user"])
    return rows(spark, [(c, v["ks"], v["p_value"], v["score"], v["drifted"]) for c, v in d["columns"].items()], "feature string, ks double, p_value double, score double, drifted boolean")


# Balancing


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", "\\s+")).cast("double").alias("words"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


for _m in ("smote", "borderline", "adasyn", "svm", "kmeans"):

    def _smote(spark: SparkSession, sf_dir: str, how: str = _m) -> DataFrame:
        return balance.smote(_toxic(spark, sf_dir), "toxic", ["chars", "words"], how).groupBy("toxic").agg(F.count("*").alias("n"))

    query(f"balance_{_m}", "select toxic, (select max(n) from (select count(*) as n from documents join labels using (doc_id) group by toxic))::bigint as n from documents join labels using (doc_id) group by 1")(_smote)

#: Scaled points of the labelled documents; the larger class is 'big'.
_POINTS = r"""
with d as (select doc_id, n_chars::double as chars, len(string_split_regex(text, '\s+'))::double as words, toxic from documents join labels using (doc_id)),
big as (select toxic as c from d group by 1 order by count(*) desc, toxic::varchar desc limit 1), s as (select stddev_pop(chars) as a, stddev_pop(words) as b from d),
p as (select doc_id, chars / a as x, words / b as y, toxic = c as big from d, s, big),
n as (select p.doc_id, p.big, p.x, p.y, q.doc_id as other, q.big as other_big, q.x as ox, q.y as oy, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) as dist from p, p q where p.doc_id <> q.doc_id)
"""
#: A row's nearest row: at equal distances its own class first, then the smallest point.
_TOMEK = _POINTS + """,
f as (select *, row_number() over (partition by doc_id order by dist, (other_big <> big)::int, ox, oy, other) as i from n),
near as (select * from f where i = 1),
-- places: a row whose nearest is of the other class, where that place's nearest is this one's
link as (select a.doc_id from near a join near b on a.ox = b.x and a.oy = b.y and b.ox = a.x and b.oy = a.y where a.big and not a.other_big and not b.big and b.other_big)
select doc_id from p where not (big and doc_id in (select doc_id from link)) and (select 1.0 * min(k) / max(k) from (select count(*) as k from p group by big)) < 0.8
union all select doc_id from p where (select 1.0 * min(k) / max(k) from (select count(*) as k from p group by big)) >= 0.8
"""
_ENN = _POINTS + """,
f as (select *, row_number() over (partition by doc_id order by dist, (other_big <> big)::int, ox, oy, other) as i from n),
gone as (select doc_id from f where i <= 3 and big group by doc_id having count(*) filter (not other_big) > 1.5)
select doc_id from p where doc_id not in (select doc_id from gone)
"""


@query("balance_tomek", _TOMEK)
def balance_tomek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay when the Tomek links' rows of the larger class go."""
    return balance.balance(_toxic(spark, sf_dir), "toxic", ["chars", "words"], ["doc_id"], "tomek").select("doc_id")


@query("balance_enn", _ENN)
def balance_enn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay when those of the larger class go whose three nearest are mostly of the other."""
    return balance.clean_borders(_toxic(spark, sf_dir), "toxic", ["chars", "words"], "enn").select("doc_id")


for _how in ("nearmiss", "smoteenn", "smotetomek", "hybrid_mix", "self_paced"):

    def _bordered(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return balance.balance(_toxic(spark, sf_dir), "toxic", ["chars", "words"], ["doc_id"], how).groupBy("toxic").agg(F.count("*").alias("n"))

    query(f"balance_{_how}")(_bordered)


# Preparation, charts' data, models


@query("prepare_classification", "select o_orderkey, dense_rank() over (order by o_orderstatus) - 1 as status, dense_rank() over (order by o_orderpriority) - 1 as priority from orders")
def prepare_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = handlers.prepare_classification(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus")
    return done.select("o_orderkey", whole("o_orderstatus").alias("status"), whole("o_orderpriority").alias("priority"))


@query("prepare_regression", "select o_orderkey, round(o_totalprice, 6) + 0.0 as y, (o_orderstatus = 'O')::int as status_o, (o_orderstatus = 'P')::int as status_p from orders")
def prepare_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = handlers.prepare_regression(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice")
    return done.select("o_orderkey", real("o_totalprice").alias("y"), F.col("o_orderstatus_O").alias("status_o"), F.col("o_orderstatus_P").alias("status_p"))


@query("prepare_text", "select doc_id, text, dense_rank() over (order by lang) - 1 as lang from documents")
def prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handlers.prepare_text(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text").select("doc_id", "text", whole("lang").alias("lang"))


_TW = "(partition by user_id order by ts, event_id{})"


@query("prepare_time_series", f"select event_id, month(ts)::bigint as month, (isodow(ts) - 1)::bigint as dayofweek, round(lag(value, 2) over {_TW.format('')}, 6) + 0.0 as lag_2, round(case when count(value) over {_TW.format(' rows between 4 preceding and 2 preceding')} = 3 then avg(value) over {_TW.format(' rows between 4 preceding and 2 preceding')} end, 6) + 0.0 as mean_3 from events")
def prepare_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = handlers.prepare_time_series(read(spark, sf_dir, "events"), "value", "ts", 2, ["user_id"], ["event_id"])
    return done.select("event_id", whole("month").alias("month"), whole("dayofweek").alias("dayofweek"), real("value_lag_2").alias("lag_2"), real("value_rolling_mean_3").alias("mean_3"))


_W = "(select (max(value) - min(value)) / 30 as w, min(value) as lo from events)"


@query("histogram", f"select least(floor((value - lo) / w), 29)::int as bin, count(*) as n from events, {_W} group by 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(read(spark, sf_dir, "events"), "value").select("bin", "n")


@query("feature_image")
def feature_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    data: list[tuple[Any, ...]] = [(c, i, j, v) for c in ("l_quantity", "l_shipdate", "l_returnflag") for i, line in enumerate(profile.image(df, c, "l_extendedprice")[:3]) for j, v in enumerate(line)]
    return rows(spark, data, "feature string, line int, bin int, value double")


@query("recommend_cleaning")
def recommend_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = profile.recommend(profile.analyze(source(spark, sf_dir, "events").drop("event_id", "props"), "value"), "value")
    return rows(spark, [(s["id"], ",".join(s["columns"]), s["priority"]) for s in steps], "step string, columns string, priority int")


@query("recommend_operators")
def recommend_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.recommend(read(spark, sf_dir, "orders").drop("o_orderkey"), "o_totalprice")
    return rows(spark, [(c, op) for c, ops in found.items() for op in ops], "feature string, operator string")


_S = "round((({c} - avg({c}) over ()) / stddev_pop({c}) over ())::double, 6) + 0.0 as {c}"


@query("preprocess", f"select o_orderkey, {_S.format(c='o_totalprice')}, (o_orderstatus = 'F')::int::double as status_f, (o_orderstatus = 'O')::int::double as status_o, (o_orderstatus = 'P')::int::double as status_p from orders")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    done = preprocessor.fit(df, {"correlation": None}, key=["o_orderkey"]).transform(df, keep=("o_orderkey",))
    return done.select("o_orderkey", real("num__o_totalprice").alias("o_totalprice"), *[F.col(f"cat__o_orderstatus_{v}").alias(f"status_{v.lower()}") for v in "FOP"])


_O = "(select *, case when o_orderstatus = 'F' then 1 else 0 end as event from orders)"
_LO, _HI = "min({c}) over ()", "max({c}) over ()"


def _fitted(spark: SparkSession, sf_dir: str, config: dict[str, Any], *columns: str, drop_rows: bool = False) -> DataFrame:
    df = source(spark, sf_dir, "orders").select("o_orderkey", "event", *columns)
    return preprocessor.fit(df, {"correlation": None} | config, "event", ["o_orderkey"]).transform(df, drop_rows, ("o_orderkey",))


@query("preprocess_dates", "select o_orderkey, " + ", ".join(f"round(({e})::double, 6) + 0.0 as {n}" for n, e in (("y", "year(o_orderdate)"), ("m", "month(o_orderdate)"), ("d", "day(o_orderdate)"), ("w", "isodow(o_orderdate) - 1"), ("e", "isodow(o_orderdate) >= 6"), ("h", "hour(o_orderdate)"))) + " from orders")
def preprocess_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _fitted(spark, sf_dir, {"dates": True, "scale": "none"}, "o_orderdate")
    return done.select("o_orderkey", *[real(f"num__o_orderdate_{p}").alias(n) for n, p in (("y", "year"), ("m", "month"), ("d", "day"), ("w", "dayofweek"), ("e", "is_weekend"), ("h", "hour"))])


@query("preprocess_target_means", f"select o_orderkey, round(avg(event) over (partition by o_orderpriority), 6) + 0.0 as mean from {_O}")
def preprocess_target_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, {"target_means": True, "scale": "none"}, "o_orderpriority").select("o_orderkey", real("num__o_orderpriority_target_mean").alias("mean"))


@query("preprocess_minmax", "select o_orderkey, round(((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()))::double, 6) + 0.0 as x, (dense_rank() over (order by o_orderpriority) - 1)::double as code from orders")
def preprocess_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _fitted(spark, sf_dir, {"scale": "minmax", "encode": "ordinal"}, "o_totalprice", "o_orderpriority")
    return done.select("o_orderkey", real("num__o_totalprice").alias("x"), F.col("cat__o_orderpriority").alias("code"))


@query("preprocess_robust", "with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b, count(*) as n from orders), k as (select o_orderkey, o_totalprice as x from orders, q where o_totalprice between a - (case when n < 10000 then 3 else 1.5 end) * (b - a) and b + (case when n < 10000 then 3 else 1.5 end) * (b - a)), s as (select quantile_cont(x, 0.5) as m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as r from k) select o_orderkey, round(((x - m) / r)::double, 6) + 0.0 as x from k, s")
def preprocess_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, {"outliers": "iqr", "scale": "robust"}, "o_totalprice", drop_rows=True).select("o_orderkey", real("num__o_totalprice").alias("x"))


@query("preprocess_maths", "with s as (select min(o_totalprice) as lo, avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders) select o_orderkey, round(((o_totalprice - m) / s)::double, 6) + 0.0 as z, round(ln(1 + case when lo >= 0 then greatest(o_totalprice - lo + 1, 0) else abs(o_totalprice) end)::double, 6) + 0.0 as l, round(sqrt(greatest(o_totalprice - lo + 1e-8, 0))::double, 6) + 0.0 as r from orders, s")
def preprocess_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _fitted(spark, sf_dir, {"generate": "maths", "scale": "none"}, "o_totalprice")
    return done.select("o_orderkey", real("num__o_totalprice_zscore").alias("z"), real("num__o_totalprice_log").alias("l"), real("num__o_totalprice_sqrt").alias("r"))


@query("preprocess_full")
def preprocess_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "priority_n", "event")
    _, out = preprocessor.fit_transform(df, "full", "event", ["o_orderkey"])
    return out


def _axis(entry, name: str, before: str = "") -> str:
    """A leading eigenvector of a matrix by power iteration, the largest entry positive: CTEs `name`_run and `name`."""
    n = range(1, len(NUMS) + 1)
    dot = lambda i: " + ".join(f"{entry(i, j)} * x[{j}]" for j in n)
    return f"""{name}_run as (select 0 as k, [1.0, 1.0, 1.0, 1.0]::double[] as x union all
  select k + 1, [v / sqrt(list_sum([u * u for u in y])) for v in y] from (select k, [{", ".join(dot(i) for i in n)}]::double[] as y from {name}_run, m{before} where k < 200)),
{name} as (select [v * sign(x[list_position([abs(u) for u in x], list_max([abs(u) for u in x]))]) for v in x] as w from {name}_run where k = 200)"""


def _m(i: int, j: int) -> str:
    return f"m.c{min(i, j)}{max(i, j)}"


def _pca_sql() -> str:
    n = range(1, len(NUMS) + 1)
    cov = ", ".join(f"covar_samp({a}, {b}) as c{i}{j}" for i, a in enumerate(NUMS, 1) for j, b in enumerate(NUMS, 1) if j >= i)
    means = ", ".join(f"avg({c}) as m{i}" for i, c in enumerate(NUMS, 1))
    value = "(" + " + ".join(f"{_m(i, j)} * a.w[{i}] * a.w[{j}]" for i in n for j in n) + ")"
    rest = lambda i, j: f"({_m(i, j)} - l.v * a.w[{i}] * a.w[{j}])"
    # The second axis is made square to the first once more, for the first holds nearly all of the variance.
    square = f"sq as (select [b.w[i] - a.w[i] * ({' + '.join(f'b.w[{j}] * a.w[{j}]' for j in n)}) for i in range(1, {len(NUMS) + 1})] as w from a, b)"
    score = lambda t: " + ".join(f"({c} - m{i}) * {t}.w[{i}]" for i, c in enumerate(NUMS, 1))
    return f"with recursive m as (select {cov}, {means} from lineitem), {_axis(_m, 'a')}, l as (select {value} as v from m, a), {_axis(rest, 'b', ', l, a')}, {square} select l_orderkey, l_linenumber, round({score('a')}, 6) + 0.0 as \"PC1\", round({score('sq')}, 6) + 0.0 as \"PC2\" from lineitem, m, a, sq"


def _svd_sql() -> str:
    dots = ", ".join(f"sum({a} * {b}) as c{i}{j}" for i, a in enumerate(NUMS, 1) for j, b in enumerate(NUMS, 1) if j >= i)
    return f"with recursive m as (select {dots} from lineitem), {_axis(_m, 'a')} select l_orderkey, l_linenumber, round({' + '.join(f'{c} * w[{i}]' for i, c in enumerate(NUMS, 1))}, 6) + 0.0 as \"SVD1\" from lineitem, a"


@query("pca", _pca_sql())
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = learn.pca(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMS), NUMS)
    return done.select("l_orderkey", "l_linenumber", real("PC1").alias("PC1"), real("PC2").alias("PC2"))


@query("svd", _svd_sql())
def svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.svd(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMS), NUMS).select("l_orderkey", "l_linenumber", real("SVD1").alias("SVD1"))


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.kmeans(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")), ["c_acctbal", "nation"], 4).select("c_custkey", "cluster")


@query("f_values", "with g as (select event, count(o_totalprice) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as v from (select *, case when o_orderstatus = 'F' then 1 else 0 end as event from orders) group by event), t as (select sum(n * m) / sum(n) as mu, sum(n) as n, count(*) as k from g) select round(sum(g.n * (m - mu) * (m - mu)) / (max(k) - 1) / (sum(g.n * v) / (max(t.n) - max(k))), 6) + 0.0 as f from g, t")
def f_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(learn.f_values(source(spark, sf_dir, "orders"), ["o_totalprice"], "event", "classification")["o_totalprice"],)], "f double")


@query("select_features")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("c"), "event", F.lit(1.0).alias("one"))
    names = ["o_totalprice", "c", "one"]
    found = {m: learn.select(df, names, "event", m, 2) for m in ("variance", "mutual_info", "model_based", "anova", "k_best")}
    return rows(spark, [(m, c) for m, cs in found.items() for c in cs], "method string, feature string")


@query("cross_validation")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = learn.cross_validate(_toxic(spark, sf_dir), ["chars", "words"], "toxic", "classification", ["doc_id"], 3)
    return rows(spark, [(i, s) for i, s in enumerate(cv["folds"])], "fold bigint, score double")


@query("feature_search")
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_shipdate", "l_extendedprice")
    tree = search.Tree(2).build(df, None, "l_extendedprice")
    found = search.search(df, "l_extendedprice", tree, {"max_depth": 2, "min_gain": -1.0, "max_redundancy": 1.1, "max_per_level": 2})
    for f in found:
        df = search.apply_chain(df, tree.lineage(f["feature"]))
    return rows(spark, [(f["feature"], f["importance"]) for f in search.refine(df, "l_extendedprice", found)], "feature string, importance double")


@query("table_grade")
def table_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r = explorer.post_process(_toxic(spark, sf_dir), "toxic", "classification", ["doc_id"])
    return rows(spark, [(r["grade"], ",".join(r["kept"]))], "grade double, kept string")


# Windows over events, as a stream would have them


@query("event_windows", "select user_id, epoch_us(time_bucket(interval '1 day', ts)) as start, count(*) as n, round(avg(value), 6) + 0.0 as mean from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("ts", F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")))
    return features.windowed(df, "ts", "value", ["user_id"], "1 day").select("user_id", F.unix_micros("start").alias("start"), "n", real("mean").alias("mean"))


@query("event_sessions", "with g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 21600000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as start, count(*) as n from s group by user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("ts", F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")))
    return features.sessions(df, "ts", ["user_id"], "6 hours").select("user_id", F.unix_micros("start").alias("start"), "n")


# Terms, and the slower model checks

_TERMS = "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]{2,}')) as w from documents), c as (select doc_id, w, count(*) as n from t group by 1, 2), v as (select w, sum(n) as n, count(*) as d from c group by w order by sum(n) desc, w limit {})"

ORACLES["tfidf"] = _TERMS.replace("{}", "10") + ", f as (select doc_id, w, c.n * (ln((1 + (select count(*) from documents)) / (1 + d)) + 1) as x from c join v using (w)), s as (select doc_id, sqrt(sum(x * x)) as l from f group by 1), a as (select doc_id, x from f where w = (select min(w) from v)) select doc_id, round(coalesce(x / l, 0)::double, 6) + 0.0 as value from documents left join s using (doc_id) left join a using (doc_id)"


@query("count_vectorize", _TERMS.replace("{}", "5") + " select doc_id, w as term, c.n as n from c join v using (w)")
def count_vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, terms = texts.count_columns(read(spark, sf_dir, "documents"), "text", 5)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"term_{i}").cast("bigint").alias("n")) for i, t in enumerate(terms)])
    return done.select("doc_id", F.inline(pairs)).where("n > 0")


@query("tfidf_bigrams")
def tfidf_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, terms = texts.tfidf_columns(read(spark, sf_dir, "documents"), "text", 5, texts.STOP_WORDS, 2)
    return done.select("doc_id", *[real(f"term_{i}").alias(f"term_{i}") for i in range(len(terms))])


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toxic(spark, sf_dir)
    model = learn.forest("classification", 10).fit(learn.vectors(df, ["chars", "words"], "toxic"))
    found = learn.permutation_importance(model, df, ["chars", "words"], "toxic", "classification", ["doc_id"], 2)
    return rows(spark, list(found.items()), "feature string, importance double")


@query("partial_dependence")
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toxic(spark, sf_dir)
    model = learn.forest("regression", 10).fit(learn.vectors(df, ["chars", "words"], "toxic"))
    return rows(spark, learn.partial_dependence(model, df, ["chars", "words"], "words", 10), "point double, prediction double")


@query("learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = learn.learning_curve(_toxic(spark, sf_dir), ["chars", "words"], "toxic", "classification", ["doc_id"], (0.5, 1.0))
    return rows(spark, [(p["share"], p["train"], p["test"]) for p in c["points"]], "share double, train double, test double")


@query("beam_search")
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explorer.beam_search(_toxic(spark, sf_dir), "toxic", ["doc_id"], "classification", {"plain": {}, "robust": {"scale": "robust"}}, depth=1)
    return rows(spark, [(s.name, s.score) for s in found], "name string, score double")


@query("lost_classes", "select 'F' as status union all select 'P'")
def lost_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a filter lost are brought back."""
    df = prepare_classification(spark, sf_dir)
    kept = df.where("status = 1")
    lost = explorer.lost_classes(df, kept, "status")
    return rows(spark, [("FOP"[int(c)],) for c in lost], "status string")


# Readers and writers, columns, sizes


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one for local masters."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{(given or tempfile.mkdtemp(prefix='tessella-')).rstrip('/')}/files-{uuid.uuid4().hex}"


for _kind in ("csv", "json", "jsonl", "parquet", "orc"):

    def _round_trip(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        """Orders written and read again, with missing values."""
        path = f"{_folder(spark)}/orders.{kind}"
        io.save(source(spark, sf_dir, "orders").selectExpr("o_orderkey", "priority_n", "if(o_orderkey % 5 = 0, double('NaN'), o_totalprice) as price"), path)
        return io.load(spark, path).select(whole("o_orderkey").alias("o_orderkey"), "priority_n", real("price").alias("price"))

    query(f"read_{_kind}", f"select o_orderkey, priority_n, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 6) + 0.0 end as price from {ORDERS}")(_round_trip)


@query("read_with_schema", "select o_orderkey, o_orderstatus, round(o_totalprice, 6) + 0.0 as price from orders")
def read_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separator and a schema of one's own."""
    path = f"{_folder(spark)}/orders.tsv"
    read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).option("sep", "\t").csv(path)
    return io.load(spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double").select("o_orderkey", "o_orderstatus", real("o_totalprice").alias("price"))


@query("from_dataframe", "select n_nationkey::bigint as n_nationkey, n_name from nation")
def from_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.from_dataframe(spark, read(spark, sf_dir, "nation").select("n_nationkey", "n_name").toPandas()).select(whole("n_nationkey").alias("n_nationkey"), "n_name")


@query("aligned_columns", "select round(o_totalprice, 6) + 0.0 as o_totalprice, 0.0::double as unseen, o_orderkey from orders")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.align(read(spark, sf_dir, "orders"), ["o_totalprice", "unseen", "o_orderkey"]).withColumn("o_totalprice", real("o_totalprice")).withColumn("unseen", real("unseen"))


@query("drop_empty_columns", "select o_orderkey, o_orderstatus from orders")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").withColumn("nothing", F.lit(None).cast("double")).withColumn("no_text", F.lit(None).cast("string"))
    return clean.drop_empty_columns(df)


@query("category_sizes", "select 'o_orderstatus' as feature, count(distinct o_orderstatus)::bigint as d, count(o_orderstatus)::bigint as n from orders union all select 'o_orderpriority', count(distinct o_orderpriority), count(o_orderpriority) from orders")
def category_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.category_profile(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return rows(spark, [(c, v["distinct"], v["count"]) for c, v in p.items()], "feature string, d bigint, n bigint")


@query("rollup", "select o_orderstatus, o_orderpriority, count(*) as n, round(avg(o_totalprice), 6) + 0.0 as mean from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), real(F.avg("o_totalprice")).alias("mean"))


_OPS = {"log(l_quantity)": "ln(l_quantity + case when (select min(l_quantity) from lineitem) >= 0 then 1 else abs((select min(l_quantity) from lineitem)) + 1 end)", "square(l_quantity)": "l_quantity * l_quantity", "cube(l_tax)": "l_tax * l_tax * l_tax"}
_BASE = {"log(l_quantity)": "l_quantity", "square(l_quantity)": "l_quantity", "cube(l_tax)": "l_tax"}


@query(
    "search_scores",
    " union all ".join(
        f"select '{n}' as feature, round(abs(corr({e}, l_extendedprice)), 6) + 0.0 as importance, round(abs(corr({e}, l_extendedprice)) - abs(corr({_BASE[n]}, l_extendedprice)), 6) + 0.0 as gain, round(greatest(abs(corr({e}, l_quantity)), abs(corr({e}, l_tax))), 6) + 0.0 as redundancy from lineitem"
        for n, e in _OPS.items()
    ),
)
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search says of each candidate of one level."""
    tree = search.Tree(1)
    for n in _OPS:
        op, column = n.rstrip(")").split("(")
        tree.root(column)
        tree.add(column, op)
    found = search.search(read(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_extendedprice"), "l_extendedprice", search.Tree.from_dict(tree.to_dict()), {"max_depth": 1, "min_gain": -2.0, "max_redundancy": 1.1})
    return rows(spark, [(f["feature"], f["importance"], f["gain"], f["redundancy"]) for f in found], "feature string, importance double, gain double, redundancy double")


@query("table_fingerprint", "select round(count(*), 6) + 0.0 as n, round(count(distinct o_orderstatus), 6) + 0.0 as classes, round(avg((priority_n is null)::int) / 1, 6) + 0.0 as missing from " + ORDERS)
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").selectExpr("o_orderstatus", "if(priority_n is null, null, o_totalprice) as price")
    f = search.fingerprint(df, "o_orderstatus")
    return rows(spark, [(f["rows"], f["classes"], f["missing"])], "n double, classes double, missing double")


@query("handler_properties", "select count(*)::bigint as n, round(avg(o_totalprice), 6) + 0.0 as mean, round(min(o_totalprice), 6) + 0.0 as low, round(quantile_cont(o_totalprice, 0.5), 6) + 0.0 as median from orders")
def handler_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = handlers.properties(read(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus"), "o_totalprice", "regression")
    return rows(spark, [(p["rows"], p["target"]["mean"], p["target"]["min"], p["target"]["median"])], "n bigint, mean double, low double, median double")


@query("minority_scores", "with p as (select toxic as y, (n_chars < 1000)::int as s from documents join labels using (doc_id)), r as (select avg(s) filter (y = 1) as a, avg(1 - s) filter (y = 0) as b, sum(s) filter (y = 1) / sum(s) as p from p) select round((a + b) / 2, 6) + 0.0 as balanced, round(sqrt(a * b), 6) + 0.0 as g_mean, round(p, 6) + 0.0 as precision, round(a, 6) + 0.0 as recall, round(2 * a * p / (a + p), 6) + 0.0 as f1 from r")
def minority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 1000).cast("int").alias("s")).join(read(spark, sf_dir, "labels"), "doc_id")
    m = validate.minority_metrics(evaluate.confusion(df, "toxic", "s"), 1)
    return rows(spark, [(m["balanced_accuracy"], m["g_mean"], m["precision"], m["recall"], m["f1"])], "balanced double, g_mean double, precision double, recall double, f1 double")


@query("null_safe_lookup", "select o_orderkey, round(avg(o_totalprice) over (partition by priority_n), 6) + 0.0 as mean from " + ORDERS + " where priority_n is not null union all select o_orderkey, null from " + ORDERS + " where priority_n is null")
def null_safe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of a row's entity; rows without an entity get nulls."""
    done = groups.entity_aggregates(source(spark, sf_dir, "orders").select("o_orderkey", "priority_n", "o_totalprice"), "priority_n", ["o_totalprice"])
    return done.select("o_orderkey", real("o_totalprice_mean").alias("mean"))
