"""Registered queries of saved chains, batched search, balancing row by row, draws by a shared hash, and charts' data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import registry
from tessella.operators import balance, charts, clean, embed, evaluate, series, texts
from tessella.plans import preprocessor, search, validate
from tessella.plans.catalog import ORACLES, QUERIES, query, read, real, source, source_sql, whole
from tessella.plans.catalog_tables import _OPS, _POINTS, _folder, _toxic, rows
from tessella.plans.saved import Chain
from tessella.sources import io

ORDERS = source_sql("orders")


def _spread(*parts: object) -> str:
    """registry.spread() in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 10))::bigint"


def _uniform(*parts: object) -> str:
    return f"(({_spread(*parts)} + 0.5) / 1099511627776.0)"


# Saved chains

_HALF = f"(select * from {ORDERS} where o_orderkey % 2 = 0)"


@query(
    "saved_chain",
    f"""with h as (select * from {_HALF}), s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s, avg(event) as e, count(*) as n, quantile_cont(o_totalprice, 0.5) as q, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) as w from h),
c as (select priority_n as p, count(*) as n, sum(event) as e from h where priority_n is not null group by 1),
l as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce(priority_n, 'missing') as v from h))
select o_orderkey, round((o_totalprice - s.m) / s.s, 6) + 0.0 as z, round(((o_totalprice - s.m) / s.s) * ((o_totalprice - s.m) / s.s), 6) + 0.0 as zz, round((o_totalprice - s.q) / s.w, 6) + 0.0 as robust,
round(coalesce((c.e + 10 * s.e) / (c.n + 10), s.e)::double, 6) + 0.0 as enc, round((c.n / s.n)::double, 6) + 0.0 as freq, l.code::bigint as label
from {ORDERS} o cross join s left join c on o.priority_n = c.p left join l on coalesce(o.priority_n, 'missing') = l.v""",
)
def saved_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain fitted on every second order, saved, loaded, and applied to all orders."""
    df, path = source(spark, sf_dir, "orders"), f"{_folder(spark)}/chain"
    steps = [
        ("standardize", ["o_totalprice"], "z", {}), ("square", ["z"], "zz", {}), ("robust_scale", ["o_totalprice"], "robust", {}), ("target_encode", ["priority_n", "event"], "enc", {}),
        ("frequency_encode", ["priority_n"], "freq", {}), ("label_encode", ["priority_n"], "label", {}),
    ]
    Chain.fit(df.where("o_orderkey % 2 = 0"), steps).save(spark, path)
    done = Chain.load(spark, path).transform(df)
    return done.select("o_orderkey", *[real(c).alias(c) for c in ("z", "zz", "robust", "enc", "freq")], whole("label").alias("label"))


# Spreadsheets


@query("read_xlsx", f"select o_orderkey, priority_n, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 6) + 0.0 end as price, o_orderstatus = 'F' as filled, epoch_us(o_orderdate)::bigint as day from {ORDERS}")
def read_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to sheets and read again: numbers, texts, booleans, times and missing values."""
    path = f"{_folder(spark)}/orders.xlsx"
    io.save(source(spark, sf_dir, "orders").selectExpr("o_orderkey", "priority_n", "if(o_orderkey % 5 = 0, double('NaN'), o_totalprice) as price", "o_orderstatus = 'F' as filled", "o_orderdate as day"), path, folder=True)
    done = io.load(spark, path)
    return done.select(whole("o_orderkey").alias("o_orderkey"), "priority_n", real("price").alias("price"), "filled", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', day)").alias("day"))


# Search

_LEVEL = {
    "square(l_quantity)": ("l_quantity * l_quantity", "l_quantity"), "log(l_quantity)": (_OPS["log(l_quantity)"], "l_quantity"), "min_max_scale(l_tax)": ("(l_tax - (select min(l_tax) from lineitem)) / (select max(l_tax) - min(l_tax) from lineitem)", "l_tax"),
    "robust_scale(l_tax)": ("(l_tax - (select quantile_cont(l_tax, 0.5) from lineitem)) / (select quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) from lineitem)", "l_tax"),
    "label_encode(l_returnflag)": ("dense_rank() over (order by l_returnflag) - 1", None), "count_encode(l_linestatus)": ("count(*) over (partition by l_linestatus)", None),
    "frequency_encode(l_returnflag)": ("count(*) over (partition by l_returnflag) / count(*) over ()", None), "extract_month(l_shipdate)": ("month(l_shipdate)", None),
}


def _level_sql(names: dict[str, tuple[str, str | None]]) -> str:
    one = "select '{n}' as feature, round(abs(corr(x, l_extendedprice))::double, 6) + 0.0 as importance, round((abs(corr(x, l_extendedprice)) - coalesce(abs({b}), 0))::double, 6) + 0.0 as gain, round(greatest(abs(corr(x, l_quantity)), abs(corr(x, l_tax)))::double, 6) + 0.0 as redundancy from (select *, ({e})::double as x from lineitem)"
    return " union all ".join(one.format(n=n, e=e, b=f"corr({b}, l_extendedprice)" if b else "null") for n, (e, b) in names.items())


def _found(df: DataFrame, names: list[str], **limits) -> DataFrame:
    tree = search.Tree(1)
    for n in names:
        op, column = n.rstrip(")").split("(")
        tree.root(column)
        tree.add(column, op)
    found = search.search(df, "l_extendedprice", tree, {"max_depth": 1, "min_gain": -9.0, "max_redundancy": 1.1} | limits)
    return rows(df.sparkSession, [(f["feature"], f["importance"], f["gain"], f["redundancy"]) for f in found], "feature string, importance double, gain double, redundancy double")


@query("search_level", _level_sql(_LEVEL))
def search_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level of numbers, categories and dates, fitted and measured together."""
    return _found(read(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice"), list(_LEVEL))


def _mi_sql(x: str) -> str:
    """Mutual information of an expression with the price, both cut at their quantiles."""
    cuts = lambda c: "list_distinct([" + ", ".join(f"quantile_cont({c}, {j / 16})" for j in range(1, 16)) + "])"
    return f"""(with o as (select ({x})::double as x, l_extendedprice as y from lineitem), q as (select {cuts('x')} as cx, {cuts('y')} as cy from o),
v as (select case when (select count(distinct x) from o) > 16 then len([c for c in cx if x > c])::varchar else x::varchar end as x, len([c for c in cy if y > c]) as y from o, q), j as (select x, y, count(*)::double as n from v group by 1, 2), t as (select sum(n) as n from j),
m as (select j.n, sum(j.n) over (partition by x) as a, sum(j.n) over (partition by y) as b from j) select greatest(0, sum(m.n / t.n * ln(m.n * t.n / (a * b)))) from m, t)"""


_RANKED = {"square(l_quantity)": ("l_quantity * l_quantity", "l_quantity"), "square(l_tax)": ("l_tax * l_tax", "l_tax"), "sin(l_quantity)": ("sin(l_quantity)", "l_quantity")}
_MEAN_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query(
    "search_ranks",
    " union all ".join(
        f"select '{n}' as feature, round({_mi_sql(e)}, 6) + 0.0 as importance, round({_mi_sql(e)} - {_mi_sql(b)}, 6) + 0.0 as gain, (select round(greatest(abs(corr(r, q)), abs(corr(r, t))), 6) + 0.0 from (select {_MEAN_RANK.format(e)} as r, {_MEAN_RANK.format('l_quantity')} as q, {_MEAN_RANK.format('l_tax')} as t from lineitem)) as redundancy"
        for n, (e, b) in _RANKED.items()
    ),
)
def search_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by mutual information and Spearman's correlation."""
    return _found(read(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_extendedprice"), list(_RANKED), measures="rank")


# Draws by a hash that any engine has: these take the place of queries that could only be counted

_H = _spread("o_orderkey", 42)


@query("hash_folds", f"select o_orderkey, ({_H} % 5)::int as fold from orders")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kfold(read(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


@query("group_folds", f"select o_orderkey, ({_spread('o_custkey', 42)} % 5)::int as fold from orders")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_kfold(read(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "fold")


@query("stratified_folds", f"select o_orderkey, ((row_number() over (partition by o_orderstatus order by {_spread('o_orderkey', 43)} % 256, {_H}, o_orderkey) - 1) % 5)::int as fold from orders")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified(read(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "fold")


@query("hash_sample", f"select o_orderkey from orders order by {_spread('o_orderkey')}, o_orderkey limit 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: exactly 100 rows."""
    return clean.hash_sample(read(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey")


_POISSON = lambda u, share: " + ".join(f"({u} > {sum(2.718281828459045**-share * share**j / _factorial(j) for j in range(k + 1))!r})::int" for k in range(12))


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)


@query("out_of_bag", f"select o_orderkey, ({_POISSON(_uniform('o_orderkey', 42, 0), 1.0)})::bigint as drawn from orders")
def out_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a bootstrap round draws each row; rows drawn 0 times are out of the bag."""
    return validate.draws(read(spark, sf_dir, "orders"), ["o_orderkey"], 0).select("o_orderkey", whole("drawn").alias("drawn"))


@query(
    "bootstrap",
    f"with w as (select i, o_totalprice as v, {_POISSON(_uniform('o_orderkey', '42000 + i'), 1.0)} as w from orders, range(0, 40) r(i)), m as (select sum(v * w) / sum(w) as m from w group by i) select round(quantile_cont(m, 0.5), 6) + 0.0 as median, round(quantile_cont(m, 0.025), 6) + 0.0 as low, round(quantile_cont(m, 0.975), 6) + 0.0 as high from m",
)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluate.bootstrap(read(spark, sf_dir, "orders"), ["o_orderkey"], F.col("o_totalprice"), 40)
    return rows(spark, [(b["median"], b["low"], b["high"])], "median double, low double, high double")


_RANDOM = f"(select *, row_number() over (partition by o_orderstatus order by {_H}, o_orderkey) as i, count(*) over (partition by o_orderstatus) as n from orders), c as (select min(n) as few, max(n) as most from (select count(*) as n from orders group by o_orderstatus))"


@query("random_under", f"with r as {_RANDOM} select o_orderkey, o_orderstatus as status from r, c where i <= few")
def random_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.random_under(read(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("random_over", f"with r as {_RANDOM} select o_orderkey, (most // n + (i <= most % n)::int)::bigint as times from r, c")
def random_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.random_over(read(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("times"))


ORACLES["word_embeddings"] = "select doc_id, round(coalesce(list_sum([" + _spread("w").replace("bigint", "hugeint") + " % 1000 for w in ws]) / len(ws) / 1000, 0)::double, 6) + 0.0 as value from (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as ws from documents)"
_HEX = "md5(coalesce(priority_n, 'nan'))"
_MOD = "0"
for _a in (1, 9, 17, 25):  # eight digits at a time
    _MOD = f"((({_MOD})::bigint * 4294967296 + ('0x' || substr({_HEX}, {_a}, 8))::bigint) % 10)"
ORACLES["hash_encode_10"] = f"select o_orderkey, ({_MOD})::bigint as value from {ORDERS}"

ORACLES["correlated_groups"] = "select 'l_quantity' as a, 'double_quantity' as b from lineitem having abs(corr(l_quantity, 2 * l_quantity + 1)) >= 0.9 and abs(corr(l_quantity, l_discount)) < 0.9"
ORACLES["identifier_columns"] = "select 'c_mktsegment' as feature from customer having count(distinct c_mktsegment) <= 0.5 * count(*) and count(distinct c_name) > 0.5 * count(*)"
ORACLES["lost_classes"] = "select distinct o_orderstatus as status from orders except select o_orderstatus from orders where o_orderstatus = 'O'"

# Balancing

#: Rows of each class with their hardness: neighbours of the other class among the ten, or five, nearest, over scaled points of their own class's deviation.
_HARD = r"""
with d as (select doc_id, n_chars::double as chars, len(string_split_regex(text, '\s+'))::double as words, toxic from documents join labels using (doc_id)),
k as (select toxic, count(*) as n from d group by 1), few as (select toxic as c from k where n < (select max(n) from k)),
s as (select stddev_pop(chars) as a, stddev_pop(words) as b from d where toxic in (from few)), p as (select doc_id, chars / a as x, words / b as y, toxic in (from few) as own from d, s),
n as (select p.doc_id, p.own, p.x, p.y, q.own as other, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) as dist from p, p q where p.doc_id <> q.doc_id and p.own),
f as (select *, row_number() over (partition by doc_id order by dist, (other <> own)::int) as i from n),
h as (select doc_id, count(*) filter (not other) as others from f where i <= {m} group by doc_id)
"""


def _starts(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """Points of the smaller class with their rows and hardness."""
    df, columns = _toxic(spark, sf_dir), ["chars", "words"]
    counts = evaluate.class_balance(df, "toxic")["counts"]
    few = min(counts, key=lambda c: (counts[c], str(c)))
    scale = balance._scale(df.where(F.col("toxic") == few), columns)
    return balance.hardness(df, "toxic", columns, few, scale, m)


for _name, _m in (("borderline_starts", 10), ("adasyn_starts", 5)):

    def _hard(spark: SparkSession, sf_dir: str, m: int = _m) -> DataFrame:
        return _starts(spark, sf_dir, m).select(real("x0").alias("x"), real("x1").alias("y"), whole("own").alias("n"), whole("others").alias("others"))

    query(_name, _HARD.replace("{m}", str(_m)) + "select round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, count(*)::bigint as n, min(others)::bigint as others from p join h using (doc_id) group by x, y")(_hard)


@query(
    "balance_near_minority",
    _POINTS + ", f as (select doc_id, dist, row_number() over (partition by doc_id order by dist) as i from n where big and not other_big), m as (select doc_id, avg(sqrt(dist)) as mean from f where i <= 3 group by 1), k as (select doc_id, row_number() over (order by mean, x, y, doc_id) as i from m join p using (doc_id)) select doc_id from p where not big or doc_id in (select doc_id from k where i <= (select count(*) from p where not big))",
)
def balance_near_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger class cut to the size of the smaller, by mean distance to the three nearest rows of the smaller."""
    df = _toxic(spark, sf_dir)
    few = min(evaluate.class_balance(df, "toxic")["counts"].values())
    return balance.near_minority(df, "toxic", ["chars", "words"], few).select("doc_id")


_SIZES = "select toxic, count(*) as n from documents join labels using (doc_id) group by toxic"
ORACLES["balance_self_paced"] = f"with k as ({_SIZES}), t as (select max(n) as most, min(n) as few from k) select toxic, (case when few / most < 0.8 and n < most * 0.5 then least((n + most * (1 - sqrt(n / most)) * 0.8)::double - 0.5, most - 1) else n end)::bigint as n from k, t"
ORACLES["balance_hybrid_mix"] = f"with k as ({_SIZES}), t as (select max(n) as most, min(n) as few from k), g as (select greatest(few, floor(most * least(0.5, few / most * 5))) as up, * from t) select toxic, (case when few / most >= 0.8 then n when n = most then least(most, floor(up / 0.7)) else up end)::bigint as n from k, g"


@query("balance_self_paced_under", f"with k as ({_SIZES}) select toxic, (select min(n) from k)::bigint as n from k")
def balance_self_paced_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class after self-paced under-sampling; which rows they are is held against a plain version in the tests."""
    return balance.self_paced_under(_toxic(spark, sf_dir), "toxic", ["chars", "words"], ["doc_id"]).groupBy("toxic").agg(F.count("*").alias("n"))


# Embeddings

#: The covariance of the centred columns is two by two; its eigenvectors are known in closed form.
_TWO = """
with o as (select o_orderkey, o_totalprice / 1000 as price, o_custkey from orders), m as (select avg(price) as a, avg(o_custkey) as b from o), c as (select var_pop(price) as p, var_pop(o_custkey::double) as q, covar_pop(price, o_custkey) as r from o),
e as (select *, (p + q) / 2 + sqrt((p - q) * (p - q) / 4 + r * r) as top from c), v as (select r / sqrt(r * r + (top - p) * (top - p)) as x, (top - p) / sqrt(r * r + (top - p) * (top - p)) as y from e),
s as (select case when abs(x) >= abs(y) then x else y end as one, case when abs(y) >= abs(x) then -y else x end as two, x, y from v)
select o_orderkey, round(((price - a) * x + (o_custkey - b) * y) * sign(one), 4) + 0.0 as u, round(((price - a) * -y + (o_custkey - b) * x) * sign(two), 4) + 0.0 as v from o, m, s
"""


@query("preprocess_projection", _TWO)
def preprocess_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preprocessor's tsne and umap settings give tables that come later: two principal components."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.col("o_custkey").cast("double").alias("o_custkey"))
    model = preprocessor.fit(df, {"reduce": "umap", "scale": "none", "correlation": None}, key=["o_orderkey"])
    done = model.transform(df, keep=("o_orderkey",))
    return done.select("o_orderkey", (F.round("PC1", 4) + 0.0).alias("u"), (F.round("PC2", 4) + 0.0).alias("v"))


@query("embedding")
def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a plane by their balance, orders and spending."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey", "left")
    return embed.embed(df, ["c_acctbal", "orders", "spent"]).select("c_custkey", real("U1").alias("u"), real("U2").alias("v"))


# Entities, series and pictures


@query(
    "preprocess_entity",
    f"select o_orderkey, {', '.join(f'round({f}(o_totalprice) over (partition by o_custkey)::double, 6) + 0.0 as {n}' for f, n in (('avg', 'mean'), ('min', 'low'), ('max', 'high'), ('count', 'n')))}, round(coalesce(stddev_samp(o_totalprice) over (partition by o_custkey), avg(o_totalprice) over ()), 6) + 0.0 as std, round(o_totalprice - avg(o_totalprice) over (partition by o_custkey), 6) + 0.0 as far from orders",
)
def preprocess_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of a row's entity as features that are learned in fitting."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("who"), "o_totalprice")
    model = preprocessor.fit(df, {"entity": "who", "scale": "none", "correlation": None, "encode": "ordinal", "max_categories": 1}, key=["o_orderkey"])
    done = model.transform(df, keep=("o_orderkey",))
    named = {"mean": "by_who_mean", "low": "by_who_min", "high": "by_who_max", "n": "by_who_count", "std": "by_who_std", "far": "diff_from_mean"}
    return done.select("o_orderkey", *[real(F.col(f"num__o_totalprice_{c}")).alias(n) for n, c in named.items()])


#: dy on y[t-1] and one difference before, by the closed form of two regressors.
_ROOT = """
with s as (select value as y, lag(value) over w as x, ts, event_id from events window w as (order by ts, event_id)), d as (select x, y - x as d0, lag(y - x) over (order by ts, event_id) as d1 from s),
m as (select count(*) as n, var_pop(x) as xx, var_pop(d1) as dd, covar_pop(x, d1) as xd, covar_pop(x, d0) as xy, covar_pop(d1, d0) as dy, var_pop(d0) as yy from d where d1 is not null),
b as (select *, xx * dd - xd * xd as det, (xy * dd - dy * xd) / (xx * dd - xd * xd) as b, (dy * xx - xy * xd) / (xx * dd - xd * xd) as g from m)
select round(b / sqrt((yy - b * xy - g * dy) * n / (n - 3) * (dd / det) / n), 6) + 0.0 as statistic, 1::bigint as lags from b
"""


@query("unit_root", _ROOT)
def unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Dickey-Fuller statistic with one lag."""
    t = series.dickey_fuller(read(spark, sf_dir, "events").select("ts", "event_id", "value"), "value", ["ts", "event_id"], 1)
    return rows(spark, [(t["statistic"], t["lags"])], "statistic double, lags bigint")


def _picture(name: str, x: str) -> str:
    """Density, mean and deviation of the price by thirtieths of a column, each brought to 0 to 1."""
    return f"""select '{name}' as feature, line, bin::int as bin, round(coalesce(case line when 0 then n / top when 1 then case when mh > ml then (m - ml) / (mh - ml) else 0.5 + 0 * m end else case when sh > sl then (s - sl) / (sh - sl) else 0.5 + 0 * s end end, 0)::double, 6) + 0.0 as value
from (select * from (select unnest(range(0, 30)) as bin), (select unnest([0, 1, 2])::int as line)) g left join (
  select *, max(n) over () as top, min(m) over () as ml, max(m) over () as mh, min(s) over () as sl, max(s) over () as sh from (
    select least(floor((x - lo) / case when hi > lo then (hi - lo) / 30 else 1 end), 29)::int as b, count(*) as n, avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s
    from (select ({x})::double as x, min(({x})::double) over () as lo, max(({x})::double) over () as hi, l_extendedprice from lineitem) group by 1)) p on p.b = g.bin"""


ORACLES["feature_image"] = " union all ".join([_picture("l_quantity", "l_quantity"), _picture("l_shipdate", "epoch_us(l_shipdate)"), _picture("l_returnflag", f"{_spread('l_returnflag')} % 30")])

#: The five most frequent words and pairs of neighbouring words, without stop words.
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in texts.STOP_WORDS) + "]"
ORACLES["tfidf_bigrams"] = (
    r"with a as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]{2,}'), lambda w: not list_contains(" + _STOP + ", w)) as ws from documents),"
    " t as (select doc_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) as w from a), c as (select doc_id, w, count(*) as n from t group by 1, 2),"
    " v as (select w, d, row_number() over (order by w) - 1 as i from (select w, sum(n) as n, count(*) as d from c group by w order by sum(n) desc, w limit 5)),"
    " f as (select doc_id, i, c.n * (ln((1 + (select count(*) from documents)) / (1 + d)) + 1) as x from c join v using (w)), s as (select doc_id, sqrt(sum(x * x)) as l from f group by 1)"
    " select doc_id, " + ", ".join(f"round(coalesce(max(x / l) filter (i = {i}), 0)::double, 6) + 0.0 as term_{i}" for i in range(5)) + " from documents left join f using (doc_id) left join s using (doc_id) group by doc_id"
)

# Charts

_GRID = ["l_quantity", "l_discount", "l_extendedprice"]


def _grid_sql() -> str:
    place = lambda c: f"least(floor(({c} - (select min({c}) from lineitem)) / (select (max({c}) - min({c})) / 20 from lineitem)), 19)::int"
    low = lambda c, b: f"round((select min({c}) from lineitem) + {b} * (select (max({c}) - min({c})) / 20 from lineitem), 6) + 0.0"
    parts = [f"select '{a}' as a, '{b}' as b, x, y, class, n, {low(a, 'x')} as low_x, {low(b, 'y')} as low_y from (select {place(a)} as x, {place(b)} as y, l_returnflag as class, count(*) as n from lineitem group by 1, 2, 3)" for i, a in enumerate(_GRID) for b in _GRID[i:]]
    return " union all ".join(parts)


@query("pair_grid", _grid_sql())
def pair_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = charts.pair_grid(read(spark, sf_dir, "lineitem"), _GRID, 20, "l_returnflag")
    return done.withColumn("low_x", real("low_x")).withColumn("low_y", real("low_y"))


_MADE = {"l_extendedprice": "l_extendedprice", "log": "ln(l_extendedprice + 1)", "square": "l_extendedprice * l_extendedprice"}
_Z = "with v as (" + " union all ".join(f"select '{n}' as feature, ({e})::double as v, l_quantity from lineitem" for n, e in _MADE.items()) + "), m as (select feature, avg(v) as m, stddev_pop(v) as s from v group by 1), z as (select feature, (v - m) / s as z, l_quantity from v join m using (feature)), e as (select min(z) as lo, (max(z) - min(z)) / 30 as w from z)"


def _variants(df: DataFrame) -> dict:
    fitted = {op: registry.fit(df, op, "l_extendedprice", out=op) for op in ("log", "square")}
    return {n: f.column() for n, f in fitted.items()}


@query("transformation_effect", f"{_Z}, b as (select feature, least(floor((z - lo) / w), 29)::int as bin, l_quantity from z, e) select feature, bin, round(lo + bin * w, 6) + 0.0 as low, round(lo + (bin + 1) * w, 6) + 0.0 as high, count(*) as n, round(avg(l_quantity), 6) + 0.0 as l_quantity from b, e group by feature, bin, lo, w")
def transformation_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    done = charts.effect(df, "l_extendedprice", _variants(df), 30, "l_quantity")
    return done.select("feature", "bin", real("low").alias("low"), real("high").alias("high"), "n", real("l_quantity").alias("l_quantity"))


@query(
    "shape_change",
    " union all ".join(
        f"select '{n}' as feature, count(x) as n, round(skew, 6) + 0.0 as skewness, round(kurt, 6) + 0.0 as kurtosis, round(c, 6) + 0.0 as correlation from (select x, (avg(power(x - m, 3)) over () / power(s, 3)) as skew, (avg(power(x - m, 4)) over () / power(s, 4) - 3) as kurt, corr(x, l_quantity) over () as c from (select ({e})::double as x, l_quantity, avg(({e})::double) over () as m, stddev_pop(({e})::double) over () as s from lineitem)) group by skew, kurt, c"
        for n, e in _MADE.items()
    ),
)
def shape_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    told = charts.shape_change(df, "l_extendedprice", _variants(df), "l_quantity")
    return rows(spark, [(t["feature"], t["n"], t["skewness"], t["kurtosis"], t["correlation"]) for t in told], "feature string, n bigint, skewness double, kurtosis double, correlation double")


_SPAN = "(select (max(epoch_us(ts)) - min(epoch_us(ts)) + 1 + 49) // 50 from events)"


@query("series_points", f"with v as (select 'value' as feature, epoch_us(ts) as t, value as v from events union all select 'user_id', epoch_us(ts), user_id::double from events), b as (select feature, ((t - (select min(epoch_us(ts)) from events)) // {_SPAN})::int as bucket, v from v) select feature, bucket, (epoch_us(make_timestamp((select min(epoch_us(ts)) from events) + bucket * {_SPAN})))::bigint as start, count(*) as n, round(avg(v), 6) + 0.0 as mean, round(min(v), 6) + 0.0 as low, round(max(v), 6) + 0.0 as high from b group by 1, 2")
def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = charts.series_points(read(spark, sf_dir, "events"), "ts", ["value", "user_id"], 50)
    return done.select("feature", "bucket", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', start)").alias("start"), "n", real("mean").alias("mean"), real("low").alias("low"), real("high").alias("high"))


@query("dashboard", "select 'l_quantity' as a, 'l_tax' as b, round(corr(l_quantity, l_tax), 6) + 0.0 as r, (select count(*) from (select distinct l_quantity, l_tax from lineitem) where false) + (select count(*) from lineitem)::bigint as n from lineitem")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation and the histogram's rows of a page on two columns."""
    page = charts.dashboard(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])
    (c,) = page["correlations"]
    return rows(spark, [(c["a"], c["b"], c["r"], sum(h["n"] for h in page["histograms"] if h["feature"] == "l_tax"))], "a string, b string, r double, n bigint")


assert QUERIES
