"""Queries of count tables, linear models and the grid of specifications on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import categorical, models
from graywacke.plans import integrals
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


@register("agg01_shares", """select o_orderpriority as "group", coalesce(o_orderstatus, 'missing') as level, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by o_orderpriority), 6) as percent
    from orders where o_orderpriority is not null group by 1, 2""")
def agg01_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(categorical.shares(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 6, "percent")


@register("st13_chi_squared", f"""with c as (select o_orderpriority as a, o_orderstatus as b, count(*)::double as n from orders where o_orderpriority is not null and o_orderstatus is not null group by 1, 2),
    r as (select a, sum(n) as na from c group by a), k as (select b, sum(n) as nb from c group by b), t as (select sum(n) as t from c),
    s as (select (select sum(case when c.n is null then na * nb / t else (c.n - na * nb / t) ** 2 / (na * nb / t) end) from r cross join k cross join t left join c using (a, b)) as chi2, ((select count(*) from r) - 1) * ((select count(*) from k) - 1)::double as df, least((select count(*) from r), (select count(*) from k)) - 1 as m,
      (select min(na) from r) * (select min(nb) from k) / (select t from t) as least_expected, (select t from t)::bigint as n)
    select round(chi2, 6) as chi2, df, round({integrals.p_chi2('chi2', 'df')}, 8) as p, round(sqrt(chi2 / (n * m)), 6) as cramers_v, round(least_expected, 6) as least_expected, n from s""")
def st13_chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(categorical.chi_squared(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), 6, "chi2", "cramers_v", "least_expected").withColumn("p", F.round("p", 8))


@register("st13_fisher", """with m as (select count(*) filter (n_regionkey = 1 and n_nationkey < 8) as a, count(*) filter (n_regionkey = 1 and n_nationkey >= 8) as b, count(*) filter (n_regionkey <> 1 and n_nationkey < 8) as c, count(*) filter (n_regionkey <> 1 and n_nationkey >= 8) as d from nation),
    x as (select m.*, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from m), w as (select *, exp(-(lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1))) as w from x)
    select a, b, c, d, round(a::double * d / (b * c), 6) as odds_ratio, round(least(1, (sum(w) filter (w <= (select w from w where x = a) * (1 + 1e-7))) / sum(w)), 8) as p from w group by a, b, c, d""")
def st13_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _table(spark, sf_dir, "nation").select((F.col("n_regionkey") == 1).alias("x"), (F.col("n_nationkey") < 8).alias("y"))
    return _rounded(categorical.fisher(flags, "x", "y"), 6, "odds_ratio").withColumn("p", F.round("p", 8))


KINDS = ("c_nationkey", "c_acctbal", "c_mktsegment", "c_name")


@register("prj09_kinds", "with m as (" + " union all ".join(f"select '{c}' as variable, count({c}) as n, count(*) - count({c}) as missing, count(distinct {c}::varchar) as levels, count(try_cast({c}::varchar as double)) as numbers from customer" for c in KINDS) + """)
    select *, case when levels > 10 and numbers >= 0.95 * n then 'continuous' else 'categorical' end as kind from m""")
def prj09_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.kinds(_table(spark, sf_dir, "customer").select(*KINDS))


COVARIED = "select c_mktsegment as g, c_nationkey::double as x, c_acctbal::double as y from customer where c_mktsegment is not null and c_nationkey is not null and c_acctbal is not null"


@register("st36_ancova", f"""with r as ({COVARIED}), w as (select sum(xx) as xx, sum(xy) as xy, sum(yy) as yy, count(*) as k, sum(n) as n from (select regr_sxx(y, x) as xx, regr_sxy(y, x) as xy, regr_syy(y, x) as yy, count(*) as n from r group by g)),
    t as (select regr_sxx(y, x) as xx, regr_sxy(y, x) as xy, regr_syy(y, x) as yy from r), e as (select w.yy - w.xy ** 2 / w.xx as error, t.yy - t.xy ** 2 / t.xx as total, (k - 1)::double as d1, (n - k - 1)::double as d2, w.xy / w.xx as slope from w, t),
    f as (select *, (total - error) / d1 / (error / d2) as f from e) select round(f, 6) as f, d1 as df_group, d2 as df_error, round({integrals.p_f('f', 'd1', 'd2')}, 7) as p, round(slope, 6) as slope from f""")
def st36_ancova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.ancova(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "c_nationkey"), 6, "f", "slope").withColumn("p", F.round("p", 7))


@register("st25_quade", f"""with r as ({COVARIED}), k as (select g, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from r),
    l as (select regr_slope(ry, rx) as b, avg(rx) as mx, avg(ry) as my from k), e as (select g, ry - my - b * (rx - mx) as e from k, l), m as (select g, count(*) as n, avg(e) as m, var_pop(e) as v from e group by g),
    a as (select sum(n * m * m) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) as f, (count(*) - 1)::double as d1, (sum(n) - count(*))::double as d2 from m)
    select round(f, 6) as f, d1 as df_between, d2 as df_within, round({integrals.p_f('f', 'd1', 'd2')}, 7) as p from a""")
def st25_quade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.quade(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "c_nationkey"), 6, "f").withColumn("p", F.round("p", 7))


WHOLE = """x0 as (select user_id as s, date_trunc('week', ts)::date as t, avg(value) as x from events where value is not null group by 1, 2),
    x as (select *, s % 3 as g from x0 where s in (select s from x0 group by s having count(*) = (select count(distinct t) from x0)))"""


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("value is not null").groupBy(F.col("user_id").alias("s"), F.to_date(F.date_trunc("week", "ts")).alias("t")).agg(F.avg("value").alias("x")).withColumn("g", F.expr("s % 3"))


@register("st31_sphericity", f"""with {WHOLE}, c as (select a.t, b.t as u, covar_samp(a.x, b.x) as c, count(*) as n from x a join x b using (s) group by 1, 2), d as (select t, u, n, c - avg(c) over (partition by t) - avg(c) over (partition by u) + avg(c) over () as d from c),
    m as (select count(distinct t) as k, max(n) as n, sum(d) filter (t = u) as trace, sum(d * d) as squares from d), e as (select *, trace ** 2 / ((k - 1) * squares) as gg from m)
    select k, n, round(gg, 6) as epsilon_gg, round(least(1, (n * (k - 1) * gg - 2) / ((k - 1) * (n - 1 - (k - 1) * gg))), 6) as epsilon_hf from e""")
def st31_sphericity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.sphericity(_weeks(spark, sf_dir), "s", "t", "x"), 6, "epsilon_gg", "epsilon_hf")


@register("st30_mixed_anova", f"""with {WHOLE}, y as (select s, t, g, x - avg(x) over () as x from x), q as (select (select sum(x * x) from y) as total, (select sum(n * m * m) from (select count(*) as n, avg(x) as m from y group by s)) as ss, (select sum(n * m * m) from (select count(*) as n, avg(x) as m from y group by g)) as sg,
    (select sum(n * m * m) from (select count(*) as n, avg(x) as m from y group by t)) as st, (select sum(n * m * m) from (select count(*) as n, avg(x) as m from y group by g, t)) as sgt, count(distinct s)::double as ns, count(distinct g)::double as ng, count(distinct t)::double as nt from y),
    e as (select 'group' as effect, sg as v, ng - 1 as df, ss - sg as w, ns - ng as df_error from q union all select 'time', st, nt - 1, total - ss - st - (sgt - sg - st), (ns - ng) * (nt - 1) from q
      union all select 'group x time', sgt - sg - st, (ng - 1) * (nt - 1), total - ss - st - (sgt - sg - st), (ns - ng) * (nt - 1) from q), f as (select *, v / df / (w / df_error) as f from e)
    select effect, round(f, 6) as f, df, df_error, round({integrals.p_f('f', 'df', 'df_error')}, 7) as p from f""")
def st30_mixed_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.mixed_anova(_weeks(spark, sf_dir), "s", "t", "x", "g"), 6, "f").withColumn("p", F.round("p", 7))


@register("st33_trend", f"""with {WHOLE}, k as (select *, dense_rank() over (order by t) - 1 as i, (select count(distinct t) from x) as k from x), w as (select s, sum((i - (k - 1) / 2.0) / sqrt(k * (k * k - 1) / 12.0) * x) as c from k group by s),
    m as (select count(*) as n, avg(c) as mean, avg(c) / (stddev_samp(c) / sqrt(count(*))) as t from w) select n, round(mean, 6) as mean, round(t, 6) as t, (n - 1)::double as df, round({integrals.p_t('t', '(n - 1)::double')}, 8) as p from m""")
def st33_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.trend(_weeks(spark, sf_dir), "s", "t", "x"), 6, "mean", "t").withColumn("p", F.round("p", 8))
