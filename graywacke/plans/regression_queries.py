"""Queries of regressions with covariates, adjusted mediation, comparisons of times, and models of repeated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import gram, mixed_model
from graywacke.plans import integrals
from graywacke.plans.registry import register
from graywacke.plans.robust_queries import st61_bootstrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str, names: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))


@register("st62_regression", f"""with r as (select c_mktsegment as g, c_nationkey::double as a, c_custkey::double as b, c_acctbal::double as y from customer where c_nationkey is not null and c_custkey is not null and c_acctbal is not null),
    m as (select g, count(*)::double as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) * count(*) as aa, var_pop(b) * count(*) as bb, covar_pop(a, b) * count(*) as ab, covar_pop(a, y) * count(*) as ay, covar_pop(b, y) * count(*) as "by", var_pop(y) * count(*) as yy from r group by g),
    d as (select *, aa * bb - ab * ab as det from m), s as (select *, (bb * ay - ab * "by") / det as ka, (aa * "by" - ab * ay) / det as kb from d), e as (select *, yy - ka * ay - kb * "by" as rest, n - 3 as df from s),
    t as (select g, n, df, 1 - rest / yy as r2, unnest([{{'term': 'intercept', 'estimate': my - ka * ma - kb * mb, 'se': sqrt(rest / df * (1 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det))}}, {{'term': 'a', 'estimate': ka, 'se': sqrt(rest / df * bb / det)}}, {{'term': 'b', 'estimate': kb, 'se': sqrt(rest / df * aa / det)}}], recursive := true) from e),
    u as (select *, estimate / se as t from t) select g, term, round(estimate, 6) as estimate, round(se, 6) as se, round(t, 6) as t, df, round(abs({integrals.p_t('t', 'df')}), 7) as p, round(r2, 7) as r2, n::bigint as n from u""")
def st62_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_mktsegment as g", "c_nationkey as a", "c_custkey as b", "c_acctbal as y")
    return gram.regression(rows, "y", ["a", "b"], ["g"]).withColumns({c: F.round(c, k) for c, k in (("estimate", 6), ("se", 6), ("t", 6), ("p", 7), ("r2", 7))})


@register("st62_mediation", f"""with r as (select embedding[1]::double as x, embedding[2]::double as m, embedding[3]::double as y, embedding[4]::double as c, embedding[5]::double as d from embeddings),
    k1 as (select regr_slope(x, c) as x, regr_slope(m, c) as m, regr_slope(y, c) as y, regr_slope(d, c) as d from r), r1 as (select r.x - k1.x * c as x, r.m - k1.m * c as m, r.y - k1.y * c as y, r.d - k1.d * c as d from r, k1),
    k2 as (select regr_slope(x, d) as x, regr_slope(m, d) as m, regr_slope(y, d) as y from r1), r2 as (select r1.x - k2.x * d as x, r1.m - k2.m * d as m, r1.y - k2.y * d as y from r1, k2),
    k3 as (select count(*) as n, regr_slope(m, x) as a, regr_slope(y, x) as total, sqrt((regr_syy(m, x) - regr_sxy(m, x) ** 2 / regr_sxx(m, x)) / (count(*) - 4) / regr_sxx(m, x)) as ea from r2),
    r3 as (select m - a * x as m, y - total * x as y from r2, k3), k4 as (select regr_slope(y, m) as b, sqrt((regr_syy(y, m) - regr_sxy(y, m) ** 2 / regr_sxx(y, m)) / (count(*) - 5) / regr_sxx(y, m)) as eb from r3),
    e as (select n, a, b, total - a * b as direct, total, a * b as indirect, sqrt(a * a * eb * eb + b * b * ea * ea) as se from k3, k4), z as (select *, indirect / se as z from e)
    select n, round(a, 7) as a, round(b, 7) as b, round(direct, 7) as direct, round(total, 7) as total, round(indirect, 7) as indirect, round(se, 7) as se, round(z, 6) as z, round({integrals.p_z('z')}, 7) as p from z""")
def st62_mediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gram.mediation(_vectors(spark, sf_dir, "xmycd"), "x", "m", "y", ["c", "d"])
    return found.withColumns({c: F.round(c, 6 if c == "z" else 7) for c in ("a", "b", "direct", "total", "indirect", "se", "z", "p")})


def _bootstrap_sql() -> str:
    from graywacke.plans.registry import _SQL

    return f"with reps as ({_SQL[st61_bootstrap.__name__]}) select count(indirect) as repeats, round(quantile_cont(indirect, 0.025), 5) as low, round(quantile_cont(indirect, 0.975), 5) as high from reps"


@register("st61_interval", _bootstrap_sql())
def st61_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = gram.bootstrap_mediation(_vectors(spark, sf_dir, "xmy"), "vec_id", "x", "m", "y", [], 20, 9)
    return gram.percentile_interval(reps, "indirect").withColumns({c: F.round(c, 5) for c in ("low", "high")})


@register("st34_times", f"""with r as (select embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings), d as (select unnest([{{'first': 'a', 'second': 'b', 'd': b - a}}, {{'first': 'a', 'second': 'c', 'd': c - a}}, {{'first': 'b', 'second': 'c', 'd': c - b}}], recursive := true) from r),
    m as (select first, second, count(*) as n, avg(d) as mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t, count(*) - 1.0 as df from d group by 1, 2), p as (select *, {integrals.p_t('t', 'df')} as p from m),
    o as (select *, p * (4 - row_number() over (order by p, first, second)) as step from p)
    select first, second, n, round(mean, 7) as mean, round(t, 6) as t, df::double as df, round(p, 7) as p, round(least(1, max(step) over (order by p, first, second rows unbounded preceding)), 7) as p_holm from o""")
def st34_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.time_pairs(_vectors(spark, sf_dir, "abc"), ["a", "b", "c"]).withColumns({c: F.round(c, 6 if c == "t" else 7) for c in ("mean", "t", "p", "p_holm")})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, time, value, group): the quantities of the first three lines of orders, some of which have fewer."""
    lines = _table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").selectExpr("l_orderkey as subject", "l_linenumber as time", "l_quantity as value")
    return lines.join(_table(spark, sf_dir, "orders").selectExpr("o_orderkey as subject", "o_orderpriority as group"), "subject")


@register("st32_mmrm")
def st32_mmrm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed_model.fit(_lines(spark, sf_dir), "subject", "time", "value", "group", [1, 2, 3])
    return mixed_model.differences(spark, found, found.groups[0])


@register("st32_mmrm_complete", f"""with r as (select l_orderkey as s, o_orderpriority as g, avg(l_quantity) filter (l_linenumber = 1) as a, avg(l_quantity) filter (l_linenumber = 2) as b, avg(l_quantity) filter (l_linenumber = 3) as c from lineitem join orders on o_orderkey = l_orderkey group by 1, 2),
    l as (select g, unnest([{{'time': '1', 'x': a}}, {{'time': '2', 'x': b}}, {{'time': '3', 'x': c}}], recursive := true) from r where a is not null and b is not null and c is not null and g is not null),
    m as (select g, time, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as ss from l group by 1, 2), v as (select time, sum(ss) / (sum(n) - count(*)) as v, (sum(n) - count(*))::double as df from m group by 1),
    f as (select time, mean as base, n as n0 from m where g = (select min(g) from m)), d as (select g as "group", m.time, mean - base as difference, sqrt(v / n + v / n0) as se, df from m join v using (time) join f using (time) where g > (select min(g) from m)), t as (select *, difference / se as t from d)
    select "group", time, round(difference, 5) as difference, round(se, 5) as se, round(t, 4) as t, df, round({integrals.p_t('t', 'df')}, 5) as p from t""")
def st32_mmrm_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    whole = rows.filter("value is not null").groupBy("subject").agg(F.count_distinct("time").alias("k")).filter("k = 3").select("subject")
    found = mixed_model.fit(rows.join(whole, "subject", "left_semi"), "subject", "time", "value", "group", [1, 2, 3])
    return mixed_model.differences(spark, found, found.groups[0]).withColumns({c: F.round(c, 4 if c == "t" else 5) for c in ("difference", "se", "t", "p")})
