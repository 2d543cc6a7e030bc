"""Queries of pooled effects: each nation's mean balance is a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import pooling
from graywacke.plans import integrals
from graywacke.plans.registry import register
from graywacke.plans.statistics_queries import STUDIES, _studies


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _tau_sql(kind: str, by: str) -> str:
    """Newton's steps, unrolled."""
    on = f"using ({by})" if by else "on true"
    change = "(q1 - (k - 1)) / q2" if kind == "pm" else "(q2 - (s1 - s2 / s1)) / (s2 - 2 * s3 / s1 + s2 * s2 / (s1 * s1))"
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    parts = [f"n0 as (select {key}0.0::double as tau2 from s {group or 'limit 1'})"]
    for i in range(pooling.STEPS):
        parts.append(f"w{i} as (select {key}y, v, tau2, 1 / (v + tau2) as w from s join n{i} {on}), c{i} as (select {key}sum(w * y) / sum(w) as mean from w{i}{group}), d{i} as (select {key}count(*) as k, max(tau2) as tau2, sum(w) as s1, sum(w * w) as s2, sum(w ** 3) as s3, sum(w * (y - mean) ** 2) as q1, sum(w * w * (y - mean) ** 2) as q2 from w{i} join c{i} {on}{group}), n{i + 1} as (select {key}greatest(0, tau2 + {change}) as tau2 from d{i})")
    last = f"select {key}count(*) as k, round(max(tau2), 3) as tau2, round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 5) as random, round(sqrt(1 / sum(1 / (v + tau2))), 5) as se from s join n{pooling.STEPS} {on}{group}"
    return f"with s as (select study % 5 as region, y, v from ({STUDIES}) where v > 0), {', '.join(parts)} {last}"


@register("st71_paule_mandel", _tau_sql("pm", ""))
def st71_paule_mandel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(pooling.random_effect(_studies(spark, sf_dir), "y", "v", "pm"), 5, "random", "se"), 3, "tau2")


@register("st71_reml", _tau_sql("reml", "region"))
def st71_reml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _studies(spark, sf_dir).withColumn("region", F.expr("study % 5"))
    return _rounded(_rounded(pooling.random_effect(rows, "y", "v", "reml", ["region"]), 5, "random", "se"), 3, "tau2")


@register("st75_egger_test", f"""with s as ({STUDIES}), x as (select y / sqrt(v) as z, 1 / sqrt(v) as x from s), m as (select count(*) as k, regr_slope(z, x) as slope, regr_intercept(z, x) as intercept, avg(x) as mx, regr_sxx(z, x) as sxx from x), r as (select sum((z - intercept - slope * x) ** 2) as rest from x, m),
    e as (select k, slope, intercept, sqrt(rest / (k - 2) * (1.0 / k + mx * mx / sxx)) as se, k - 2.0 as df from m, r), t as (select *, intercept / se as t from e)
    select k, round(intercept, 6) as intercept, round(se, 6) as se, round(t, 6) as t, df::double as df, round({integrals.p_t('t', 'df')}, 7) as p, round(slope, 6) as slope from t""")
def st75_egger_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(pooling.egger(_studies(spark, sf_dir), "y", "v"), 6, "intercept", "se", "t", "slope"), 7, "p")


@register("st74_random_left_out", f"""with s as ({STUDIES}), o as (select a.study, b.y, b.v from s a join s b on a.study <> b.study), f as (select study, count(*) as k, sum(1 / v) as w, sum(1 / v / v) as w2, sum(y / v) / sum(1 / v) as fixed from o group by 1),
    q as (select study, sum((y - fixed) ** 2 / v) as q from o join f using (study) group by 1), t as (select study, greatest(0, (q - (k - 1)) / (w - w2 / w)) as tau2 from f join q using (study))
    select study, round(max(tau2), 3) as tau2, round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 5) as random, round(sqrt(1 / sum(1 / (v + tau2))), 5) as se from o join t using (study) group by 1""")
def st74_random_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(pooling.left_out(_studies(spark, sf_dir), "study", "y", "v"), 5, "random", "se"), 3, "tau2")


#: Effects of which some on the left have been lost: what trim and fill is for.
SKEWED = f"select study, y + case when study % 4 = 0 then 900 when study % 6 = 1 then 400 else 0 end as y, v from ({STUDIES})"


def _fill_sql(rounds: int = 8) -> str:
    parts = ["r as (select *, row_number() over (order by y desc, v, study) as place, count(*) over () as n from s)", "k0 as (select 0 as k)"]
    for i in range(rounds):
        parts.append(f"c{i} as (select sum(y / v) / sum(1 / v) as c from r, k{i} where place > k), d{i} as (select n, y - c as d, rank() over (order by abs(y - c)) + (count(*) over (partition by abs(y - c)) - 1) / 2.0 as rank from r, c{i}), k{i + 1} as (select greatest(0, least(max(n) - 2, floor((4 * coalesce(sum(rank) filter (d > 0), 0) - max(n) * (max(n) + 1)) / (2 * max(n) - 1) + 0.5)))::bigint as k from d{i})")
    return f"""with s as ({SKEWED}), {', '.join(parts)}, a as (select y, v, 0 as filled from r union all select 2 * c - y, v, 1 from r, k{rounds - 1}, c{rounds - 1} where place <= k)
        select count(*) as k, sum(filled)::bigint as n_filled, round(sum(y / v) / sum(1 / v), 5) as fixed, round(sqrt(1 / sum(1 / v)), 5) as se from a"""


@register("st76_trim_and_fill", _fill_sql())
def st76_trim_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _studies(spark, sf_dir).selectExpr("study", "y + case when study % 4 = 0 then 900 when study % 6 = 1 then 400 else 0 end as y", "v")
    return _rounded(pooling.filled_effect(pooling.trim_and_fill(rows, "study", "y", "v")), 5, "fixed", "se")


@register("snk06_funnel", f"""with s as (select y, sqrt(v) as e from ({STUDIES})), m as (select min(y) as low, max(y) as high, max(e) as most from s), c as (select least(11, floor(e / most * 12))::int as line, least(40, floor((y - low) / (high - low) * 41))::int as x from s, m),
    n as (select line, x, least(9, count(*))::varchar as c from c group by 1, 2), g as (select l.line, k.x, coalesce(c, ' ') as c from (select distinct line from n) l cross join (select unnest(range(41)) as x) k left join n on n.line = l.line and n.x = k.x)
    select line, rtrim(string_agg(c, '' order by x)) as text from g group by 1""")
def snk06_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.funnel(_studies(spark, sf_dir), "y", "v")
