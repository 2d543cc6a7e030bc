"""Queries of group comparison, agreement, accuracy, pooling, reliability, repeated measures and mediation on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import compare, designs, measures
from graywacke.plans import integrals
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _p(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """p values to so many places, as far as sums over panels agree."""
    return df.withColumns({c: F.round(c, places) for c in columns or ("p",)})


CUSTOMER = "from customer where c_mktsegment is not null and c_acctbal is not null"


@register("agg01_summary", f"""select c_mktsegment as "group", count(*) as n, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as sd,
    round(quantile_cont(c_acctbal, 0.25), 6) as q1, round(quantile_cont(c_acctbal, 0.5), 6) as median, round(quantile_cont(c_acctbal, 0.75), 6) as q3 {CUSTOMER} group by 1""")
def agg01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.summary(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), "mean", "sd", "q1", "median", "q3")


@register("st03_st04_t_tests", f"""with m as (select count(*) filter (c_mktsegment = 'BUILDING') as n_a, count(*) filter (c_mktsegment = 'MACHINERY') as n_b,
    avg(c_acctbal) filter (c_mktsegment = 'BUILDING') as m_a, avg(c_acctbal) filter (c_mktsegment = 'MACHINERY') as m_b,
    var_samp(c_acctbal) filter (c_mktsegment = 'BUILDING') as v_a, var_samp(c_acctbal) filter (c_mktsegment = 'MACHINERY') as v_b {CUSTOMER}),
    p as (select *, ((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) as pooled, v_a / n_a + v_b / n_b as se2 from m),
    t as (select *, (m_a - m_b) / sqrt(pooled * (1.0 / n_a + 1.0 / n_b)) as ts, (m_a - m_b) / sqrt(se2) as tw, se2 * se2 / ((v_a / n_a) ** 2 / (n_a - 1) + (v_b / n_b) ** 2 / (n_b - 1)) as dw from p)
    select n_a, n_b, round(ts, 6) as t_student, round(tw, 6) as t_welch, round(dw, 6) as df_welch,
    round({integrals.p_t('ts', '(n_a + n_b - 2)::double')}, 8) as p_student, round({integrals.p_t('tw', 'dw')}, 8) as p_welch,
    round((m_a - m_b) / sqrt(pooled) * (1 - 3.0 / (4 * (n_a + n_b) - 9)), 6) as hedges_g, round((m_a - m_b) / sqrt((v_a + v_b) / 2), 6) as smd from t""")
def st03_st04_t_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = compare.two_sample(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    tests = tests.select("n_a", "n_b", "t_student", "t_welch", "df_welch", F.round("p_student", 8).alias("p_student"), F.round("p_welch", 8).alias("p_welch"), "hedges_g", "smd")
    return _rounded(tests, "t_student", "t_welch", "df_welch", "hedges_g", "smd")


@register("st05_mann_whitney", f"""with r as (select c_mktsegment as g, count(*) over (partition by c_acctbal) as ties, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0 as k {CUSTOMER} and c_mktsegment in ('BUILDING', 'MACHINERY')),
    s as (select sum(k) filter (g = 'BUILDING') as r, count(*) filter (g = 'BUILDING') as n_a, count(*) filter (g <> 'BUILDING') as n_b, count(*)::double as n, sum(ties::double ** 2 - 1) as ties_sum from r),
    w as (select *, r - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0 as away, sqrt(n_a::double * n_b / 12 * (n + 1 - ties_sum / (n * (n - 1)))) as sigma from s), z as (select *, sign(away) * greatest(0, abs(away) - 0.5) / sigma as z from w)
    select n_a, n_b, r - n_a * (n_a + 1) / 2.0 as u, round(2 * (r - n_a * (n_a + 1) / 2.0) / (n_a * n_b) - 1, 6) as rank_biserial, round(z, 6) as z, round({integrals.p_z('z')}, 8) as p from z""")
def st05_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = compare.mann_whitney(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return _rounded(test.select("n_a", "n_b", F.col("u").cast("double").alias("u"), "rank_biserial", "z", F.round("p", 8).alias("p")), "rank_biserial", "z")


ANOVA = """with e as (select g, count(*) as n, avg(v) as m, var_pop(v) as s from x group by g), t as (select sum(n * m) / sum(n) as grand from e),
    a as (select sum(n * (m - grand) ** 2) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))) as f, (count(*) - 1)::double as df_between, (sum(n) - count(*))::double as df_within,
    round(sum(n * (m - grand) ** 2) / (sum(n * (m - grand) ** 2) + sum(n * s)), 6) as eta_squared from e, t)
    select round(f, 6) as f, df_between, df_within, eta_squared, round(""" + integrals.p_f("f", "df_between", "df_within") + """, 7) as p from a"""


@register("st06_anova", f"with x as (select c_mktsegment as g, c_acctbal as v {CUSTOMER}), {ANOVA[5:]}")
def st06_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_p(compare.anova(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), 7), "f", "eta_squared")


@register("st02_levene", f"with x as (select c_mktsegment as g, abs(c_acctbal - median(c_acctbal) over (partition by c_mktsegment)) as v {CUSTOMER}), {ANOVA[5:]}")
def st02_levene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_p(compare.levene(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), 7), "f", "eta_squared")


@register("st07_kruskal_wallis", f"""with x as (select event_type as g, floor(value) as v from events where event_type is not null and value is not null),
    r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as k, count(*) over () as n from x),
    t as (select sum(c::double ** 3 - c) as ties from (select count(*) as c from x group by v)),
    s as (select sum(q) as s, count(*) as groups, max(n) as n from (select sum(k) ** 2 / count(*) as q, max(n) as n from r group by g)),
    h as (select (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::double ** 3 - n)) as h, (groups - 1)::double as df from s, t)
    select round(h, 6) as h, df, round({integrals.p_chi2('h', 'df')}, 8) as p from h""")
def st07_kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.kruskal_wallis(_table(spark, sf_dir, "events").withColumn("value", F.floor("value")), "value", "event_type"), "h").withColumn("p", F.round("p", 8))


@register("st10_holm", """with g as (select l_returnflag as flag, avg(l_discount) as p from lineitem group by 1), o as (select *, p * (count(*) over () - row_number() over (order by p, flag) + 1) as step from g)
    select flag, round(p, 9) as p, round(least(1.0, max(step) over (order by p, flag)), 9) as p_holm from o""")
def st10_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("p"))
    return compare.holm(tests).select("flag", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


PAIR = "select embedding[2]::double as a, embedding[3]::double as b from embeddings"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("embedding")[1].cast("double").alias("a"), F.col("embedding")[2].cast("double").alias("b"))


@register("st23_paired", f"""with x as ({PAIR}), d as (select a - b as d from x), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as k from d where d <> 0),
    t as (select count(*) as n, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from d), s as (select sum(c::double ** 3 - c) as ties from (select count(*) as c from r group by abs(d))),
    w as (select coalesce(sum(k) filter (d > 0), 0)::double as w_plus, coalesce(sum(k) filter (d < 0), 0)::double as w_minus, count(*)::double as m from r),
    z as (select *, (w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) as z from w, s)
    select n, round(t, 6) as t, w_plus, w_minus, round(z, 6) as z, round({integrals.p_t('t', '(n - 1)::double')}, 8) as p_t, round({integrals.p_z('z')}, 8) as p_wilcoxon from t, z""")
def st23_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.paired(_pair(spark, sf_dir), "a", "b").select("n", "t", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), "z", F.round("p_t", 8).alias("p_t"), F.round("p_wilcoxon", 8).alias("p_wilcoxon")), "t", "z")


@register("st24_correlations", f"""with x as ({PAIR}), r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from x)
    select count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from r""")
def st24_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.correlations(_pair(spark, sf_dir), "a", "b"), "pearson", "spearman")


@register("st40_bland_altman", f"""with x as ({PAIR}), d as (select a, b, a - b as d, (a + b) / 2 as m from x)
    select count(*) as n, round(avg(d), 6) as bias, round(stddev_samp(d), 6) as sd, round(avg(d) - 1.96 * stddev_samp(d), 6) as loa_low, round(avg(d) + 1.96 * stddev_samp(d), 6) as loa_high,
    round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2), 6) as ccc, round(regr_slope(d, m), 6) as slope from d""")
def st40_bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.bland_altman(_pair(spark, sf_dir), "a", "b"), "bias", "sd", "loa_low", "loa_high", "ccc", "slope")


@register("st42_icc", """with x as (select vec_id as s, r, embedding[r]::double as x from embeddings, unnest(range(1, 5)) as u(r)), g as (select avg(x) as g, count(distinct s) as n, count(distinct r) as k from x),
    ss as (select sum(m * m) as v from (select avg(x - g) as m from x, g group by s)), sr as (select sum(m * m) as v from (select avg(x - g) as m from x, g group by r)), st as (select sum((x - g) ** 2) as v from x, g),
    ms as (select n, k, k * ss.v / (n - 1) as s, n * sr.v / (k - 1) as r, (st.v - k * ss.v - n * sr.v) / ((n - 1) * (k - 1)) as e from g, ss, sr, st)
    select n, k, round((s - e) / (s + (k - 1) * e + k * (r - e) / n), 6) as icc_2_1, round((s - e) / (s + (k - 1) * e), 6) as icc_3_1 from ms""")
def st42_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.posexplode(F.slice("embedding", 1, 4)).alias("r", "x"))
    return _rounded(measures.icc(long, "s", "r", "x"), "icc_2_1", "icc_3_1")


SCORED = "select n_chars::double as s, quality as y from documents join labels using (doc_id) where n_chars is not null and quality is not null"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality")


@register("st50_roc", f"""with x as ({SCORED}), c as (select s, sum(y) as p, sum(1 - y) as q from x group by s), r as (select s, sum(p) over (order by s desc) as tp, sum(q) over (order by s desc) as fp, sum(p) over () as n1, sum(q) over () as n0 from c)
    select s as threshold, tp::bigint as tp, fp::bigint as fp, (n1 - tp)::bigint as fn, (n0 - fp)::bigint as tn, round(tp / n1, 6) as sensitivity, round((n0 - fp) / n0, 6) as specificity from r""")
def st50_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.roc(_scored(spark, sf_dir), "n_chars", "quality").drop("youden", "positives", "negatives"), "sensitivity", "specificity")


Z = measures.Z95


@register("st51_auc", f"""with x as ({SCORED}), r as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as k, rank() over (partition by y order by s) + (count(*) over (partition by y, s) - 1) / 2.0 as own, count(*) over (partition by y) as n_own from x),
    n as (select sum(y)::double as n1, sum(1 - y)::double as n0, (sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as auc from r),
    v as (select y, case when y = 1 then (k - own) / n0 else 1 - (k - own) / n1 end as v, auc, n1, n0 from r, n),
    e as (select max(auc) as auc, sqrt(var_samp(v) filter (y = 1) / max(n1) + var_samp(v) filter (y = 0) / max(n0)) as se from v)
    select round(auc, 6) as auc, round(se, 6) as se, round(greatest(0, auc - {Z} * se), 6) as auc_low, round(least(1, auc + {Z} * se), 6) as auc_high,
    (select s from (select s, sum(sum(y)) over (order by s desc) / sum(sum(y)) over () - sum(sum(1 - y)) over (order by s desc) / sum(sum(1 - y)) over () as youden from x group by s) order by round(youden, 9) desc, s limit 1) as best_threshold from e""")
def st51_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.auc(measures.roc(_scored(spark, sf_dir), "n_chars", "quality")), "auc", "se", "auc_low", "auc_high")


RATES = ("sensitivity", "specificity", "ppv", "npv")
WILSON = ", ".join(
    f"round(case when {w} > 0 then ({p} + {Z * Z} / 2) / ({w} + {Z * Z}) {sign} {Z} / ({w} + {Z * Z}) * sqrt({p} * ({w} - {p})::double / {w} + {Z * Z} / 4) end, 6) as {name}_{end}"
    for name, p, w in (("sensitivity", "tp", "n1"), ("specificity", "(n0 - fp)", "n0"), ("ppv", "tp", "(tp + fp)"), ("npv", "(n0 - fp)", "(n0 - fp + n1 - tp)")) for sign, end in (("-", "low"), ("+", "high"))
)


@register("st53_accuracy", f"""with x as ({SCORED}), c as (select s, sum(y) as p, sum(1 - y) as q from x group by s),
    r as (select s, (sum(p) over (order by s desc))::double as tp, (sum(q) over (order by s desc))::double as fp, (sum(p) over ())::double as n1, (sum(q) over ())::double as n0 from c)
    select s as threshold, tp::bigint as tp, fp::bigint as fp, (n1 - tp)::bigint as fn, (n0 - fp)::bigint as tn, round(tp / n1, 6) as sensitivity, round((n0 - fp) / n0, 6) as specificity, round(tp / (tp + fp), 6) as ppv,
    round(case when n0 - fp + n1 - tp > 0 then (n0 - fp) / (n0 - fp + n1 - tp) end, 6) as npv, round(case when fp > 0 then tp / n1 / (fp / n0) end, 6) as lr_plus, round(case when n0 > fp then (1 - tp / n1) / ((n0 - fp) / n0) end, 6) as lr_minus, {WILSON} from r""")
def st53_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.accuracy(measures.roc(_scored(spark, sf_dir), "n_chars", "quality"))
    return _rounded(rows, *RATES, "lr_plus", "lr_minus", *(f"{c}_{e}" for c in RATES for e in ("low", "high")))


@register("st40_st41_st44_intervals", f"""with x as ({PAIR}), d as (select a - b as d, (a + b) / 2 as m from x),
    s as (select count(*)::double as n, avg(d) as bias, stddev_samp(d) as sd, avg(m) as mean, avg(d * d / 2) as within, regr_slope(d, m) as slope, regr_sxx(d, m) as sxx, regr_syy(d, m) as syy, regr_sxy(d, m) as sxy from d),
    t as (select *, slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) as t from s)
    select n::bigint as n, round(bias - {Z} * sd / sqrt(n), 6) as bias_low, round(bias + {Z} * sd / sqrt(n), 6) as bias_high, round(bias - {Z} * sd - {Z} * sd * sqrt(3 / n), 6) as lower_low, round(bias - {Z} * sd + {Z} * sd * sqrt(3 / n), 6) as lower_high,
    round(bias + {Z} * sd - {Z} * sd * sqrt(3 / n), 6) as upper_low, round(bias + {Z} * sd + {Z} * sd * sqrt(3 / n), 6) as upper_high, round(slope, 6) as slope, round(t, 6) as t, round({integrals.p_t('t', 'n - 2')}, 8) as p, round(sqrt(within) / mean, 4) as cv from t""")
def st40_st41_st44_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.agreement_intervals(_pair(spark, sf_dir), "a", "b").withColumns({"p": F.round("p", 8), "cv": F.round("cv", 4)})
    return _rounded(rows, "bias_low", "bias_high", "lower_low", "lower_high", "upper_low", "upper_high", "slope", "t")


STUDIES = "select c_nationkey as study, avg(c_acctbal) as y, var_samp(c_acctbal) / count(*) as v from customer where c_acctbal is not null group by 1 having count(*) > 1"


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _table(spark, sf_dir, "customer").filter("c_acctbal is not null").groupBy(F.col("c_nationkey").alias("study")).agg(F.avg("c_acctbal").alias("y"), F.var_samp("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    return each.filter("n > 1").selectExpr("study", "y", "s / n as v")


@register("st70_pooled", f"""with s as ({STUDIES}), f as (select count(*) as k, sum(1 / v) as sw, sum(1 / v / v) as sw2, sum(y / v) / sum(1 / v) as fixed from s),
    q as (select max(k) as k, max(sw) as sw, max(sw2) as sw2, max(fixed) as fixed, sum((y - fixed) ** 2 / v) as q from s, f), t as (select *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) as tau2 from q)
    select round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 6) as random, round(sqrt(1 / sum(1 / (v + tau2))), 6) as random_se, max(k) as k, round(max(q), 6) as q, round(max(tau2), 6) as tau2, round(max(fixed), 6) as fixed,
    round(sqrt(1 / max(sw)), 6) as fixed_se, round(greatest(0, (max(q) - (max(k) - 1)) / max(q)), 6) as i2 from s, t""")
def st70_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.pooled(_studies(spark, sf_dir), "y", "v"), "random", "random_se", "q", "tau2", "fixed", "fixed_se", "i2")


@register("st74_leave_one_out", f"with s as ({STUDIES}), t as (select sum(1 / v) as w, sum(y / v) as wy from s) select study, round((wy - y / v) / (w - 1 / v), 6) as without from s, t")
def st74_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.leave_one_out(_studies(spark, sf_dir), "study", "y", "v"), "without")


@register("st75_egger", f"with s as ({STUDIES}) select round(regr_intercept(y / sqrt(v), 1 / sqrt(v)), 6) as intercept, round(regr_slope(y / sqrt(v), 1 / sqrt(v)), 6) as slope from s")
def st75_egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.egger(_studies(spark, sf_dir), "y", "v"), "intercept", "slope")


@register("st94_st95_reliability", """with r as (select embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d from embeddings), t as (select *, a + b + c + d as total from r),
    v as (select unnest(['a', 'b', 'c', 'd']) as item, unnest([var_samp(a), var_samp(b), var_samp(c), var_samp(d)]) as v, unnest([covar_samp(a, total), covar_samp(b, total), covar_samp(c, total), covar_samp(d, total)]) as c,
    var_samp(total) as vt, var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d) as sv from t)
    select item, round(4.0 / 3 * (1 - sv / vt), 6) as alpha, round(3.0 / 2 * (1 - (sv - v) / (vt - 2 * c + v)), 6) as alpha_without, round((c - v) / sqrt(v * (vt - 2 * c + v)), 6) as item_rest from v""")
def st94_st95_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abcd")])
    return _rounded(measures.reliability(items, list("abcd")), "alpha", "alpha_without", "item_rest")


@register("sg05_sg07_variability", """with d as (select user_id as subject, value as x, value - lag(value) over w as d, value + lag(value) over w as s from events where value is not null window w as (partition by user_id order by event_id))
    select subject, count(*) as n, round(stddev_samp(x), 6) as sdnn, round(sqrt(avg(d * d)), 6) as rmssd, round(avg(case when abs(d) > 50 then 1.0 when d is not null then 0.0 end), 6) as pnn50, round(sqrt(var_samp(d) / 2), 6) as sd1, round(sqrt(var_samp(s) / 2), 6) as sd2 from d group by 1""")
def sg05_sg07_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.variability(_table(spark, sf_dir, "events").filter("value is not null"), "user_id", "event_id", "value"), "sdnn", "rmssd", "pnn50", "sd1", "sd2")


WEEKS = "select user_id as s, date_trunc('week', ts)::date as t, avg(value) as x from events where value is not null group by 1, 2"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("value is not null").groupBy(F.col("user_id").alias("s"), F.to_date(F.date_trunc("week", "ts")).alias("t")).agg(F.avg("value").alias("x"))


@register("st30_repeated_anova", f"""with x0 as ({WEEKS}), k as (select count(distinct t) as k from x0), x as (select * from x0 where s in (select s from x0 group by s having count(*) = (select k from k))), g as (select avg(x) as g from x),
    s as (select sum(m * m) as q, count(*) as n from (select avg(x - g) as m from x, g group by s)), t as (select sum(m * m) as q, count(*) as k from (select avg(x - g) as m from x, g group by t)), a as (select sum((x - g) ** 2) as ss from x, g),
    f as (select n, t.k, n * t.q / (t.k - 1) / ((ss - n * t.q - t.k * s.q) / ((n - 1) * (t.k - 1))) as f, (t.k - 1)::double as df_time, ((n - 1) * (t.k - 1))::double as df_error, round(n * t.q / (ss - t.k * s.q), 6) as partial_eta_squared from s, t, a)
    select n, k, round(f, 6) as f, df_time, df_error, partial_eta_squared, round({integrals.p_f('f', 'df_time', 'df_error')}, 7) as p from f""")
def st30_repeated_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_p(designs.repeated_anova(_weeks(spark, sf_dir), "s", "t", "x"), 7), "f", "partial_eta_squared")


@register("st35_change", f"with x as ({WEEKS}) select s, t, round(x, 6) as x, round(first_value(x) over (partition by s order by t), 6) as baseline, round(x - first_value(x) over (partition by s order by t), 6) as change from x")
def st35_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(designs.change_from_baseline(_weeks(spark, sf_dir), "s", "t", "x"), "x", "baseline", "change")


GAPPED = "select user_id as s, event_id as t, case when event_id % 3 <> 0 then value end as x from events"


@register("prj13_carried", f"with x as ({GAPPED}) select s, t, x, last_value(x ignore nulls) over (partition by s order by t rows unbounded preceding) as locf, coalesce(x, first_value(x) over (partition by s order by t)) as bocf from x")
def prj13_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = _table(spark, sf_dir, "events").select(F.col("user_id").alias("s"), F.col("event_id").alias("t"), F.expr("case when event_id % 3 <> 0 then value end").alias("x"))
    return designs.carried(gapped, "s", "t", "x")


@register("st60_mediation", """with r as (select embedding[1]::double as x, embedding[2]::double as m, embedding[3]::double as y from embeddings),
    s as (select count(*) as n, covar_samp(x, x) as xx, covar_samp(x, m) as xm, covar_samp(x, y) as xy, covar_samp(m, m) as mm, covar_samp(m, y) as my from r)
    select n, round(xm / xx, 6) as a, round((my * xx - xy * xm) / (mm * xx - xm * xm), 6) as b, round((xy * mm - my * xm) / (mm * xx - xm * xm), 6) as direct, round(xy / xx, 6) as total, round(xm / xx * (my * xx - xy * xm) / (mm * xx - xm * xm), 6) as indirect from s""")
def st60_mediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xmy")])
    return _rounded(designs.mediation(rows, "x", "m", "y"), "a", "b", "direct", "total", "indirect")


GROUPED = "select study, study % 5 as region, y, v from studies"


def _pooled_sql(by: str) -> str:
    key, group, join = ("region, ", "group by region", "using (region)") if by else ("", "", "on true")
    return f"""with studies as ({STUDIES}), g as ({GROUPED}), m as (select {key}count(*) as k, sum(y * y / v) - sum(y / v) ** 2 / sum(1 / v) as q, greatest(0, (sum(y * y / v) - sum(y / v) ** 2 / sum(1 / v) - (count(*) - 1)) / (sum(1 / v) - sum(1 / v / v) / sum(1 / v))) as dl,
    greatest(0, var_samp(y) - avg(v)) as he from g {group}), r as (select {key}max(k) as k, max(q) as q, max(dl) as dl, max(he) as he, sum(y / (v + dl)) / sum(1 / (v + dl)) as random, sqrt(1 / sum(1 / (v + dl))) as se from g join m {join} {group})
    select {key}k, round(q, 6) as q, round(dl, 4) as tau2_dl, round(he, 4) as tau2_he, round(random, 6) as random, round(random - {Z} * se, 6) as low, round(random + {Z} * se, 6) as high,
    round(random - {Z} * sqrt(dl + se * se), 5) as predicted_low, round(random + {Z} * sqrt(dl + se * se), 5) as predicted_high from r"""


def _heterogeneity(df: DataFrame) -> DataFrame:
    places = {"q": 6, "tau2_dl": 4, "tau2_he": 4, "random": 6, "low": 6, "high": 6, "predicted_low": 5, "predicted_high": 5}
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@register("st71_st72_heterogeneity", _pooled_sql(""))
def st71_st72_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heterogeneity(measures.heterogeneity(_studies(spark, sf_dir), "y", "v"))


@register("st73_subgroups", _pooled_sql("region"))
def st73_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heterogeneity(measures.heterogeneity(_studies(spark, sf_dir).withColumn("region", F.expr("study % 5")), "y", "v", ["region"]))


@register("st75_begg", f"""with s as ({STUDIES}), t as (select count(*) as k, sum(1 / v) as w, sum(y / v) / sum(1 / v) as fixed from s), r as (select (y - fixed) / sqrt(v - 1 / w) as e, v, k from s, t),
    m as (select sum(sign(b.e - a.e))::double as s, max(a.k) as k from r a join r b on a.v < b.v), z as (select *, s / sqrt(k * (k - 1) * (2 * k + 5) / 18.0) as z from m) select k, s, round(z, 6) as z, round({integrals.p_z('z')}, 8) as p from z""")
def st75_begg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.begg(_studies(spark, sf_dir), "y", "v"), "z").withColumn("p", F.round("p", 8))
