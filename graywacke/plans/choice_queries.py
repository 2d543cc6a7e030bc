"""Queries of tests that are picked and run, intervals of differences, periods, unsure columns, ids, nights, silences and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import audits, choice, documents, logs, trace
from graywacke.plans import integrals, statistics_queries  # noqa: F401
from graywacke.plans.manuscript_queries import LINES, _manuscripts
from graywacke.plans.registry import _SQL, register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


#: The quantile of t by its expansion in 1 / df, for the 0.975 of many degrees of freedom.
T_975 = "(1.959963984540054 + (1.959963984540054 ** 3 + 1.959963984540054) / (4 * df) + (5 * 1.959963984540054 ** 5 + 16 * 1.959963984540054 ** 3 + 3 * 1.959963984540054) / (96 * df ** 2) + (3 * 1.959963984540054 ** 7 + 19 * 1.959963984540054 ** 5 + 17 * 1.959963984540054 ** 3 - 15 * 1.959963984540054) / (384 * df ** 3))"


@register("st09_difference", f"""with r as (select c_mktsegment = 'BUILDING' as a, c_acctbal::double as v from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal is not null), m as (select count(*) filter (a) as n_a, count(*) filter (not a) as n_b, avg(v) filter (a) - avg(v) filter (not a) as d, var_samp(v) filter (a) as va, var_samp(v) filter (not a) as vb from r),
    e as (select *, sqrt(va / n_a + vb / n_b) as se, (va / n_a + vb / n_b) ** 2 / ((va / n_a) ** 2 / (n_a - 1) + (vb / n_b) ** 2 / (n_b - 1)) as df, d / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) * (1 - 3.0 / (4 * (n_a + n_b) - 9)) as g from m), h as (select *, 1.959963984540054 * sqrt((n_a + n_b) / (n_a::double * n_b) + g * g / (2 * (n_a + n_b))) as ge from e)
    select n_a, n_b, round(d, 4) as difference, round(d - {T_975} * se, 4) as low, round(d + {T_975} * se, 4) as high, round(g, 6) as g, round(g - ge, 6) as g_low, round(g + ge, 6) as g_high from h""")
def st09_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(choice.difference(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"), 4, "difference", "low", "high"), 6, "g", "g_low", "g_high")


@register("st24_correlations", f"""with r as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from r),
    c as (select count(*) as n, corr(x, y) as a, corr(rx, ry) as b from k), t as (select *, a * sqrt((n - 2) / (1 - a * a)) as ta, b * sqrt((n - 2) / (1 - b * b)) as tb, n - 2.0 as df from c)
    select n, round(a, 7) as pearson, round(abs({integrals.p_t('ta', 'df')}), 7) as p_pearson, round(b, 7) as spearman, round(abs({integrals.p_t('tb', 'df')}), 7) as p_spearman from t""")
def st24_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(choice.correlations(rows, "x", "y"), 7, "pearson", "p_pearson", "spearman", "p_spearman")


@register("st11_chosen", f"""with h as ({_SQL["st07_kruskal_wallis"]}), c as ({_SQL["st13_chi_squared"]}) select 'value' as variable, 'kruskal-wallis' as test, round(h, 4) as statistic, round(p, 6) as p from h union all select 'status', 'chi squared', round(chi2, 4), round(p, 6) from c""")
def st11_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("value", F.floor("value").cast("double"))
    value = choice.compared(events, "value", "event_type").withColumn("variable", F.lit("value"))
    status = choice.compared(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").withColumn("variable", F.lit("status"))
    return value.unionByName(status).select("variable", "test", F.round("statistic", 4).alias("statistic"), F.round("p", 6).alias("p"))


@register("lg02_periods", f"""with m as (select user_id, avg(value) filter (day(ts) <= 15) as a, avg(value) filter (day(ts) > 15) as b from events group by 1), d as (select b - a as d from m where a is not null and b is not null), t as (select count(*) as n, avg(d) as mean_d, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t, count(*) - 1.0 as df from d)
    select n, round(mean_d, 6) as mean_d, round(t, 6) as t, round({integrals.p_t('t', 'df')}, 7) as p_t from t""")
def lg02_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("period"), "value")
    return choice.periods(rows, "user_id", "period", "value", "early", "late").select("n", F.round("mean_d", 6).alias("mean_d"), F.round("t", 6).alias("t"), F.round("p_t", 7).alias("p_t"))


@register("tx33_unsure", """with l as (select unnest([{'variable': 'c_acctbal', 'v': c_acctbal::varchar}, {'variable': 'c_mktsegment', 'v': c_mktsegment::varchar}, {'variable': 'mixed', 'v': case when c_nationkey < 8 then c_name else c_custkey::varchar end}], recursive := true) from customer),
    m as (select variable, count(v) as n, count(*) - count(v) as missing, count(distinct v) as levels, count(try_cast(v as double)) as numbers from l group by 1)
    select *, case when numbers > 0.05 * n and numbers < 0.95 * n then 'unsure' when levels > 10 and numbers >= 0.95 * n then 'continuous' else 'categorical' end as kind from m""")
def tx33_unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.sure_kinds(_table(spark, sf_dir, "customer").selectExpr("c_acctbal", "c_mktsegment", "case when c_nationkey < 8 then c_name else cast(c_custkey as string) end as mixed"))


@register("agg17_subgroups", """with b as (select p_brand as doc_id, count(*) as n, count(*) filter (p_size < 20) as k, count(*) filter (p_size between 20 and 35) as m, count(*) filter (p_size > 35) as l from part group by 1)
    select doc_id, 1 as line_no, n as whole, k + l + case when m % 2 = 0 then m else 0 end as total, k + l + case when m % 2 = 0 then m else 0 end = n as ok from b""")
def agg17_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("p_size < 20")).alias("k"), F.count_if(F.expr("p_size between 20 and 35")).alias("m"), F.count_if(F.expr("p_size > 35")).alias("l"))
    text = F.expr("concat('We had parts (n = 5); N = ', n, ' (', k, ' small, ', if(m % 2 = 0, concat(m, ' middling and '), ''), l, ' large) came.')")
    return choice.subgroup_totals(documents.lines(b.select("doc_id", text.alias("text")), "doc_id", "text")).select("doc_id", "line_no", "whole", "total", "ok")


@register("prj06_subjects", """with r as (select c_custkey as k, case c_custkey % 3 when 0 then 's 0' || c_custkey when 1 then 'S' || c_custkey else ' s00' || c_custkey || ' ' end as raw from customer) select raw, 'S' || k as subject from r""")
def prj06_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("case c_custkey % 3 when 0 then concat('s 0', c_custkey) when 1 then concat('S', c_custkey) else concat(' s00', c_custkey, ' ') end as raw")
    return rows.select("raw", audits.subject_id(F.col("raw")).alias("subject"))


@register("prj07_nights", "select (ts - interval 12 hour)::date as night, count(*) as n, count(distinct user_id) as users from events group by 1")
def prj07_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(audits.night(F.col("ts")).alias("night")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@register("lg12_silences", """with l as (select event_id, user_id, floor(value / 20) as level, ts - lag(ts) over w > interval 1 day as gap, count(*) over r as k, min(floor(value / 20)) over r as low, max(floor(value / 20)) over r as high from events window w as (partition by user_id order by ts), r as (partition by user_id order by ts rows between 2 preceding and current row))
    select event_id, user_id, coalesce(gap, false) as after_gap, k = 3 and low = high as constant from l where coalesce(gap, false) or k = 3 and low = high""")
def lg12_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _table(spark, sf_dir, "events").withColumn("level", F.floor(F.col("value") / 20))
    return logs.silences(levels, "user_id", "ts", "level", 86_400, 3).select("event_id", "user_id", "after_gap", "constant")


@register("join09_citations", rf"""with {LINES}, c as (select distinct unnest(regexp_extract_all(line, '\[(\d+)\]', 1))::int as number from l), r as (select distinct nullif(regexp_extract(source, '(\d+)', 1), '')::int as number from documents where source is not null and regexp_matches(source, '\d'))
    select number, 'not listed' as status from c where number not in (select number from r) union all select number, 'never cited' from r where number not in (select number from c)""")
def join09_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _table(spark, sf_dir, "documents").filter("source is not null").select(F.regexp_extract("source", r"(\d+)", 1).try_cast("int").alias("number")).filter("number is not null").distinct()
    return documents.citations(_manuscripts(spark, sf_dir), listed)


@register("tx13_unmatched", r"""with s as (select o_orderpriority as k, round(avg(o_totalprice), 1) as now, round(avg(o_totalprice) filter (o_orderkey % 2 = 0), 1) as half from orders group by 1) select count(*) as numbers, count(*) filter (k < '3' and half <> now) as unmatched, count(*) filter (k < '3' and half <> now) > 0.3 * count(*) as undecidable from s""")
def tx13_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice"), 1).alias("now"), F.round(F.avg(F.expr("case when o_orderkey % 2 = 0 then o_totalprice end")), 1).alias("half"))
    said = s.select(F.col("k").alias("doc_id"), F.format_string("It cost %.1f in all.", F.when(F.col("k") < "3", F.col("half")).otherwise(F.col("now"))).alias("text"))
    return trace.verdict(trace.traced(documents.lines(said, "doc_id", "text"), s.select(F.lit("now.csv").alias("file"), F.col("now").alias("value"))))
