"""Queries of audited joins, visit windows and document checks on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import audits, documents
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("join02_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def join02_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("join01_merged", """with o as (select o_custkey as k, count(*) as orders from orders group by 1), c as (select c_custkey as k, c_acctbal from customer)
    select k, orders, c_acctbal, case when o.k is not null then true end as in_orders, case when c.k is not null then true end as in_customers from o full join c using (k)""")
def join01_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return audits.merged({"orders": orders, "customers": customers}, ["k"]).result


@register("agg06_flow", """with l as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
    select 'lineitem' as source, sum(n)::bigint as rows_in, 0::bigint as no_key, (sum(n) filter (n > 1))::bigint as repeated, (sum(n) filter (n = 1))::bigint as rows_used from l""")
def agg06_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.merged({"lineitem": _table(spark, sf_dir, "lineitem")}, ["l_orderkey", "l_linenumber"]).coverage


@register("join03_overlap", "select count(*) filter (a and b) as both, count(*) filter (b is null) as only_a, count(*) filter (a is null) as only_b from (select distinct c_custkey as k, true as a from customer) full join (select distinct o_custkey as k, true as b from orders) using (k)")
def join03_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.overlap(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


PROTOCOL = [(k, 200 * k - 900, 150, 100, k <= 3) for k in range(1, 8)]


def _visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    visits = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("visit_code"), F.to_date("l_shipdate").alias("visit_date"))
    baselines = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.to_date("o_orderdate").alias("baseline"))
    return visits, baselines, spark.createDataFrame(PROTOCOL, "visit_code int, offset_days int, before int, after int, required boolean")


PLAN = f"plan as (select * from (values {', '.join(map(str, PROTOCOL))}) as p(visit_code, offset_days, before, after, required))".replace("True", "true").replace("False", "false")


@register("va01_visit_windows", f"""with {PLAN}, v as (select l_orderkey as subject, l_linenumber as visit_code, l_shipdate::date as visit_date, (o_orderdate::date + offset_days)::date as scheduled, before, after
    from lineitem left join orders on o_orderkey = l_orderkey left join plan on plan.visit_code = l_linenumber), a as (select *, visit_date - scheduled as away from v),
    d as (select *, case when away < -before then away + before when away > after then away - after when away is not null then 0 end::int as deviation_days from a)
    select subject, visit_code, visit_date, scheduled, deviation_days, case when deviation_days is null then 'undecidable' when deviation_days < 0 then 'early' when deviation_days > 0 then 'late' else 'on time' end as status, date '2026-08-20' as as_of from d""")
def va01_visit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.visit_windows(*_visits(spark, sf_dir), as_of="2026-08-20")


@register("join06_missing_visits", f"""with {PLAN} select o_orderkey as subject, visit_code, case when o_orderdate::date + offset_days + after >= date '1996-01-01' then 'not due' else 'missing' end as status
    from orders, plan where required and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = visit_code)""")
def join06_missing_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.missing_visits(*_visits(spark, sf_dir), as_of="1996-01-01")


@register("tx01_numbers")
def tx01_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.numbers(documents.lines(_table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "line_no", "nth", "raw", "value")


@register("tx04_grim", """with c as (select c_nationkey as k, count(*) as n, round(avg(c_custkey), 2) as mean from customer group by 1)
    select k, n, mean, (round(mean * 100) between floor(floor(mean * n) / n * 100 + 1e-9) and ceil(floor(mean * n) / n * 100 - 1e-9)) or (round(mean * 100) between floor(ceil(mean * n) / n * 100 + 1e-9) and ceil(ceil(mean * n) / n * 100 - 1e-9)) as possible from c""")
def tx04_grim(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_custkey"), 2).alias("mean"))
    return documents.grim(claims.withColumn("decimals", F.lit(2)), "mean", "n", "decimals").drop("decimals")
