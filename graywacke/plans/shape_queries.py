"""Queries of tables brought into shape and looked over, diaries, and episodes of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import designs, logs, measures, shape
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


@register("prj02_long", "select l_orderkey, l_linenumber, g as \"group\", v::double as value from (select l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) as g, unnest([l_quantity::double, l_discount::double, l_tax::double]) as v from lineitem) where v is not null")
def prj02_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    return shape.long_form(wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@register("prj08_zone", "select event_id, strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M:%S') as local from events")
def prj08_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(shape.in_zone(F.col("ts"), "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss").alias("local"))


ITEMS = ["l_quantity", "l_discount", "l_tax"]


@register("agg04_items", "with x as (select unnest(['l_quantity', 'l_discount', 'l_tax']) as item, unnest([l_quantity::double, l_discount::double, l_tax::double]) as v from lineitem) select item, count(v) as n, count(*) - count(v) as missing, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, min(v) as least, max(v) as most, count(*) filter (v < 0.02 or v > 40) as outside from x group by item")
def agg04_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.item_summary(_table(spark, sf_dir, "lineitem"), ITEMS, 0.02, 40), "mean", "sd")


@register("prj05_subscale", "select l_orderkey, l_linenumber, round((l_discount::double + (0.1 - l_tax::double)) / 2, 9) as score from lineitem")
def prj05_subscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.subscale(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("b")), ["a", "b"], "score", ("b",), 0, 0.1)
    return rows.select("l_orderkey", "l_linenumber", F.round("score", 9).alias("score"))


@register("agg05_coverage", "select user_id, count(*) filter (event_type = 'view') as \"view\", count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase from events group by 1")
def agg05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.coverage_matrix(_table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@register("agg10_two_stage", "with e as (select o_orderpriority as g, o_custkey, avg(o_totalprice) as m, count(*) as k from orders where o_totalprice is not null group by 1, 2) select g as \"group\", count(*) as subjects, round(sum(k) / count(*), 6) as rows_each, round(avg(m), 4) as mean, round(stddev_samp(m), 4) as sd from e group by 1")
def agg10_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.two_stage(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")
    return rows.withColumns({"rows_each": F.round("rows_each", 6), "mean": F.round(F.col("mean").cast("double"), 4), "sd": F.round("sd", 4)})


@register("agg09_enrolment", """with m as (select date_trunc('month', o_orderdate)::date as month, count(*) as n from orders where o_orderdate is not null group by 1), r as (select *, sum(n) over (order by month) as total, date_diff('month', min(month) over (), month) + 1 as spent from m)
    select strftime(month, '%Y-%m') as month, n, total::bigint as total, round(total / spent, 6) as rate, round(greatest(0, (20000 - total) / (total / spent)), 6) as months_left from r""")
def agg09_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(shape.enrolment(_table(spark, sf_dir, "orders"), "o_orderdate", 20000), "rate", "months_left")
    return rows.withColumn("month", F.date_format("month", "yyyy-MM"))


RULES = {"balance": "c_acctbal >= 0", "segment": "c_mktsegment <> 'BUILDING'", "nation": "c_nationkey between 3 and 20"}


@register("prj10_rechecked", """select c_custkey, array_to_string(list_filter([case when not c_acctbal >= 0 then 'balance' end, case when not c_mktsegment <> 'BUILDING' then 'segment' end, case when not c_nationkey between 3 and 20 then 'nation' end], lambda x: x is not null), ';') as violations,
    array_to_string(list_filter([case when c_acctbal is null then 'balance' end, case when c_mktsegment is null then 'segment' end, case when c_nationkey is null then 'nation' end], lambda x: x is not null), ';') as undecidable from customer""")
def prj10_rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.rechecked(_table(spark, sf_dir, "customer"), RULES)
    return rows.select("c_custkey", F.array_join("violations", ";").alias("violations"), F.array_join("undecidable", ";").alias("undecidable"))


@register("agg07_flow", """with n as (select count(*) as a, count(*) filter (c_acctbal >= 0) as b, count(*) filter (c_acctbal >= 0 and c_mktsegment <> 'BUILDING') as c, count(*) filter (c_acctbal >= 0 and c_mktsegment <> 'BUILDING' and c_nationkey between 3 and 20) as d from customer)
    select 1 as stage_no, 'balance' as stage, b as n, a - b as lost from n union all select 2, 'segment', c, b - c from n union all select 3, 'nation', d, c - d from n""")
def agg07_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.flow(_table(spark, sf_dir, "customer"), RULES)


@register("agg08_per_protocol", """with r as (select l_orderkey as subject, case when l_returnflag = 'R' then 'returned' when l_tax > 0.06 then 'taxed' end as reason from lineitem) select subject, string_agg(distinct reason, '; ' order by reason) as reasons from r where reason is not null group by 1""")
def agg08_per_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("case when l_returnflag = 'R' then 'returned' when l_tax > 0.06 then 'taxed' end").alias("reason"))
    return shape.per_protocol(rows, "l_orderkey", "reason")


@register("topk_brands", "with c as (select p_type as maker, p_brand as brand, count(*) as n from part group by 1, 2), r as (select *, row_number() over (partition by maker order by n desc, brand) as k from c) select maker, brand, n from r where k <= 2")
def topk_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("maker"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return shape.top(counts, "n", 2, "maker", "brand")


@register("agg11_trend", "with y as (select o_orderpriority as topic, year(o_orderdate)::double as year, count(*) as k from orders group by 1, 2) select topic, sum(k)::bigint as n, count(*) as years, round(regr_slope(k, year), 6) as slope from y group by 1")
def agg11_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"))
    return _rounded(shape.yearly_trend(rows, "o_orderpriority", "year"), "slope")


@register("lg01_diary", """with n as (select event_id, 1260 + event_id % 300 as bed, event_id % 50 as asleep, event_id % 70 as awake, event_id % 97 as w from events), m as (select event_id, bed % 1440 as bed, asleep, awake, (bed + 420 + w) % 1440 as wake, (bed + 440 + w) % 1440 as rise, w from n)
    select event_id, (440 + w)::int as tib, (420 + w - asleep - awake)::int as tst, round(100.0 * (420 + w - asleep - awake) / (440 + w), 6) as se, (bed + asleep + (420 + w - asleep) / 2.0) % 1440 as mid_sleep from m""")
def lg01_diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "cast((1260 + event_id % 300) % 1440 as int) as bed", "cast(event_id % 50 as int) as asleep", "cast(event_id % 70 as int) as awake", "cast((1260 + event_id % 300 + 420 + event_id % 97) % 1440 as int) as wake", "cast((1260 + event_id % 300 + 440 + event_id % 97) % 1440 as int) as rise")
    return shape.diary(rows, "bed", "asleep", "awake", "wake", "rise").select("event_id", "tib", "tst", F.round("se", 6).alias("se"), F.col("mid_sleep").cast("double").alias("mid_sleep"))


@register("lg08_episodes", """with e as (select user_id, ts from events where value >= 60), f as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1800 second then 0 else 1 end as fresh from e), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from f),
    r as (select user_id, k, count(*) as n from s group by 1, 2) select user_id, count(*) as episodes, sum(n)::bigint as rows_above from r group by 1""")
def lg08_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.episodes(_table(spark, sf_dir, "events"), 60.0, "user_id", "ts", "value")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n_events").alias("rows_above"))


@register("lg10_overlap", "select l_orderkey, l_linenumber, 86400.0::double * greatest(0, least(l_quantity::int, 12) - l_linenumber) as seconds from lineitem where l_shipdate is not null and l_quantity is not null")
def lg10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").filter("l_shipdate is not null and l_quantity is not null").withColumn("t", F.col("l_shipdate").cast("timestamp"))
    rows = rows.selectExpr("l_orderkey", "l_linenumber", "t as a0", "t + make_dt_interval(cast(l_quantity as int)) as a1", "t + make_dt_interval(l_linenumber) as b0", "t + make_dt_interval(12) as b1")
    return rows.select("l_orderkey", "l_linenumber", logs.overlap_seconds("a0", "a1", "b0", "b1").cast("double").alias("seconds"))


@register("st38_responders", "with w as (select user_id as s, date_trunc('week', ts)::date as t, avg(value) as x from events where value is not null group by 1, 2), c as (select s % 2 as arm, x - first_value(x) over (partition by s order by t) as change from w) select arm, count(*) as n, count(*) filter (change >= 5) as responders, round(count(*) filter (change >= 5) / count(*), 6) as share from c group by 1")
def st38_responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _table(spark, sf_dir, "events").filter("value is not null").groupBy(F.col("user_id").alias("s"), F.to_date(F.date_trunc("week", "ts")).alias("t")).agg(F.avg("value").alias("x"))
    changes = designs.change_from_baseline(weeks, "s", "t", "x").withColumn("arm", F.expr("s % 2"))
    return _rounded(designs.responders(changes, "arm", "change", 5.0), "share")


@register("prj04_reversed", "select l_orderkey, l_linenumber, round(0.1 - l_discount::double, 9) as l_discount from lineitem")
def prj04_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("l_discount"))
    return measures.reverse_scored(rows, ["l_discount"], 0.0, 0.1).select("l_orderkey", "l_linenumber", F.round("l_discount", 9).alias("l_discount"))


@register("snk06_forest", """with s as (select c_nationkey as study, avg(c_acctbal) as y, sqrt(var_samp(c_acctbal) / count(*)) as e from customer where c_acctbal is not null group by 1 having count(*) > 1), b as (select *, y - 2 * e as l, y + 2 * e as h, min(y - 2 * e) over () as lo, max(y + 2 * e) over () as hi from s),
    p as (select study, round((l - lo) / (hi - lo) * 40)::int as l, round((y - lo) / (hi - lo) * 40)::int as y, round((h - lo) / (hi - lo) * 40)::int as h from b)
    select study as name, array_to_string(list_transform(range(41), lambda i: case when i = y then '*' when i = l then '<' when i = h then '>' when i between l and h then '-' else ' ' end), '') as plot from p""")
def snk06_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _table(spark, sf_dir, "customer").filter("c_acctbal is not null").groupBy(F.col("c_nationkey").alias("study")).agg(F.avg("c_acctbal").alias("y"), F.expr("sqrt(var_samp(c_acctbal) / count(*))").alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return shape.forest_plot(each.selectExpr("study", "y - 2 * e as l", "y", "y + 2 * e as h"), "study", "l", "y", "h")
