"""Queries of reported statistics: lines that the tables at hand give, written out as a paper would and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import documents, reported
from graywacke.plans import integrals
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For each group of parts: a statistic in hundredths, degrees of freedom and a p in hundredths, some right and most wrong.
CLAIMED = "select p_size as doc_id, count(*) as df, (sum(p_partkey) % 700) / 100.0 as v, (sum(p_partkey) % 23) as p from part group by 1"
KINDS = ("t", "F", "χ²", "z", "r")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one test each: of a kind by the group's number."""
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("doc_id")).agg(F.count(F.lit(1)).alias("df"), F.expr("sum(p_partkey) % 700").alias("v"), F.expr("sum(p_partkey) % 23").alias("p"))
    value, p, df = F.format_string("%.2f", F.col("v") / 100.0), F.format_string("0.%02d", "p"), F.col("df").cast("string")
    r = F.format_string("%.2f", F.expr("(v - 350) / 300.0D"))
    k = F.expr("doc_id % 5")
    text = F.when(k == 0, F.concat(F.lit("Groups differed, t("), df, F.lit(") = "), value)).when(k == 1, F.concat(F.lit("Overall F(2, "), df, F.lit(") = "), value)).when(k == 2, F.concat(F.lit("Counts: χ²(3) = "), value)).when(k == 3, F.concat(F.lit("(one-sided) z = "), value)).otherwise(F.concat(F.lit("r("), df, F.lit(") = "), r))
    return documents.lines(rows.select("doc_id", F.concat(F.lit("Results.\n"), text, F.lit(", p = "), p, F.lit(".")).alias("text")), "doc_id", "text")


def _tests_sql() -> str:
    ends = []
    for end in ("v_low", "v_high"):
        t_of_r = f"({end} * sqrt(df / (1 - {end} * {end})))"
        ends.append("case k when 0 then {} when 1 then {} when 2 then {} when 3 then {} else {} end".format(integrals.p_t(end, "df"), integrals.p_f(end, "2.0", "df"), integrals.p_chi2(end, "3.0"), integrals.p_z(end), integrals.p_t(t_of_r, "df")))
    return f"""with g as ({CLAIMED}), c as (select doc_id, doc_id % 5 as k, df::double as df, case when doc_id % 5 = 4 then round((v * 100 - 350) / 300.0, 2)::double else v::double end as v, p / 100.0 as written from g),
        e as (select *, greatest(0.0, abs(v) - 0.005) as v_low, case when k = 4 then least(1 - 1e-12, abs(v) + 0.005) else abs(v) + 0.005 end as v_high from c), q as (select *, {ends[0]} as p_high, {ends[1]} as p_low from e where not (k = 4 and abs(v) > 1)),
        s as (select *, p_low < written + 0.01 and p_high > written - 0.01 as fits, case when written < 0.05 then p_low >= 0.05 else p_high < 0.05 end as flips from q)
        select doc_id, case k when 0 then 't' when 1 then 'F' when 2 then 'chi2' when 3 then 'z' else 'r' end as kind, v as value, written::double as written, round(p_low, 7) as p_low, round(p_high, 7) as p_high,
               case when fits then 'consistent' when flips then 'contradiction' else 'inconsistent' end as status, case when not fits then case when k = 3 or not flips then 'warning' else 'fatal' end end as severity from s
        union all select doc_id, 'r', v, written::double, null, null, 'impossible', 'fatal' from e where k = 4 and abs(v) > 1"""


@register("tx03_reported_tests", _tests_sql())
def tx03_reported_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reported.tests(_written(spark, sf_dir))
    ends = [F.when(F.col("status") != "impossible", F.round(c, 7)).alias(c) for c in ("p_low", "p_high")]
    return rows.select("doc_id", "kind", "value", "written", *ends, "status", "severity")


@register("agg13_recomputed", "select count(*) as candidates, count(*) as recomputed, 0::bigint as skipped, count(*) < 5 as undecidable from (select distinct p_size from part)")
def agg13_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported.coverage(reported.tests(_written(spark, sf_dir)))


@register("tx06_intervals", """with g as (select p_size as doc_id, (sum(p_partkey) % 300 - 150) / 10.0 as e, (count(*) % 70) / 10.0 as w, (sum(p_partkey) % 11) / 100.0 as p from part group by 1)
    select doc_id, 1 as line_no, e::double as estimate, round(e - w, 1)::double as low, round(e + w - 2, 1)::double + 0.0 as high, p::double as written, e between e - w and e + w - 2 as inside, (p < 0.05) = (0 not between round(least(e - w, e + w - 2), 1) and round(greatest(e - w, e + w - 2), 1)) as agrees from g""")
def tx06_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("doc_id")).agg(F.expr("sum(p_partkey) % 300 - 150").alias("e"), F.expr("count(*) % 70").alias("w"), F.expr("sum(p_partkey) % 11").alias("p"))
    tenth = lambda c: F.format_string("%.1f", F.expr(c) / 10.0)
    text = F.concat(F.lit("The effect was "), tenth("e"), F.lit(" (95% CI "), tenth("e - w"), F.lit(" to "), tenth("e + w - 20"), F.lit("), p = "), F.format_string("0.%02d", "p"), F.lit("."))
    return reported.intervals(documents.lines(rows.select("doc_id", text.alias("text")), "doc_id", "text"))


@register("tx07_wording", """with g as (select p_size as doc_id, (sum(p_partkey) % 11) / 100.0 as p from part group by 1)
    select doc_id, 1 as line_no, p::double as written, case when doc_id % 2 = 0 then 'called significant' else 'called not significant' end as claim from g where (doc_id % 2 = 0) = (p >= 0.05)""")
def tx07_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("doc_id")).agg(F.expr("sum(p_partkey) % 11").alias("p"))
    text = F.concat(F.lit("We looked. The change was "), F.when(F.expr("doc_id % 2 = 0"), "significant").otherwise("not significant"), F.lit(" (p = "), F.format_string("0.%02d", "p"), F.lit("). More follows."))
    return reported.wording(documents.lines(rows.select("doc_id", text.alias("text")), "doc_id", "text"))


@register("tx05_changes", """with g as (select p_size as doc_id, count(*) % 90 as a, sum(p_partkey) % 90 as b from part group by 1), c as (select *, case doc_id % 3 when 0 then b - a when 1 then a - b else b - a + 7 end as w from g)
    select doc_id, 1 as line_no, a / 10.0 as pre, b / 10.0 as post, w / 10.0 as written, round((b - a) / 10.0, 6)::double as recomputed, case when doc_id % 3 = 0 or abs(b - a - w) <= 1 then 'ok' when abs(b - a + w) <= 1 then 'sign' else 'wrong' end as status from c""")
def tx05_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("doc_id")).agg(F.expr("count(*) % 90").alias("a"), F.expr("sum(p_partkey) % 90").alias("b"))
    rows = rows.withColumn("w", F.expr("case doc_id % 3 when 0 then b - a when 1 then a - b else b - a + 7 end"))
    tenth = lambda c: F.format_string("%.1f", F.col(c) / 10.0)
    text = F.concat(F.lit("Scores fell from "), tenth("a"), F.lit(" to "), tenth("b"), F.lit(" (change "), tenth("w"), F.lit(")."))
    return reported.changes(documents.lines(rows.select("doc_id", text.alias("text")), "doc_id", "text")).withColumn("recomputed", F.round("recomputed", 6))


@register("tx02_ratios", """with g as (select p_brand as doc_id, count(*) filter (p_size <= 20) as part, count(*) as whole from part group by 1), w as (select *, round(100.0 * part / whole, 1) + case when part % 3 = 0 then 1 else 0 end as written, 100.0 * part / whole as re from g)
    select doc_id, 1 as line_no, part::double as part, whole::double as whole, written::double as written, round(re, 6)::double as recomputed, round(written * 10) between floor(re * 10 + 1e-9) and ceil(re * 10 - 1e-9) as ok from w""")
def tx02_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.count_if(F.col("p_size") <= 20).alias("part"), F.count(F.lit(1)).alias("whole"))
    shown = F.format_string("%.1f", F.round(F.expr("100.0D * part / whole"), 1) + F.expr("case when part % 3 = 0 then 1 else 0 end"))
    text = F.concat(F.lit("Small ones: "), F.col("part").cast("string"), F.lit("/"), F.col("whole").cast("string"), F.lit(" ("), shown, F.lit("%)."))
    return documents.ratios(documents.lines(rows.select("doc_id", text.alias("text")), "doc_id", "text")).withColumn("recomputed", F.round("recomputed", 6))


@register("tx04_grimmer", """with c as (select p_size as k, count(*) as n, round(avg(p_partkey % 10), 2) as mean, round(stddev_samp(p_partkey % 10), 2) + case when p_size % 2 = 0 then 0.01 * (p_size % 7) else 0 end as sd from part group by 1),
    s as (select *, unnest(range(floor(n * (mean - 0.02))::bigint, ceil(n * (mean + 0.02))::bigint + 1)) as total from c), w as (select * from s where round(mean * 100) between floor(100.0 * total / n + 1e-9) and ceil(100.0 * total / n - 1e-9)),
    q as (select *, unnest(range(floor((n - 1) * greatest(0, sd - 0.006) ** 2 + total * total / n)::bigint - 1, ceil((n - 1) * (sd + 0.006) ** 2 + total * total / n)::bigint + 2)) as squares from w),
    h as (select distinct k from q where (squares - total) % 2 = 0 and squares * n >= total * total and sqrt(greatest(0, squares - total * total / n) / (n - 1)) between sd - 0.005 - 1e-9 and sd + 0.005 + 1e-9)
    select c.k, n, mean, round(sd, 2) as sd, h.k is not null as possible_sd from c left join h using (k)""")
def tx04_grimmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("p_partkey % 10")
    claims = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_samp(x), 2).alias("sd"))
    claims = claims.withColumns({"sd": F.expr("sd + case when k % 2 = 0 then 0.01D * (k % 7) else 0 end"), "places": F.lit(2)})
    return reported.grimmer(claims, "mean", "sd", "n", "places").drop("places").withColumn("sd", F.round("sd", 2))
