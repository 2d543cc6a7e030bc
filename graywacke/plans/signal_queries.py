"""Queries of spectra, factor analysis, normality and streaming operators on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import normality, scales, signals
from graywacke.plans.registry import register
from graywacke.streaming import sessions as streams

LENGTH = 16
#: Each user's values in the order of their events as a series, one a second; spectra by the definition of the transform.
SPECTRUM = f"""with x as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x from events),
    s as (select series, i, x, unnest([i // 8, i // 8 - 1]) as segment from x),
    c as (select series, segment, i - segment * 8 as j, x - avg(x) over w as y, count(x) over w as n from s where segment >= 0 and i < segment * 8 + {LENGTH} window w as (partition by series, segment)),
    v as (select series, segment, j, y * (0.5 - 0.5 * cos(2 * pi() * j / {LENGTH})) as y from c where n = {LENGTH}),
    f as (select series, segment, bin, sum(y * cos(2 * pi() * j * bin / {LENGTH})) as re, sum(y * sin(2 * pi() * j * bin / {LENGTH})) as im from v, range(9) as b(bin) group by all),
    p as (select series, bin, bin / {LENGTH}.0 as frequency, avg((re * re + im * im) * case when bin in (0, 8) then 1 else 2 end / 6.0) as power from f group by all)"""


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    numbered = events.withColumn("i", F.expr("row_number() over (partition by user_id order by ts, event_id) - 1"))
    return signals.welch(numbered, "user_id", "i", "value", 1.0, LENGTH)


@register("sg01_welch", f"{SPECTRUM} select series, bin, round(frequency, 6) as frequency, round(power, 4) as power from p where bin > 0")
def sg01_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).filter("bin > 0").select("series", F.col("bin").cast("long").alias("bin"), F.round("frequency", 6).alias("frequency"), F.round("power", 4).alias("power"))


@register("sg02_band_powers", f"""{SPECTRUM}, b as (select series, case when frequency < 0.15 then 'low' else 'high' end as band, sum(power) / {LENGTH} as absolute from p where frequency >= 0.04 and frequency < 0.4 group by all)
    select series, band, round(absolute, 4) as absolute, round(absolute / sum(absolute) over (partition by series), 6) as relative from b""")
def sg02_band_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    powers = signals.band_powers(_spectrum(spark, sf_dir), {"low": (0.04, 0.15), "high": (0.15, 0.4)})
    return powers.select("series", "band", F.round("absolute", 4).alias("absolute"), F.round("relative", 6).alias("relative"))


@register("sg04_edges", f"""{SPECTRUM}, r as (select *, sum(power) over (partition by series order by bin) as run, sum(power) over (partition by series) as total from p where bin > 0)
    select series, min(frequency) filter (run >= 0.95 * total) as edge, arg_max(frequency, power) as peak from r group by 1""")
def sg04_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.edges(_spectrum(spark, sf_dir))


@register("st90_suitability", """with c as (select count(*) as n, corr(l_quantity, l_extendedprice) as a, corr(l_quantity, l_tax) as b, corr(l_extendedprice, l_tax) as c from lineitem
    where l_quantity is not null and l_extendedprice is not null and l_tax is not null),
    k as (select *, a * a + b * b + c * c as plain, (a - b * c) ** 2 / ((1 - b * b) * (1 - c * c)) + (b - a * c) ** 2 / ((1 - a * a) * (1 - c * c)) + (c - a * b) ** 2 / ((1 - a * a) * (1 - b * b)) as rest from c)
    select n, round(plain / (plain + rest), 6) as kmo, round(-(n - 1 - 11 / 6.0) * ln(1 + 2 * a * b * c - a * a - b * b - c * c), 3) as chi2, 3 as df from k""")
def st90_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scales.suitability(*scales.correlation_matrix(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_tax"]))
    return spark.createDataFrame([(found.n, round(found.kmo, 6), round(found.chi2, 3), found.df)], "n long, kmo double, chi2 double, df int")


@register("st92_loadings")
def st92_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    n, r = scales.correlation_matrix(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), items)
    found, common = scales.loadings(r, 2)
    return spark.createDataFrame([(item, *map(float, row), float(h)) for item, row, h in zip(items, found, common)], "item string, factor_1 double, factor_2 double, communality double")


@register("st01_shapiro_wilk")
def st01_shapiro_wilk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normality.by_group(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_mktsegment")


@register("stream02_totals", """select time_bucket(interval 1 hour, ts) as began, event_type as kind, count(*) as n_events, round(sum(value), 4) as total from events group by 1, 2""")
def stream02_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.totals(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.withColumns({"began": F.col("began").cast("timestamp_ntz"), "total": F.round("total", 4)})
