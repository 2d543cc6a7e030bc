"""Queries of beat-to-beat series: each user's or type's values in the order of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import heartbeat, signals
from graywacke.plans.registry import register
from graywacke.plans.signal_queries import LENGTH, SPECTRUM

HOURS = "(epoch_us(ts) - 1704067200000000) / 3600000000.0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with i, their number among the user's, and h, hours since 2024 began."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("*", "row_number() over (partition by user_id order by ts, event_id) - 1 as i", "(unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3600000000.0 as h")


@register("prj19_stretches", """with d as (select user_id as series, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as d from events)
    select series, count(*) as n, count(*) filter (d > 7200000000) as n_gaps, coalesce(sum(d) filter (d <= 7200000000), 0)::double as observed, coalesce(sum(d) filter (d > 7200000000), 0)::double as discarded from d group by 1""")
def prj19_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeat.stretches(_events(spark, sf_dir).withColumn("t", F.expr("unix_micros(cast(ts as timestamp))")), "user_id", "t", 7200e6)


@register("prj14_ectopic", """with x as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x from events),
    m as (select *, median(x) over (partition by series order by i rows between 5 preceding and 5 following) as m from x), j as (select *, abs(x - m) > 0.6 * m as ectopic from m), g as (select *, case when not ectopic then i end as gi, case when not ectopic then x end as gx from j),
    n as (select *, last_value(gi ignore nulls) over a as ai, last_value(gx ignore nulls) over a as ax, first_value(gi ignore nulls) over b as bi, first_value(gx ignore nulls) over b as bx from g
          window a as (partition by series order by i rows between 10 preceding and 1 preceding), b as (partition by series order by i rows between 1 following and 10 following))
    select series, i::bigint as i, x, ectopic, round(case when not ectopic then x else coalesce(ax + (bx - ax) * (i - ai) / (bi - ai), ax, bx) end, 6) as corrected from n""")
def prj14_ectopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heartbeat.without_ectopic(_events(spark, sf_dir), "user_id", "i", "value", 0.6, block=16)
    return found.withColumns({"i": F.col("i").cast("long"), "corrected": F.round("corrected", 6)})


@register("sg06_lf_hf", f"""with e as (select event_type as series, {HOURS} as t, value as x from events), d as (select *, lead(t) over w as t2, lead(x) over w as x2 from e window w as (partition by series order by t, x)),
    g as (select series, t, t2, x, x2, unnest(range(ceil(t * 4)::bigint, ceil(t2 * 4)::bigint)) as k from d where t2 - t <= 5), v as (select series, k, x + (x2 - x) * (k / 4.0 - t) / (t2 - t) as x from g),
    s as (select series, k, x, unnest([k // 32, k // 32 - 1]) as segment from v), c as (select series, segment, k - segment * 32 as j, x - avg(x) over w as y, count(x) over w as n from s where segment >= 0 and k < segment * 32 + 64 window w as (partition by series, segment)),
    h as (select series, segment, j, y * (0.5 - 0.5 * cos(2 * pi() * j / 64)) as y from c where n = 64), f as (select series, segment, bin, sum(y * cos(2 * pi() * j * bin / 64)) as re, sum(y * sin(2 * pi() * j * bin / 64)) as im from h, range(1, 32) as b(bin) group by all),
    p as (select series, bin * 4 / 64.0 as frequency, avg((re * re + im * im) * 2 / (4 * 24)) as power from f group by all), b as (select series, sum(power) filter (frequency >= 0.04 and frequency < 0.15) / 16 as lf, sum(power) filter (frequency >= 0.15 and frequency < 0.4) / 16 as hf from p group by 1)
    select series, round(lf, 4) as lf, round(hf, 4) as hf, round(lf / hf, 6) as lf_hf from b""")
def sg06_lf_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heartbeat.lf_hf(_events(spark, sf_dir), "event_type", "h", "value", 4.0, 64, 5.0, 24.0)
    return found.select("series", F.round("lf", 4).alias("lf"), F.round("hf", 4).alias("hf"), F.round("lf_hf", 6).alias("lf_hf"))


@register("sg08_sample_entropy", """with x as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) as i, value as x from events), t as (select series, i, x as x0, lead(x) over w as x1, lead(x, 2) over w as x2 from x window w as (partition by series order by i)),
    r as (select series, count(x) as n, 0.2 * stddev_samp(x) as r from x group by 1), p as (select series, count(*) as b, count(*) filter (abs(a.x2 - b.x2) <= r) as a from t a join t b using (series) join r using (series) where a.i < b.i and a.x2 is not null and b.x2 is not null and abs(a.x0 - b.x0) <= r and abs(a.x1 - b.x1) <= r group by 1)
    select series, n, round(r, 6) as r, coalesce(b, 0)::bigint as b, coalesce(a, 0)::bigint as a, round(case when a > 0 then -ln(a / b) end, 6) as entropy from r left join p using (series)""")
def sg08_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heartbeat.sample_entropy(_events(spark, sf_dir), "user_id", "i", "value", block=16)
    return found.select("series", "n", F.round("r", 6).alias("r"), "b", "a", F.round("entropy", 6).alias("entropy"))


EPOCHS = SPECTRUM.replace("select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x from events", "select user_id * 100000 + k // 32 as series, k % 32 as i, value as x from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events)")


@register("agg14_epochs", f"""{EPOCHS}, b as (select series // 100000 as s, series, case when frequency < 0.15 then 'low' else 'high' end as band, sum(power) / {LENGTH} as absolute from p where frequency >= 0.04 and frequency < 0.4 group by all),
    q as (select *, absolute / sum(absolute) over (partition by series) as relative from b)
    select s as series, band, count(*) as n, round(avg(absolute), 4) as mean, round(stddev_samp(absolute), 4) as sd, round(min(absolute), 4) as low, round(max(absolute), 4) as high, round(avg(relative), 6) as relative from q group by all""")
def agg14_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = heartbeat.epochs(_events(spark, sf_dir), "user_id", "i", "value", 1.0, 32, LENGTH, {"low": (0.04, 0.15), "high": (0.15, 0.4)})
    return heartbeat.epoch_summary(each).withColumns({c: F.round(c, 6 if c == "relative" else 4) for c in ("mean", "sd", "low", "high", "relative")})


@register("sg04_slowing", f"{SPECTRUM} select series, round(sum(power) filter (frequency >= 0.04 and frequency < 0.15) / sum(power) filter (frequency >= 0.15 and frequency < 0.4), 6) as slowing from p group by 1")
def sg04_slowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    powers = signals.band_powers(signals.welch(_events(spark, sf_dir), "user_id", "i", "value", 1.0, LENGTH), {"low": (0.04, 0.15), "high": (0.15, 0.4)})
    return heartbeat.slowing(powers, ("low",), ("high",)).withColumn("slowing", F.round("slowing", 6))
