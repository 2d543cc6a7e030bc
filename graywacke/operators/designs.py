"""Repeated measures, mediation and sample sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graywacke.functions.special import noncentral_t_upper, p_f, t_quantile


def repeated_anova(long: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """One-way repeated-measures ANOVA of subjects with every time: F, degrees of freedom, partial eta squared and p."""
    x = long.select(F.col(subject).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("x")).dropna().groupBy("s", "t").agg(F.avg("x").alias("x"))
    times = x.agg(F.count_distinct("t").alias("k"))
    whole = x.join(x.groupBy("s").agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(times), F.col("have") == F.col("k"), "left_semi"), "s", "left_semi")
    c = whole.crossJoin(F.broadcast(whole.agg(F.avg("x").alias("g")))).withColumn("y", F.expr("x - g"))
    by_s = c.groupBy("s").agg(F.avg("y").alias("m")).agg(F.sum(F.expr("m * m")).alias("q_s"), F.count(F.lit(1)).alias("n"))
    by_t = c.groupBy("t").agg(F.avg("y").alias("m")).agg(F.sum(F.expr("m * m")).alias("q_t"), F.count(F.lit(1)).alias("k"))
    m = c.agg(F.sum(F.expr("y * y")).alias("ss")).crossJoin(F.broadcast(by_s)).crossJoin(F.broadcast(by_t)).selectExpr("n", "k", "n * q_t as ss_t", "ss - n * q_t - k * q_s as ss_e")
    m = m.selectExpr("n", "k", "ss_t / nullif(k - 1, 0) / nullif(ss_e / nullif((n - 1) * (k - 1), 0), 0) as f", "cast(k - 1 as double) as df_time", "cast((n - 1) * (k - 1) as double) as df_error", "ss_t / nullif(ss_t + ss_e, 0) as partial_eta_squared")
    return m.withColumn("p", p_f("f", "df_time", "df_error"))


def change_from_baseline(long: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """long with baseline (the value at the first time) and change."""
    first = F.first_value(value).over(Window.partitionBy(subject).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return long.withColumn("baseline", first).withColumn("change", F.col(value) - F.col("baseline"))


def carried(long: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """long with locf (the last known value so far) and bocf (the value, else the subject's first)."""
    w = Window.partitionBy(subject).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumns({"locf": F.last(value, ignorenulls=True).over(so_far), "bocf": F.coalesce(F.col(value), F.first(value).over(so_far))})


def responders(long: DataFrame, group: str, change: str, least: float) -> DataFrame:
    """By group: how many changed by at least the smallest change that matters."""
    return long.filter(F.col(change).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(change) >= least).alias("responders")).withColumn("share", F.col("responders") / F.col("n"))


def mediation(df: DataFrame, x: str, m: str, y: str) -> DataFrame:
    """a (m on x), b (y on m given x), direct, total and indirect effect a * b, from one pass of centred cross-products."""
    r = df.select(*[F.col(c).cast("double").alias(k) for c, k in ((x, "x"), (m, "m"), (y, "y"))]).dropna()
    s = r.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(p, q).alias(f"{p}{q}") for p, q in ("xx", "xm", "xy", "mm", "my")])
    s = s.selectExpr("n", "xm / nullif(xx, 0) as a", "(my * xx - xy * xm) / nullif(mm * xx - xm * xm, 0) as b", "(xy * mm - my * xm) / nullif(mm * xx - xm * xm, 0) as direct", "xy / nullif(xx, 0) as total")
    return s.withColumn("indirect", F.expr("a * b"))


def bootstrap_indirect(df: DataFrame, key: str, x: str, m: str, y: str, repeats: int, seed: int) -> DataFrame:
    """(rep, indirect): each row counts in a repeat as often as a Poisson(1) draw from the hash of seed, repeat and key says, so
    that the draws are the same however rows are dealt."""
    r = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(k) for c, k in ((x, "x"), (m, "m"), (y, "y"))]).dropna()
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col("key").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    # The cumulated Poisson(1) probabilities of 0 to 6.
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col("u") >= cuts[0], 1).otherwise(0))
    drawn = r.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("u", u).withColumn("w", weight).filter("w > 0")
    products = drawn.groupBy("rep").agg(F.sum("w").alias("n"), *[F.sum(F.expr("*".join(["w", *p]))).alias("s" + "".join(p)) for p in ("x", "m", "y", "xx", "xm", "xy", "mm", "my")])
    c = lambda p, q: f"(s{p}{q} - s{p} * s{q} / n)"
    return products.selectExpr("rep", f"{c('x', 'm')} / nullif({c('x', 'x')}, 0) * ({c('m', 'y')} * {c('x', 'x')} - {c('x', 'y')} * {c('x', 'm')}) / nullif({c('m', 'm')} * {c('x', 'x')} - {c('x', 'm')} * {c('x', 'm')}, 0) as indirect")


def t_test_power(n: int, d: float, alpha: float = 0.05) -> float:
    """Power of a two-sided two-sample t test with n in each group (the far tail left out)."""
    df = 2 * n - 2
    return noncentral_t_upper(t_quantile(1 - alpha / 2, df), df, d * (n / 2) ** 0.5)


def sample_sizes(spark: SparkSession, designs: list[tuple[float, float, float, float]]) -> DataFrame:
    """For designs (d, power, alpha, dropout): n_analysed and n_recruited in each group."""
    grid = spark.createDataFrame(designs, "d double, power double, alpha double, dropout double")

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                low, high = 2, 4
                while t_test_power(high, r.d, r.alpha) < r.power:
                    low, high = high, high * 2
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if t_test_power(mid, r.d, r.alpha) >= r.power else (mid + 1, high)
                out.append((*r, low, int(-(-low // (1 - r.dropout)))))
            yield pd.DataFrame(out, columns=["d", "power", "alpha", "dropout", "n_analysed", "n_recruited"])

    return grid.mapInPandas(solve, "d double, power double, alpha double, dropout double, n_analysed long, n_recruited long")
