"""Group comparison: tests, effect sizes and corrections, from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywacke.functions.special import p_chi2, p_f, p_t, p_z
from graywacke.operators.ranks import mid_rank, value_ranks


def _clean(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(F.col(group).alias("g"), v.alias("v")).filter(F.col("g").isNotNull() & v.isNotNull() & ~F.isnan(v))


def summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean, SD, median and quartiles by group."""
    return _clean(df, value, group).groupBy(F.col("g").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.75)).alias("q3"),
    )


def two_sample(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Student's and Welch's t of group a against b, Hedges' g and the standardised mean difference, with two-sided p."""
    side = lambda k, f: f(F.when(F.col("g") == k, F.col("v")))
    m = _clean(df, value, group).agg(*[side(k, f).alias(f"{n}_{s}") for k, s in ((a, "a"), (b, "b")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    m = m.withColumns({"df_student": F.expr("n_a + n_b - 2"), "pooled": F.expr("((n_a - 1) * v_a + (n_b - 1) * v_b) / nullif(n_a + n_b - 2, 0)"), "se2": F.expr("v_a / nullif(n_a, 0) + v_b / nullif(n_b, 0)")})
    m = m.withColumns({
        "t_student": F.expr("(m_a - m_b) / nullif(sqrt(pooled * (1 / n_a + 1 / n_b)), 0)"), "t_welch": F.expr("(m_a - m_b) / nullif(sqrt(se2), 0)"),
        "df_welch": F.expr("se2 * se2 / nullif(pow(v_a / n_a, 2) / nullif(n_a - 1, 0) + pow(v_b / n_b, 2) / nullif(n_b - 1, 0), 0)"),
        "hedges_g": F.expr("(m_a - m_b) / nullif(sqrt(pooled), 0) * (1 - 3 / (4 * (n_a + n_b) - 9))"), "smd": F.expr("(m_a - m_b) / nullif(sqrt((v_a + v_b) / 2), 0)"),
    })
    return m.withColumns({"p_student": p_t("t_student", F.col("df_student").cast("double")), "p_welch": p_t("t_welch", "df_welch")}).drop("pooled", "se2")


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """U of group a, the tie-corrected z with continuity, its p and the rank-biserial correlation."""
    rows = _clean(df, value, group).filter(F.col("g").isin(a, b))
    ranked = value_ranks(rows, "v").withColumn("rank", mid_rank())
    sides = rows.groupBy("v").agg(F.count(F.when(F.col("g") == a, 1)).alias("k"), F.count(F.lit(1)).alias("t")).join(ranked, "v")
    m = sides.agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("n_a"), F.sum(F.col("t") - F.col("k")).alias("n_b"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties_sum"))
    m = m.withColumn("u", F.expr("r - n_a * (n_a + 1) / 2")).withColumn("n", F.expr("n_a + n_b"))
    m = m.withColumn("sigma", F.expr("sqrt(cast(n_a as double) * n_b / 12 * (n + 1 - ties_sum / nullif(cast(n as double) * (n - 1), 0)))"))
    m = m.withColumn("z", F.expr("sign(u - n_a * n_b / 2) * greatest(0, abs(u - n_a * n_b / 2) - 0.5) / nullif(sigma, 0)"))
    return m.select("n_a", "n_b", "u", "z", F.expr("2 * u / nullif(cast(n_a as double) * n_b, 0) - 1").alias("rank_biserial"), p_z("z").alias("p"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way ANOVA: F, its degrees of freedom, eta squared and p. Sums are taken about the grand mean of group means, so
    that large values don't cancel."""
    each = _clean(df, value, group).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("v"))
    centred = each.crossJoin(F.broadcast(each.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))))
    m = centred.agg(F.sum(F.expr("n * pow(m - grand, 2)")).alias("between"), F.sum(F.expr("n * v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    m = m.selectExpr("between / nullif(k - 1, 0) / nullif(within / nullif(n - k, 0), 0) as f", "cast(k - 1 as double) as df_between", "cast(n - k as double) as df_within", "between / nullif(between + within, 0) as eta_squared")
    return m.withColumn("p", p_f("f", "df_between", "df_within"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's test about the medians (Brown and Forsythe): an ANOVA of absolute deviations."""
    rows = _clean(df, value, group)
    middle = rows.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("middle"))
    return anova(rows.join(middle, "g").select("g", F.abs(F.col("v") - F.col("middle")).alias("d")), "d", "g")


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with the correction for ties, its degrees of freedom and p."""
    rows = _clean(df, value, group)
    ranked = value_ranks(rows, "v").withColumn("rank", mid_rank())
    each = rows.groupBy("v", "g").agg(F.count(F.lit(1)).alias("k")).join(ranked, "v")
    ties = ranked.agg(F.sum(F.expr("cast(ties as double) * ties * ties - ties")).alias("ties_sum"), F.sum("ties").alias("n"))
    m = each.groupBy("g").agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("n_g")).agg(F.sum(F.expr("r * r / n_g")).alias("s"), F.count(F.lit(1)).alias("groups")).crossJoin(F.broadcast(ties))
    m = m.selectExpr("(12 / (cast(n as double) * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - ties_sum / (cast(n as double) * n * n - n), 0) as h", "cast(groups - 1 as double) as df")
    return m.withColumn("p", p_chi2("h", "df"))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with p_holm. Few rows: the tests of one family."""
    order = Window.orderBy(F.col(p), *[c for c in tests.columns if c != p])
    step = tests.filter(F.col(p).isNotNull()).withColumn("step", F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1))
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t of a - b, and Wilcoxon's signed ranks (zeros left out): W+, W- and z."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).filter("d is not null and not isnan(d)")
    t = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d")).withColumn("t", F.expr("mean_d / nullif(sd_d / sqrt(n), 0)"))
    rows = d.filter("d <> 0").select("d", F.abs("d").alias("size"))
    ranked = value_ranks(rows, "size").withColumn("rank", mid_rank())
    each = rows.groupBy("size").agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.lit(1)).alias("all")).join(ranked, "size")
    w = each.agg(F.coalesce(F.sum(F.expr("up * rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.expr("(all - up) * rank")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum("all"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.expr("cast(all as double) * all * all - all")), F.lit(0.0)).alias("ties_sum"))
    both = t.crossJoin(F.broadcast(w)).withColumn("z", F.expr("(w_plus - cast(m as double) * (m + 1) / 4) / nullif(sqrt(cast(m as double) * (m + 1) * (2 * m + 1) / 24 - ties_sum / 48), 0)"))
    return both.withColumns({"p_t": p_t("t", (F.col("n") - 1).cast("double")), "p_wilcoxon": p_z("z")}).drop("ties_sum")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r and Spearman's rho, the latter of mid-ranks."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rx, ry = (value_ranks(rows, c).select(c, mid_rank().alias(f"r{c}")) for c in ("x", "y"))
    return rows.join(rx, "x").join(ry, "y").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
