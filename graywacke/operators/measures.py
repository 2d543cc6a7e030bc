"""Agreement of two methods, diagnostic accuracy, pooled effects, reliability of scales, interval series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywacke.functions.special import p_t, p_z
from graywacke.operators.ranks import ranges

#: Standard normal quantile of 0.975.
Z95 = 1.959963984540054


def bland_altman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias, its 95 % limits of agreement, Lin's concordance and the slope of difference on mean."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().withColumns({"d": F.expr("a - b"), "m": F.expr("(a + b) / 2")})
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.expr("regr_slope(d, m)").alias("slope"))
    return m.selectExpr("n", "bias", "sd", "bias - 1.96 * sd as loa_low", "bias + 1.96 * sd as loa_high", "2 * c / nullif(va + vb + pow(ma - mb, 2), 0) as ccc", "slope")


def icc(long: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) and ICC(3,1) of a complete subject by rater table, from its two-way mean squares."""
    x = long.select(F.col(subject).alias("s"), F.col(rater).alias("r"), F.col(value).cast("double").alias("x")).dropna()
    grand = x.agg(F.avg("x").alias("g"), F.count_distinct("s").alias("n"), F.count_distinct("r").alias("k"))
    c = x.crossJoin(F.broadcast(grand)).withColumn("y", F.expr("x - g"))
    rows = c.groupBy("s").agg(F.avg("y").alias("m")).agg(F.sum(F.expr("m * m")).alias("ss_s"))
    cols = c.groupBy("r").agg(F.avg("y").alias("m")).agg(F.sum(F.expr("m * m")).alias("ss_r"))
    m = c.agg(F.sum(F.expr("y * y")).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k")).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))
    m = m.selectExpr("n", "k", "k * ss_s / (n - 1) as ms_s", "n * ss_r / (k - 1) as ms_r", "(ss - k * ss_s - n * ss_r) / ((n - 1) * (k - 1)) as ms_e")
    return m.selectExpr("n", "k", "(ms_s - ms_e) / nullif(ms_s + (k - 1) * ms_e + k * (ms_r - ms_e) / n, 0) as icc_2_1", "(ms_s - ms_e) / nullif(ms_s + (k - 1) * ms_e, 0) as icc_3_1")


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """A row for each threshold (score >= threshold is positive): tp, fp, fn, tn, sensitivity, specificity and Youden's index.

    Scores are counted first; cumulative sums run over ranges of thresholds, with the totals of the ranges above added.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(truth).cast("int").alias("y")).dropna()
    counts = rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    counts = counts.withColumn("part", -ranges(counts, "s"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("q").alias("qq"))
    starts = parts.select("part", F.coalesce(F.sum("pp").over(up), F.lit(0)).alias("p0"), F.coalesce(F.sum("qq").over(up), F.lit(0)).alias("q0"), F.sum("pp").over(Window.partitionBy()).alias("n1"), F.sum("qq").over(Window.partitionBy()).alias("n0"))
    run = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(starts), "part").select(F.col("s").alias("threshold"), (F.sum("p").over(run) + F.col("p0")).alias("tp"), (F.sum("q").over(run) + F.col("q0")).alias("fp"), "n1", "n0", "p", "q")
    rates = placed.selectExpr("threshold", "tp", "fp", "n1 - tp as fn", "n0 - fp as tn", "tp / nullif(n1, 0) as sensitivity", "(n0 - fp) / nullif(n0, 0) as specificity", "p as positives", "q as negatives")
    return rates.withColumn("youden", F.expr("sensitivity + specificity - 1"))


def auc(curve: DataFrame) -> DataFrame:
    """The area under a curve of roc() with DeLong's standard error and 95 % interval, and its best threshold by Youden's index (ties:
    the lowest). A row of the curve knows the step that led to it, so that all is one aggregate."""
    # Placements: how many negatives score below a positive of this threshold, and how many positives above a negative; ties count half.
    n1, n0 = "(tp + fn)", "(fp + tn)"
    v10, v01 = f"(({n0} - fp + negatives / 2) / {n0})", f"((tp - positives / 2) / {n1})"
    m = curve.agg(
        (F.sum(F.expr("negatives * (2 * tp - positives) / 2")) / F.max(F.expr("(tp + fn) * (fp + tn)"))).alias("auc"), F.max(F.expr(n1)).alias("n1"), F.max(F.expr(n0)).alias("n0"),
        F.sum(F.expr(f"positives * {v10} * {v10}")).alias("s1"), F.sum(F.expr(f"negatives * {v01} * {v01}")).alias("s0"), F.max_by("threshold", F.struct(F.round("youden", 9).alias("youden"), -F.col("threshold"))).alias("best_threshold"),
    )
    m = m.withColumn("se", F.expr("sqrt((s1 - n1 * auc * auc) / nullif(n1 - 1, 0) / n1 + (s0 - n0 * auc * auc) / nullif(n0 - 1, 0) / n0)"))
    return m.selectExpr("auc", "se", f"greatest(0, auc - {Z95} * se) as auc_low", f"least(1, auc + {Z95} * se) as auc_high", "best_threshold")


def wilson(part: str, whole: str) -> tuple[str, str]:
    """SQL of the bounds of Wilson's 95 % interval of a proportion."""
    z, z2 = f"{Z95}D", f"{Z95 * Z95}D"
    middle, away = f"({part} + {z2} / 2) / ({whole} + {z2})", f"{z} / ({whole} + {z2}) * sqrt({part} * ({whole} - {part}) / nullif({whole}, 0) + {z2} / 4)"
    return f"{middle} - {away}", f"{middle} + {away}"


def accuracy(curve: DataFrame) -> DataFrame:
    """For each threshold of roc(): predictive values and likelihood ratios, with Wilson's intervals of sensitivity, specificity and predictive values."""
    rows = curve.withColumns({"ppv": F.expr("tp / nullif(tp + fp, 0)"), "npv": F.expr("tn / nullif(tn + fn, 0)"), "lr_plus": F.expr("sensitivity / nullif(1 - specificity, 0)"), "lr_minus": F.expr("(1 - sensitivity) / nullif(specificity, 0)")})
    for name, part, whole in (("sensitivity", "tp", "(tp + fn)"), ("specificity", "tn", "(fp + tn)"), ("ppv", "tp", "(tp + fp)"), ("npv", "tn", "(tn + fn)")):
        low, high = wilson(part, whole)
        rows = rows.withColumns({f"{name}_low": F.when(F.expr(f"{whole} > 0"), F.expr(low)), f"{name}_high": F.when(F.expr(f"{whole} > 0"), F.expr(high))})
    return rows.drop("positives", "negatives", "youden")


def pooled(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """Fixed effect, and random effects by DerSimonian and Laird: estimates, standard errors, Q, I squared and tau squared."""
    s = studies.select(F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v")).dropna().filter("v > 0").withColumn("w", F.expr("1 / v"))
    fixed = s.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.expr("w * w")).alias("sw2"), (F.sum(F.expr("w * y")) / F.sum("w")).alias("fixed"))
    q = s.crossJoin(F.broadcast(fixed)).agg(F.sum(F.expr("w * pow(y - fixed, 2)")).alias("q"), *[F.max(c).alias(c) for c in ("k", "sw", "sw2", "fixed")])
    tau = q.withColumn("tau2", F.expr("greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0))"))
    r = s.crossJoin(F.broadcast(tau)).withColumn("u", F.expr("1 / (v + tau2)"))
    return r.agg((F.sum(F.expr("u * y")) / F.sum("u")).alias("random"), F.sqrt(1 / F.sum("u")).alias("random_se"), *[F.max(c).alias(c) for c in ("k", "q", "tau2", "fixed")], F.sqrt(1 / F.max("sw")).alias("fixed_se")).withColumn("i2", F.expr("greatest(0, (q - (k - 1)) / nullif(q, 0))"))


def leave_one_out(studies: DataFrame, study: str, effect: str, variance: str) -> DataFrame:
    """The fixed effect without each study in turn: totals less the study's own sums, not a copy of the table for each."""
    s = studies.select(F.col(study).alias("study"), F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v")).dropna().filter("v > 0").withColumn("w", F.expr("1 / v"))
    total = s.agg(F.sum("w").alias("sw"), F.sum(F.expr("w * y")).alias("swy"))
    return s.crossJoin(F.broadcast(total)).selectExpr("study", "(swy - w * y) / nullif(sw - w, 0) as without")


def egger(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """Egger's regression of the standardised effect on precision: its intercept and slope."""
    s = studies.selectExpr(f"{effect} / sqrt({variance}) as z", f"1 / sqrt({variance}) as x").dropna()
    return s.agg(F.expr("regr_intercept(z, x)").alias("intercept"), F.expr("regr_slope(z, x)").alias("slope"))


def reliability(answers: DataFrame, items: list[str]) -> DataFrame:
    """item, alpha (of the scale), alpha_without (the item), item_rest (correlation of the item with the sum of the others).

    One pass: variances and covariances of each item with the total; rows with a missing item are left out.
    """
    rows = answers.select(*[F.col(c).cast("double").alias(c) for c in items]).dropna().withColumn("total", sum((F.col(c) for c in items[1:]), F.col(items[0])))
    k = len(items)
    one = rows.agg(F.var_samp("total").alias("vt"), *[F.var_samp(c).alias(f"v_{c}") for c in items], *[F.covar_samp(c, "total").alias(f"c_{c}") for c in items])
    one = one.withColumn("sv", sum((F.col(f"v_{c}") for c in items[1:]), F.col(f"v_{items[0]}")))
    each = F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"v_{c}").alias("v"), F.col(f"c_{c}").alias("c")) for c in items])
    e = one.select("vt", "sv", F.explode(each).alias("e")).select("vt", "sv", "e.*").withColumn("rest", F.expr("vt - 2 * c + v"))
    return e.selectExpr("item", f"{k} / {k - 1} * (1 - sv / nullif(vt, 0)) as alpha", f"{k - 1} / {max(1, k - 2)} * (1 - (sv - v) / nullif(rest, 0)) as alpha_without", "(c - v) / nullif(sqrt(v * rest), 0) as item_rest")


def reverse_scored(answers: DataFrame, items: list[str], low: float, high: float) -> DataFrame:
    return answers.withColumns({c: F.lit(low + high) - F.col(c) for c in items})


def variability(intervals: DataFrame, subject: str, order: str, rr: str) -> DataFrame:
    """SDNN, RMSSD, pNN50, and Poincare's SD1 and SD2 of each subject's intervals in ms."""
    d = intervals.select(F.col(subject).alias("subject"), F.col(rr).cast("double").alias("x"), F.lag(F.col(rr).cast("double")).over(Window.partitionBy(subject).orderBy(order)).alias("before")).filter("x is not null")
    d = d.withColumns({"d": F.expr("x - before"), "s": F.expr("x + before")})
    m = d.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sdnn"), F.sqrt(F.avg(F.expr("d * d"))).alias("rmssd"), F.avg(F.when(F.abs("d") > 50, 1.0).when(F.col("d").isNotNull(), 0.0)).alias("pnn50"), F.var_samp("d").alias("vd"), F.var_samp("s").alias("vs"))
    return m.selectExpr("subject", "n", "sdnn", "rmssd", "pnn50", "sqrt(vd / 2) as sd1", "sqrt(vs / 2) as sd2")


def agreement_intervals(df: DataFrame, a: str, b: str) -> DataFrame:
    """95 % intervals of the bias and of the limits of agreement (Bland and Altman, 1999: a limit's variance is 3 s^2 / n), the test of
    proportional bias (slope of difference on mean, its t and p) and the within-subject coefficient of variation of pairs."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().withColumns({"d": F.expr("a - b"), "m": F.expr("(a + b) / 2")})
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.avg("m").alias("mean"), F.expr("avg(d * d / 2)").alias("within"), F.expr("regr_sxx(d, m)").alias("sxx"), F.expr("regr_sxy(d, m)").alias("sxy"), F.expr("regr_syy(d, m)").alias("syy"))
    m = m.withColumns({"slope": F.expr("sxy / nullif(sxx, 0)"), "df": F.expr("cast(n - 2 as double)")}).withColumn("t", F.expr("slope / nullif(sqrt((syy - slope * sxy) / nullif(df, 0) / nullif(sxx, 0)), 0)"))
    limit = lambda sign, to: F.expr(f"bias {sign} {Z95} * sd {to} {Z95} * sd * sqrt(3 / n)")
    return m.select("n", F.expr(f"bias - {Z95} * sd / sqrt(n)").alias("bias_low"), F.expr(f"bias + {Z95} * sd / sqrt(n)").alias("bias_high"), limit("-", "-").alias("lower_low"), limit("-", "+").alias("lower_high"), limit("+", "-").alias("upper_low"), limit("+", "+").alias("upper_high"), "slope", "t", p_t("t", "df").alias("p"), F.expr("sqrt(within) / nullif(mean, 0)").alias("cv"))


def heterogeneity(studies: DataFrame, effect: str, variance: str, by: list[str] | None = None) -> DataFrame:
    """tau squared by DerSimonian and Laird and by Hedges and Olkin, the random effect with its 95 % interval and prediction interval
    (normal), by subgroup where asked; a row for each subgroup."""
    s = studies.select(*(by or []), F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v")).dropna().filter("v > 0")
    keys = by or []
    m = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(F.expr("1 / v")).alias("w"), F.sum(F.expr("1 / v / v")).alias("w2"), F.sum(F.expr("y / v")).alias("wy"), F.sum(F.expr("y * y / v")).alias("wyy"), F.var_samp("y").alias("s2"), F.avg("v").alias("mv"))
    m = m.selectExpr(*keys, "k", "wyy - wy * wy / w as q", "greatest(0, (wyy - wy * wy / w - (k - 1)) / nullif(w - w2 / w, 0)) as tau2_dl", "greatest(0, s2 - mv) as tau2_he")
    joined = s.join(F.broadcast(m), keys) if keys else s.crossJoin(F.broadcast(m))
    r = joined.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("k", "q", "tau2_dl", "tau2_he")], (F.sum(F.expr("y / (v + tau2_dl)")) / F.sum(F.expr("1 / (v + tau2_dl)"))).alias("random"), F.sqrt(1 / F.sum(F.expr("1 / (v + tau2_dl)"))).alias("se"))
    low, high = (f"random {sign} {Z95} * se" for sign in "-+")
    return r.selectExpr(*keys, "k", "q", "tau2_dl", "tau2_he", "random", f"{low} as low", f"{high} as high", f"random - {Z95} * sqrt(tau2_dl + se * se) as predicted_low", f"random + {Z95} * sqrt(tau2_dl + se * se) as predicted_high")


def begg(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """Begg and Mazumdar's rank correlation of standardised effects and variances: Kendall's concordant less discordant pairs, z and p.

    Studies meet in pairs: a list of studies is short.
    """
    s = studies.select(F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v")).dropna().filter("v > 0")
    total = s.agg(F.sum(F.expr("1 / v")).alias("w"), (F.sum(F.expr("y / v")) / F.sum(F.expr("1 / v"))).alias("fixed"), F.count(F.lit(1)).alias("k"))
    rows = s.crossJoin(F.broadcast(total)).selectExpr("(y - fixed) / sqrt(v - 1 / w) as e", "v", "k")
    other = rows.select(F.col("e").alias("e2"), F.col("v").alias("v2"))
    m = rows.join(F.broadcast(other), F.col("v") < F.col("v2")).agg(F.sum(F.expr("sign(e2 - e)")).alias("s"), F.max("k").alias("k"))
    m = m.withColumn("z", F.expr("s / sqrt(k * (k - 1) * (2 * k + 5) / 18)"))
    return m.select(F.col("k"), F.col("s").cast("double").alias("s"), "z", p_z("z").alias("p"))
