"""Pooled effects beyond the first estimators: four estimators of tau squared, Egger's test, studies left out under random effects, trim and fill.

An iteration is an aggregate over the studies that the step before is joined to; steps are fixed in number, so that a plan is known before it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywacke.functions.special import p_t
from graywacke.operators.ranks import mid_rank, value_ranks

#: Newton steps of an estimator of tau squared; at most so many rounds of trimming.
STEPS, ROUNDS = 12, 20


def _studies(studies: DataFrame, effect: str, variance: str, *more: str) -> DataFrame:
    return studies.select(*more, F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v")).dropna(subset=["y", "v"]).filter("v > 0")


def _step(s: DataFrame, state: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The next tau2 of each group. Paule and Mandel: Q less its expectation over the slope of Q; REML: the score over its information."""
    joined = s.join(state, keys) if keys else s.crossJoin(F.broadcast(state))
    w = F.expr("1 / (v + tau2)")
    m = joined.withColumn("w", w).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max("tau2").alias("tau2"), F.sum("w").alias("s1"), F.sum(F.expr("w * w")).alias("s2"), F.sum(F.expr("w * w * w")).alias("s3"), *(F.sum(F.expr(f"{w} * {y}")).alias(f"{a}{b}") for w, a in (("w", "a"), ("w * w", "b"), ("w * w * w", "c")) for y, b in (("y", "y"), ("y * y", "yy"))))
    # Sums of w^p (y - mean)^2 from sums about zero: effects are of the size of their spread.
    m = m.withColumn("mean", F.expr("ay / s1")).withColumns({"q1": F.expr("ayy - 2 * mean * ay + mean * mean * s1"), "q2": F.expr("byy - 2 * mean * by + mean * mean * s2")})
    change = "(q1 - (k - 1)) / nullif(q2, 0)" if kind == "pm" else "(q2 - (s1 - s2 / s1)) / nullif(s2 - 2 * s3 / s1 + s2 * s2 / (s1 * s1), 0)"
    return m.select(*keys, F.expr(f"greatest(0D, tau2 + coalesce({change}, 0D))").alias("tau2"))


def tau2(studies: DataFrame, effect: str, variance: str, kind: str, by: list[str] | None = None, steps: int = STEPS) -> DataFrame:
    """(by..., tau2) by Paule and Mandel (pm) or restricted maximum likelihood (reml), from 0; for DerSimonian and Laird's and Hedges' see measures.heterogeneity()."""
    if kind not in ("pm", "reml"):
        raise ValueError("kind is pm or reml")
    keys = by or []
    s = _studies(studies, effect, variance, *keys)
    state = s.groupBy(*keys).agg(F.lit(0.0).alias("tau2"))
    for _ in range(steps):
        state = _step(s, state, keys, kind)
    return state


def random_effect(studies: DataFrame, effect: str, variance: str, kind: str, by: list[str] | None = None) -> DataFrame:
    """(by..., k, tau2, random, se) with tau2 by pm or reml."""
    keys = by or []
    state, s = tau2(studies, effect, variance, kind, by), _studies(studies, effect, variance, *keys)
    joined = s.join(state, keys) if keys else s.crossJoin(F.broadcast(state))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max("tau2").alias("tau2"), (F.sum(F.expr("y / (v + tau2)")) / F.sum(F.expr("1 / (v + tau2)"))).alias("random"), F.sqrt(1 / F.sum(F.expr("1 / (v + tau2)"))).alias("se"))


def egger(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """(k, intercept, se, t, df, p, slope): Egger's regression of the standardised effect on precision; its intercept is the test of a skewed funnel."""
    m = _studies(studies, effect, variance).selectExpr("y / sqrt(v) as z", "1 / sqrt(v) as x").agg(F.count(F.lit(1)).alias("k"), F.avg("x").alias("mx"), *(F.expr(f"{f}(z, x)").alias(n) for f, n in (("regr_sxx", "sxx"), ("regr_sxy", "sxy"), ("regr_syy", "syy"), ("regr_slope", "slope"), ("regr_intercept", "intercept"))))
    m = m.withColumn("df", F.expr("cast(k - 2 as double)")).withColumn("se", F.expr("sqrt(greatest(0, syy - slope * sxy) / nullif(df, 0) * (1 / nullif(k, 0) + mx * mx / nullif(sxx, 0)))")).withColumn("t", F.expr("intercept / nullif(se, 0)"))
    return m.select("k", "intercept", "se", "t", "df", p_t("t", "df").alias("p"), "slope")


def left_out(studies: DataFrame, study: str, effect: str, variance: str) -> DataFrame:
    """(study, tau2, random, se) of random effects (DerSimonian and Laird) without each study in turn.

    tau2 without a study is sums less its own. The weights under it differ from study to study, so that each study needs a sum over all: they
    travel to it as one array, up to MOST_STUDIES of them; more are an error.
    """
    s = _studies(studies, effect, variance, F.col(study).alias("study"))
    total = s.agg(F.count(F.lit(1)).alias("k"), *(F.sum(F.expr(e)).alias(n) for n, e in (("w", "1 / v"), ("w2", "1 / v / v"), ("wy", "y / v"), ("wyy", "y * y / v"))))
    if total.select("k").first().k > MOST_STUDIES:
        raise ValueError(f"more than {MOST_STUDIES} studies")
    less = s.crossJoin(F.broadcast(total)).selectExpr("study", "y", "v", "k - 1 as k", "w - 1 / v as w", "w2 - 1 / v / v as w2", "wy - y / v as wy", "wyy - y * y / v as wyy")
    taus = less.selectExpr("study", "y", "v", "greatest(0D, (wyy - wy * wy / w - (k - 1)) / nullif(w - w2 / w, 0)) as tau2")
    every = taus.crossJoin(F.broadcast(s.agg(F.collect_list(F.struct("y", "v")).alias("every"))))
    sums = every.selectExpr("study", "tau2", "aggregate(every, 0D, (a, e) -> a + 1 / (e.v + tau2)) - 1 / (v + tau2) as w", "aggregate(every, 0D, (a, e) -> a + e.y / (e.v + tau2)) - y / (v + tau2) as wy")
    return sums.selectExpr("study", "tau2", "wy / nullif(w, 0) as random", "sqrt(1 / nullif(w, 0)) as se")


#: Studies that travel as one array.
MOST_STUDIES = 10_000


def trim_and_fill(studies: DataFrame, study: str, effect: str, variance: str, side: str = "right") -> DataFrame:
    """studies (study, y, v) with trimmed and filled ones: Duval and Tweedie's L0 (2000). filled rows are the mirror images of the trimmed ones.

    side: where studies are in excess. In each round the fixed effect of what isn't trimmed is the centre; of the ranks of distances from it
    those on the side in excess tell how many to trim; it ends when that number stays the same, or with ROUNDS. A round gives the driver one number.
    """
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    sign = 1 if side == "right" else -1
    s = _studies(studies, effect, variance, F.col(study).alias("study")).withColumn("y", sign * F.col("y"))
    # Places from the top: by value over the table, and among equal values by variance and study.
    above = value_ranks(s, "y")
    n = above.agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("n")).first().n
    among = F.row_number().over(Window.partitionBy("y").orderBy("v", "study"))
    placed = s.withColumn("among", among).join(above, "y").select("study", "y", "v", (F.lit(n) - F.col("below") - F.col("ties") + F.col("among")).alias("place"))
    trimmed, centre = 0, None
    for _ in range(ROUNDS):
        centre = placed.filter(F.col("place") > trimmed).agg((F.sum(F.expr("y / v")) / F.sum(F.expr("1 / v"))).alias("c")).first().c
        if centre is None:
            break
        away = placed.select((F.col("y") - F.lit(centre)).alias("d")).withColumn("size", F.abs("d"))
        ranked = away.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("up")).join(value_ranks(away, "size"), "size")
        t = ranked.agg(F.coalesce(F.sum(F.col("up") * mid_rank()), F.lit(0.0)).alias("t")).first().t
        found = min(max(0, n - 2), max(0, int((4 * t - n * (n + 1)) / (2 * n - 1) + 0.5))) if n > 2 else 0
        if found == trimmed:
            break
        trimmed = found
    cut = (F.col("place") <= trimmed).alias("trimmed")
    own = placed.select(F.col("study").cast("string").alias("study"), (sign * F.col("y")).alias("y"), "v", cut, F.lit(False).alias("filled"))
    if not trimmed:
        return own
    mirrored = placed.filter(F.col("place") <= trimmed).select(F.concat(F.lit("filled "), F.col("study").cast("string")).alias("study"), (sign * (2 * F.lit(centre) - F.col("y"))).alias("y"), "v", F.lit(False).alias("trimmed"), F.lit(True).alias("filled"))
    return own.unionByName(mirrored)


def filled_effect(found: DataFrame) -> DataFrame:
    """From trim_and_fill(): (k, n_filled, fixed, se) of the studies and the filled ones."""
    return found.agg(F.count(F.lit(1)).alias("k"), F.count_if("filled").alias("n_filled"), (F.sum(F.expr("y / v")) / F.sum(F.expr("1 / v"))).alias("fixed"), F.sqrt(1 / F.sum(F.expr("1 / v"))).alias("se"))


def funnel(studies: DataFrame, effect: str, variance: str, width: int = 41, height: int = 12) -> DataFrame:
    """(line, text) of a funnel plot in text: standard errors downwards from 0, effects across, a digit (9 for more) for the studies at a place."""
    s = _studies(studies, effect, variance).selectExpr("y", "sqrt(v) as e")
    ends = s.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.max("e").alias("most"))
    at = lambda x, low, high, n: F.least(F.lit(n - 1), F.floor(F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) * n)).cast("int")
    cells = s.crossJoin(F.broadcast(ends)).select(at(F.col("e"), F.lit(0.0), F.col("most"), height).alias("line"), at(F.col("y"), F.col("low"), F.col("high"), width).alias("x")).groupBy("line", "x").agg(F.least(F.lit(9), F.count(F.lit(1))).cast("string").alias("c"))
    # At most width cells a line.
    rows = cells.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("x", "c"))).alias("m"))
    text = F.rtrim(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.element_at("m", x), F.lit(" "))), ""))
    return rows.select("line", text.alias("text"))
