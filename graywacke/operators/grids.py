"""Grids of specifications from one scan: a row goes to each specification that keeps it, and tests are aggregates by specification.

Two groups (12), paired values (36) and two columns (12): rules for outliers, a parametric and a rank test, logarithms or not, and for
pairs three rules for missing values. What stands out is judged against the main specification, the first, with guards against noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graywacke.functions.special import log_gamma, p_t, p_z
from graywacke.operators.ranks import mid_rank, quantiles, value_ranks
from graywacke.operators.robust import ALPHA, GRAZED, LEAST_ROWS, LEAST_SPECS, OUTLIERS

MISSING = ("complete", "locf", "mean")
#: Rows whose values are summed up in one task.
PART_ROWS = 1_000_000
#: Rows up to which rank tests are exact, ties included.
MOST_EXACT = 40
#: From which size an effect is small, medium or large: differences in SDs, and correlations. How near a limit grazes it.
GRADES = {"g": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5)}
GRAZED_EFFECT = 0.01


@F.pandas_udf(DoubleType())
def exact_rank_p(ranks: pd.Series, taken: pd.Series, total: pd.Series) -> pd.Series:
    """Two-sided p of a rank sum: the share of all choices of so many of the ranks whose sum is at least as far from the middle; null if there are no
    ranks or all are taken. Mid-ranks, doubled, are whole numbers, so that a choice's sum is a place in a table of counts."""
    out = []
    for row, k, s in zip(ranks, taken, total):
        if row is None or k is None or len(row) == 0 or not 0 < k < len(row):
            out.append(None)
            continue
        twice = np.rint(2 * np.asarray(row, float)).astype(int)
        ways = np.zeros((int(k) + 1, twice.sum() + 1))
        ways[0, 0] = 1
        for r in twice:
            ways[1:, r:] += ways[:-1, : ways.shape[1] - r].copy()
        at = np.arange(ways.shape[1])
        middle = k * twice.sum() / len(twice)
        far = np.abs(at - middle) >= abs(2 * s - middle) - 1e-9
        out.append(float(ways[int(k), far].sum() / ways[int(k)].sum()))
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def exact_signed_p(ranks: pd.Series, total: pd.Series) -> pd.Series:
    """Two-sided p of a sum of positive ranks, from all ways to give each rank a sign; null without ranks."""
    out = []
    for row, s in zip(ranks, total):
        if row is None or len(row) == 0:
            out.append(None)
            continue
        twice = np.rint(2 * np.asarray(row, float)).astype(int)
        ways = np.zeros(twice.sum() + 1)
        ways[0] = 1
        for r in twice:
            ways[r:] += ways[: len(ways) - r].copy()
        far = np.abs(np.arange(len(ways)) - twice.sum() / 2) >= abs(2 * s - twice.sum() / 2) - 1e-9
        out.append(float(ways[far].sum() / ways.sum()))
    return pd.Series(out, dtype=float)


def kept(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows once for each rule of OUTLIERS (column outliers) that keeps them: every column within its limits in its group, by mean and SD, or by quartiles.
    Groups are few."""
    limits = rows.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    for c in columns:
        limits = limits.join(quantiles(rows, c, by, **{f"a_{c}": 0.25, f"b_{c}": 0.75}), by)
    within = F.lit(True), F.lit(True)
    for c in columns:
        within = within[0] & F.expr(f"abs({c} - m_{c}) <= 3 * s_{c}"), within[1] & F.expr(f"{c} between 2.5 * a_{c} - 1.5 * b_{c} and 2.5 * b_{c} - 1.5 * a_{c}")
    rules = F.array_compact(F.array(F.lit(OUTLIERS[0]), F.when(within[0], OUTLIERS[1]), F.when(within[1], OUTLIERS[2])))
    return rows.join(F.broadcast(limits), by).select(*by, *columns, F.explode(rules).alias("outliers"))


def with_logs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with log: once as they are and once with logarithms of columns, null where they aren't positive."""
    values = lambda log: [F.when(F.col(c) > 0, F.log(c)).alias(c) if log else F.col(c).cast("double").alias(c) for c in columns]
    both = F.array(*(F.struct(F.lit(log).alias("log"), *values(log)) for log in (False, True)))
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.explode(both).alias("e")).select(*others, "e.*")


def _listed(tests: dict[str, DataFrame], keys: list[str], order: list[tuple[str, tuple]]) -> DataFrame:
    """The tests' rows (keys, n, effect, p, least_p) as one grid, numbered by the places of the keys in order, the last first to change."""
    rows = None
    for name, found in tests.items():
        part = found.select(*keys, F.lit(name).alias("test"), "n", "effect", "p", "least_p")
        rows = part if rows is None else rows.unionByName(part)
    number = F.lit(1)
    for key, values in order:
        place = F.coalesce(*(F.when(F.col(key) == F.lit(v), F.lit(i)) for i, v in enumerate(values)))
        size = 1
        for _, later in order[order.index((key, values)) + 1 :]:
            size *= len(later)
        number = number + place * size
    return rows.select(number.alias("spec"), *keys, "test", "n", "effect", "p", "least_p")


def two_groups(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(spec, log, outliers, test, n, effect, p, least_p): Welch's test with Hedges' g, and Mann and Whitney's, exact up to MOST_EXACT rows, with
    the rank-biserial correlation; least_p is the least that an exact test of so many rows can give."""
    rows = with_logs(df.filter(F.col(group).isin(a, b)).select((F.col(group) == a).alias("a"), F.col(value).alias("v")), ["v"]).filter("v is not null and not isnan(v)")
    keys = ["log", "outliers"]
    x = kept(rows, ["log", "a"], ["v"])
    side = lambda f, s: f(F.when(F.col("a") == (s == "a"), F.col("v"))).alias(f"{f.__name__[0]}{s}")
    m = x.groupBy(*keys).agg(*(side(f, s) for s in "ab" for f in (F.count, F.avg, F.var_samp))).withColumns({"ea": F.expr("va / nullif(ca, 0)"), "eb": F.expr("vb / nullif(cb, 0)")})
    m = m.withColumns({"t": F.expr("(aa - ab) / nullif(sqrt(ea + eb), 0)"), "df": F.expr("pow(ea + eb, 2) / nullif(ea * ea / nullif(ca - 1, 0) + eb * eb / nullif(cb - 1, 0), 0)")})
    g = F.expr("(aa - ab) / nullif(sqrt(((ca - 1) * va + (cb - 1) * vb) / nullif(ca + cb - 2, 0)), 0) * (1 - 3 / (4 * (ca + cb) - 9))")
    welch = m.select(*keys, F.expr("ca + cb").alias("n"), g.alias("effect"), p_t("t", "df").alias("p"), F.lit(None).cast("double").alias("least_p"))
    counts = x.groupBy(*keys, "v").agg(F.count_if("a").alias("k"), F.count(F.lit(1)).alias("t")).join(value_ranks(x, "v", keys, dealt=True).withColumn("rank", mid_rank()), [*keys, "v"])
    u = counts.groupBy(*keys).agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("na"), F.sum(F.col("t") - F.col("k")).alias("nb"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    u = u.withColumns({"n": F.expr("na + nb"), "u": F.expr("r - na * (na + 1) / 2")}).withColumn("z", F.expr("greatest(0, abs(u - na * nb / 2) - 0.5) / nullif(sqrt(cast(na as double) * nb / 12 * (n + 1 - ties / nullif(cast(n as double) * (n - 1), 0))), 0)"))
    few = counts.join(F.broadcast(u.filter(F.col("n") <= MOST_EXACT).select(*keys)), keys).groupBy(*keys).agg(F.flatten(F.collect_list(F.array_repeat("rank", F.col("t").cast("int")))).alias("ranks"))
    u = u.join(few, keys, "left")
    least = F.expr(f"if(n <= {MOST_EXACT} and na > 0 and nb > 0, 2 * exp({_ln_factorial('na')} + {_ln_factorial('nb')} - {_ln_factorial('n')}), null)")
    ranked = u.select(*keys, "n", F.expr("2 * u / nullif(cast(na as double) * nb, 0) - 1").alias("effect"), F.coalesce(exact_rank_p("ranks", F.col("na").cast("double"), "r"), F.when(F.col("n") > MOST_EXACT, p_z("z"))).alias("p"), F.least(F.lit(1.0), least).alias("least_p"))
    return _listed({"welch": welch, "mann-whitney": ranked}, keys, [("log", (False, True)), ("outliers", OUTLIERS), ("test", ("welch", "mann-whitney"))])


def _ln_factorial(n: str) -> str:
    """SQL of the logarithm of n!, for small n."""
    return f"aggregate(sequence(0, cast({n} as int)), 0D, (s, i) -> s + ln(greatest(i, 1)))"


def pairs(df: DataFrame, before: str, after: str) -> DataFrame:
    """(spec, missing, log, outliers, test, n, effect, p, least_p) of after less before: paired t with its standardised mean, and Wilcoxon's signed ranks, exact
    up to MOST_EXACT differences, with the rank-biserial correlation. A missing value is left out with its pair, carried on from before, or the mean of its column."""
    rows = with_logs(df.select(F.col(before).alias("x"), F.col(after).alias("y")), ["x", "y"])
    means = rows.groupBy("log").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    filled = F.array(*(F.struct(F.lit(k).alias("missing"), d.alias("d")) for k, d in zip(MISSING, (F.expr("y - x"), F.expr("coalesce(y, x) - x"), F.expr("coalesce(y, my) - coalesce(x, mx)")))))
    d = rows.join(F.broadcast(means), "log").select("log", F.explode(filled).alias("e")).select("log", "e.*").filter("d is not null and not isnan(d)")
    keys = ["missing", "log", "outliers"]
    x = kept(d, ["missing", "log"], ["d"])
    m = x.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).withColumn("t", F.expr("m / nullif(s / sqrt(n), 0)"))
    plain = m.select(*keys, "n", F.expr("m / nullif(s, 0)").alias("effect"), p_t("t", F.expr("cast(n - 1 as double)")).alias("p"), F.lit(None).cast("double").alias("least_p"))
    signed = x.filter("d <> 0").withColumn("size", F.abs("d"))
    counts = signed.groupBy(*keys, "size").agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("t")).join(value_ranks(signed, "size", keys, dealt=True).withColumn("rank", mid_rank()), [*keys, "size"])
    w = counts.groupBy(*keys).agg(F.sum(F.expr("up * rank")).alias("w"), F.sum("t").alias("k"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    w = w.withColumn("z", F.expr("(w - cast(k as double) * (k + 1) / 4) / nullif(sqrt(cast(k as double) * (k + 1) * (2 * k + 1) / 24 - ties / 48), 0)"))
    few = counts.join(F.broadcast(w.filter(F.col("k") <= MOST_EXACT).select(*keys)), keys).groupBy(*keys).agg(F.flatten(F.collect_list(F.array_repeat("rank", F.col("t").cast("int")))).alias("ranks"))
    w = m.select(*keys, "n").join(w, keys, "left").join(few, keys, "left")
    least = F.expr(f"if(k <= {MOST_EXACT}, least(1, pow(2D, 1 - k)), null)")
    ranked = w.select(*keys, "n", F.expr("4 * w / nullif(cast(k as double) * (k + 1), 0) - 1").alias("effect"), F.coalesce(exact_signed_p("ranks", "w"), F.when(F.col("k") > MOST_EXACT, p_z("z"))).alias("p"), least.alias("least_p"))
    return _listed({"t": plain, "wilcoxon": ranked}, keys, [("missing", MISSING), ("log", (False, True)), ("outliers", OUTLIERS), ("test", ("t", "wilcoxon"))])


def columns(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spec, log, outliers, test, n, effect, p, least_p) of Pearson's and Spearman's correlation, with the p of their t; an outlier in either column is left out."""
    rows = with_logs(df.select(F.col(x).alias("x"), F.col(y).alias("y")), ["x", "y"]).dropna()
    keys = ["log", "outliers"]
    both = kept(rows, ["log"], ["x", "y"])
    ranked = both
    for c in ("x", "y"):
        ranked = ranked.join(value_ranks(both, c, keys, dealt=True).select(*keys, c, mid_rank().alias(f"r{c}")), [*keys, c])

    def tested(rows: DataFrame, a: str, b: str) -> DataFrame:
        m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("effect"))
        return m.select(*keys, "n", "effect", p_r("effect", "n").alias("p"), F.lit(None).cast("double").alias("least_p"))

    return _listed({"pearson": tested(both, "x", "y"), "spearman": tested(ranked, "rx", "ry")}, keys, [("log", (False, True)), ("outliers", OUTLIERS), ("test", ("pearson", "spearman"))])


def p_r(r: str, n: str) -> Column:
    """Two-sided p of a correlation of n rows by its t; null below three rows."""
    return F.when(F.col(n) > 2, p_t(F.expr(f"if(abs({r}) >= 1, 1e300, {r} * sqrt(({n} - 2) / (1 - {r} * {r})))"), F.expr(f"cast({n} - 2 as double)")))


def judged(grid: DataFrame) -> DataFrame:
    """The grid with flip_p, flip_sign and flip_grade against the main specification (null where it can't be told) and unreachable.

    flip_p: the other side of ALPHA, unless either has grazed it; never where an exact rank test of so few rows can't reach ALPHA (unreachable).
    Effects are looked at only where either is significant, grades (small, medium, large) only on one scale, as they are or in
    logarithms, and only if neither effect grazes a limit of its grades. Ordered by what flips, then by number, never by p.
    """
    limits = F.when(F.col("test").isin("welch", "t"), F.array(*map(F.lit, GRADES["g"]))).otherwise(F.array(*map(F.lit, GRADES["r"])))
    graded = grid.withColumn("limits", limits).withColumns({"grade": F.size(F.filter("limits", lambda e: F.abs("effect") >= e)), "grazed": F.exists("limits", lambda e: F.abs(F.abs("effect") - e) < GRAZED_EFFECT)}).drop("limits")
    main = graded.filter("spec = 1").select(F.col("p").alias("p0"), F.col("effect").alias("effect0"), F.col("grade").alias("grade0"), F.col("grazed").alias("grazed0"), F.col("log").alias("log0"))
    rows = graded.crossJoin(F.broadcast(main))
    near = lambda p: F.abs(F.col(p) - ALPHA) < GRAZED
    unreachable = F.coalesce(F.col("least_p") > ALPHA, F.lit(False))
    flip_p = F.when(F.col("p").isNotNull() & F.col("p0").isNotNull(), ((F.col("p") < ALPHA) != (F.col("p0") < ALPHA)) & ~near("p") & ~near("p0") & ~unreachable)
    either = (F.col("p") < ALPHA) | (F.col("p0") < ALPHA)
    known = F.col("effect").isNotNull() & F.col("effect0").isNotNull()
    sign = F.when(known, either & (F.signum("effect") * F.signum("effect0") < 0) & (F.abs("effect") >= GRAZED_EFFECT) & (F.abs("effect0") >= GRAZED_EFFECT))
    grade = F.when(known, either & (F.col("log") == F.col("log0")) & (F.col("grade") != F.col("grade0")) & ~F.col("grazed") & ~F.col("grazed0"))
    out = rows.withColumns({"flip_p": flip_p, "flip_sign": sign, "flip_grade": grade, "unreachable": unreachable})
    any_flip = F.coalesce("flip_p", F.lit(False)) | F.coalesce("flip_sign", F.lit(False)) | F.coalesce("flip_grade", F.lit(False))
    return out.drop("p0", "effect0", "grade0", "grazed0", "log0", "grade", "grazed").orderBy(F.desc(any_flip), "spec")


def verdict(rows: DataFrame) -> DataFrame:
    """(specs, flips, verdict) from judged(): fragile where anything flips, undecidable with too few rows or specifications."""
    any_flip = F.coalesce("flip_p", F.lit(False)) | F.coalesce("flip_sign", F.lit(False)) | F.coalesce("flip_grade", F.lit(False))
    m = rows.agg(F.count("p").alias("specs"), F.count_if(any_flip).alias("flips"), F.min("n").alias("least"))
    return m.select("specs", "flips", F.when((F.col("least") < LEAST_ROWS) | (F.col("specs") < LEAST_SPECS), "undecidable").when(F.col("flips") > 0, "fragile").otherwise("robust").alias("verdict"))


def left_out_ranks(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(v, a, times, p) of Mann and Whitney's test (normal, tie-corrected) without one row: rows of one value and group are alike, and give one row.

    U without a row is U less what the row adds to it; ties fall by one row of their value. Nothing is run again.
    """
    rows = df.filter(F.col(group).isin(a, b)).select((F.col(group) == a).alias("a"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = rows.groupBy("v").agg(F.count_if("a").alias("ka"), F.count_if(~F.col("a")).alias("kb")).join(value_ranks(rows, "v"), "v")
    total = counts.agg(F.sum("ka").alias("na"), F.sum("kb").alias("nb"), F.sum(F.expr("ka * (below + (ties + 1) / 2)")).alias("r"), F.sum(F.expr("cast(ties as double) * ties * ties - ties")).alias("cubes"))
    each = _lower(counts).crossJoin(F.broadcast(total)).withColumn("side", F.explode(F.array(F.struct(F.lit(True).alias("a"), F.col("ka").alias("times")), F.struct(F.lit(False).alias("a"), F.col("kb").alias("times"))))).filter("side.times > 0")
    each = each.selectExpr("v", "side.a as a", "side.times as times", "r - na * (na + 1) / 2 as u", "na - if(side.a, 1, 0) as na", "nb - if(side.a, 0, 1) as nb", "if(side.a, below - lower_a + kb / 2, (total_a - lower_a - ka) + ka / 2) as own", "cubes - (3D * ties * ties - 3D * ties) as cubes")
    z = each.withColumns({"u": F.expr("u - own"), "n": F.expr("na + nb")}).withColumn("z", F.expr("greatest(0, abs(u - na * nb / 2) - 0.5) / nullif(sqrt(cast(na as double) * nb / 12 * (n + 1 - cubes / nullif(cast(n as double) * (n - 1), 0))), 0)"))
    return z.select("v", "a", "times", p_z("z").alias("p"))


def _lower(counts: DataFrame) -> DataFrame:
    """counts (v, ka, below, ...) with lower_a, how many rows of a are below v, and total_a; values are dealt by their rank into parts of PART_ROWS rows."""
    total = counts.agg(F.sum("ka").alias("total_a"))
    parts = counts.withColumn("part", F.floor(F.col("below") / F.lit(PART_ROWS)))
    start = parts.groupBy("part").agg(F.sum("ka").alias("part_a"))
    start = start.withColumn("start_a", F.coalesce(F.sum("part_a").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_a")
    inside = F.coalesce(F.sum("ka").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("inside", inside).join(start, "part").withColumn("lower_a", F.col("start_a") + F.col("inside")).drop("part", "inside", "start_a").crossJoin(F.broadcast(total))


@F.pandas_udf(DoubleType())
def least_rank_p(n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """The least two-sided p that an exact rank test of so many rows can give, for any numbers: two of all choices, or the only one."""
    a, b = n_a.to_numpy(float), n_b.to_numpy(float)
    return pd.Series(np.minimum(1, 2 * np.exp(log_gamma(a + 1) + log_gamma(b + 1) - log_gamma(a + b + 1))))


def exact_by_stratum(df: DataFrame, value: str, group: str, a: str, b: str, by: list[str], most: int = MOST_EXACT) -> DataFrame:
    """(by..., n_a, n_b, u, least_p, p) of Mann and Whitney's exact test, ties included, in each stratum; p is null in strata of more than most rows, which
    the normal test is for, least_p in none."""
    rows = df.filter(F.col(group).isin(a, b)).select(*by, (F.col(group) == a).alias("a"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = rows.groupBy(*by, "v").agg(F.count_if("a").alias("k"), F.count(F.lit(1)).alias("t")).join(value_ranks(rows, "v", by).withColumn("rank", mid_rank()), [*by, "v"])
    m = counts.groupBy(*by).agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("n_a"), F.sum(F.col("t") - F.col("k")).alias("n_b"))
    few = counts.join(m.filter(F.col("n_a") + F.col("n_b") <= most).select(*by), by).groupBy(*by).agg(F.flatten(F.collect_list(F.array_repeat("rank", F.col("t").cast("int")))).alias("ranks"))
    return m.join(few, by, "left").select(*by, "n_a", "n_b", F.expr("r - n_a * (n_a + 1) / 2").alias("u"), least_rank_p("n_a", "n_b").alias("least_p"), exact_rank_p("ranks", F.col("n_a").cast("double"), "r").alias("p"))
