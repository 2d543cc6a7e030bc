"""Whether a result hangs on one way to analyse: a grid of specifications, what flips in it, and rows left out one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.functions.special import p_t
from graywacke.operators.compare import mann_whitney, two_sample

ALPHA = 0.05
#: A p this close to ALPHA has grazed it: no flip. Rows and specifications below which there is no verdict.
GRAZED, LEAST_ROWS, LEAST_SPECS = 0.001, 6, 5
OUTLIERS = ("none", "3 sd", "1.5 iqr")


def without_outliers(df: DataFrame, value: str, group: str, rule: str) -> DataFrame:
    """The rows whose value the rule keeps, by the mean and SD or the quartiles of their group."""
    if rule == "none":
        return df
    if rule not in OUTLIERS:
        raise ValueError(f"no such rule: {rule}")
    v = F.col(value).cast("double")
    low, high = (F.avg(v) - 3 * F.stddev_samp(v), F.avg(v) + 3 * F.stddev_samp(v)) if rule == "3 sd" else (2.5 * F.percentile(v, F.lit(0.25)) - 1.5 * F.percentile(v, F.lit(0.75)), 2.5 * F.percentile(v, F.lit(0.75)) - 1.5 * F.percentile(v, F.lit(0.25)))
    bounds = df.filter(F.col(group).isNotNull() & v.isNotNull()).groupBy(F.col(group).alias("its_group")).agg(low.alias("low"), high.alias("high"))
    return df.join(bounds, (F.col(group) == F.col("its_group")) & v.between(F.col("low"), F.col("high")), "left_semi")


def logged(df: DataFrame, value: str) -> DataFrame:
    """df with the logarithm of the value; null where it isn't positive."""
    v = F.col(value).cast("double")
    return df.withColumn(value, F.when(v > 0, F.log(v)))


def two_group_grid(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(spec, outliers, test, log, n, p) of the twelve specifications: three rules for outliers, Welch or Mann and Whitney, logarithms or not.
    The first is the main one."""
    rows = df.filter(F.col(group).isin(a, b)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    specs = []
    for log in (False, True):
        for rule in OUTLIERS:
            kept = without_outliers((logged(rows, "v") if log else rows).filter("v is not null"), "v", "g", rule)
            for test, p in (("welch", two_sample(kept, "v", "g", a, b).selectExpr("n_a + n_b as n", "p_welch as p")), ("mann-whitney", mann_whitney(kept, "v", "g", a, b).selectExpr("n_a + n_b as n", "p"))):
                specs.append(p.select(F.lit(len(specs) + 1).alias("spec"), F.lit(rule).alias("outliers"), F.lit(test).alias("test"), F.lit(log).alias("log"), "n", "p"))
    return reduce(DataFrame.unionByName, specs)


def judged(grid: DataFrame) -> DataFrame:
    """The grid with flipped: whether a specification stands on the other side of ALPHA than the main one, without having grazed it (null
    where it can't be told); Flipped ones come first, then by number, never by significance."""
    main = grid.filter("spec = 1").select(F.col("p").alias("p_main"))
    near = lambda p: F.abs(F.col(p) - ALPHA) < GRAZED
    flipped = F.when(F.col("p").isNotNull() & F.col("p_main").isNotNull(), ((F.col("p") < ALPHA) != (F.col("p_main") < ALPHA)) & ~near("p") & ~near("p_main"))
    return grid.crossJoin(F.broadcast(main)).withColumn("flipped", flipped).drop("p_main").orderBy(F.desc_nulls_last("flipped"), "spec")


def verdict(rows: DataFrame) -> DataFrame:
    """(specs, flips, verdict) from judged(): fragile where anything flips, undecidable with too few rows or specifications."""
    m = rows.agg(F.count("p").alias("specs"), F.count_if("flipped").alias("flips"), F.min("n").alias("least"))
    return m.select("specs", "flips", F.when((F.col("least") < LEAST_ROWS) | (F.col("specs") < LEAST_SPECS), "undecidable").when(F.col("flips") > 0, "fragile").otherwise("robust").alias("verdict"))


def least_exact_p(n_a: str, n_b: str):
    """The least two-sided p that an exact rank test of so many can have, 2 / C(n_a + n_b, n_a): 0.1 at 3 and 3. Up to 20 rows."""
    return F.expr(f"least(1, 2 * factorial({n_a}) * factorial({n_b}) / cast(factorial({n_a} + {n_b}) as double))")


def left_out(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(n, flips, least_p, most_p) of Welch's test without each row in turn: sums about the grand mean less the row's own, not a copy of the
    rows for each."""
    v = F.col(value).cast("double")
    rows = df.filter(F.col(group).isin(a, b) & v.isNotNull()).select((F.col(group) == a).alias("a"), v.alias("v"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("v").alias("grand")))).selectExpr("a", "v - grand as v")
    sums = rows.agg(*[f(F.when(c, x)).alias(f"{n}_{side}") for side, c in (("a", F.col("a")), ("b", ~F.col("a"))) for n, f, x in (("n", F.count, F.col("v")), ("s", F.sum, F.col("v")), ("q", F.sum, F.col("v") * F.col("v")))])
    own = lambda side, x: f"{x}_{side} - if({'a' if side == 'a' else 'not a'}, {dict(n='1', s='v', q='v * v')[x]}, 0)"
    m = rows.crossJoin(F.broadcast(sums)).selectExpr(*[f"cast({own(side, x)} as double) as {x}{side}" for side in "ab" for x in "nsq"])
    m = m.selectExpr("na", "nb", "sa / na - sb / nb as d", "(qa - sa * sa / na) / nullif(na - 1, 0) / na as ea", "(qb - sb * sb / nb) / nullif(nb - 1, 0) / nb as eb")
    m = m.selectExpr("d / nullif(sqrt(ea + eb), 0) as t", "pow(ea + eb, 2) / nullif(ea * ea / nullif(na - 1, 0) + eb * eb / nullif(nb - 1, 0), 0) as df").withColumn("p", p_t("t", "df"))
    whole = two_sample(df, value, group, a, b).select(F.col("p_welch").alias("p_main"))
    return m.crossJoin(F.broadcast(whole)).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") < ALPHA) != (F.col("p_main") < ALPHA)).alias("flips"), F.min("p").alias("least_p"), F.max("p").alias("most_p"))
