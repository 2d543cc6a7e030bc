"""Tests that are picked by what the data are and then run, intervals of differences, periods compared, and columns whose kind is unsure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graywacke.functions.special import normal_quantile, t_quantile
from graywacke.operators import categorical, compare, grids, normality

ALPHA = 0.05
#: A column is unsure if its share of numbers is between these: it is never taken for one to calculate with.
UNSURE = (0.05, 0.95)


@F.pandas_udf(DoubleType())
def t_at(share: pd.Series, df: pd.Series) -> pd.Series:
    """The quantile of t; null without degrees of freedom."""
    return pd.Series([t_quantile(float(p), float(d)) if d is not None and d > 0 else None for p, d in zip(share, df)], dtype=float)


def difference(df: DataFrame, value: str, group: str, a: str, b: str, level: float = 0.95) -> DataFrame:
    """(n_a, n_b, difference, low, high, g, g_low, g_high): the difference of means with Welch's interval, and Hedges' g with its normal one."""
    m = compare.two_sample(df, value, group, a, b).withColumns({"difference": F.expr("m_a - m_b"), "se": F.expr("sqrt(v_a / nullif(n_a, 0) + v_b / nullif(n_b, 0))"), "n": F.expr("nullif(n_a + n_b, 0)")})
    half = t_at(F.lit((1 + level) / 2), "df_welch") * F.col("se")
    z = normal_quantile((1 + level) / 2)
    ge = F.expr(f"{z}D * sqrt(n / nullif(cast(n_a as double) * n_b, 0) + hedges_g * hedges_g / (2 * n))")
    return m.withColumns({"half": half, "ge": ge}).select("n_a", "n_b", "difference", (F.col("difference") - F.col("half")).alias("low"), (F.col("difference") + F.col("half")).alias("high"), F.col("hedges_g").alias("g"), (F.col("hedges_g") - F.col("ge")).alias("g_low"), (F.col("hedges_g") + F.col("ge")).alias("g_high"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, p_pearson, spearman, p_spearman)."""
    m = compare.correlations(df, x, y)
    return m.select("n", "pearson", grids.p_r("pearson", "n").alias("p_pearson"), "spearman", grids.p_r("spearman", "n").alias("p_spearman"))


def compared(df: DataFrame, value: str, group: str) -> DataFrame:
    """(test, statistic, p, normal, equal_spread): the test that the variable's kind, the number of groups, Shapiro and Wilk's p in each group and Levene's
    call for, and its result. normal is null where a group is too large or small to be tested; then it counts as not normal.

    The checks are aggregates; the driver looks at one row of each and at the groups, up to MOST_GROUPS of them.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    names = sorted(r[0] for r in rows.select(group).distinct().limit(MOST_GROUPS + 1).collect())
    if not 2 <= len(names) <= MOST_GROUPS:
        raise ValueError(f"from 2 to {MOST_GROUPS} groups")
    kind = categorical.kinds(rows.select(value)).first().kind
    normal = spread = None
    if kind != "continuous":
        tested = categorical.chi_squared(rows, group, value).first()
        levels = rows.select(value).distinct().limit(3).count()
        name = categorical.suited_test(False, max(len(names), levels), least_expected=tested.least_expected)
        if name == "fisher":
            first = rows.agg(F.min(F.col(value).cast("string")).alias("v")).first().v
            found = categorical.fisher(rows.select((F.col(group) == names[0]).alias("x"), (F.col(value).cast("string") == first).alias("y")), "x", "y").select(F.lit(None).cast("double").alias("statistic"), "p")
        else:
            found = categorical.chi_squared(rows, group, value).select(F.col("chi2").alias("statistic"), "p")
    else:
        ps = [r.p for r in normality.by_group(rows, value, group).select("p").collect()]
        normal = None if any(p is None for p in ps) else all(p >= ALPHA for p in ps)
        levene = compare.levene(rows, value, group).first().p
        spread = None if levene is None else levene >= ALPHA
        name = categorical.suited_test(True, len(names), bool(normal), bool(spread))
        if name in ("student t", "welch t"):
            short = name.split()[0]
            found = compare.two_sample(rows, value, group, *names).select(F.col(f"t_{short}").alias("statistic"), F.col(f"p_{short}").alias("p"))
        elif name == "mann-whitney":
            found = compare.mann_whitney(rows, value, group, *names).select(F.col("u").alias("statistic"), "p")
        elif name == "anova":
            found = compare.anova(rows, value, group).select(F.col("f").alias("statistic"), "p")
        else:
            found = compare.kruskal_wallis(rows, value, group).select(F.col("h").alias("statistic"), "p")
    return found.select(F.lit(name).alias("test"), F.col("statistic").cast("double").alias("statistic"), "p", F.lit(normal).cast("boolean").alias("normal"), F.lit(spread).cast("boolean").alias("equal_spread"))


MOST_GROUPS = 200


def periods(rows: DataFrame, subject: str, period: str, value: str, first: str, second: str) -> DataFrame:
    """compare.paired() of subjects' means in two periods, second less first: a subject counts once, and only with both."""
    means = rows.filter(F.col(period).isin(first, second)).groupBy(F.col(subject).alias("s")).agg(*(F.avg(F.when(F.col(period) == k, F.col(value).cast("double"))).alias(c) for k, c in ((first, "a"), (second, "b"))))
    return compare.paired(means, "b", "a")


def sure_kinds(df: DataFrame) -> DataFrame:
    """categorical.kinds() with kind "unsure" where some values are numbers and too many aren't: such a column is not to be calculated with."""
    share = F.col("numbers") / F.nullif(F.col("n"), F.lit(0))
    return categorical.kinds(df).withColumn("kind", F.when((share > UNSURE[0]) & (share < UNSURE[1]), "unsure").otherwise(F.col("kind")))


def subgroup_totals(rows: DataFrame) -> DataFrame:
    """From lines (doc_id, line_no, line): claims like "N = 40 (22 women and 18 men)": (doc_id, line_no, whole, parts, total, ok)."""
    claim = r"\b[Nn]\s*=\s*(\d+)\s*\(\s*((?:\d+\s+\p{L}+(?:\s*,\s*|\s+and\s+|\s*))+)\)"
    found = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(claim), F.lit(0))).alias("raw"))
    parts = F.transform(F.regexp_extract_all(F.regexp_extract("raw", claim, 2), F.lit(r"(\d+)\s+\p{L}"), F.lit(1)), lambda n: n.try_cast("long"))
    cells = found.select("doc_id", "line_no", F.regexp_extract("raw", claim, 1).try_cast("long").alias("whole"), parts.alias("parts")).filter(F.size("parts") > 1)
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, n: s + n)
    return cells.withColumn("total", total).withColumn("ok", F.col("total") == F.col("whole"))
