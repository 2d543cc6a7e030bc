"""Tables of counts: n (%), chi squared, Fisher's exact test, kinds of variables and which test suits them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graywacke.functions import special

#: Distinct values up to which a column of numbers counts as a category, and the share of values that must be numbers for a measurement.
MOST_LEVELS, LEAST_NUMBERS = 10, 0.95


def shares(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, level, n, percent): how many rows of a group have each level; nulls are a level of their own, "missing"."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), F.coalesce(F.col(value).cast("string"), F.lit("missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    return counts.join(totals, "group").select("group", "level", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df, p, cramers_v, least_expected, n) of the table of a by b; rows with a null don't count."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("total"))
    # sum(n^2 / expected) - total: empty cells add nothing, so that only cells that occur are looked at.
    m = cells.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(total)).agg(F.sum(F.expr("cast(n as double) * n * total / (cast(na as double) * nb)")).alias("s"), F.max("total").alias("n"))
    sizes = rows.agg(F.count(F.lit(1)).alias("r"), F.min("na").alias("ra")).crossJoin(F.broadcast(columns.agg(F.count(F.lit(1)).alias("c"), F.min("nb").alias("cb"))))
    m = m.crossJoin(F.broadcast(sizes)).selectExpr("greatest(0, s - n) as chi2", "cast((r - 1) * (c - 1) as double) as df", "least(r, c) - 1 as k", "cast(ra as double) * cb / n as least_expected", "n")
    return m.select("chi2", "df", F.when(F.col("df") > 0, special.p_chi2("chi2", "df")).alias("p"), F.expr("sqrt(chi2 / nullif(n * k, 0))").alias("cramers_v"), "least_expected", "n")


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(a: int, b: int, c: int, d: int) -> float:
        x = np.arange(max(0, a - d), min(a + b, a + c) + 1)
        logs = -(special.log_gamma(x + 1.0) + special.log_gamma(a + b - x + 1.0) + special.log_gamma(a + c - x + 1.0) + special.log_gamma(d - a + x + 1.0))
        logs -= logs.max()
        odds = np.exp(logs)
        return min(1.0, float(odds[odds <= odds[a - x[0]] * (1 + 1e-7)].sum() / odds.sum()))

    return pd.Series([one(*map(int, v)) for v in zip(a, b, c, d)], dtype="float64")


def fisher(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, c, d, odds_ratio, p) of two columns of true and false: the two-sided exact test, the sum of all tables no likelier."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    m = df.filter(x.isNotNull() & y.isNotNull()).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return m.select("a", "b", "c", "d", F.expr("cast(a as double) * d / nullif(cast(b as double) * c, 0)").alias("odds_ratio"), _fisher("a", "b", "c", "d").alias("p"))


@F.pandas_udf(DoubleType())
def p_few_together(n_ab: pd.Series, n_a: pd.Series, n_b: pd.Series, n: pd.Series) -> pd.Series:
    """The hypergeometric chance of so few or fewer common ones, where n_a and n_b of n are drawn apart from each other."""
    def choose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return special.log_gamma(a + 1.0) - special.log_gamma(b + 1.0) - special.log_gamma(a - b + 1.0)

    def one(k: int, a: int, b: int, n: int) -> float:
        x = np.arange(max(0, a + b - n), k + 1)
        return float(min(1.0, np.exp(choose(a, x) + choose(n - a, b - x) - choose(n, b)).sum())) if len(x) else 0.0

    return pd.Series([one(*map(int, v)) for v in zip(n_ab, n_a, n_b, n)], dtype="float64")


def kinds(df: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """(variable, n, missing, levels, numbers, kind): continuous where nearly all values are numbers and there are many of them, else categorical."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns))).alias("x")).select("x.*")
    each = long.groupBy("variable", "v").agg(F.count(F.lit(1)).alias("k"))
    m = each.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("missing"), F.count("v").alias("levels"),
        F.coalesce(F.sum(F.when(F.col("v").try_cast("double").isNotNull(), F.col("k"))), F.lit(0)).alias("numbers"),
    )
    return m.withColumn("kind", F.when((F.col("levels") > most) & (F.col("numbers") >= LEAST_NUMBERS * F.col("n")), "continuous").otherwise("categorical"))


def suited_test(continuous: bool, groups: int, normal: bool = True, equal_spread: bool = True, least_expected: float = math.inf) -> str:
    """The test for a variable: by its kind, the number of groups, and what the checks of its assumptions said."""
    if not continuous:
        return "fisher" if groups == 2 and least_expected < 5 else "chi squared"
    if groups == 2:
        return ("student t" if equal_spread else "welch t") if normal else "mann-whitney"
    return "anova" if normal and equal_spread else "kruskal-wallis"
