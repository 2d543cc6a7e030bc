"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt into: a range is ranked in one task.
RANGES = 64


def ranges(df: DataFrame, value: str, n: int = RANGES) -> Column:
    """The number of the range that a value is in, for about n ranges of equally many rows of df.

    The bounds are constants, so that a row's range is the same however often and wherever it is computed.
    """
    bounds = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.1 / n)))
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(value)))


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """(by..., value, ties, below): for each distinct value how many rows have it and how many rows are smaller.

    With groups, ranks are within each group, and a group's values are ranked in one task. Without, or if groups are dealt (few and large), values
    are dealt by range; a range's rows are ranked in it and the totals of the ranges before it, a row for each range, are added.
    """
    keys = by or []
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    if by and not dealt:
        before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("below", F.coalesce(F.sum("ties").over(before), F.lit(0)))
    dealt_out = counts.withColumn("part", ranges(counts.withColumn(value, F.col(value).cast("double")), value))
    totals = dealt_out.groupBy(*keys, "part").agg(F.sum("ties").alias("total"))
    start = totals.withColumn("start", F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    before = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt_out.withColumn("inside", F.coalesce(F.sum("ties").over(before), F.lit(0)))
    # RANGES rows a group, and groups are few where they are dealt.
    return inside.join(F.broadcast(start), [*keys, "part"]).select(*keys, value, "ties", (F.col("inside") + F.col("start")).alias("below"))


def quantiles(df: DataFrame, value: str, by: list[str], **shares: float) -> DataFrame:
    """(by..., name...): exact quantiles of few large groups, interpolated between neighbours; no group's values meet in one buffer."""
    ranked = value_ranks(df, value, by, dealt=True)
    n = ranked.groupBy(*by).agg(F.sum("ties").alias("n"))
    rows = ranked.join(F.broadcast(n), by)
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("ties")), F.col(value)))
    cells = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(float(share))
        cells += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
    found = rows.groupBy(*by).agg(F.max("n").alias("n"), *cells)
    return found.select(*by, *(F.expr(f"{name}_low + ((n - 1) * {float(share)}D - floor((n - 1) * {float(share)}D)) * ({name}_high - {name}_low)").alias(name) for name, share in shares.items()))


def mid_rank() -> Column:
    return F.col("below") + (F.col("ties") + 1) / 2
