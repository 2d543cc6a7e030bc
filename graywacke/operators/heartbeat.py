"""Beat-to-beat series: gaps, ectopic beats, an even grid, LF and HF power, sample entropy, and summaries over epochs.

A long series is never one group: it is cut into blocks with a halo of neighbours, so that windows and kernels have bounded input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from graywacke.operators import signals

#: Beats in a block; beats on either side that a median is taken over; the longest run that is bridged; share of the median that makes a beat ectopic.
BLOCK, REACH, LONGEST, ECTOPIC = 1000, 5, 10, 0.2
#: Hz of the even grid, and of the bands.
RATE, BANDS = 4.0, {"lf": (0.04, 0.15), "hf": (0.15, 0.4)}
#: Templates that a kernel compares with all others of its cell at once.
CHUNK = 512


def haloed(rows: DataFrame, at: str, block: float, before: float, after: float) -> DataFrame:
    """rows in blocks of their place (column block), and again in the next or last block where they are nearer than before or after; own: in their own."""
    if max(before, after) > block:
        raise ValueError("a halo is not wider than a block")
    b = F.floor(F.col(at) / block)
    later, earlier = F.when(F.col(at) >= (b + 1) * block - before, b + 1), F.when(F.col(at) < b * block + after, b - 1)
    return rows.withColumn("block", F.explode(F.array_compact(F.array(b, later, earlier)))).withColumn("own", F.col("block") == F.floor(F.col(at) / block))


def stretches(samples: DataFrame, series: str, time: str, longest: float) -> DataFrame:
    """(series, n, n_gaps, observed, discarded): time between neighbouring samples, where it is at most longest, and the rest, in which nothing
    was recorded (a device asleep). time: a number, longest in its unit."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(series).orderBy(time))
    d = samples.filter(F.col(time).isNotNull()).select(F.col(series).alias("series"), step.alias("d"))
    gap = F.col("d") > longest
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("n_gaps"), F.coalesce(F.sum(F.when(~gap, F.col("d"))), F.lit(0.0)).alias("observed"), F.coalesce(F.sum(F.when(gap, F.col("d"))), F.lit(0.0)).alias("discarded"))


def median(values: Column) -> Column:
    """Of an array of numbers."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def without_ectopic(beats: DataFrame, series: str, order: str, value: str, share: float = ECTOPIC, reach: int = REACH, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(series, i, x, ectopic, corrected): a beat is ectopic if it is further than share of it from the running median of the reach beats on
    either side and its own. It is replaced along a line between the last good beat before and the next after it, or by the only one
    of them, within longest beats; else corrected is null. order numbers the beats of a series. A null interval counts as ectopic.
    """
    x = beats.select(F.col(series).alias("series"), F.col(order).alias("i"), F.col(value).cast("double").alias("x"))
    rows = haloed(x, "i", block, reach + longest, reach + longest)
    run = Window.partitionBy("series", "block").orderBy("i")
    middle = median(F.collect_list("x").over(run.rowsBetween(-reach, reach)))
    judged = rows.withColumn("m", middle).withColumn("ectopic", F.coalesce(F.abs(F.col("x") - F.col("m")) > share * F.col("m"), F.lit(True)))
    good = F.when(~F.col("ectopic"), F.struct("i", "x"))
    near = judged.withColumns({"a": F.last(good, ignorenulls=True).over(run.rowsBetween(-longest, -1)), "b": F.first(good, ignorenulls=True).over(run.rowsBetween(1, longest))})
    line = F.expr("a.x + (b.x - a.x) * (i - a.i) / (b.i - a.i)")
    return near.filter("own").select("series", "i", "x", "ectopic", F.when(~F.col("ectopic"), F.col("x")).otherwise(F.coalesce(line, F.col("a.x"), F.col("b.x"))).alias("corrected"))


def even(beats: DataFrame, series: str, time: str, value: str, rate: float = RATE, longest: float = 5.0, block: float = 600.0) -> DataFrame:
    """(series, k, x): values at k / rate, on the line between the known values about it, if those are at most longest seconds apart.

    Each pair of neighbours gives the points between them: no point looks for its neighbours. Nulls are no known values.
    """
    x = beats.select(F.col(series).alias("series"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x")).dropna(subset=["t", "x"])
    run = Window.partitionBy("series", "block").orderBy("t", "x")
    pairs = haloed(x, "t", block, 0.0, longest * 1.000001).withColumns({"t2": F.lead("t").over(run), "x2": F.lead("x").over(run)}).filter(f"own and t2 - t <= {longest}")
    first, last = F.ceil(F.col("t") * rate), F.ceil(F.col("t2") * rate) - 1
    points = pairs.withColumns({"k0": first, "k1": last}).filter("k0 <= k1").select("series", "t", "t2", "x", "x2", F.explode(F.sequence("k0", "k1")).alias("k"))
    return points.select("series", "k", F.expr(f"x + (x2 - x) * (k / {rate} - t) / (t2 - t)").alias("x"))


def lf_hf(beats: DataFrame, series: str, time: str, value: str, rate: float = RATE, length: int = 256, longest: float = 5.0, block: float = 600.0, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(series, lf, hf, lf_hf): power of intervals in the low and the high band, by Welch's method on an even grid, and their ratio."""
    powers = signals.band_powers(signals.welch(even(beats, series, time, value, rate, longest, block), "series", "k", "x", rate, length), bands)
    of = {c: F.sum(F.when(F.col("band") == c, F.col("absolute"))).alias(c) for c in ("lf", "hf")}
    return powers.groupBy("series").agg(*of.values()).withColumn("lf_hf", F.expr("lf / nullif(hf, 0)"))


@F.pandas_udf(ArrayType(LongType()))
def pairs_within(r: pd.Series, own: pd.Series, others: pd.Series) -> pd.Series:
    """For templates as rows of x..., weight: how many pairs, own with own and own with others, are within r in all but the last place, and in all."""
    out = []
    for limit, mine, near in zip(r, own, others):
        a = np.array([list(t) for t in mine], float)
        b = np.array([list(t) for t in near], float) if len(near) else a[:0]
        b = np.concatenate([a, b])
        w, v = a[:, -1], b[:, -1]
        # Within the cell each pair counts once: a template with later ones, and with its own copies.
        short = full = (w * (w - 1) / 2).sum()
        for at in range(0, len(a), CHUNK):
            part = a[at : at + CHUNK]
            close = np.abs(part[:, None, :-1] - b[None, :, :-1]) <= limit
            close[np.arange(len(b))[None, :] <= (at + np.arange(len(part)))[:, None]] = False
            weight = part[:, -1][:, None] * v[None, :]
            short += weight[close[:, :, :-1].all(2)].sum()
            full += weight[close.all(2)].sum()
        out.append([int(short), int(full)])
    return pd.Series(out)


def sample_entropy(samples: DataFrame, series: str, order: str, value: str, m: int = 2, share: float = 0.2, block: int = BLOCK) -> DataFrame:
    """(series, n, r, b, a, entropy): sample entropy (Richman and Moorman, 2000): -ln(a / b) of pairs of templates of m and m + 1 samples that
    differ by at most r = share of the standard deviation everywhere; null where no pair of m + 1 does.

    order numbers the samples of a series without gaps; templates with a null are left out. Templates are dealt into cells of width r by
    their first two samples, equal ones counted as one, and a cell meets itself and four of its neighbours: no series meets itself whole.
    """
    if m < 2:
        raise ValueError("templates have two samples at least")
    x = samples.select(F.col(series).alias("series"), F.col(order).alias("i"), F.col(value).cast("double").alias("x"))
    scale = x.groupBy("series").agg(F.count("x").alias("n"), (share * F.stddev_samp("x")).alias("r"))
    run = Window.partitionBy("series", "block").orderBy("i")
    each = haloed(x, "i", block, 0, m).withColumns({f"x{k}": F.lead("x", k).over(run) for k in range(m + 1)}).filter("own").dropna(subset=[f"x{k}" for k in range(m + 1)])
    places = [f"x{k}" for k in range(m + 1)]
    alike = each.groupBy("series", *places).agg(F.count(F.lit(1)).cast("double").alias("w")).join(scale.filter("r > 0"), "series")
    alike = alike.withColumns({"c0": F.floor(F.col("x0") / F.col("r")), "c1": F.floor(F.col("x1") / F.col("r"))})
    template = F.array(*places, "w")
    cells = F.array(*(F.struct((F.col("c0") - a).alias("c0"), (F.col("c1") - b).alias("c1"), F.lit(a == b == 0).alias("own")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    dealt = alike.select("series", "r", template.alias("t"), F.explode(cells).alias("c")).select("series", "r", "t", "c.*")
    met = dealt.groupBy("series", "c0", "c1").agg(F.max("r").alias("r"), F.collect_list(F.when(F.col("own"), F.col("t"))).alias("mine"), F.collect_list(F.when(~F.col("own"), F.col("t"))).alias("near"))
    counts = met.filter("size(mine) > 0").select("series", pairs_within("r", "mine", "near").alias("p"))
    total = counts.groupBy("series").agg(F.sum(F.col("p")[0]).alias("b"), F.sum(F.col("p")[1]).alias("a"))
    found = scale.join(total, "series", "left").na.fill(0, ["a", "b"])
    return found.withColumn("entropy", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))))


def epochs(samples: DataFrame, series: str, order: str, value: str, rate: float, samples_per_epoch: int, length: int, bands: dict[str, tuple[float, float]] = signals.BANDS) -> DataFrame:
    """(series, epoch, band, absolute, relative): band powers of each epoch of a series; order numbers its samples from 0."""
    cut = samples.select(F.struct(F.col(series).alias("series"), F.floor(F.col(order) / samples_per_epoch).alias("epoch")).alias("of"), (F.col(order) % samples_per_epoch).alias("i"), F.col(value).alias("x"))
    return signals.band_powers(signals.welch(cut, "of", "i", "x", rate, length), bands).select("series.series", "series.epoch", "band", "absolute", "relative")


def epoch_summary(each: DataFrame) -> DataFrame:
    """From epochs(): (series, band, n, mean, sd, low, high) of the absolute power and relative, its mean share."""
    return each.groupBy("series", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("absolute").alias("mean"), F.stddev_samp("absolute").alias("sd"), F.min("absolute").alias("low"), F.max("absolute").alias("high"), F.avg("relative").alias("relative"))


def slowing(powers: DataFrame, slow: tuple[str, ...] = ("delta", "theta"), fast: tuple[str, ...] = ("alpha", "beta")) -> DataFrame:
    """(series, slowing): power of the slow bands over that of the fast ones. powers: from band_powers()."""
    power = lambda bands: F.sum(F.when(F.col("band").isin(*bands), F.col("absolute")))
    return powers.groupBy("series").agg((power(slow) / F.nullif(power(fast), F.lit(0.0))).alias("slowing"))
