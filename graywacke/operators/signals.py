"""Spectra of evenly sampled series: Welch's method over bounded segments, band powers, edge and peak frequencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names and limits in Hz, lower one included.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def welch(samples: DataFrame, series: str, order: str, value: str, rate: float, length: int = 256) -> DataFrame:
    """(series, bin, frequency, power): one-sided densities, the mean over Hann-windowed segments of `length` samples, half overlapping.

    order numbers the samples of a series from 0 without gaps. A segment is what goes to one call, so that no series is ever
    gathered whole. Segments with a missing or null sample are left out; a series shorter than a segment has no spectrum.
    """
    step = length // 2
    i = F.col(order)
    x = samples.select(F.col(series).alias("series"), i.alias("i"), F.col(value).cast("double").alias("x"))
    last = F.floor(F.col("i") / step)
    each = x.withColumn("segment", F.explode(F.array(last, last - 1))).filter(f"segment >= 0 and i < segment * {step} + {length}")
    packed = each.groupBy("series", "segment").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    packed = packed.select("series", F.col("s.x").alias("s")).filter(f"size(s) = {length} and not exists(s, v -> v is null or isnan(v))")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    scale = np.full(length // 2 + 1, 2.0)
    scale[0] = 1.0
    if length % 2 == 0:
        scale[-1] = 1.0

    @F.pandas_udf("array<double>")
    def density(segments: pd.Series) -> pd.Series:
        s = np.stack(segments.to_list()) if len(segments) else np.zeros((0, length))
        spectrum = np.fft.rfft((s - s.mean(1, keepdims=True)) * window, axis=1)
        return pd.Series(list(np.abs(spectrum) ** 2 * scale / (rate * (window**2).sum())))

    bins = packed.select("series", F.posexplode(density("s")).alias("bin", "p")).groupBy("series", "bin").agg(F.avg("p").alias("power"))
    return bins.select("series", "bin", (F.col("bin") * rate / length).alias("frequency"), "power")


def band_powers(spectrum: DataFrame, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """For each series and band the sum of its bins' densities times their width, and its share of all bands'."""
    named = F.coalesce(*(F.when((F.col("frequency") >= low) & (F.col("frequency") < high), F.lit(name)) for name, (low, high) in bands.items()))
    width = spectrum.filter("bin = 1").select(F.col("series").alias("of"), F.col("frequency").alias("width"))
    power = spectrum.withColumn("band", named).filter("band is not null").groupBy("series", "band").agg(F.sum("power").alias("total"))
    power = power.join(width, F.expr("series <=> of")).selectExpr("series", "band", "total * width as absolute")
    return power.withColumn("relative", F.expr("absolute / nullif(sum(absolute) over (partition by series), 0)"))


def edges(spectrum: DataFrame, share: float = 0.95) -> DataFrame:
    """For each series the frequency below which that share of the power lies, and the frequency of its highest bin above 0."""
    run = Window.partitionBy("series").orderBy("bin")
    rows = spectrum.filter("bin > 0").withColumns({"run": F.sum("power").over(run), "total": F.sum("power").over(Window.partitionBy("series"))})
    reached = F.min(F.when(F.col("run") >= share * F.col("total"), F.col("frequency")))
    return rows.groupBy("series").agg(reached.alias("edge"), F.max_by("frequency", F.struct("power", -F.col("bin"))).alias("peak"))
