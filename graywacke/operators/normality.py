"""Shapiro and Wilk's test by group (Royston, 1995)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.functions import special

#: The approximation holds up to so many values.
MOST = 5000

# Polynomials of the published approximation, lowest power first.
LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_SD = (0.544, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of 4 to MOST values that are not all equal; else NaN."""
    x, n = np.sort(x), len(x)
    if not 4 <= n <= MOST or x[0] == x[-1]:
        return np.nan, np.nan
    value = np.polynomial.polynomial.polyval
    m = np.array([special.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, root = (m * m).sum(), 1 / np.sqrt(n)
    a = m / np.sqrt(square)
    last = value(root, LAST) + a[-1]
    if n > 5:
        second = value(root, SECOND) + a[-2]
        rest = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / np.sqrt(rest)
        a[[0, 1, -2, -1]] = -last, -second, second, last
    else:
        a = m / np.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[0, -1]] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    below = np.log(max(1 - w, 1e-300))
    if n < 12:
        room = 0.459 * n - 2.273
        if below >= room:
            return w, 1e-99
        z = (-np.log(room - below) - value(n, SMALL_MEAN)) / np.exp(value(n, SMALL_SD))
    else:
        z = (below - value(np.log(n), LARGE_MEAN)) / np.exp(value(np.log(n), LARGE_SD))
    p = float(special.normal_two_sided(abs(z))) / 2
    return w, p if z > 0 else 1 - p


def by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, w, p). Groups of more than MOST values are counted and not tested, so that none is gathered beyond that."""
    x = df.select(F.col(group).alias("group"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("x")).dropna()
    counts = x.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    small = x.join(counts.filter(f"n <= {MOST}").select("group"), "group", "left_semi")

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *shapiro_wilk(rows.x.to_numpy()))], columns=["group", "w", "p"])

    kind = x.schema["group"].dataType.simpleString()
    tested = small.groupBy("group").applyInPandas(test, f"group {kind}, w double, p double")
    return counts.join(tested, "group", "left")
