"""Suitability for factor analysis, number of factors and rotated loadings, from one pass of cross-products.

Rows are reduced to a correlation matrix by Spark; only that matrix, as large as the number of items squared, is on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.functions import special


def correlation_matrix(answers: DataFrame, items: list[str]) -> tuple[int, np.ndarray]:
    """Complete rows and the items' correlations; NaN answers count as missing."""
    x = answers.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(items))).dropna()
    pairs = [(i, j) for i in range(len(items)) for j in range(i)]
    row = x.agg(F.count(F.lit(1)).alias("n"), *(F.corr(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    r = np.eye(len(items))
    for i, j in pairs:
        c = row[f"c{i}_{j}"]
        r[i, j] = r[j, i] = np.nan if c is None else c
    return row.n, r


@dataclass(frozen=True)
class Suitability:
    n: int
    kmo: float
    chi2: float
    df: int
    p: float


def suitability(n: int, r: np.ndarray) -> Suitability:
    """Kaiser, Meyer and Olkin's measure and Bartlett's test of sphericity; NaN where an item is constant or the matrix singular."""
    k = len(r)
    df = k * (k - 1) // 2
    sign, logarithm = np.linalg.slogdet(r) if np.isfinite(r).all() else (0.0, np.nan)
    if sign <= 0 or n < 2:
        return Suitability(n, np.nan, np.nan, df, np.nan)
    inverse, off = np.linalg.inv(r), ~np.eye(k, dtype=bool)
    partial = inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    plain, rest = (r[off] ** 2).sum(), (partial[off] ** 2).sum()
    chi2 = -(n - 1 - (2 * k + 5) / 6) * logarithm
    return Suitability(n, float(plain / (plain + rest)), float(chi2), df, float(special.chi2_upper(chi2, df)))


def factors_by_parallel_analysis(n: int, r: np.ndarray, repeats: int = 100, seed: int = 1) -> tuple[int, int]:
    """Factors to keep: by eigenvalues above 1, and above the mean eigenvalues of random data of the same shape.

    Random correlation matrices are drawn as Wishart ones, so the work doesn't grow with n.
    """
    k, rng = len(r), np.random.default_rng(seed)
    own = np.linalg.eigvalsh(r)[::-1]
    drawn = []
    for _ in range(repeats):
        root = np.tril(rng.normal(size=(k, k)), -1) + np.diag(np.sqrt(rng.chisquare(np.maximum(n - 1 - np.arange(k), 1))))
        s = root @ root.T
        d = np.sqrt(np.diag(s))
        drawn.append(np.linalg.eigvalsh(s / np.outer(d, d))[::-1])
    over = own > np.mean(drawn, axis=0)
    return int((own > 1).sum()), int(over.argmin()) if not over.all() else k


def loadings(r: np.ndarray, factors: int, turns: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Principal-component loadings after Varimax (Kaiser, 1958: each pair of factors turned by its best angle), and communalities. Each factor's largest loading is positive."""
    values, vectors = np.linalg.eigh(r)
    a = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors], 0))
    b, k = a.copy(), len(a)
    for _ in range(turns):
        most = 0.0
        for i, j in ((i, j) for j in range(factors) for i in range(j)):
            x, y = b[:, i].copy(), b[:, j].copy()
            u, v = x * x - y * y, 2 * x * y
            angle = np.arctan2(2 * (u @ v) - 2 * u.sum() * v.sum() / k, (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / k) / 4
            b[:, i], b[:, j] = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
            most = max(most, abs(angle))
        if most < 1e-9:
            break
    b = b * np.where(b[np.abs(b).argmax(0), np.arange(factors)] < 0, -1, 1)
    return b, (b**2).sum(1)
