"""Mixed model for repeated measures (MMRM): means by group and time with an unstructured covariance, by restricted maximum likelihood.

The data are aggregated to sufficient statistics, one row for each group and pattern of missing times (number, means and cross-products of
what is there). Fisher scoring then works on matrices of as many rows as there are times: what the driver holds is bounded
by MOST_TIMES and MOST_ROWS, not by subjects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.functions.special import t_two_sided

MOST_TIMES, MOST_ROWS, MOST_STEPS = 12, 20_000, 200


@dataclass(frozen=True)
class Fit:
    groups: list
    times: list
    means: np.ndarray
    errors: np.ndarray
    covariance: np.ndarray
    minus_2_log_likelihood: float
    n: int
    converged: bool


def statistics(long: DataFrame, subject: str, time: str, value: str, group: str, times: list) -> DataFrame:
    """(g, seen, n, means, cross): of the subjects of a group whose observed times are seen (bit k for times[k]), means and centred sums of
    products over the times, null where unseen. A subject's values at one time are averaged; times that aren't listed are left out."""
    k = len(times)
    x = long.select(F.col(subject).alias("s"), F.col(group).alias("g"), F.col(time).alias("t"), F.col(value).cast("double").alias("x")).dropna().filter(F.col("t").isin(times))
    wide = x.groupBy("s", "g").agg(*(F.avg(F.when(F.col("t") == F.lit(t), F.col("x"))).alias(f"x{i}") for i, t in enumerate(times)))
    seen = sum((F.when(F.col(f"x{i}").isNotNull(), 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    m = wide.withColumn("seen", seen).groupBy("g", "seen").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k)), *((F.covar_pop(f"x{i}", f"x{j}") * F.count(F.lit(1))).alias(f"c{i}_{j}") for i, j in pairs))
    return m.select("g", "seen", "n", F.array(*(f"m{i}" for i in range(k))).alias("means"), F.array(*(f"c{max(i, j)}_{min(i, j)}" for i in range(k) for j in range(k))).alias("cross"))


class _Pattern:
    def __init__(self, group: int, seen: int, n: int, means: list, cross: list, k: int):
        self.at = [i for i in range(k) if seen >> i & 1]
        self.group, self.n, self.box = group, n, np.ix_(self.at, self.at)
        self.mean = np.array([means[i] for i in self.at], float)
        self.cross = np.array([[cross[i * k + j] for j in self.at] for i in self.at], float)


def _state(sigma: np.ndarray, patterns: list[_Pattern], groups: int) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """-2 log restricted likelihood, means, their covariances by group, and for each pattern the inverse and the residual products, in full size."""
    k = len(sigma)
    inverses, information, score, value = [], np.zeros((groups, k, k)), np.zeros((groups, k)), 0.0
    for p in patterns:
        part = np.linalg.inv(sigma[p.box])
        value += p.n * np.linalg.slogdet(sigma[p.box])[1]
        whole = np.zeros((k, k))
        whole[p.box] = part
        inverses.append(whole)
        information[p.group] += p.n * whole
        score[p.group, p.at] += p.n * part @ p.mean
    spread = np.linalg.inv(information)
    means = np.einsum("gij,gj->gi", spread, score)
    value += np.linalg.slogdet(information)[1].sum()
    residuals = []
    for p, inverse in zip(patterns, inverses):
        d = p.mean - means[p.group, p.at]
        whole = np.zeros((k, k))
        whole[p.box] = p.cross + p.n * np.outer(d, d)
        value += (inverse * whole).sum()
        residuals.append(whole)
    return value, means, spread, inverses, residuals


def fit(long: DataFrame, subject: str, time: str, value: str, group: str, times: list) -> Fit:
    """The model of these times. ValueError where a group has no value at one of them, where there are too many times or rows, or too few subjects."""
    k = len(times)
    if not 2 <= k <= MOST_TIMES:
        raise ValueError(f"from 2 to {MOST_TIMES} times")
    rows = statistics(long, subject, time, value, group, times).orderBy("g", "seen").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} groups and patterns")
    names = sorted({r.g for r in rows})
    patterns = [_Pattern(names.index(r.g), r.seen, r.n, r.means, r.cross, k) for r in rows]
    for g in range(len(names)):
        if {i for p in patterns if p.group == g for i in p.at} != set(range(k)):
            raise ValueError(f"group {names[g]} has no value at some time")
    n = sum(p.n for p in patterns)
    if not names or n - len(names) < k:
        raise ValueError("too few subjects")
    basis = [np.outer(a, b) + (np.outer(b, a) if i != j else 0) for i, a in enumerate(np.eye(k)) for j, b in enumerate(np.eye(k)) if j <= i]
    within = [sum(p.cross[p.at.index(i), p.at.index(i)] for p in patterns if i in p.at) / max(1, sum(p.n for p in patterns if i in p.at) - len(names)) for i in range(k)]
    sigma = np.diag([max(v, 1e-12) for v in within])
    state, converged = _state(sigma, patterns, len(names)), False
    for _ in range(MOST_STEPS):
        _, _, spread, inverses, residuals = state
        size = len(basis)
        gradient, hessian, sums = np.zeros(size), np.zeros((size, size)), np.zeros((len(names), size, k, k))
        for p, w, r in zip(patterns, inverses, residuals):
            c = spread[p.group]
            wsw = np.array([w @ s @ w for s in basis])
            gradient += np.einsum("aij,ji->a", wsw, r) - p.n * (np.array([(w * s).sum() for s in basis]) - np.einsum("aij,ji->a", wsw, c))
            hessian += p.n * (np.einsum("aij,bji->ab", wsw, np.array(basis)) - 2 * np.einsum("aij,bji->ab", np.array([c @ m for m in wsw]), np.array([s @ w for s in basis])))
            sums[p.group] += p.n * wsw
        for c, a in zip(spread, sums):
            ca = np.array([c @ m for m in a])
            hessian += np.einsum("aij,bji->ab", ca, ca)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        change, length = sum(s * b for s, b in zip(step, basis)), 1.0
        while length > 1e-10:
            trial = sigma + length * change
            if np.linalg.eigvalsh(trial)[0] > 0 and (new := _state(trial, patterns, len(names)))[0] <= state[0] + 1e-12 * abs(state[0]):
                break
            length /= 2
        else:
            converged = bool(np.abs(gradient).max() < 1e-3)
            break
        done = np.abs(length * change).max() <= 1e-10 * np.abs(sigma).max()
        sigma, state = trial, new
        if done:
            converged = True
            break
    value_, means, spread, *_ = state
    free = sum(p.n * len(p.at) for p in patterns) - len(names) * k
    return Fit(names, list(times), means, np.sqrt(np.einsum("gii->gi", spread)), sigma, float(value_ + free * np.log(2 * np.pi)), n, converged)


def means(spark, found: Fit) -> DataFrame:
    """(group, time, mean, se) as strings for group and time."""
    rows = [(str(g), str(t), float(found.means[i, j]), float(found.errors[i, j])) for i, g in enumerate(found.groups) for j, t in enumerate(found.times)]
    return spark.createDataFrame(rows, "group string, time string, mean double, se double")


def differences(spark, found: Fit, reference) -> DataFrame:
    """(group, time, difference, se, t, df, p) against the reference group at each time. df: subjects less groups, the exact one where no
    value is missing."""
    base, df = found.groups.index(reference), found.n - len(found.groups)
    rows = []
    for i, g in enumerate(found.groups):
        for j, t in enumerate(found.times if i != base else []):
            d, se = found.means[i, j] - found.means[base, j], float(np.hypot(found.errors[i, j], found.errors[base, j]))
            rows.append((str(g), str(t), float(d), se, float(d / se), float(df), float(t_two_sided(d / se, df))))
    return spark.createDataFrame(rows, "group string, time string, difference double, se double, t double, df double, p double")
