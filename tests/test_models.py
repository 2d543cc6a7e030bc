"""Regressions against numpy, and the model of repeated measures against the likelihood of whole matrices."""

import numpy as np
import pytest

from graywacke.operators import gram, mixed_model


def test_regression_of_groups_against_least_squares(spark):
    rng = np.random.default_rng(1)
    rows, told = [], {}
    for g, n in (("a", 60), ("b", 9), ("few", 3)):
        x = rng.normal(size=(n, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 5]
        y = x @ [2, 1e-4, -300] + rng.normal(size=n)
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
        told[g] = (np.column_stack([np.ones(n), x]), y)
    rows += [("a", None, 1.0, 1.0, 1.0), ("flat", 1.0, 2.0, 3.0, 4.0), *(("line", float(i), 2.0 * i, float(i * i), float(i)) for i in range(9))]
    found = {}
    for r in gram.regression(spark.createDataFrame(rows, "g string, p double, q double, r double, y double"), "y", ["p", "q", "r"], ["g"]).collect():
        found.setdefault(r.g, {})[r.term] = r
    for g in ("a", "b"):
        x, y = told[g]
        beta, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
        s2 = float(rest[0]) / (len(y) - 4)
        errors = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
        for k, term in enumerate(("intercept", "p", "q", "r")):
            assert found[g][term].estimate == pytest.approx(beta[k], rel=1e-5) and found[g][term].se == pytest.approx(errors[k], rel=1e-4) and found[g][term].df == len(y) - 4
    assert all(found[g][t].estimate is None for g in ("few", "flat", "line") for t in ("intercept", "p"))


def test_a_covariate_that_explains_the_path_takes_it_away(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=400)
    x, m, y = c + rng.normal(size=400), c + rng.normal(size=400), c + rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, m, y, c))], "k long, x double, m double, y double, c double")
    plain, adjusted = (gram.mediation(df, "x", "m", "y", more).first() for more in ([], ["c"]))
    assert plain.p < 0.001 and adjusted.p > 0.05 and adjusted.total == pytest.approx(adjusted.direct + adjusted.indirect)
    reps = gram.bootstrap_mediation(df, "k", "x", "m", "y", ["c"], 60, 1)
    interval = gram.percentile_interval(reps, "indirect").first()
    assert interval.repeats == 60 and interval.low < adjusted.indirect < interval.high and interval.high - interval.low < 20 * adjusted.se
    dealt = gram.bootstrap_mediation(df.repartition(3), "k", "x", "m", "y", ["c"], 60, 1)
    assert [r.indirect for r in reps.orderBy("rep").collect()] == pytest.approx([r.indirect for r in dealt.orderBy("rep").collect()])


def dense(subjects, sigma, groups, k):
    """-2 log restricted likelihood from the whole design and covariance of all values."""
    xs, ys, blocks = [], [], []
    for g, at, values in subjects:
        for i, v in zip(at, values):
            xs.append(np.eye(groups * k)[g * k + i])
            ys.append(v)
        blocks.append(sigma[np.ix_(at, at)])
    n = len(ys)
    v, x, y = np.zeros((n, n)), np.array(xs), np.array(ys)
    at = 0
    for b in blocks:
        v[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    w = np.linalg.inv(v)
    m = x.T @ w @ x
    beta = np.linalg.solve(m, x.T @ w @ y)
    r = y - x @ beta
    return np.linalg.slogdet(v)[1] + np.linalg.slogdet(m)[1] + r @ w @ r + (n - groups * k) * np.log(2 * np.pi), beta, np.sqrt(np.diag(np.linalg.inv(m)))


def test_repeated_measures_with_missing_values_against_the_whole_likelihood(spark):
    rng = np.random.default_rng(3)
    true = np.array([[4, 2, 1], [2, 5, 2.5], [1, 2.5, 6.0]])
    rows, subjects = [], []
    for s in range(70):
        g = s % 2
        values = rng.multivariate_normal([10, 11 + g, 12 + 2 * g], true)
        at = [i for i in range(3) if rng.random() < (1, 0.8, 0.6)[i]]
        rows += [(s, f"t{i}", float(values[i]), "ab"[g]) for i in at] + [(s, "t1", None, "ab"[g])]
        subjects.append((g, at, values[at]))
    long = spark.createDataFrame(rows, "s long, t string, x double, g string")
    found = mixed_model.fit(long, "s", "t", "x", "g", ["t0", "t1", "t2"])
    value, beta, errors = dense(subjects, found.covariance, 2, 3)
    assert found.converged and found.n == 70 and found.minus_2_log_likelihood == pytest.approx(value)
    assert found.means.ravel() == pytest.approx(beta) and found.errors.ravel() == pytest.approx(errors)
    for _ in range(60):  # no covariance nearby does better
        step = rng.normal(size=(3, 3)) * 0.05
        assert dense(subjects, found.covariance + step + step.T, 2, 3)[0] >= value - 1e-8
    told = {(r.group, r.time): r for r in mixed_model.differences(spark, found, "a").collect()}
    assert told["b", "t2"].difference == pytest.approx(beta[5] - beta[2]) and set(told) == {("b", f"t{i}") for i in range(3)}
    assert mixed_model.means(spark, found).count() == 6


def test_complete_data_give_the_pooled_covariance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 2)) @ [[1, 0.5], [0, 1]]
    long = spark.createDataFrame([(s, t, float(x[s, t]), s % 2) for s in range(20) for t in range(2)], "s long, t long, x double, g long")
    found = mixed_model.fit(long, "s", "t", "x", "g", [0, 1])
    rest = np.concatenate([x[g::2] - x[g::2].mean(0) for g in (0, 1)])
    assert found.covariance == pytest.approx(rest.T @ rest / 18, rel=1e-6)
    for wrong in (lambda: mixed_model.fit(long.filter("g = 0 or t = 0"), "s", "t", "x", "g", [0, 1]), lambda: mixed_model.fit(long.limit(0), "s", "t", "x", "g", [0, 1]), lambda: mixed_model.fit(long, "s", "t", "x", "g", [0])):
        with pytest.raises(ValueError):
            wrong()
