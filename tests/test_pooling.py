"""Pooled effects against plain numpy."""

import numpy as np
import pytest

from graywacke.operators import pooling


def studies(spark, y, v):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, v))] + [(97, None, 1.0), (98, 1.0, None), (99, 1.0, 0.0)], "study long, y double, v double")


def test_tau_squared_by_two_estimators(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(0.05, 0.6, 25)
    y = rng.normal(0.3, np.sqrt(v + 0.4))
    df = studies(spark, y, v)
    pm, reml = (pooling.tau2(df, "y", "v", k).first().tau2 for k in ("pm", "reml"))
    w = 1 / (v + pm)
    assert (w * (y - (w * y).sum() / w.sum()) ** 2).sum() == pytest.approx(24)

    def loss(t):
        w = 1 / (v + t)
        return np.log(v + t).sum() + np.log(w.sum()) + (w * (y - (w * y).sum() / w.sum()) ** 2).sum()

    assert reml > 0 and all(loss(reml) <= loss(reml * f) for f in (0.9, 0.99, 0.999, 1.001, 1.01, 1.1))
    same = studies(spark, np.full(5, 0.2), np.full(5, 0.1))
    assert [pooling.tau2(same, "y", "v", k).first().tau2 for k in ("pm", "reml")] == [0.0, 0.0]
    with pytest.raises(ValueError):
        pooling.tau2(df, "y", "v", "dl")


def test_left_out_studies_and_egger(spark):
    rng = np.random.default_rng(2)
    v = rng.uniform(0.05, 0.6, 9)
    y = rng.normal(0.3, np.sqrt(v + 0.3))
    for r in pooling.left_out(studies(spark, y, v), "study", "y", "v").collect():
        a, b = np.delete(y, r.study), np.delete(v, r.study)
        w = 1 / b
        q = (w * (a - (w * a).sum() / w.sum()) ** 2).sum()
        tau = max(0, (q - 7) / (w.sum() - (w**2).sum() / w.sum()))
        u = 1 / (b + tau)
        assert (r.tau2, r.random, r.se) == pytest.approx((tau, (u * a).sum() / u.sum(), 1 / np.sqrt(u.sum())))
    found = pooling.egger(studies(spark, y, v), "y", "v").first()
    x = np.column_stack([np.ones(9), 1 / np.sqrt(v)])
    beta, rest = np.linalg.lstsq(x, y / np.sqrt(v), rcond=None)[:2]
    assert (found.intercept, found.slope, found.se) == pytest.approx((beta[0], beta[1], np.sqrt(rest[0] / 7 * np.linalg.inv(x.T @ x)[0, 0])))


def brute_fill(y, v):
    n, k = len(y), 0
    order = sorted(range(n), key=lambda i: (-y[i], v[i], i))
    for _ in range(20):
        left = order[k:]
        c = sum(y[i] / v[i] for i in left) / sum(1 / v[i] for i in left)
        d = [a - c for a in y]
        sizes = sorted(map(abs, d))
        t = sum(sizes.index(abs(x)) + (sizes.count(abs(x)) + 1) / 2 for x in d if x > 0)
        new = min(n - 2, max(0, int((4 * t - n * (n + 1)) / (2 * n - 1) + 0.5)))
        if new == k:
            break
        k = new
    return k, c


@pytest.mark.parametrize("side", ["left", "right"])
def test_trim_and_fill_mirrors_what_is_in_excess(spark, side):
    rng = np.random.default_rng(3)
    v = rng.uniform(0.02, 0.9, 30)
    y = rng.normal(0, np.sqrt(v))
    keep = ~((y < -0.3) & (v > 0.3))  # small studies without an effect were never published
    y, v = y[keep], v[keep]
    k, c = brute_fill(list(y), list(v))
    sign = 1 if side == "right" else -1
    found = pooling.trim_and_fill(studies(spark, sign * y, v), "study", "y", "v", side)
    rows = found.collect()
    assert k > 0 and sum(r.filled for r in rows) == sum(r.trimmed for r in rows) == k and len(rows) == len(y) + k
    own = {r.study: r for r in rows if not r.filled}
    assert all(r.y == pytest.approx(2 * sign * c - own[r.study.removeprefix("filled ")].y) for r in rows if r.filled)
    assert sign * pooling.filled_effect(found).first().fixed < sign * (sign * y / v).sum() / (1 / v).sum()


def test_a_funnel_and_no_studies(spark):
    rows = {r.line: r.text for r in pooling.funnel(studies(spark, [0, 1, 2, 2], [1, 0.01, 1, 1]), "y", "v", 5, 4).collect()}
    assert rows == {0: "  1", 3: "1   2"}
    none = studies(spark, [], [])
    assert pooling.trim_and_fill(none, "study", "y", "v").count() == 0 and pooling.funnel(none, "y", "v").count() == 0 and pooling.egger(none, "y", "v").first().p is None
