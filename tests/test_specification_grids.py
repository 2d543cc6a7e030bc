"""Grids of specifications: exact rank tests, guards, quantiles of dealt groups, and logs and missing values."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from graywacke.functions import special
from graywacke.operators import grids, ranks


def test_exact_tests_against_all_choices(spark):
    rng = random.Random(1)
    rows = [(s, "ab"[i % 2] if s else "aab"[i % 3], float(rng.choice([1, 2, 2, 3, 5, 8]))) for s in range(3) for i in range(9)] + [(3, "a", 1.0), (4, "a", 1.0), (4, "b", None)] + [(5, "ab"[i % 2], float(i)) for i in range(41)]
    found = {r.s: r for r in grids.exact_by_stratum(spark.createDataFrame(rows, "s long, g string, v double"), "v", "g", "a", "b", ["s"]).collect()}
    for s in range(3):
        values = [(g, v) for k, g, v in rows if k == s]
        sums = lambda pick: sum(v > w or 0.5 * (v == w) for i, (_, v) in enumerate(values) if i in pick for j, (_, w) in enumerate(values) if j not in pick)
        mine = {i for i, (g, _) in enumerate(values) if g == "a"}
        every = [sums(set(c)) for c in itertools.combinations(range(9), len(mine))]
        middle = len(mine) * (9 - len(mine)) / 2
        assert found[s].u == sums(mine) and found[s].p == pytest.approx(sum(abs(u - middle) >= abs(sums(mine) - middle) - 1e-9 for u in every) / len(every))
    assert found[3].p is None and found[4].p is None and found[5].p is None and found[5].n_a == 21


def test_least_p_of_strata_of_any_size(spark):
    rows = [(s, "ab"[i % 2], float(i % 5)) for s, n in enumerate((2, 12, 30, 60, 3000)) for i in range(n)] + [(5, "a", 1.0)]
    df = spark.createDataFrame(rows, "s long, g string, v double")
    found = {r.s: r for r in grids.exact_by_stratum(df, "v", "g", "a", "b", ["s"], most=20).collect()}
    for s, n in enumerate((2, 12, 30, 60, 3000)):
        assert found[s].least_p == pytest.approx(min(1, 2 / math.comb(n, n // 2) if n < 1000 else 0), rel=1e-9)
        assert (found[s].p is None) == (n > 20)
    assert found[5].least_p == 1


def test_least_p_can_be_sent_to_tasks_after_log_gamma_was_used():
    assert special.log_gamma([3.0, 5.0]) == pytest.approx([math.log(2), math.log(24)])
    sent = cloudpickle.loads(cloudpickle.dumps(grids.least_rank_p.func))
    assert sent(pd.Series([2, 3]), pd.Series([2, 0])).to_list() == pytest.approx([1 / 3, 1])


def test_few_rows_cannot_reach_alpha(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(3)] + [("b", 10.0 + i) for i in range(3)], "g string, v double")
    found = {(r.test, r.outliers, r.log): r for r in grids.judged(grids.two_groups(rows, "v", "g", "a", "b")).collect()}
    ranked = found["mann-whitney", "none", False]
    assert ranked.p == pytest.approx(0.1) and ranked.least_p == pytest.approx(0.1) and ranked.unreachable and ranked.flip_p is False
    assert found["welch", "none", False].p < 0.05 and len(found) == 12
    assert grids.verdict(grids.judged(grids.two_groups(rows, "v", "g", "a", "b"))).first().verdict == "undecidable"  # two rows a group are left of logarithms


def grid(spark, *rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "spec int, log boolean, outliers string, test string, n long, effect double, p double, least_p double")


def test_guards_against_noise(spark):
    base = (False, "none", "welch", 50)
    rows = lambda main, *others: {r.spec: r for r in grids.judged(grid(spark, (*base, *main), *others)).collect()}
    # Neither is significant: effects aren't looked at.
    r = rows((0.1, 0.6, None), (*base, -0.9, 0.3, None))
    assert (r[2].flip_p, r[2].flip_sign, r[2].flip_grade) == (False, False, False)
    # Significant: a sign, a grade; not a grade on another scale, nor one that grazes its limit.
    r = rows((0.4, 0.01, None), (*base, -0.4, 0.02, None), (*base, 0.7, 0.001, None), (True, "none", "welch", 50, 0.9, 0.001, None), (*base, 0.505, 0.01, None), (*base, 0.3, 0.0505, None), (*base, 0.3, 0.06, None))
    assert [(r[k].flip_p, r[k].flip_sign, r[k].flip_grade) for k in range(2, 8)] == [(False, True, False), (False, False, True), (False, False, False), (False, False, False), (False, False, False), (True, False, False)]
    order = [x.spec for x in grids.judged(grid(spark, (*base, 0.4, 0.01, None), (*base, 0.4, 0.001, None), (*base, 0.4, 0.2, None))).collect()]
    assert order == [3, 1, 2]  # by what flips, not by p


def test_pairs_with_missing_values_and_signs(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(1, 30)), float(rng.randint(2, 34)) if rng.random() < 0.8 else None) for _ in range(25)] + [(None, 5.0), (-1.0, 3.0)]
    found = {(r.missing, r.log, r.outliers, r.test): r for r in grids.pairs(spark.createDataFrame(rows, "x double, y double"), "x", "y").collect()}
    assert len(found) == 36 and sorted(r.spec for r in found.values()) == list(range(1, 37))
    whole = [y - x for x, y in rows if x is not None and y is not None]
    assert found["complete", False, "none", "t"].n == len(whole) and found["locf", False, "none", "t"].n == sum(x is not None for x, _ in rows) and found["mean", False, "none", "t"].n == len(rows)
    assert found["complete", True, "none", "t"].n == len(whole) - 1
    signed = [d for d in whole if d]
    sizes = sorted(map(abs, signed))
    rank = lambda s: sizes.index(s) + (sizes.count(s) + 1) / 2
    w = sum(rank(abs(d)) for d in signed if d > 0)
    counts = {0.0: 1}
    for s in sizes:
        new = {}
        for total, ways in counts.items():
            for t in (total, total + rank(s)):
                new[t] = new.get(t, 0) + ways
        counts = new
    middle = len(sizes) * (len(sizes) + 1) / 4
    assert found["complete", False, "none", "wilcoxon"].p == pytest.approx(sum(k for t, k in counts.items() if abs(t - middle) >= abs(w - middle) - 1e-9) / 2 ** len(sizes))


def test_quantiles_of_dealt_groups(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=301)] + [("b", float(v)) for v in rng.integers(0, 4, 200)] + [("c", 7.0), ("c", None)]
    found = {r.g: r for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], q1=0.25, q3=0.75).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        assert (found[g].q1, found[g].q3) == pytest.approx(tuple(np.quantile(values, [0.25, 0.75])))


def test_ranks_without_each_row(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2], float(rng.randint(0, 6))) for i in range(24)]
    found = grids.left_out_ranks(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").collect()
    assert sum(r.times for r in found) == 24 and len({(r.v, r.a) for r in found}) == len(found)
