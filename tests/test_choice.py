"""Tests picked and run, intervals, periods, unsure columns and subgroup totals."""

import random

import pytest

from graywacke.operators import choice, compare


def test_the_named_test_is_run(spark):
    rng = random.Random(1)
    normal = [("a", rng.gauss(0, 1)) for _ in range(40)] + [("b", rng.gauss(0.5, 1)) for _ in range(40)]
    df = spark.createDataFrame(normal, "g string, v double")
    found, told = choice.compared(df, "v", "g").first(), compare.two_sample(df, "v", "g", "a", "b").first()
    assert (found.test, found.normal, found.equal_spread) == ("student t", True, True) and (found.statistic, found.p) == pytest.approx((told.t_student, told.p_student))
    wide = spark.createDataFrame([(g, v * (6 if g == "b" else 1)) for g, v in normal], df.schema)
    assert choice.compared(wide, "v", "g").first().test == "welch t"
    skewed = spark.createDataFrame([(g, 2.7 ** (3 * v)) for g, v in normal], df.schema)
    assert choice.compared(skewed, "v", "g").first().test == "mann-whitney"
    three = df.union(spark.createDataFrame([("c", rng.gauss(0, 1)) for _ in range(40)], df.schema))
    assert choice.compared(three, "v", "g").first().test == "anova"
    few = spark.createDataFrame([(g, w) for g, w in [("a", "x")] * 7 + [("a", "y")] + [("b", "y")] * 5], "g string, v string")
    found = choice.compared(few, "v", "g").first()
    assert found.test == "fisher" and found.p < 0.05 and found.statistic is None
    with pytest.raises(ValueError):
        choice.compared(df.filter("g = 'a'"), "v", "g")


def test_intervals_hold_what_the_test_says(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 9)] + [("b", float(v)) for v in (2, 4, 4, 5)] + [("c", 1.0)], "g string, v double")
    r = choice.difference(df, "v", "g", "a", "b").first()
    # Welch: difference 0.05, standard error 1.5283, 5.49 degrees of freedom, for which t is 2.503.
    assert (r.difference, (r.low + r.high) / 2) == pytest.approx((0.05, 0.05)) and r.high - r.low == pytest.approx(2 * 2.503 * 1.5283, rel=2e-3) and r.g_low < r.g < r.g_high
    assert choice.difference(df, "v", "g", "a", "c").first().low is None
    m = choice.correlations(spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "x double, y double"), "x", "y").first()
    assert m.spearman == pytest.approx(1) and m.p_spearman == 0 and 0 < m.p_pearson < 0.01


def test_periods_count_a_subject_once(spark):
    rows = [("s", "early", 1.0), ("s", "early", 3.0), ("s", "late", 5.0), ("t", "early", 1.0), ("t", "late", 2.0), ("u", "late", 9.0), ("u", "other", 1.0)]
    r = choice.periods(spark.createDataFrame(rows, "s string, p string, v double"), "s", "p", "v", "early", "late").first()
    assert (r.n, r.mean_d) == (2, 2.0)


def test_unsure_columns_and_subgroups(spark):
    df = spark.createDataFrame([(str(i), str(i) if i % 3 else "n/a", "x") for i in range(30)], "a string, b string, c string")
    assert {r.variable: r.kind for r in choice.sure_kinds(df).collect()} == {"a": "continuous", "b": "unsure", "c": "categorical"}
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["N = 40 (22 women and 18 men).", "n = 41 (22 women, 18 men), N = 9 (9 cats)", "N = 5 (SD 2)", "N=12 (3 a, 4 b and 5 c)"])], "doc_id long, line_no long, line string")
    assert sorted((r.line_no, r.whole, r.total, r.ok) for r in choice.subgroup_totals(lines).collect()) == [(0, 40, 40, True), (1, 41, 40, False), (3, 12, 12, True)]
