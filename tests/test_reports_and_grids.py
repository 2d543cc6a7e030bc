"""Reported statistics, traced numbers, grids and shapes against known cases and brute force."""

import math
import re

import pytest
from pyspark.sql import functions as F

from graywacke.operators import categorical, documents, measures, models, ranks, reported, robust, shape, trace
from graywacke.plans import registry


def lines(spark, *texts):
    return spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "doc_id long, line_no int, line string")


def test_reported_tests(spark):
    texts = ["t(10) = 2.228, p = .050", "t(10) = 2.228, p = .08", "t(10) = 2.2, p < .01", "F(2, 57) = 0.10; p < .05", "one-tailed: F(2, 57) = 0.10, p < .05", "r(30) = 1.5, p = .01", "t(0) = 2, p = .04", "χ²(1) = -3.9, p = .04", "χ2(1, N = 40) = 3.84, p = .05", "z = 1.96, p = .05", "t = 2.0, p = .05", "p = .05 alone", None]
    found = {r.doc_id: (r.status, r.severity) for r in reported.tests(lines(spark, *texts)).collect()}
    assert found == {
        0: ("consistent", None), 1: found[1], 2: found[2], 3: ("contradiction", "fatal"), 4: ("contradiction", "warning"), 5: ("impossible", "fatal"), 6: ("impossible", "fatal"), 7: ("impossible", "fatal"),
        8: ("consistent", None), 9: ("consistent", None), 10: ("skipped", None),
    }
    assert found[1][0] in ("inconsistent", "contradiction") and found[2][0] in ("inconsistent", "contradiction")
    row = reported.coverage(reported.tests(lines(spark, *texts))).first()
    assert (row.candidates, row.skipped, row.undecidable) == (11, 1, False)
    assert reported.coverage(reported.tests(lines(spark, "t(3) = 1, p = .4"))).first().undecidable
    p = reported.tests(lines(spark, "t(10) = 2.228, p = .05")).first()
    assert p.p_low <= 0.0500117718171113 <= p.p_high


def test_intervals_words_and_changes(spark):
    found = {r.doc_id: (r.inside, r.agrees) for r in reported.intervals(lines(spark, "1.2 (95% CI 0.3, 2.1), p = .01", "1.2 (95% CI: -0.3 to 2.1), p = .01", "9 (95% CI [1; 2])")).collect()}
    assert found == {0: (True, True), 1: (True, False), 2: (False, None)}
    said = {r.doc_id: r.claim for r in reported.wording(lines(spark, "It was significant (p = .07).", "Not significant (p = .03).", "It was significant (p = .03).", "p = .2. No words")).collect()}
    assert said == {0: "called significant", 1: "called not significant"}
    status = {r.doc_id: r.status for r in reported.changes(lines(spark, "from 14.2 to 9.6 (change -4.6)", "from 14.2 to 9.6 (change 4.6)", "from 14.2 to 9.6 (Δ = -5.6)")).collect()}
    assert status == {0: "ok", 1: "sign", 2: "wrong"}


def test_grim_and_grimmer(spark):
    claims = spark.createDataFrame([(14.37, 3.0, 23, 2), (14.35, 3.0, 23, 2)], "mean double, sd double, n int, places int")
    assert [r.possible for r in documents.grim(claims, "mean", "n", "places").orderBy("mean").collect()] == [True, False]
    sets = [[1, 2, 2, 5, 7], [0, 0, 0, 1, 9], [3, 3, 3, 3, 3]]
    rows = []
    for x in sets:
        m = sum(x) / 5
        rows.append((round(m, 2), round(math.sqrt(sum((v - m) ** 2 for v in x) / 4), 2), 5, 2))
    assert all(r.possible_sd for r in reported.grimmer(spark.createDataFrame(rows, claims.schema), "mean", "sd", "n", "places").collect())
    # 149 zeros and one 1: three sums have means that are written 0.01, and not the nearest one fits.
    assert reported.grimmer(spark.createDataFrame([(0.01, 0.08, 150, 2)], claims.schema), "mean", "sd", "n", "places").first().possible_sd
    assert not reported.grimmer(spark.createDataFrame([(3.4, 2.55, 5, 2)], claims.schema), "mean", "sd", "n", "places").first().possible_sd


def test_numbers_against_a_plain_scan(spark):
    text = "10 20 30, 3.14 -5 (45%) 1.5e-05 v1.2.3 S01 .07 12. 7,5\n+2 x9 9x"
    found = [(r.line_no, r.raw) for r in documents.numbers(documents.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text")).orderBy("line_no", "nth").collect()]
    expected = [(n + 1, m) for n, line in enumerate(text.split("\n")) for m in re.findall(documents.NUMBER, line)]
    assert found == expected and (1, "1.5e-05") in found and (1, "45") in found and (1, "-5") in found


def test_numbers_traced_to_sources(spark):
    text = ["For 8 weeks p < 0.05 [3] Table 2 PHQ-9 1:1 NCT0123 2021-03-04 95% CI: 14.6 and 2.35 and 2.34 and 7.7 and 99.9"]
    rows, counts = trace.skipped(lines(spark, *text))
    assert {r.reason: r.n for r in counts.collect()} == {"duration": 1, "p threshold": 1, "citation": 1, "table or figure": 1, "scale name": 1, "ratio of arms": 1, "trial number": 1, "date": 1, "interval level": 1}
    now = spark.createDataFrame([("a.csv", -14.63), ("a.csv", 2.345)], "file string, value double")
    before = spark.createDataFrame([("old.csv", 7.7)], "file string, value double")
    found = trace.traced(rows, now, before)
    assert [r.status for r in found.orderBy("nth").collect()] == ["sign", "found", "found", "stale", "no source"]
    assert not trace.verdict(found).first().undecidable and trace.verdict(found.filter("status = 'no source'")).first().undecidable


def test_grids_and_exact_tests(spark):
    rows = [("a", float(k % 7 + 1)) for k in range(30)] + [("b", float(k % 7 + 1.4)) for k in range(30)] + [("b", 90.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    grid = robust.judged(robust.two_group_grid(df, "v", "g", "a", "b"))
    assert [r.spec for r in grid.collect() if not r.flipped] == sorted(r.spec for r in grid.collect() if not r.flipped) and grid.count() == 12
    assert {r.outliers: r.n for r in grid.filter("test = 'welch' and not log").collect()} == {"none": 61, "3 sd": 60, "1.5 iqr": 60}
    assert robust.verdict(robust.judged(robust.two_group_grid(df.filter("v < 1.5"), "v", "g", "a", "b"))).first().verdict in ("undecidable", "robust", "fragile")
    assert spark.range(1).select(robust.least_exact_p("3", "3").alias("p")).first().p == pytest.approx(0.1)
    flags = spark.createDataFrame([(True, True)] * 3 + [(True, False)] * 1 + [(False, True)] * 1 + [(False, False)] * 3, "x boolean, y boolean")
    assert categorical.fisher(flags, "x", "y").first().p == pytest.approx(0.4857142857)
    assert (categorical.suited_test(False, 2, least_expected=3), categorical.suited_test(True, 2, normal=False), categorical.suited_test(True, 3)) == ("fisher", "mann-whitney", "anova")


def test_range_dealt_ranks_and_areas(spark):
    values = [float((k * 37) % 101) for k in range(500)]
    df = spark.createDataFrame([(v, int(v > 50) ^ (k % 5 == 0)) for k, v in enumerate(values)], "v double, y int")
    found = {r.v: (r.ties, r.below) for r in ranks.value_ranks(df, "v").collect()}
    assert found == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
    pos, neg = ([r.v for r in df.collect() if r.y == k] for k in (1, 0))
    area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    row = measures.auc(measures.roc(df, "v", "y")).first()
    assert row.auc == pytest.approx(area) and row.auc_low < area < row.auc_high
    assert measures.auc(measures.roc(df.limit(0), "v", "y")).first().auc is None


def test_shapes(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "id int, a double, b double")
    assert {tuple(r) for r in shape.long_form(df, ["id"], ["a", "b"]).collect()} == {(1, "a", 2.0), (2, "b", 4.0)}
    assert {r.column: (r.type, r.nulls) for r in shape.inspect(df).collect()} == {"id": ("int", 0), "a": ("double", 1), "b": ("double", 1)}
    assert shape.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | 2.0 |  |"
    row = shape.diary(spark.createDataFrame([(1430, 20, 30, 400, 420)], "bed int, sol0 int, awake int, wake int, rise int"), "bed", "sol0", "awake", "wake", "rise").first()
    assert (row.tib, row.tst, row.mid_sleep) == (430, 360, 205.0)
    times = spark.createDataFrame([(s, t, float(s + 2 * t)) for s in range(5) for t in range(4)], "s int, t int, x double")
    assert models.trend(times, "s", "t", "x").first().n == 5 and models.trend(times, "s", "t", "x").first()["mean"] == pytest.approx(2 * math.sqrt(5))
    assert shape.top(times, "x", 2, "s", "t").count() == 10


def test_every_sql_belongs_to_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys() and len(registry.queries()) > 90
