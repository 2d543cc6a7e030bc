"""Golden cases of the statistics, audits and document checks."""

import math

import pytest
from pyspark.sql import functions as F

from graywacke.functions import special
from graywacke.operators import audits, compare, designs, documents, logs, measures
from graywacke.plans import registry
from graywacke.plans.result import Verdict


def test_distributions():
    assert float(special.t_two_sided(2.228, 10)) == pytest.approx(0.050011771817110584, abs=1e-12)
    assert float(special.t_two_sided(0.837, 606.35)) == pytest.approx(0.40292, abs=1e-4)
    assert float(special.chi2_upper(3.841458820694124, 1)) == pytest.approx(0.05, abs=1e-12)
    assert float(special.f_upper(2.228**2, 1, 10)) == pytest.approx(0.050011771817110584, abs=1e-12)
    assert float(special.normal_two_sided(1.959963984540054)) == pytest.approx(0.05, abs=1e-12)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert special.noncentral_t_upper(2.0, 10, 0.0) == pytest.approx(float(special.t_two_sided(2.0, 10)) / 2, abs=1e-12)


def test_sample_size_of_a_medium_effect(spark):
    row = designs.sample_sizes(spark, [(0.5, 0.8, 0.05, 0.15)]).first()
    assert (row.n_analysed, row.n_recruited) == (64, 76)


def test_icc_of_the_published_table(spark):
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    long = spark.createDataFrame([(s, r, float(x)) for s, row in enumerate(table) for r, x in enumerate(row)], "s int, r int, x double")
    row = measures.icc(long, "s", "r", "x").first()
    assert round(row.icc_2_1, 5) == 0.28976 and round(row.icc_3_1, 5) == 0.71484


def test_two_groups_with_ties_nulls_and_nan(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", 5.0), ("b", None), ("a", math.nan), (None, 3.0)], "g string, v double")
    test = compare.mann_whitney(rows, "v", "g", "a", "b").first()
    assert (test.n_a, test.n_b, float(test.u)) == (3, 3, 1.0)
    assert compare.two_sample(rows, "v", "g", "a", "b").first().p_welch == pytest.approx(0.1389, abs=2e-2)
    empty = compare.mann_whitney(rows.limit(0), "v", "g", "a", "b").first()
    assert empty.u is None and empty.p is None


def test_holm(spark):
    rows = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "t string, p double")
    assert {r.t: round(r.p_holm, 6) for r in compare.holm(rows).collect()} == {"x": 0.03, "y": 0.06, "z": 0.06}


def test_ids_nights_and_numbers(spark):
    ids = spark.createDataFrame([("S01",), ("s 1",), ("Ｓ０１",), ("S02",), ("BELL-001-01",)], "raw string")
    assert [r[0] for r in ids.select(audits.subject_id(F.col("raw"))).collect()] == ["S1", "S1", "S1", "S2", "BELL-1-1"]
    nights = spark.sql("select timestamp_ntz '2024-05-01 23:40' as ts union all select timestamp_ntz '2024-05-02 03:20'")
    assert nights.select(audits.night(F.col("ts"))).distinct().count() == 1
    raw = spark.createDataFrame([("3,14",), ("1.5e-05",), (" 7 ",), ("x",), (None,)], "raw string")
    assert [r[0] for r in raw.select(audits.number(F.col("raw"))).collect()] == [None, 1.5e-05, 7.0, None, None]


def test_merge_never_multiplies_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    out = audits.merged({"a": a, "b": b}, ["k"])
    assert out.result.count() == 2 and out.verdict is Verdict.ISSUES
    assert {(r.source, r.rows_in, r.no_key, r.repeated, r.rows_used) for r in out.coverage.collect()} == {("a", 4, 1, 2, 1), ("b", 2, 0, 0, 2)}
    assert audits.merged({"a": a.filter("k = 1"), "b": b}, ["k"]).verdict is Verdict.UNDECIDABLE


def test_document_checks(spark):
    text = "We saw 23/48 (45.2%) and 23/48 (47.9%).\nCited [1] and [3], p = 1.5e-05, n = 0/0 (0%)."
    rows = documents.lines(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t")
    found = [(r.written, r.ok) for r in documents.ratios(rows).orderBy("line_no", "written").collect()]
    assert found == [(45.2, False), (47.9, True), (0.0, None)]
    assert "1.5e-05" in [r.raw for r in documents.numbers(rows).collect()]
    references = spark.createDataFrame([(1,), (2,)], "number int")
    assert {(r.number, r.status) for r in documents.citations(rows, references).collect()} == {(3, "not listed"), (2, "never cited")}
    claims = spark.createDataFrame([(14.37, 23, 2), (14.35, 23, 2), (1.0, 0, 1)], "m double, n int, d int")
    assert [r.possible for r in documents.grim(claims, "m", "n", "d").collect()] == [False, True, None]
    comments = spark.createDataFrame([(2, 3), (2, 4), (2, 6)], "r int, n int")
    assert [tuple(r) for r in documents.gaps(comments, "r", "n").collect()] == [(2, 5)]


def test_sessions_of_empty_and_tied_rows(spark):
    rows = spark.sql("select 1L as user_id, timestamp_ntz '2024-01-01 10:00' as ts union all select 1L, timestamp_ntz '2024-01-01 10:00' union all select 1L, timestamp_ntz '2024-01-01 10:30' union all select 1L, timestamp_ntz '2024-01-01 11:01' union all select null, timestamp_ntz '2024-01-01 10:00'")
    assert sorted((r.session_no, r.n_events) for r in logs.sessions(rows).collect()) == [(1, 3), (2, 1)]
    assert logs.sessions(rows.limit(0)).count() == 0


def test_the_numbers_query_gives_every_number_with_its_place(spark, tmp_path):
    texts = {1: "10 20 30\nx = 3.14, -5 (45%) p=1.5e-05", 2: "12,\n\n2-5 and .07. v1.2.3 a7 34명", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {1: [["10", "20", "30"], ["3.14", "-5", "45", "1.5e-05"]], 2: [["12"], [], ["2", "5", ".07", "34"]]}
    found = registry.queries()["tx01_numbers"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((d, k, i, raw, float(raw)) for d, rows in expected.items() for k, row in enumerate(rows, 1) for i, raw in enumerate(row))


def test_the_join_queries_use_whole_tables(spark, tmp_path):
    customers, orders = [(k, k / 2) for k in range(1, 8)], [1, 1, 2, 4, 9, 9, 9]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in orders], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["join01_merged"](spark, str(tmp_path)).collect()
    assert {(r.k, r.orders, r.c_acctbal) for r in found} == {(k, orders.count(k) or None, dict(customers).get(k)) for k in {*orders, *dict(customers)}}
    assert tuple(registry.queries()["join03_overlap"](spark, str(tmp_path)).first()) == (3, 4, 1)
