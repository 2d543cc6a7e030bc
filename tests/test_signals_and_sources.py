"""Golden cases of spectra, factor analysis, normality, streams and readers."""

import io
import zipfile

import numpy as np
import pytest

from graywacke.operators import normality, scales, signals
from graywacke.sources import readers
from graywacke.streaming import sessions as streams


def test_welch_of_a_sine(spark):
    x = [(1, i, float(np.sin(2 * np.pi * 8 * i / 64))) for i in range(256)] + [(2, i, None) for i in range(64)] + [(3, 0, 1.0)]
    spectrum = signals.welch(spark.createDataFrame(x, "s int, i long, x double"), "s", "i", "x", 64.0, 64)
    rows = {r.bin: r.power for r in spectrum.collect() if r.series == 1}
    assert len(rows) == 33 and spectrum.select("series").distinct().count() == 1
    assert sum(rows.values()) == pytest.approx(0.5, abs=1e-9)
    edge = signals.edges(spectrum).first()
    assert (edge.peak, edge.edge) == (8.0, 9.0)
    assert signals.band_powers(spectrum).filter("band = 'alpha'").first().relative > 0.8


def test_shapiro_wilk_of_the_published_weights(spark):
    w, p = normality.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.7888, abs=5e-4) and p == pytest.approx(0.0067, abs=3e-4)
    rows = spark.createDataFrame([("a", 1.0)] * 5 + [("b", float(i)) for i in range(20)] + [("b", float("nan")), (None, 1.0)], "g string, x double")
    found = {r.group: r for r in normality.by_group(rows, "x", "g").collect()}
    assert found["a"].n == 5 and (found["a"].w is None or np.isnan(found["a"].w)) and found["b"].n == 20 and found["b"].p > 0.5


def test_factors_of_two_blocks(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(500, 2))
    x = np.column_stack([f[:, k // 3] + 0.5 * rng.normal(size=500) for k in range(6)])
    n, r = scales.correlation_matrix(spark.createDataFrame(x.tolist(), [f"q{k}" for k in range(6)]), [f"q{k}" for k in range(6)])
    assert n == 500 and np.allclose(r, np.corrcoef(x.T))
    found = scales.suitability(n, r)
    assert found.kmo > 0.7 and found.df == 15 and found.p < 1e-6
    assert scales.factors_by_parallel_analysis(n, r) == (2, 2)
    loads, common = scales.loadings(r, 2)
    assert sorted(np.abs(loads).argmax(1).tolist()) == [0, 0, 0, 1, 1, 1] and np.abs(loads).min(1).max() < 0.2 and (common > 0.7).all()
    assert np.isnan(scales.suitability(5, np.ones((3, 3))).kmo)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "user_id int, at string").selectExpr("user_id", "cast(at as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id int, ts timestamp_ntz").parquet(f"{tmp_path}/in")
    query = streams.sessions(stream).writeStream.format("memory").queryName("found_sessions").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("found_sessions").collect()) == [1, 2]


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,"a ""q"""\n')
    assert [r.note for r in readers.table(spark, f"{tmp_path}/a.csv").orderBy("id").collect()] == ["two\nlines", 'a "q"']
    (tmp_path / "t.md").write_text("one\r\ntwo\n")
    assert [(r.line_no, r.line) for r in readers.text_lines(spark, f"{tmp_path}/t.md").orderBy("line_no").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "r.bib").write_text('@article{k1,\n title = {A, b},\n year="2020"\n}\n@book{k2, doi={10.1/x}}\n')
    found = {r.key: r for r in readers.bibtex(spark, f"{tmp_path}/r.bib").collect()}
    assert (found["k1"].title, found["k1"].year, found["k1"].doi, found["k2"].kind, found["k2"].doi) == ("A, b", "2020", None, "book", "10.1/x")
    body = f'<d xmlns:w="{readers.WORD[1:-1]}"><w:p><w:t>a</w:t><w:ins><w:t>b</w:t></w:ins></w:p></d>'
    (tmp_path / "office").mkdir()
    (tmp_path / "office/a.docx").write_bytes(zipped({"word/document.xml": body}))
    (tmp_path / "office/bomb.docx").write_bytes(zipped({"word/document.xml": "<!DOCTYPE d [<!ENTITY e 'x'>]>" + body}))
    rows = {r.file.rpartition("/")[2]: r for r in readers.word_files(spark, f"{tmp_path}/office").collect()}
    assert (rows["a.docx"].text, rows["a.docx"].tracked, rows["a.docx"].error) == ("ab", True, None) and "entities" in rows["bomb.docx"].error
    sheet = f'<s xmlns="{readers.SHEET[1:-1]}"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3.5</v></c></s>'
    (tmp_path / "office/b.xlsx").write_bytes(zipped({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f'<t xmlns="{readers.SHEET[1:-1]}"><si><t>name</t></si></t>'}))
    assert sorted((r.cell, r.value) for r in readers.excel_files(spark, f"{tmp_path}/office").collect()) == [("A1", "name"), ("B1", "3.5")]


def test_writing_never_touches_inputs(spark, tmp_path):
    df = spark.range(3)
    readers.write_apart(df, f"{tmp_path}/out", [f"{tmp_path}/in"])
    with pytest.raises(ValueError):
        readers.write_apart(df, f"{tmp_path}/in/x", [f"{tmp_path}/in"])
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_apart(df, f"{tmp_path}/out", [])
