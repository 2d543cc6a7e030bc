"""Episodes in batches and streams, and files read by ranges of bytes."""

import random
import time

import pytest

from graywacke.operators import episodes
from graywacke.sources import lines, readers


def brute(times, window):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1][0] + window:
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(e) for e in out]


def events(spark, rows):
    return spark.createDataFrame([(i, k, None if t is None else t) for i, k, t in rows], "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(s) as ts")


def test_episodes_of_a_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randrange(30_000)) for i in range(700)] + [(9001, None, 5), (9002, "a", None)]
    found = episodes.episodes(events(spark, rows), "key", "ts", "randomised", 3).collect()
    told = {k: brute([t for _, key, t in rows if key == k and t is not None], 180) for k in "ab"}
    assert {k: sorted((int(r.started.timestamp()), r.n_events) for r in found if r.key == k) for k in "ab"} == told
    assert {r.played for r in found} == {True, False} and all(r.played == (r.draw < 0.5) for r in found)
    for mode, played in (("observe", {False}), ("always", {True})):
        assert {r.played for r in episodes.episodes(events(spark, rows), "key", "ts", mode, 3).collect()} == played
    with pytest.raises(ValueError):
        episodes.episodes(events(spark, rows), "key", "ts", "sometimes", 3)


def test_episodes_of_a_stream_with_late_and_repeated_rows(spark, tmp_path):
    first = [(1, "a", 1000), (3, "a", 1100), (2, "a", 1050), (1, "a", 1000), (4, "b", 1010)]  # out of order, and one twice
    second = [(5, "a", 1179), (6, "a", 1180), (3, "a", 1100), (7, "b", 1500)]  # the watermark is at 1040: one row again, and the window's last and next second
    third = [(8, "a", 1000), (9, "b", 1445), (10, "b", 90_000), (11, "a", 90_000)]  # the watermark is at 1440: one row too late, one in time
    fourth = [(12, "c", 200_000)]
    for rows in (first, second, third, fourth):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = episodes.stream_episodes(stream, "key", "ts", ["id"], "randomised", 3)
    query = found.writeStream.format("memory").queryName("found_episodes").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = {(r.key, int(r.started.timestamp()), r.n_events, round(r.draw, 6), r.played) for r in spark.table("found_episodes").collect()}
    kept = {r[0]: r for r in [*first, *second, *third] if r[0] != 8}.values()
    batch = episodes.episodes(events(spark, kept), "key", "ts", "randomised", 3).collect()
    assert got == {(r.key, int(r.started.timestamp()), r.n_events, round(r.draw, 6), r.played) for r in batch}
    assert {(k, s, n) for k, s, n, *_ in got} == {("a", 1000, 4), ("a", 1180, 1), ("b", 1010, 1), ("b", 1445, 2), ("b", 90_000, 1), ("a", 90_000, 1)}


@pytest.mark.parametrize("separator", ["\n", "\n@", "ab"])
def test_records_of_ranges_are_those_of_the_file(tmp_path, separator):
    rng = random.Random(6)
    for k in range(9):
        (tmp_path / f"f{k}.txt").write_bytes("".join(rng.choices(["a", "b", "é", "\n", "@", "\n@", "ab", "x" * 40], k=rng.choice([0, 3, 200]))).encode())
    (tmp_path / "_hidden.txt").write_text("no")
    for size in (1, 3, 7, 64, 1 << 20):
        reader = lines.LineReader({"path": str(tmp_path), "separator": separator, "suffix": ".txt", "range_bytes": str(size)})
        got = {}
        for part in reader.partitions():
            for batch in reader.read(part):
                for r in batch.to_pylist():
                    got.setdefault(r["file"].rpartition("/")[2], []).append((r["begins"], r["value"], r["bytes"]))
        assert "_hidden.txt" not in got
        for path in tmp_path.glob("f*.txt"):
            text = path.read_bytes().decode()
            parts = text.split(separator)
            told = parts[:-1] if parts[-1] == "" else parts
            mine = sorted(got.get(path.name, []))
            assert [v for _, v, _ in mine] == told and sum(n for *_, n in mine) == len(text.encode())


def test_a_long_line_is_read_and_a_cut_one_is_no_pass(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(b"one\r\n" + "é".encode() * (1 << 20) + b"\nthree\rfour")
    found = lines.records(spark, str(tmp_path), range_bytes=500_000)
    began = time.perf_counter()
    rows = lines.numbered(lines.complete(found)).orderBy("line_no").collect()
    assert time.perf_counter() - began < 60
    assert [(r.line_no, r.line[:5], len(r.line)) for r in rows] == [(1, "one", 3), (2, "ééééé", 1 << 20), (3, "three", 5), (4, "four", 4)]
    cut = lines.records(spark, str(tmp_path), most_bytes=1001)
    assert [(r.n_records, r.n_cut, r.complete) for r in lines.report(cut).collect()] == [(3, 1, False)]
    assert max(len(r.value) for r in cut.collect()) == 500  # half a character is left out
    with pytest.raises(lines.IncompleteReadError, match="1 records cut"):
        lines.complete(cut)
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfeh\x00")
    with pytest.raises(lines.IncompleteReadError, match="1 undecodable"):
        readers.text_lines(spark, str(tmp_path))


def test_references_with_braces(spark, tmp_path):
    (tmp_path / "r.bib").write_text('% notes\n@article{a, title = {The {RNA} of {one {two}} cells}, year = 2020, doi={10.1/x}}\n@book{b,\n title="Plain, really",\n journal = {J} }\n')
    found = {r.key: (r.kind, r.title, r.year, r.journal, r.doi) for r in readers.bibtex(spark, f"{tmp_path}/r.bib").collect()}
    assert found == {"a": ("article", "The {RNA} of {one {two}} cells", "2020", None, "10.1/x"), "b": ("book", "Plain, really", None, "J", None)}
