"""Filter audit, line dedup and fill-in-the-middle against brute force, and odd rows."""

import hashlib
import itertools
import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from graywacke.llm import fill_in_middle, filter_audit, html_extract, language_id, line_dedup, warc

LONG = "Word another\n" * 60_000
ODD = [(1, None, None), (2, "", "s"), (3, " \n \x0b\n", "s"), (4, "One #", "s"), (4, "One #", "s"), (4, "other", "s"), (None, "null id", "s"), (None, "null id", "t"), (5, "É é ß 漢字 😀 a\x00b é", None), (6, LONG, "t"), (7, LONG, ""), (8, "", "t"), (9, "has <S> in it", "t")]
SCHEMA = "doc_id long, text string, source string, extra string"


def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], SCHEMA)


def made(n, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choices("aAbB cé#\t", k=rng.randint(0, 9))) for _ in range(40)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(n)]
    for i in range(0, n, 4):
        texts[i] = texts[rng.randrange(n)]
    return texts


def failed(rows):
    """The letters of the filters that each row (doc_id, text, source) fails, one by one."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = len(re.findall("[A-Z]", t))
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append("".join(k for k, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 2 * len(t), re.search(r"[#$%&*|]", t), copy)) if x))
    return out


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    fails, out, removed_in_all = failed(rows), {}, {}
    parts = [s or "" for *_, s in rows]
    for part in set(parts):
        mine = [(i, f) for (i, _, _), f, p in zip(rows, fails, parts) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for s, k in enumerate(order):
                gone, left = [r for r in left if k in r[1]], [r for r in left if k not in r[1]]
                early = sum(k in f and any(e in f for e in order[:s]) for _, f in mine)
                out[part, "".join(order), s + 1] = [len(left), len(gone), early, sum(f == k for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                removed_in_all[part, k] = removed_in_all.get((part, k), 0) + len(gone)
    return {(p, o, s): (*v, removed_in_all[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(spark, rows, labels):
    flags = filter_audit.failures(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    found = filter_audit.audit(flags).collect()
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in found)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}


def test_audit_of_all_orders_against_filters_run_one_by_one(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 300])], k=rng.choice([50, 250]))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_odd_rows_and_of_none(spark):
    labels = [(4, 1, 0), (6, 0, 1)]
    assert audited(spark, ODD, labels) == brute_audit(ODD, labels)
    assert audited(spark, [], labels) == {}


def test_audit_of_other_filters(spark):
    rows = [("p", True, False, True, False, 3), ("p", False, False, False, True, 2), ("p", True, True, False, False, 1)]
    flags = spark.createDataFrame(rows, "part string, x boolean, y boolean, good boolean, toxic boolean, n long")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(flags, ("x", "y")).collect()}
    assert found == {("xy", 1): (2, 4, 0, 3, 3, 7), ("xy", 2): (2, 0, 1, 0, 0, 1), ("yx", 1): (5, 1, 0, 0, 0, 1), ("yx", 2): (2, 3, 1, 3, 3, 7)}


def brute_lines(rows, documents, least):
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    held = {}
    for i, t in rows:
        for k in keys(t):
            held.setdefault(k, set()).add((i, None if i is not None else t))
    gone = {k for k, who in held.items() if len(k) >= least and len(who) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if k not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("documents", "least", "most"), [(10, 1, 1 << 20), (10, 1, 0), (3, 4, 0), (2, 0, 1 << 20)])
def test_shared_lines_go(spark, documents, least, most):
    rows = [*enumerate(made(150, 5)), *((i, t) for i, t, _ in ODD)]
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], SCHEMA)
    found = line_dedup.deduplicated(df, documents, least, most=most)
    assert found.columns == [*df.columns, *line_dedup.ADDED]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=str) == brute_lines(rows, documents, least)


def test_hot_lines_beyond_the_broadcast(spark):
    rows = [(i, f"Everywhere\nown {i}\nhalf {i % 20}\nEVERYWHERE ") for i in range(300)]
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], SCHEMA)
    found = line_dedup.deduplicated(df, most=0, share=3).collect()  # the line of all documents is hot, the others aren't
    assert {(r.n_lines, r.n_dropped) for r in found} == {(4, 3)} and {r.kept_text for r in found} == {f"own {i}" for i in range(300)}


def test_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.deduplicated(none).collect() == [] and fill_in_middle.transformed(none).collect() == []
    for operator, name in ((line_dedup.deduplicated, "N_lines"), (fill_in_middle.transformed, "output")):
        with pytest.raises(ValueError, match=name):
            operator(none.withColumnRenamed("extra", name))
    # Names that the operators use inside are the caller's to use.
    named = spark.createDataFrame([(1, "a b c\nd", "s", "x")], SCHEMA).withColumn("our_text", F.lit("mine")).withColumn("their_id", F.lit(7)).withColumn("row", F.lit(1)).withColumn("our_h1", F.lit(2))
    assert line_dedup.deduplicated(named).select("our_text", "their_id", "row", "our_h1", "kept_text").first()[:] == ("mine", 7, 1, 2, "a b c\nd")
    assert fill_in_middle.transformed(named).select("our_text", "their_id", "row", "our_h1", "n").first()[:] == ("mine", 7, 1, 2, 7)


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(size, density):
    flags = np.random.default_rng(size).random(size) < density
    bits = fill_in_middle.Bits(flags)
    assert bits.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(flags)]).tolist()
    assert bits.select(np.arange(flags.sum())).tolist() == np.flatnonzero(flags).tolist()


def brute_middle(i, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, named = len(tokens), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(named[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_move_and_come_back(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab  Zé漢😀<\n<PSM>", k=rng.randint(0, 60)))) for i in range(600)]
    rows += [(i, t) for i, t, _ in ODD] + [(10_000 + i, "<" * i) for i in range(30)] + [(20_000, "letters" * 20_000), (20_001, "é" * 70_000)]
    found = fill_in_middle.transformed(spark.createDataFrame([(*r, "s", "x") for r in rows], SCHEMA).repartition(3)).withColumn("again", fill_in_middle.restored("output", "form")).collect()
    assert all(r.again == (r.text or "") for r in found) and len(found) == len(rows)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, r.text) for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/", f"page {i % 50}") for i in range(200)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    listed = sorted((tmp_path / "w").glob("*.warc.zst"))
    # An attempt that died after its third archive; the attempt that counts, in another order, needed fewer.
    shutil.copy(listed[0], tmp_path / "w" / "pages-000000-999-00002.warc.zst")
    found = warc.read_archives(spark, folder)
    assert sorted(r.page_id for r in found.collect()) == list(range(200))
    assert found.filter("record_type = 'response'").count() == 50
    # A folder of others, without a manifest, is read whole.
    (tmp_path / "x").mkdir()
    for path in listed:
        shutil.copy(path, tmp_path / "x" / path.name)
    assert warc.read_archives(spark, f"file://{tmp_path}/x").count() == 200


@pytest.mark.parametrize("trial", range(4))
def test_languages_with_equal_rows_are_learned(spark, trial):
    rows = [(i, f"le chat dort dans la maison {trial}", "fr") for i in range(1000)] + [(i, f"the house of cat number {i} and {trial}", "en") for i in range(2000, 2050)] + [(i, f"{i}", "fr") for i in range(3000, 6000)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=5).names == ["en", "fr"]


@pytest.mark.parametrize("markup", [True, False])
def test_titles_and_leads_of_their_own_stay(spark, markup):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(500)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    pages, told = [], {}
    for k in range(40):
        title, lead, body = f"Title {said(3)}", f"Lead {said(12)}", [said(40) for _ in range(2 + k % 10)]
        html = f"<div class=menu><a>Home</a> <a>News</a></div><div class=top><h1>{title}</h1></div><div class=lead><p>{lead[:9]}<b>{lead[9:]}</b></p></div><div class=text>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div class=low><p>All rights reserved</p></div>"
        pages.append((k, "http://one.org/", html))
        told[k] = "\n\n".join([title, lead, *body])
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), markup=markup).collect()
    assert {r.page_id: r.text for r in found} == told
    none = html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.collect() == [] and none.columns[-2:] == ["text", "n_chars"]
