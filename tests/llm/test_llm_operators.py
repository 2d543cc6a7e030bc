"""The operators for training data against brute force, round trips and odd rows."""

import hashlib
import itertools
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graywacke.llm import chat, decontaminate, html_extract, language_id, minhash, packing, quality_classifier, quality_rules, url_filter, url_table, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "null id"), (5, "É é ß İ Σ ﬁ e\u0301 \x1c <|endoftext|> 3.14 it's ..."), (6, "word " * 3000)]
SCHEMA = "doc_id long, text string, lang string, extra string"


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in ODD], SCHEMA)


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    rows = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 90))) for _ in range(n)]
    for i in range(0, n, 3):  # copies with a few words changed, chains of them too
        words = rows[rng.randrange(max(1, i))].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows[i] = " ".join(words)
    return rows


def brute_components(rows):
    sets = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return sets, label


@pytest.mark.parametrize("turns", [1, 2])
def test_near_duplicates_against_all_pairs(spark, turns):
    rows = [*texts(240), None, "", "two words", "two words"]
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), turns=turns).collect()
    sets, label = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(rows))}


@pytest.mark.parametrize("deviations", [minhash.DEVIATIONS, None])
def test_the_exact_join_finds_what_pivots_leave(spark, deviations):
    rows = texts(150, 7)
    found = [(i, len(x), x.view(np.int64).tolist()) for i, x in enumerate(minhash.sets(rows))]
    nodes = minhash.sketched(spark.createDataFrame(found, "node long, n_shingles long, shingles array<long>"))
    keys = minhash.prefixes(nodes, 75).withColumn("component", F.col("node"))
    pairs = {(r.a, r.b) for r in minhash.across(keys, 75, deviations).collect()}
    sets, _ = brute_components(rows)
    assert {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} <= pairs


def test_near_duplicates_keeps_ids_beyond_doubles(spark):
    rows = [(2**53 + 1, "a b c d e f"), (None, "a b c d e f"), (2**53 - 1, "x y"), (2**53, "q")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (2**53 - 1, 2**53 - 1), (2**53, 2**53)}


def test_near_duplicates_of_odd_and_no_rows(spark):
    found = minhash.near_duplicates(odd(spark)).collect()
    assert len(found) == len(ODD) and {r.component_id for r in found if r.doc_id == 4} == {4}
    assert all(r.n_shingles == 0 and r.kept for r in found if r.doc_id in (1, 2, 3))
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_the_pipeline_drops_near_copies_only(spark):
    first, other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, first), (None, first + " x"), (None, other), (2, first + " y"), (2, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.minhash_stage(spark, docs, "").collect()
    assert {tuple(r) for r in kept} == {(1, first), (None, other), (2, third)}


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choices("ab cd ef gh ij".split(), k=n)) for n in (3, 9, 10, 14, 30)] + ["", None, "!!"]
    docs = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=60)) for _ in range(30)] + [f"Xx {items[3].upper()}, yy {items[4]}", items[2], items[0], None, "", "É É"]
    docs += docs[:1]
    found = decontaminate.contamination(spark.createDataFrame([(i % 36, t) for i, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = []
    for i, t in enumerate(docs):
        w, hit, ids = split(t), set(), set()
        for k, item in enumerate(items):
            b = split(item)
            n = min(10, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[j : j + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(k))
        expected.append((i % 36, len(w), len(hit), sorted(ids), bool(hit)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in found) == sorted(expected)
    assert not any(r.contaminated for r in decontaminate.contamination(odd(spark), spark.createDataFrame([], "item_id long, text string")).collect())


def test_contamination_of_rows_without_id(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(None, f"a {item} b"), (None, "clean text"), (1, f"c {item}")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_hit, list(r.item_ids), r.contaminated) for r in found) == [(0, 0, [], False), (0, 12, ["7"], True), (1, 12, ["7"], True)]


def test_packing_round_trip_and_bounds(spark):
    rows = packing.packed_documents(odd(spark), TOKENIZER, packing.Capacity(64)).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    by_text = {}
    for r in packing.tokenized(odd(spark), TOKENIZER, 64).collect():
        by_text.setdefault(r.doc_id, []).append((r.piece, list(np.frombuffer(bytes(r.ids), "<u4"))))
    for i in (1, 2, 5, 6):
        ids = tokenizer.encode(dict(ODD)[i] or "", add_special_tokens=False).ids + [1]
        assert [x for _, piece in sorted(by_text[i]) for x in piece] == ids
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) <= sum(ends.values()) / 64 + 2
    assert packing.packed_documents(odd(spark).limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, documents=3), packing.Capacity(100, attention=3000), packing.Capacity(100, 4, 4000, dot_product=True)])
def test_best_fit_keeps_every_capacity(capacity):
    lengths = np.random.default_rng(0).integers(1, 50, 400)
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in range(sequence.max() + 1):
        mine = lengths[sequence == s]
        assert (np.array([mine.sum(), len(mine), (mine**2).sum()]) <= capacity.limits()).all()
        assert sorted(zip(offset[sequence == s], mine)) == sorted(zip(np.cumsum(np.r_[0, mine[np.argsort(offset[sequence == s])]])[:-1], mine[np.argsort(offset[sequence == s])]))
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), packing.Capacity(100))


def test_rule_counts_against_brute_force():
    rng = random.Random(5)
    rows = ["\n".join(" ".join(rng.choices(["a", "bé", "c#", "|", "D"], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "\n\n", "a a a a", "x\r\nx\r\n"]
    found = quality_rules.measure(rows)
    for i, t in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeated = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(int(found[k][i]) for k in quality_rules.COUNTS) == expected


def test_forest_rejects_odd_rates_and_keeps_clean_rows(spark):
    rows = texts(400, 11)
    rows = [t if i % 10 else " ".join(w + "###" for w in t.split()) for i, t in enumerate(rows)]
    rows = [" ".join([t] if len(t.split()) >= 50 else [t, *texts(3, i + 50)]) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(300)], "doc_id long, quality int")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels)).select("doc_id", "rules.*").collect()
    late = [r for r in judged if r.doc_id >= 300 and not r.base_failed]
    assert np.mean([r.kept for r in late if r.doc_id % 10]) > 0.97 and np.mean([r.kept for r in late if r.doc_id % 10 == 0]) < 0.2
    assert quality_rules.judge(docs.limit(0), []).count() == 0
    assert all(r.rules.base_failed for r in quality_rules.judge(odd(spark).filter("doc_id < 5"), []).collect())


def test_forest_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    ids = [r.id for r in spark.range(600).orderBy(F.xxhash64("id"), "id").collect()]
    late = ids[120:]
    # In the sample: good rows, bad ones full of signs, three full of digits. Outside it: good rows full of signs, bad ones full of digits.
    signs, digits = {*ids[:12], *late[:40]}, {*ids[12:15], *late[40:100]}
    bad = {*ids[:12], *digits}
    plain = ["\n".join([t, *texts(9, i + 50), f"no. {i} of 600"]) for i, t in enumerate(texts(600, 13))]
    rows = [t if i not in signs | digits else " ".join(w + ("##" if i in signs else "77") for w in t.split()) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(600)], "doc_id long, quality int")
    found = []
    for by_broadcast in (True, False):
        if not by_broadcast:
            monkeypatch.setattr(quality_rules, "bounded", lambda df: df)
        forests = quality_rules.fit(docs, labels, most=120)
        found.append([f.threshold for f in forests])
        lost = {r.doc_id for r in quality_rules.judge(docs, forests).filter("not rules.kept and not rules.base_failed").select("doc_id").collect()}
        measured = quality_rules.failed(quality_rules.measure(rows))
        assert {i for i in digits if not measured[i]} <= lost and len(lost - bad) <= quality_rules.LOSS * 600 * len(forests)
    assert found[0] == found[1]
    # The same thresholds by brute force over all rows: none of those tried is worth more.
    m = quality_rules.measure(rows)
    x, good = quality_rules.rates(m)[~quality_rules.failed(m)], np.array([i not in bad for i in range(600)])[~quality_rules.failed(m)]
    scores = forests[0].scores(x)
    worth = lambda t: (scores[~good] > t).sum() / (~good).sum() - quality_rules.WEIGHT * (scores[good] > t).sum() / good.sum()
    assert all(worth(t) <= worth(forests[0].threshold) + 1e-12 for t in np.unique(scores) if (scores[good] > t).sum() <= quality_rules.LOSS * good.sum())


def test_classifier_learns_and_scores_alone_as_in_company(spark):
    good, bad = texts(120, 21), [t.upper() + "!!" for t in texts(120, 22)]
    model = quality_classifier.train([(t, 1) for t in good[:80]] + [(t, 0) for t in bad[:80]])
    scores = model.scores(good[80:] + bad[80:])
    assert (scores[:40] > 0.5).mean() > 0.95 and (scores[40:] < 0.5).mean() > 0.95
    together = model.scores([good[0], "", None, "x", bad[0]])
    assert np.allclose(together, [model.scores([t])[0] for t in (good[0], "", None, "x", bad[0])])
    assert quality_classifier.score(odd(spark), model).count() == len(ODD)
    # Of one class there is nothing to learn: a constant.
    assert quality_classifier.train([("a", 1)]).scores(["a", None]).tolist() == [0.5, 0.5]


def test_language_profiles(spark):
    rows = [(i, t, lang, "") for i, (t, lang) in enumerate([("the cat and the dog of the house with this that", "en"), ("der Hund und die Katze in dem Haus mit nicht", "de"), ("le chat et les chiens dans une maison avec", "fr")] * 30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    profiles = language_id.fit(docs)
    said = {r.text: r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "the house of the cats", "", ""), (2, "die Katze und der Hund", "", ""), (3, "les chats dans la maison", "", ""), (4, None, "", ""), (5, "123 !", "", "")], SCHEMA), profiles).collect()}
    assert list(said.values()) == ["en", "de", "fr", "und", "und"]
    assert language_id.predict(docs.limit(0), profiles).count() == 0
    none = language_id.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, none).collect()} == {("und", 0.0)}
    same = docs.withColumn("doc_id", F.lit(1).cast("long"))
    assert language_id.fit(same.withColumn("text", F.lit("1 2 3"))).names == []
    assert language_id.fit(same).names == ["de", "en", "fr"]


def test_url_rules_and_parts(spark):
    urls = ["http://Example.com/en/1?x#y", "https://www.EXAMPLE.com/en/1", "ftp://a.net/es/", "http://a.net?/es/", "http://casino-pills.org/win", "http://com/", "no scheme", None, "http://xcom/", "a://b://c/d"]
    rules = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"))
    model = url_filter.fit(url_table.labelled_urls())
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules, model).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.net", "/es/", "net/es/"), ("a.net", "", None), ("casino-pills.org", "/win", None), ("com", "/", "com/"), ("", "", None), ("", "", None), ("xcom", "/", None), ("b:", "//c/d", None)]
    assert rows[4].verdict == "block" and rows[0].verdict == "block" and rows[1].verdict == "allow"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div class="site-strip">%s</div><nav><ul><li>Menu</ul></nav>
<div class="content"><h1>Title &amp; more</h1><p>First %s<br>line<p>Second <b>bold</b> &lt;tag&gt;<div class="comments"><p>me too</p></div></div><aside>Side</aside><form>Q</form><script>var a="</p>"</script><footer>&copy; x</footer>"""


def test_html_text_and_site_tree(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % ("Our cookies are the best", f"page {k}")) for k in range(12)] + [(90, None, None), (91, "http://x.y/", "<p>cut <b>short &am"), (92, "http://h2/", "<article><p>a</p></article>")]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # The strip and the title are the same on all pages of the host.
    assert found[3].text == "First page 3 line\n\nSecond bold <tag>"
    assert html_extract.main_text(PAGE % ("Strip", "one"), frozenset()) == "Strip\n\nTitle & more\n\nFirst one line\n\nSecond bold <tag>"
    assert (found[90].text, found[91].text, found[92].text, found[92].n_chars) == ("", "cut short &am", "a", 1)


def html_texts(spark, sources):
    rows = [(k, f"http://h.example/{k}", source) for k, source in enumerate(sources)]
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_site_tree_leaves_articles_and_counts_copies_once(spark):
    page = "<body><article><h1>News</h1><p>%s</p><ul><li>%s</ul></article>"
    found = html_texts(spark, [page % ("copied", "a list")] * 18 + [page % ("alone", "own list"), page % ("copied", "other")])
    assert (found[18], found[19], found[0]) == ("News\n\nalone\n\nown list", "News\n\ncopied\n\nother", "News\n\ncopied\n\na list")
    # Without articles: copies are no evidence, and of a path that most pages repeat only what they repeat goes.
    plain = "<body><div class=x><p>%s</p></div><h2>%s</h2>"
    assert html_texts(spark, [plain % ("copied", "one")] * 30 + [plain % ("alone", "two")])[30] == "alone\n\ntwo"
    found = html_texts(spark, [plain % ("strip" if k else "own words", f"head {k}") for k in range(30)])
    assert (found[0], found[1]) == ("own words\n\nhead 0", "head 1")


@pytest.mark.parametrize(("source", "text"), [
    ("<div class='content no-sidebar'><p>a</p></div>", "a"), ("<div id='page' class='has-sidebar'><p>a</p></div>", "a"), ("<main class='search-enabled'><p>a</p></main>", "a"),
    ("<article class='post has-comments'><header class='entry-header'><h1>t</h1></header><p>a</p></article>", "t\n\na"), ("<article class='notice'><header class='header'><h1>t</h1></header>a</article>", "t\n\na"),
    ("<div id='page' class='sidebar'><nav>n</nav><main><p>a</p></main></div>", "a"), ("<div class='widget'><p>a</p></div><nav>n</nav>", "a"), ("<form><p>a</p></form>", "a"),
    ("<div class='post'><article>a</article></div><div id='comments'><article class='comment'>me too</article></div>", "a"), ("<p>a</p><div class='sidebar wide'>s</div>", "a"), ("<nav>n</nav>", ""),
])
def test_classes_that_name_furniture(source, text):
    assert html_extract.main_text(source, frozenset()) == text
    assert html_extract.main_text("<div>" * 5000 + source, frozenset()) == text


def test_warc_round_trip_and_validation(spark, tmp_path):
    rows = [(1, "http://a/b c\r\nX: y", "<p>é"), (2, None, "<p>é"), (3, "http://c/", None), (4, "", ""), (None, "http://n/", "z"), (5, "http://big/", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert sum(r.n_records for r in warc.write_archives(pages, folder).collect()) == len(rows)
    found = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert (found[1].record_type, found[1].refers_to, found[1].payload_bytes, found[2].record_type) == ("revisit", 2, 5, "response")
    assert (found[3].refers_to, found[4].record_type, found[None].payload_bytes) == (4, "response", 1)
    assert found[1].url == rows[0][1] and bytes(found[5].payload) == b"x" * 200_000 and found[2].payload_digest == warc.digest("<p>é".encode())
    archive = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    with pytest.raises(ValueError):
        list(warc.records(archive[:-3]))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, "d").replace(b"abc", b"abd"))
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_chat_round_trip(spark):
    said = [(1, 0, "user", r"\s \l <turn x> </turn> \\ & > <image>"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (2, 5, None, None), (2, None, "assistant", "")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    chats = chat.format_chats(turns)
    back = sorted((r.conv_id, r.place, r.role, r.text, r.masked) for r in chat.read_chats(chats).collect())
    assert back == [(1, 0, "user", said[0][3], None), (1, 1, "assistant", "a\nb", "a\nb"), (1, 2, "assistant", "a\nb", "a\nb"), (2, 0, "assistant", "", ""), (2, 1, "", "", None)]
    row = chats.filter("conv_id = 1").first()
    assert [row.formatted[s.start : s.start + s.length] for s in row.spans if s.counted] == ["a\nb", "a\nb"]
    assert chat.read_chats(chat.format_chats(turns.limit(0))).count() == 0


def test_chat_parts_become_numbered_placeholders(spark):
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    rows = [(1, 0, "user", [part("image", ref="a.png", n=10), part("text", "<image> or"), part("audio", ref="b.wav", n=7)]), (1, 1, "assistant", [part("text", "ok"), part("document", ref="c.pdf")])]
    row = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert row.formatted == r"<turn user><image:1>\limage\g or<audio:2></turn>" + "\n<turn assistant>ok<document:3></turn>\n"
    assert [(a.number, a.reference) for a in row.attachments] == [(1, "a.png"), (2, "b.wav"), (3, "c.pdf")] and row.n_tokens_attached == 17
    assert [row.formatted[s.start : s.start + s.length] for s in row.spans if s.counted] == ["ok<document:3>"]
    assert hashlib.sha256(row.formatted.encode()).hexdigest()
