"""Brute-force versions, odd ids, clashing columns and the stages of the pipeline."""

import math
import random
import sys
import unicodedata
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graywacke.llm import chat, common, decontaminate, html_extract, language_id, minhash, packing, quality_classifier, quality_rules, url_filter, url_table, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BIG = 2**53 + 1


def test_ids_beyond_doubles_beside_nulls(spark, tmp_path):
    rows = [(BIG, "same words here"), (None, "none"), (2**53 - 1, "same words here")]
    pieces = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert {r.doc_id for r in pieces} == {BIG, None, 2**53 - 1}
    pages = spark.createDataFrame([(i, "http://a/", t) for i, t in rows], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert found == {BIG: ("response", None), None: ("response", None), 2**53 - 1: ("revisit", BIG)}


def test_token_ids_are_the_tokenizers_for_all_characters():
    ids = packing.WordIds(TOKENIZER)
    assert ids.wordwise
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xE100 <= c < 0xF800 and c < 0xF0000]
    settled = [c for c in points if unicodedata.category(chr(c)) != "Cn"]
    others = [c for c in points if unicodedata.category(chr(c)) == "Cn"][::97]
    runs = [settled[i : i + 32] for i in range(0, len(settled), 32)] + [[c] for c in others]
    texts = [" ".join(f"a{c}b {c} {c}{c}1 {c}, x" for c in map(chr, run)) for run in runs]
    for i in range(0, len(texts), 512):
        part = texts[i : i + 512]
        assert [list(x) for x in ids.encode(part)] == [e.ids for e in ids.tokenizer.encode_batch(part, add_special_tokens=False)]
    assert ids.encode([None, ""])[0].tolist() == []


def test_other_tokenizers_are_asked_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = packing.WordIds(path)
    assert not ids.wordwise and list(ids.encode(["It's here, 3.14"])[0]) == ids.tokenizer.encode("It's here, 3.14", add_special_tokens=False).ids


def naive_best_fit(lengths, capacity):
    limits, weights, bins, out = capacity.limits(), capacity.weights, [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = [x / m for x, m in zip((lengths[i], 1, lengths[i] ** 2), limits)]
        best = None
        for k, left in enumerate(bins):
            after = [a - b for a, b in zip(left, need)]
            if min(after) >= -1e-12:
                worth = -sum(a * w * b for a, w, b in zip(left, weights, need)) if capacity.dot_product else sum(w * a * a for a, w in zip(after, weights))
                if best is None or worth < best[0] - 1e-15:
                    best = (worth, k)
        if best is None:
            bins.append([1.0] * 3)
            best = (0, len(bins) - 1)
        bins[best[1]] = [a - b for a, b in zip(bins[best[1]], need)]
        out[i] = best[1]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("capacity", [packing.Capacity(128), packing.Capacity(128, 4, 6000), packing.Capacity(128, 5, dot_product=True)])
def test_best_fit_against_a_naive_packer(capacity):
    lengths = np.random.default_rng(4).choice([1, 2, 4, 8, 16, 32, 64], 300)
    assert packing.best_fit(lengths, capacity)[0].tolist() == naive_best_fit(lengths.tolist(), capacity)


def test_language_distance_against_a_naive_one():
    rng = random.Random(2)
    learned = {k: np.array(rng.sample(range(97, 123), 20)) for k in "ab"}
    profiles = language_id.Profiles(learned)
    for _ in range(50):
        text = "".join(rng.choices("abcdefghij klmnop", k=rng.randint(1, 60)))
        low = " " + " ".join(text.split()) + " "
        grams = Counter()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                g = low[i : i + n]
                if g != " " and (n < 3 or g[1] != " "):
                    grams[sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(g))] += 1
        if low.strip() == "":
            assert profiles.nearest(text) == ("und", 0.0)
            continue
        ranked = sorted(grams, key=lambda g: (-grams[g], g))[: language_id.PROFILE]
        away = {k: sum(abs(list(p).index(g) - r) if g in p else language_id.PROFILE for r, g in enumerate(ranked)) for k, p in learned.items()}
        best = min(away, key=lambda k: (away[k], k))
        assert profiles.nearest(text)[0] == best and profiles.nearest(text)[1] == pytest.approx(1 - away[best] / max(1, max(away.values())))


def test_url_scores_against_brute_force_and_held_out(spark):
    rows = url_table.labelled_urls()
    model = url_filter.fit(rows)
    urls = ["http://M.Casino7.net/de/12?x#y", "https://quiet.org", "", None, "http://é.org/ü"]
    found = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), (), model).orderBy("page_id").collect()
    for r in found:
        ids = []
        for kind, text in (("h", r.host), ("p", r.path)):
            framed = f"{kind}^{''.join('0' if c in '123456789' else c for c in text)}$".encode()
            ids += [zlib.crc32(framed[i : i + n], ord(kind)) % url_filter.BUCKETS for n in (3, 4, 5) for i in range(1, len(framed) - n + 1)]
        logit = model.bias + sum(model.weights[i] for i in ids) / math.sqrt(max(1, len(ids)))
        assert r.unwanted == pytest.approx(1 / (1 + math.exp(-logit))) and r.verdict == ("block" if logit >= 0 else "allow")
    right = 0
    for fold in range(5):
        part = url_filter.fit([r for r in rows if zlib.crc32(r[0].encode()) % 5 != fold])
        for url, label in rows:
            if zlib.crc32(url.encode()) % 5 == fold:
                host, _, path = url.split("://")[1].partition("/")
                right += (part.unwanted(host, f"/{path.split('?')[0]}") >= 0.5) == label
    assert right / len(rows) > 0.8
    assert url_filter.fit([]).unwanted("a.b", "/") == 0.5


def test_classifier_against_brute_force():
    rng = np.random.default_rng(3)
    model = quality_classifier.Model(rng.normal(size=quality_classifier.BUCKETS + 1).astype(np.float32), 0.25)
    for text in ("", None, "one", "two words", "é ü\n ab  c", "word " * 40):
        ids = [i for ids, _ in quality_classifier.features(quality_classifier.Texts([text])) for i in ids]
        w = (text or "").split()
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        expected = len(w) + max(0, len(w) - 1) + len(triples) - len(set(triples))
        framed = "\n" + (text or "") + "\n"
        data = framed.encode()
        space = [b in (32, 9, 10, 11, 12, 13) for b in data]
        expected += sum(not any(space[i + 1 : i + n - 1]) for n in (3, 4, 5) for i in range(len(data) - n + 1))
        assert len(ids) == expected
        logit = 0.25 + (sum(float(model.weights[i]) for i in ids) / len(ids) if ids else 0)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_samples_are_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(300)] + [(2, "x" * 5000), (3, "short"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    assert len(common.labelled_sample(docs, labels, "quality", 10)) == 9
    assert len(common.labelled_sample(docs, labels, "quality", 4)) == 4
    assert sum(len(t) for t, _ in common.labelled_sample(docs, labels, "quality", 10, characters=40)) <= 40
    assert common.labelled_sample(docs.limit(0), labels, "quality", 10) == []


def test_columns_that_would_be_overwritten_are_an_error(spark):
    row = spark.createDataFrame([(1, "a", "http://a/", "<p>a")], "doc_id long, text string, url string, html string")
    model = quality_classifier.train([])
    for call in (
        lambda: url_filter.judge_urls(row.withColumn("HOST", F.lit("x")), (), url_filter.fit([])), lambda: quality_classifier.score(row.withColumn("score", F.lit(1)), model),
        lambda: language_id.predict(row.withColumn("Score", F.lit(1)), language_id.Profiles({})), lambda: quality_rules.judge(row.withColumn("rules", F.lit(1)), []), lambda: html_extract.extract(row),
    ):
        with pytest.raises(ValueError):
            call()
    mine = row.drop("text").withColumns({"paths": F.lit(1), "their_host": F.lit(2), "site_host": F.lit(3), "blocks": F.lit(4), "host": F.lit(5)})
    assert html_extract.extract(mine).collect()[0].asDict() == {"doc_id": 1, "url": "http://a/", "html": "<p>a", "paths": 1, "their_host": 2, "site_host": 3, "blocks": 4, "host": 5, "text": "a", "n_chars": 1}
    more = row.withColumns({"node": F.lit(1), "component": F.lit(2), "their_id": F.lit(3), "w": F.lit(4), "key": F.lit(5)})
    assert [r.component_id for r in minhash.near_duplicates(more).collect()] == [1]
    assert [r.n_hit for r in decontaminate.contamination(more, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()] == [1]


def test_an_item_without_an_id_counts(spark):
    docs = spark.createDataFrame([(1, "x a b y")], "doc_id long, text string")
    row = decontaminate.contamination(docs, spark.createDataFrame([(None, "a b"), (2, "b y")], "item_id long, text string")).first()
    assert (row.n_hit, row.n_items, list(row.item_ids)) == (3, 2, ["", "2"])


def test_parts_of_unknown_kinds_stop_the_job(spark):
    rows = [(1, 0, "user", [("video", None, "v", 3)])]
    with pytest.raises(Exception, match="no such kind"):
        chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()


BARE = "<body><div class=x1><span>Home</span> Start %d</div><div class=x2>Buy now %d</div><div class=x3><h2>Title %d</h2>%s</div><div class=x4>Terms %d</div>"


def bare_pages(n=40):
    rng = random.Random(8)
    return [BARE % (k, k, k, "".join(f"<p>words of page {k} part {j} and more</p>" for j in range(rng.randint(2, 12))), k) for k in range(n)]


def test_the_tree_alone_finds_the_text_that_authors_vary(spark):
    sources = bare_pages()
    pages = spark.createDataFrame([(k, "http://h/", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    on = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    off = {r.page_id: r.text for r in html_extract.extract(pages, tree=False).collect()}
    for k in range(len(sources)):
        assert on[k].startswith(f"Title {k}\n\nwords of page {k} part 0") and "Terms" not in on[k] and "Buy" not in on[k]
        assert off[k].startswith(f"Home Start {k}") and "Terms" in off[k] and "Buy" in off[k]


def test_importances_against_naive_entropies(spark):
    sources = bare_pages(25) + bare_pages(3)[:3] + ["<body><div class=x9>Same</div><p>a<p>b"] * 2 + [f"<body><div class=x9>Same</div><p>{k}" for k in range(30)]
    pages = spark.createDataFrame([("h", s) for s in sources], "host string, html string")
    counts = html_extract.merged(pages)
    distinct = [html_extract.Page(s) for s in dict.fromkeys(sources)]
    per_page = [Counter((e.path, e.up.path) for e in p.elements if e.up and e.path != e.up.path) for p in distinct]
    have = [{0, *(path for path, _ in c)} for c in per_page]
    expected = set()
    for child, parent in set().union(*per_page):
        seen = Counter(c[(child, parent)] for c, paths in zip(per_page, have) if parent in paths)
        total = sum(seen.values())
        if -sum(n / total * math.log(n / total) for n in seen.values()) >= html_extract.VARIED:
            expected.add(parent)
    assert {r.path for r in html_extract.important(counts).collect()} == expected and expected
    blocks = Counter(b for p in distinct for b in {(e.path, html_extract.fingerprint(t)) for e, t in p.blocks})
    limit = (1 - html_extract.THRESHOLD) * math.log(len(distinct) + html_extract.SMOOTH)
    nodes = {path: [n for (p, _), n in blocks.items() if p == path] for path, _ in blocks}
    low = {(path, f) for (path, f), n in blocks.items() if math.log(n) > limit and sum(k * math.log(k) for k in nodes[path]) / sum(nodes[path]) > limit}
    assert {(r.path, r.feature) for r in html_extract.recurring(counts).collect()} == low and low


def corpus(spark, folder):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(900)]
    good = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 120))) + "." for _ in range(160)]
    junk = [" ".join("#*" + w.upper() + "$%" for w in rng.choices(vocabulary, k=80)) for _ in range(60)]
    poor = [" ".join(rng.choices(["CLICK", "HERE", "NOW!!", "win", "$$"] + vocabulary[:20], k=90)) for _ in range(60)]
    item = " ".join(rng.choices(vocabulary, k=14))
    texts = good + junk + poor + [good[0] + " x", good[1], good[2] + f" {item} end", None, "", "too short"]
    docs = spark.createDataFrame([(None if i == 5 else i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("their_id", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 160), 0) for i in range(280)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, item


def test_the_stages_of_the_pipeline_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    texts, item = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        rows = docs.select("doc_id", "text").collect()
        kept.append({r.text for r in rows})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    measured = quality_rules.measure(texts)
    base = {t for t, bad in zip(texts, quality_rules.failed(measured)) if not bad}
    assert kept[0] <= base and len([t for t in texts[:160] if t in kept[0]]) >= 155 and not any(t in kept[0] for t in texts[160:220])
    model = quality_classifier.train(common.labelled_sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "quality", quality_classifier.PER_CLASS, balanced=True))
    assert kept[1] == {t for t in kept[0] if model.scores([t])[0] >= 0.5}
    sets = {t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in kept[1]}
    first = {t: i for i, t in reversed(list(enumerate(texts))) if t}
    gone = {t for t in kept[1] for u in kept[1] if t != u and 100 * len(sets[t] & sets[u]) >= 75 * len(sets[t] | sets[u]) and first[u] < first[t]}
    assert kept[2] == kept[1] - gone and gone
    assert kept[3] == {t for t in kept[2] if item not in t}
    result = corpus_pipeline.run(spark, folder)
    assert result.select("doc_id", "piece").distinct().count() == result.count() == len(kept[3])


def test_the_pipeline_of_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    corpus(spark, f"file://{tmp_path}/some")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/some/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
