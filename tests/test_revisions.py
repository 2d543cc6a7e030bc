"""Letters, submissions and revisions: quotes, alignment, claims and files."""

import random
from itertools import combinations

from graywacke.operators import revisions
from graywacke.plans import registry

NEW = "We studied 41 people over 8 weeks. The mean fell from 14.2 to 9.6 points in the treated group.\nNobody left the study early, as far as we know. All gave consent."
LETTER = """Dear editor
Comment 1-1: We have revised the text: “The mean fell from 14.2 to 9.6 points in the treated group.”
Comment 1-2: It now says "The mean fell from 14.2 to 9.7 points in the treated group."
Comment 1-3: "Nobody left ... as far as we know." and "Nobody left the study early, as far as we knew."
Comment 1-5: We changed this. Comment on it.
Comment 1-5: See line 99.
Comment 2-1: "Birds sing at dawn and at dusk." Thank you, lines 2 to 3."""


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_quotes_claims_and_comment_numbers(spark):
    new = revisions.sentences(frame(spark, NEW), "doc_id", "text")
    answered = revisions.answers(frame(spark, LETTER), "doc_id", "text")
    found = {(r.nth, r.part): (r.status, r.severity, r.place) for r in revisions.checked_quotes(revisions.quotes(answered), new).collect()}
    assert found == {
        (1, 0): ("verbatim", None, 1), (2, 0): ("digits", "fatal", 1), (3, 0): ("abbreviated", "warning", 2), (3, 1): ("reworded", "warning", 2), (6, 0): ("absent", "fatal", None),
    }
    ratio = [r.ratio for r in revisions.checked_quotes(revisions.quotes(answered), new).filter("status = 'digits'").collect()]
    assert 0.98 < ratio[0] < 1  # fatal all the same
    told = {(r.comment, r.claim, r.location) for r in revisions.claims(answered, new).collect()}
    assert told == {("1-1", "checkable", None), ("1-2", None, None), ("1-3", None, None), ("1-5", "unverifiable", None), ("1-5", None, "out of range"), ("2-1", None, "ok")}
    assert {r.location for r in revisions.claims(answered, new, numbered=False).collect()} == {None, "unverifiable"}
    assert {(r.comment, r.issue) for r in revisions.comments(answered).collect()} == {("1-5", "duplicate"), ("1-4", "gap")}


def test_equal_quotes_are_looked_up_once(spark):
    lines = ["The same line is here many times."] * 300 + ["Another line of several words stands here, once."]
    new = revisions.sentences(frame(spark, "\n".join(lines)), "doc_id", "text")
    said = [lines[0], lines[-1], "Another line of several words stands here, twice.", "Nothing of this."]
    asked = spark.createDataFrame([(0, nth, 0, said[nth % 4]) for nth in range(400)], "doc_id long, nth int, part int, quote string")
    found = sorted((r.quote, r.place, r.nearest) for r in revisions.nearest(asked, new).collect())
    assert found == sorted([(said[0], 0, said[0]), (said[1], 300, said[1]), (said[2], 300, said[1])])
    status = {(r.nth % 4, r.status, r.place) for r in revisions.checked_quotes(asked, new).collect()}
    assert status == {(0, "verbatim", 0), (1, "verbatim", 300), (2, "absent", 300), (3, "absent", None)}
    assert revisions.checked_quotes(asked, new).count() == 400


def test_changed_values_that_no_quote_mentions(spark):
    old = revisions.sentences(frame(spark, NEW.replace("9.6", "9.8").replace("41", "43").replace("consent", "consent and 2 pens").replace("8 weeks", "eight weeks")), "doc_id", "text")
    new = revisions.sentences(frame(spark, NEW), "doc_id", "text")
    checked = revisions.checked_quotes(revisions.quotes(revisions.answers(frame(spark, LETTER), "doc_id", "text")), new)
    found = {(r.old_place, r.new_place): (r.status, r.values_gone, r.linked, r.severity) for r in revisions.changes(revisions.aligned(old, new), checked).collect()}
    assert found == {(0, 0): ("changed", True, False, "fatal"), (1, 1): ("changed", True, True, None), (3, 3): ("changed", True, False, "fatal")}


def test_alignment_keeps_a_longest_run_and_loses_no_sentence(spark):
    rng = random.Random(2)
    versions = []
    for _ in range(25):
        old = [f"s{rng.randrange(9)}." for _ in range(rng.randrange(9))]
        new = [x for x in old if rng.random() < 0.8]
        for _ in range(rng.randrange(3)):
            new.insert(rng.randrange(len(new) + 1), f"s{rng.randrange(12)}.")
        if len(new) > 2 and rng.random() < 0.5:
            new.append(new.pop(0))
        versions.append((old, new))
    sides = [revisions.sentences(frame(spark, *("\n".join(v[k]) for v in versions)), "doc_id", "text") for k in (0, 1)]
    runs, rows = {}, {}
    for r in revisions.anchors(*sides).collect():
        runs.setdefault(r.doc_id, []).append((r.old_place, r.new_place))
    for r in revisions.aligned(*sides).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for k, (old, new) in enumerate(versions):
        pairs = sorted((old.index(x), new.index(x)) for x in set(old) & set(new) if old.count(x) == new.count(x) == 1)
        best = max((n for n in range(len(pairs) + 1) for c in combinations(pairs, n) if all(a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        run = sorted(runs.get(k, []))
        assert len(run) == best and set(run) <= set(pairs) and all(a[1] < b[1] for a, b in zip(run, run[1:]))
        mine = rows.get(k, [])
        assert sorted(r.old_place for r in mine if r.old_place is not None) == list(range(len(old)))
        assert sorted(r.new_place for r in mine if r.new_place is not None) == list(range(len(new)))
        both = sorted((r.old_place, r.new_place) for r in mine if r.old_place is not None and r.new_place is not None)
        assert all(a[1] < b[1] for a, b in zip(both, both[1:])) and all((r.status == "same") == (r.old == r.new) for r in mine)


def test_files_attached(spark):
    a, b, c = NEW, NEW + " One more.", "Nothing of it is here. Not a word."
    old = revisions.sentences(frame(spark, a, a, c, a, ""), "doc_id", "text")
    new = revisions.sentences(frame(spark, a, b, a, "", ""), "doc_id", "text")
    assert {r.doc_id: r.status for r in revisions.attachments(old, new).collect()} == {0: "same file", 1: "ok", 2: "unrelated", 3: "missing"}


def test_manuscripts_are_compared_in_their_rows(spark, tmp_path):
    texts = ["Of a study.\n" + NEW.replace("9.6", "9.8").replace("consent", "consent and 2 pens"), "Of a study.\n" + NEW, "Alone.\nNothing else begins so.", " \n ", " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [registry.queries()[name](spark, str(tmp_path)) for name in ("tx17_changes", "tx15_quotes")]
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
        found = [sorted(map(tuple, f.collect()), key=str) for f in frames]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # First lines twice, texts and their ids for each of two joins, and the submissions' texts once more: no sentence is dealt out.
    assert all(p.count("Exchange hashpartitioning") <= 7 and "checkpoint" not in p.lower() and "ExistingRDD" not in p for p in plans)
    assert found[0] == [(1, 2, 2, "changed", True, False, "fatal"), (1, 4, 4, "changed", True, False, "fatal")]
    assert found[1] == [(1, 1, "abbreviated", "warning", None, None), (1, 3, "verbatim", None, 3, 1.0), (1, 4, "absent", "fatal", None, None)]
