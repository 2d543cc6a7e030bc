"""A response letter against the submitted and the revised version of a manuscript: quotes, changed values, claims, places, files.

A manuscript (doc_id) is a row that holds its quotes and sentences as arrays: what is compared never leaves that row, and nothing of it is dealt
out again. Quotes meet sentences by their rarest shingles, versions are aligned by anchors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Words in a shingle; a sentence is near a quote if it has at least one in so many of the quote's shingles.
SHINGLE, SHARE = 3, 4
#: Edit ratio from which a quote that isn't verbatim is only a warning, if its digits agree.
NEAR = 0.95
GAP, BLANK = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: What stands for words left out of a quote.
ELLIPSIS = r"\s*(?:\[\s*)?(?:\.\.\.|…)(?:\s*\])?\s*"
ANSWER = r"\n(?=\s*Comment\s+\d)"
COMMENT = r"^\s*Comment\s+(\d+(?:[-.]\d+)?)"
QUOTE = r"[\"“]([^\"“”]+)[\"”]"
CLAIM = r"(?i)\bwe\s+(?:have\s+)?(?:revised|changed|added|removed|deleted|corrected|clarified|rewritten|updated|replaced)\b"
PLACE = r"(?i)\blines?\s+(\d+)"


def parted(text: str) -> Column:
    """The sentences of a text, parted at line ends and after . ! ? before white space; inner white space as one space."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?]){GAP}", "$1\n"), "\n")
    return F.filter(F.transform(parts, squeezed), lambda s: s != "")


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, GAP, " "), F.lit(BLANK))


def sentences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, place, sentence): the sentences of parted(), from 0."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(parted(text)).alias("place", "sentence"))


def held(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(doc_id, name): what a manuscript has of the columns, as one array in their order."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def answers(letters: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, nth, comment, claims, quotes, places) of each answer in a letter, from one "Comment 2-4" to the next: whether it claims a
    change, what it quotes, and the lines it refers to."""
    parts = letters.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, ANSWER)).alias("nth", "part")).filter(F.regexp_like("part", F.lit(COMMENT)))
    said = F.regexp_replace("part", QUOTE, "")
    places = F.transform(F.regexp_extract_all(said, F.lit(PLACE), F.lit(1)), lambda n: n.try_cast("int"))
    return parts.select("doc_id", "nth", F.regexp_extract("part", COMMENT, 1).alias("comment"), F.regexp_like(said, F.lit(CLAIM)).alias("claims"), F.regexp_extract_all("part", F.lit(QUOTE), F.lit(1)).alias("quotes"), places.alias("places"))


def quotes(answered: DataFrame) -> DataFrame:
    """From answers(): (doc_id, nth, part, quote), inner white space as one space."""
    cells = answered.select("doc_id", "nth", F.posexplode("quotes").alias("part", "quote"))
    return cells.withColumn("quote", squeezed(F.col("quote")))


def quoted(text: Column) -> Column:
    """What quotes() gives of one letter, as an array of (nth, part, quote)."""
    inside = lambda part: F.regexp_extract_all(part, F.lit(QUOTE), F.lit(1))
    listed = lambda part, nth: F.transform(inside(part), lambda q, k: F.struct(nth.alias("nth"), k.alias("part"), squeezed(q).alias("quote")))
    return F.flatten(F.transform(F.split(text, ANSWER), lambda part, nth: F.filter(listed(part, nth), lambda _: F.regexp_like(part, F.lit(COMMENT)))))


def shingles(text: str) -> set[str]:
    """Runs of SHINGLE words in lower case; of fewer words, all of them as one."""
    words = text.lower().split(" ")
    return {" ".join(words[k : k + SHINGLE]) for k in range(max(len(words) - SHINGLE, 0) + 1)}


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def near_places(quotes: pd.Series, sentences: pd.Series) -> pd.Series:
    """For each quote of a manuscript the places of the sentences that can be nearest: the first that equals it; or else, of equal ones the
    first, those with at least one in SHARE of its shingles.

    A sentence that has enough of a quote's n shingles has one of any n - ceil(n / SHARE) + 1 of them: the rarest are enough to find it.
    """

    def found(quotes: Sequence[str], sentences: Sequence[str]) -> list[list[int]]:
        first: dict[str, int] = {}
        for place, s in enumerate(sentences):
            first.setdefault(s, place)
        out: dict[str, list[int]] = {q: [first[q]] for q in quotes if q in first}
        if len(rest := {q for q in quotes if q not in out}):
            having, runs = defaultdict(list), {place: shingles(s) for s, place in first.items()}
            for place, each in runs.items():
                for run in each:
                    having[run].append(place)
            for q in rest:
                mine = shingles(q)
                enough = -(-len(mine) // SHARE)
                # What no sentence has is among the rarest and finds nothing.
                places = sorted((having[run] for run in mine if run in having), key=len)
                may = {place for p in places[: max(0, len(places) - enough + 1)] for place in p}
                out[q] = sorted(place for place in may if len(mine & runs[place]) >= enough)
        return [out[q] for q in quotes]

    return pd.Series([found(q, s) for q, s in zip(quotes, sentences)], dtype=object)


def judged(rows: DataFrame) -> DataFrame:
    """rows (quotes: array of nth, part, quote; sentences: array of text) with checked, an array with a struct for each quote: nth, part, quote,
    status and severity as in checked_quotes(), and at, nearest and ratio of its nearest sentence, the first one of equals."""
    rows = rows.withColumn("asked", F.arrays_zip("quotes", near_places("quotes.quote", "sentences").alias("near")))
    # Null without sentences, so that nothing is verbatim.
    rows = rows.withColumn("whole", F.expr("if(size(sentences) > 0, array_join(sentences, ' '), null)"))
    pieces = rf"filter(split(h.quote, r'{ELLIPSIS}'), p -> p != '')"
    # The place after each piece, or 0 once a piece is missing.
    after = f"aggregate({pieces}, 1, (at, p) -> if(at > 0, transform(array(locate(p, whole, at)), x -> if(x > 0, x + length(p), 0))[0], 0))"
    short = rf"h.quote rlike r'{ELLIPSIS}' and size({pieces}) > 0 and coalesce({after}, 0) > 0"
    ratio = "if(s = h.quote, 1D, 1 - levenshtein(h.quote, s) / greatest(length(h.quote), length(s)))"
    best = f"array_max(transform(a.near, p -> named_struct('ratio', transform(array(sentences[p]), s -> {ratio})[0], 'first', -p)))"
    told = f"transform(asked, a -> transform(array(a.quotes), h -> named_struct('h', h, 'verbatim', coalesce(contains(whole, h.quote), false), 'short', not coalesce(contains(whole, h.quote), false) and {short}, 'best', {best}))[0])"
    rows = rows.withColumn("told", F.expr(told)).drop("asked", "whole")

    def nearest(t: Column) -> Column:
        return F.struct(t.h.alias("h"), t.verbatim.alias("verbatim"), t.short.alias("short"), (-t.best.first).alias("at"), F.get("sentences", -t.best.first).alias("nearest"), t.best.ratio.alias("ratio"))

    def status(t: Column) -> Column:
        other = t.nearest.isNotNull() & (digits(t.h.quote) != digits(t.nearest))
        kind = F.when(t.verbatim, "verbatim").when(t.short, "abbreviated").when(other, "digits").when(t.ratio >= NEAR, "reworded").otherwise("absent")
        return F.struct(t.h.nth.alias("nth"), t.h.part.alias("part"), t.h.quote.alias("quote"), kind.alias("status"), t["at"].alias("at"), t.nearest.alias("nearest"), t.ratio.alias("ratio"))

    def severity(t: Column) -> Column:
        return t.withField("severity", F.when(t.status.isin("abbreviated", "reworded"), "warning").when(t.status != "verbatim", "fatal"))

    return rows.withColumn("checked", F.transform(F.transform(F.transform("told", nearest), status), severity)).drop("told")


def spread(rows: DataFrame, each: Column | str) -> DataFrame:
    """doc_id and the fields of each struct in the array. Outer, as Spark would else test the array's size below the functions that it comes from."""
    return rows.select("doc_id", F.explode_outer(each).alias("p")).filter("p is not null").select("doc_id", "p.*")


def _checked(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, c, place): a row for each of asked, c as in judged()."""
    rows = held(asked, "quotes", "nth", "part", "quote").join(held(sentences, "of", "place", "sentence"), "doc_id", "left")
    rows = judged(rows.select("doc_id", "quotes", "of", F.coalesce("of.sentence", F.array().cast("array<string>")).alias("sentences")))
    placed = F.transform("checked", lambda c: F.struct(c.alias("c"), F.get("of.place", c["at"]).alias("place")))
    return spread(rows, placed)


def nearest(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, quote, place, nearest, ratio): for each different quote of a manuscript the sentence with the greatest edit ratio, the first
    one of equals, among those with at least one in SHARE of its shingles; quotes without such a sentence are left out."""
    each = _checked(asked, sentences).filter("place is not null")
    return each.select("doc_id", "c.quote", "place", "c.nearest", "c.ratio").distinct()


def digits(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def checked_quotes(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """asked (doc_id, nth, part, quote) with status, severity and the nearest sentence of the revised version (place, nearest, ratio).

    verbatim: the version has it, character by character; abbreviated: it has the pieces about an ellipsis, in order (warning);
    digits: its nearest sentence has other digits (fatal, however near); reworded: the nearest has a ratio of NEAR or more (warning); absent (fatal).
    """
    return _checked(asked, sentences).select("doc_id", "c.nth", "c.part", "c.quote", "c.status", "c.severity", "place", "c.nearest", "c.ratio")


def longest_run(new: list[int]) -> list[int]:
    """For places in one version, in the order of the other: which are kept so that the most increase; of equal choices the first for each length."""

    def lengths(values: list[int]) -> list[int]:
        ends: list[int] = []
        out = []
        for v in values:
            at = bisect_left(ends, v)
            ends[at : at + 1] = [v]
            out.append(at + 1)
        return out

    up, down = lengths(new), lengths([-v for v in reversed(new)])[::-1]
    longest, seen, out = max(up, default=0), set(), []
    for k, (a, b) in enumerate(zip(up, down)):
        # Those on some longest run and at one place in it fall: taking the first for each place gives a run.
        if a + b - 1 == longest and a not in seen:
            seen.add(a)
            out.append(k)
    return out


def anchored(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """The places of sentences that both versions have once, the longest run of them in the order of both."""
    many_old, many_new = Counter(old), Counter(new)
    there = {s: k for k, s in enumerate(new) if many_new[s] == 1}
    both = [(k, there[s]) for k, s in enumerate(old) if many_old[s] == 1 and s in there]
    return [both[k] for k in longest_run([b for _, b in both])]


PLACES = StructType().add("old", ArrayType(IntegerType())).add("new", ArrayType(IntegerType()))


@F.pandas_udf(PLACES)
def anchor_places(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    each = [anchored(a, b) for a, b in zip(old, new)]
    return pd.DataFrame({"old": [[a for a, _ in e] for e in each], "new": [[b for _, b in e] for e in each]}, dtype=object)


@F.pandas_udf(PLACES)
def dealt_places(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Places that stand against each other, -1 for none: between two anchors the k-th sentence of one version and the k-th of the other."""
    rows: dict[str, list[list[int]]] = {"old": [], "new": []}
    for a, b in zip(old, new):
        ends = [*anchored(a, b), (len(a), len(b))]
        left, right = [], []
        for (i, j), (to_i, to_j) in zip([(0, 0), *ends], ends):
            for k in range(max(to_i - i, to_j - j)):
                left.append(i + k if i + k < to_i else -1)
                right.append(j + k if j + k < to_j else -1)
        rows["old"].append(left)
        rows["new"].append(right)
    return pd.DataFrame(rows, dtype=object)


def against(before: str, after: str, pairs: str) -> Column:
    """For rows with the sentences of two versions and what dealt_places() gives for them: an array of (a, b, old, new, status), a and b the
    places in the versions, -1 for none; status: same, changed, removed or added."""
    texts = F.transform(F.arrays_zip(F.col(f"{pairs}.old").alias("a"), F.col(f"{pairs}.new").alias("b")), lambda p: F.struct(p.a.alias("a"), p.b.alias("b"), F.get(before, p.a).alias("old"), F.get(after, p.b).alias("new")))
    status = lambda p: F.when(p.new.isNull(), "removed").when(p.old.isNull(), "added").when(p.old == p.new, "same").otherwise("changed")
    return F.transform(texts, lambda p: p.withField("status", status(p)))


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, before, after): the sentences of two versions with their places."""
    rows = held(before, "before", "place", "sentence").join(held(after, "after", "place", "sentence"), "doc_id", "full_outer")
    none = F.array().cast(rows.schema["before"].dataType)
    return rows.select("doc_id", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def anchors(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, old_place, new_place): sentences that both versions have once, the longest run of them in the order of both."""
    rows = _both(before, after).withColumn("run", anchor_places("before.sentence", "after.sentence"))
    placed = F.transform(F.arrays_zip("run.old", "run.new"), lambda p: F.struct(F.get("before.place", p.old).alias("old_place"), F.get("after.place", p.new).alias("new_place")))
    return spread(rows, placed)


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, old_place, new_place, old, new, status) of the sentences of two versions: same, changed, removed or added.

    Between two anchors the k-th sentence of one version stands against the k-th of the other.
    """
    rows = _both(before, after).select("doc_id", F.col("before.place").alias("old_at"), F.col("after.place").alias("new_at"), F.col("before.sentence").alias("before"), F.col("after.sentence").alias("after"))
    rows = rows.withColumn("pairs", dealt_places("before", "after"))
    placed = F.transform(against("before", "after", "pairs"), lambda p: F.struct(F.get("old_at", p.a).alias("old_place"), F.get("new_at", p.b).alias("new_place"), p.old.alias("old"), p.new.alias("new"), p.status.alias("status")))
    return spread(rows, placed)


def gone(old: Column, new: Column, status: Column) -> Column:
    """Whether a number of the old sentence is missing in the new one, where it is changed."""
    return (status == "changed") & (F.size(F.array_except(digits(F.coalesce(old, F.lit(""))), digits(F.coalesce(new, F.lit(""))))) > 0)


def changed_rows(rows: DataFrame) -> DataFrame:
    """What changes() gives, for rows of judged() with both versions' sentences (before, sentences)."""
    rows = rows.withColumn("pairs", dealt_places("before", "sentences"))
    linked = F.array_distinct(F.transform(F.filter("checked", lambda c: c["at"].isNotNull() & (c.status != "absent")), lambda c: c["at"]))
    rows = rows.select("doc_id", "before", "sentences", "pairs", linked.alias("linked"))
    some = F.filter(against("before", "sentences", "pairs"), lambda p: p.status != "same")
    place = lambda k: F.when(k >= 0, k)
    told = F.transform(some, lambda p: F.struct(place(p.a).alias("old_place"), place(p.b).alias("new_place"), p.status.alias("status"), gone(p.old, p.new, p.status).alias("values_gone"), F.array_contains("linked", p.b).alias("linked")))
    return spread(rows, told).withColumn("severity", F.when(F.col("values_gone") & ~F.col("linked"), "fatal"))


def changes(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """From aligned() and checked_quotes(): (doc_id, old_place, new_place, status, values_gone, linked) of what isn't the same.

    values_gone: a number of the old sentence is missing in the new one (a number that is only added isn't); linked: a quote that isn't
    absent is nearest to the new sentence. A changed value that isn't linked is fatal.
    """
    told = checked.filter("place is not null and status <> 'absent'").select("doc_id", F.col("place").alias("new_place"), F.lit(True).alias("linked")).distinct()
    rows = pairs.filter("status <> 'same'").withColumn("values_gone", gone(F.col("old"), F.col("new"), F.col("status"))).drop("old", "new")
    rows = rows.join(told, ["doc_id", "new_place"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    severity = F.when(F.col("values_gone") & ~F.col("linked"), "fatal")
    return rows.select("doc_id", "old_place", "new_place", "status", "values_gone", "linked", severity.alias("severity"))


def claims(answered: DataFrame, after: DataFrame, numbered: bool = True) -> DataFrame:
    """(doc_id, nth, comment, claim, location) of each answer in a letter.

    claim: unverifiable where a change is claimed without a quote or a place, else checkable, null without a claim; location: unverifiable where
    the revised file has no line numbers (numbered is false), out of range beyond its last sentence, or else ok; null without a place.
    """
    size = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = answered.join(size, "doc_id", "left")
    claim = F.when(F.col("claims"), F.when((F.size("quotes") == 0) & (F.size("places") == 0), "unverifiable").otherwise("checkable"))
    beyond = F.coalesce(F.array_max("places"), F.lit(0)) > F.coalesce("n", F.lit(0))
    place = F.when(F.size("places") > 0, F.when(F.lit(not numbered), "unverifiable").when(beyond | F.array_contains("places", 0), "out of range").otherwise("ok"))
    return rows.select("doc_id", "nth", "comment", claim.alias("claim"), place.alias("location"))


def attachments(before: DataFrame, after: DataFrame, least: float = 0.05) -> DataFrame:
    """(doc_id, n_old, n_new, n_both, status): same file (both versions are one), unrelated (less than least of the revised one's sentences were
    there before), missing (a version has no sentences) or ok. n_both counts different sentences."""
    each = lambda rows, name: rows.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias(name))
    both = each(before, "in_old").join(each(after, "in_new"), ["doc_id", "sentence"], "full_outer")
    order = lambda rows, name: rows.groupBy("doc_id").agg(F.sum(F.xxhash64("place", "sentence").cast("decimal(38,0)")).alias(name))
    n = both.groupBy("doc_id").agg(F.count("in_old").alias("n_old"), F.count("in_new").alias("n_new"), F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).alias("n_both"))
    rows = n.join(order(before, "sum_old"), "doc_id", "left").join(order(after, "sum_new"), "doc_id", "left")
    status = F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), "missing").when(F.col("sum_old") == F.col("sum_new"), "same file").when(F.col("n_both") < least * F.col("n_new"), "unrelated").otherwise("ok")
    return rows.select("doc_id", "n_old", "n_new", "n_both", status.alias("status"))


def comments(answered: DataFrame) -> DataFrame:
    """(doc_id, comment, issue): comment numbers answered twice (duplicate) or missing between others of their reviewer (gap, as 2-5 between 2-4 and 2-6)."""
    cells = answered.select("doc_id", "comment", F.regexp_extract("comment", r"^(?:(\d+)[-.])?", 1).alias("reviewer"), F.regexp_extract("comment", r"(\d+)$", 1).try_cast("int").alias("k"))
    twice = cells.groupBy("doc_id", "comment").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "comment", F.lit("duplicate").alias("issue"))
    order = Window.partitionBy("doc_id", "reviewer").orderBy("k")
    steps = cells.select("doc_id", "reviewer", "k").distinct().withColumn("next", F.lead("k").over(order)).filter("next > k + 1")
    lost = steps.select("doc_id", "reviewer", F.explode(F.sequence(F.col("k") + 1, F.col("next") - 1)).alias("k"))
    name = F.when(F.col("reviewer") != "", F.concat("reviewer", F.lit("-"), F.col("k").cast("string"))).otherwise(F.col("k").cast("string"))
    return twice.unionByName(lost.select("doc_id", name.alias("comment"), F.lit("gap").alias("issue")))
