"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003), in DataFrame operations only.

Of every window of GRAMS consecutive k-gram hashes the least is kept as a fingerprint. A run of WINDOW = K + GRAMS - 1
words has the same least hash wherever it stands, so that a document and a benchmark item that share such a run share a
fingerprint: none is missed. Documents without a shared fingerprint are done; in the others every run of WINDOW words is
compared with the items' runs, and hits that overlap are joined. An item shorter than WINDOW words is a run as a whole;
for the lengths of such items, runs of all documents are compared.

Fingerprints are taken from words in full lower case, which only adds candidates; runs are compared by words in which
only A-Z are lower-cased, as two 64-bit hashes.

Cases: a null or empty text has no words and no hits; documents and items are read whole; equal rows (doc_id and text)
each get their row; items of equal words all count, one without an id under an empty name; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graywacke.llm.common import bounded, cut

WINDOW, K = 10, 5
GRAMS = WINDOW - K + 1
#: What parts words: a word is made of digits, a-z and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, full: bool = False) -> Column:
    """Words of a text; full: in full lower case, else only A-Z."""
    low = F.lower(text) if full else F.translate(text, UPPER, LOWER)
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def fingerprints(hashes: str) -> Column:
    """Distinct fingerprints from an array of word hashes; none for fewer words than WINDOW."""
    k_grams = f"transform(sequence(0, size({hashes}) - {K}), i -> xxhash64({', '.join(f'{hashes}[i + {j}]' for j in range(K))}))"
    least = f"transform(sequence(0, size(g) - {GRAMS}), i -> least({', '.join(f'g[i + {j}]' for j in range(GRAMS))}))"
    return F.expr(f"if(size({hashes}) < {WINDOW}, array(), array_distinct(transform(array({k_grams}), g -> {least})[0]))")


def runs(n: int) -> Column:
    """From the array w of words: (place, n, h1, h2) of each run of n words; the two hashes, of different seeds, stand for its words."""
    return F.expr(f"if(size(w) < {n}, array(), transform(sequence(0, size(w) - {n}), i -> struct(i as place, {n} as n, xxhash64(slice(w, i + 1, {n})) as h1, xxhash64(1, slice(w, i + 1, {n})) as h2)))")


def item_runs(items: DataFrame) -> DataFrame:
    """(item_id, n, h1, h2): the runs that count for each item."""
    split = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    each = F.expr("transform(sequence(0, size(w) - n), i -> struct(xxhash64(slice(w, i + 1, n)) as h1, xxhash64(1, slice(w, i + 1, n)) as h2))")
    return split.select("item_id", "n", F.explode(each).alias("r")).select("item_id", "n", "r.*").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for each row of docs (doc_id, text) against items (item_id, text).

    item_ids: the items with a run in the document, as strings, sorted. A column text_hash tells rows of one doc_id apart.
    """
    targets = cut(item_runs(items))
    marks = items.select(words(F.col("text"), full=True).alias("w")).select(F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    marks = bounded(cut(marks.select(F.explode(fingerprints("h")).alias("mark")).distinct().withColumn("shared", F.lit(True))))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text"), full=True).alias("w"))
    rows = rows.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    spread = rows.select("doc_id", "text_hash", "n_words", F.posexplode_outer(fingerprints("h")).alias("place", "mark"))
    seen = spread.join(marks, "mark", "left").groupBy("doc_id", "text_hash", "n_words")
    seen = cut(seen.agg(F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), F.coalesce(F.max("shared"), F.lit(False)).alias("shared")))

    short = [r.n for r in targets.select("n").distinct().filter(F.col("n") < WINDOW).collect()]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wanted = bounded(cut(seen.filter("shared").select(F.col("doc_id").alias("their_id"), F.col("text_hash").alias("their_hash"))))
    hits = hit_runs(rows.join(wanted, F.expr("doc_id <=> their_id and text_hash <=> their_hash"), "left_semi"), [WINDOW], targets)
    if short:
        # One scan of all documents for the lengths of all short items.
        hits = hits.union(hit_runs(rows, short, targets))
    hits = cut(hits)

    doc = ["doc_id", "text_hash"]
    ordered = Window.partitionBy(*doc).orderBy("place", "end")
    before = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = hits.select(*doc, "place", (F.col("place") + F.col("n")).alias("end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("place", before))
    covered = places.withColumn("fresh", fresh).groupBy(*doc).agg(F.sum("fresh").alias("n_hit"))
    found = hits.select(*doc, "n", "h1", "h2").distinct().join(bounded(targets), ["n", "h1", "h2"]).select(*doc, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")).distinct()
    named = found.groupBy(*doc).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    named = named.select(F.col("doc_id").alias("their_id"), F.col("text_hash").alias("their_hash"), "item_ids")
    same = F.expr("doc_id <=> their_id and text_hash <=> their_hash")
    result = covered.join(named, same).select("their_id", "their_hash", "n_hit", "item_ids")
    joined = seen.join(bounded(cut(result)), same, "left")
    n_hit, item_ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"),
    ).drop("copy")


def hit_runs(rows: DataFrame, lengths: list[int], targets: DataFrame) -> DataFrame:
    """(doc_id, text_hash, place, n, h1, h2) for the runs of these lengths, in rows (doc_id, text_hash, text), that an item has."""
    split = rows.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    each = split.select("doc_id", "text_hash", F.explode(F.concat(*map(runs, lengths))).alias("r")).select("doc_id", "text_hash", "r.*")
    mine = bounded(cut(targets.filter(F.col("n").isin(lengths)).select("n", "h1", "h2").distinct()))
    return each.join(mine, ["n", "h1", "h2"]).select("doc_id", "text_hash", "place", "n", "h1", "h2").distinct()
