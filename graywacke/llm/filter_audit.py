"""What filters do to each other: survivors of every subset of filters from one SQL CUBE, and from those every order's steps.

Documents are counted by their failures first, so that the cube runs over at most 2^n rows a part. In the grouping set of
a subset of flags, the row in which all those flags are false holds what passes them: its survivors. Each step of an order
goes from one subset to a larger one; a join of the two gives what the step removes. The steps of all orders share n 2^(n-1)
pairs of subsets.

failures() gives the five standard flags. The copy flag (E) needs no group in one task: the smallest id of a text is a
maximum with partial aggregation, and rows meet it by text and id together, which spreads copies of one text.

Cases: a null text is empty, and so are both texts of such a pair equal; a null part is the empty string; a null id is
never a copy, as it isn't larger than any; rows of the same id and text are no copies of each other, each counts; labels
that conflict count as the larger, null ones as none; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.llm.common import cut

#: White space that parts words.
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOL = 200, 50, 2, r"[#$%&*|]"
FILTERS = ("A", "B", "C", "D", "E")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) for each row of docs (doc_id, text, source); labels has doc_id, quality and toxic."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", GAP), "")
    rows = rows.select("doc_id", "part", "text", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    flags = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.col("n") < MIN_WORDS).alias("A"), (100 * F.col("d") < MIN_DISTINCT_PERCENT * F.col("n")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MAX_UPPER_PERCENT * F.length("text").cast("long")).alias("C"), F.col("text").rlike(SYMBOL).alias("D"),
    )
    known = labels.groupBy(F.col("doc_id").alias("its_id")).agg(*(F.coalesce(F.max(F.col(k) == 1), F.lit(False)).alias(a) for k, a in (("quality", "good"), ("toxic", "toxic"))))
    flags = flags.join(known, F.col("doc_id") == F.col("its_id"), "left").drop("its_id")
    flags = flags.groupBy("doc_id", "digest", "part", "A", "B", "C", "D", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    first = flags.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first_id"))
    found = flags.join(first, F.expr("digest = of and doc_id = first_id"), "left")
    copy = F.col("first_id").isNull() & F.col("doc_id").isNotNull()
    return found.select("part", "A", "B", "C", "D", copy.alias("E"), "good", "toxic", "n")


def survivors(flags: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """(part, subset, kept, good, toxic): what passes every filter of a subset, whose bit k stands for filters[k].

    flags: part, one boolean column a filter, good, toxic, n (rows that are alike). Subsets that nothing passes have a row of zeros.
    """
    counted = cut(flags.groupBy("part", *filters).agg(F.sum("n").alias("kept"), *(F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in ("good", "toxic"))))
    cube = counted.cube(*filters, "part").agg(*(F.sum(k).alias(k) for k in ("kept", "good", "toxic")), *(F.grouping(k).alias(f"free_{k}") for k in (*filters, "part")))
    # A flag that is free in a grouping set isn't in its subset. In that set only the row counts in which all others are false.
    passing = cube.filter("free_part = 0")
    for k in filters:
        passing = passing.filter((F.col(f"free_{k}") == 1) | ~F.col(k))
    subset = sum(((1 - F.col(f"free_{k}").cast("int")) * (1 << i) for i, k in enumerate(filters)), F.lit(0))
    passing = passing.select(F.col("part").alias("in_part"), subset.alias("in_subset"), "kept", "good", "toxic")
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    zero = F.lit(0).cast("long")
    found = every.join(passing, F.expr("part = in_part and subset = in_subset"), "left")
    return found.select("part", "subset", *(F.coalesce(k, zero).alias(k) for k in ("kept", "good", "toxic")))


def steps(filters: tuple[str, ...] = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, subset before, subset after) of all orders: n n! rows, which don't depend on data."""
    bit = {k: 1 << i for i, k in enumerate(filters)}
    return [("".join(o), s + 1, k, sum(map(bit.get, o[:s])), sum(map(bit.get, o[: s + 1]))) for o in permutations(filters) for s, k in enumerate(o)]


def audit(flags: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    shapley is the filter's removed, summed over all orders: a pair of subsets of k and k + 1 filters occurs in k! (n - k - 1)! of them.
    """
    n, spark = len(filters), flags.sparkSession
    found = cut(survivors(flags, filters))
    pairs = [(k, before, before | 1 << i, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())) for i, k in enumerate(filters) for before in range(1 << n) if not before >> i & 1]
    pairs = F.broadcast(spark.createDataFrame(pairs, "filter string, before int, after int, weight long"))
    held = found.select(F.col("part").alias("its_part"), F.col("subset").alias("its_subset"), *(F.col(k).alias(f"{k}_after") for k in ("kept", "good", "toxic")))
    pair = found.join(pairs, F.col("subset") == F.col("before")).join(held, F.expr("part = its_part and after = its_subset"))
    removed = F.col("kept") - F.col("kept_after")
    pair = pair.select("part", "filter", "before", "weight", F.col("kept_after").alias("kept"), removed.alias("removed"), (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"))
    first = lambda subset: F.max(F.when(F.col("before") == subset, F.col("removed")))
    others = sum((F.when(F.col("filter") == k, F.lit((1 << n) - 1 - (1 << i))).otherwise(0) for i, k in enumerate(filters)), F.lit(0))
    alone = pair.groupBy(F.col("part").alias("its_part"), F.col("filter").alias("its_filter")).agg(first(0).alias("fails"), first(others).alias("unique_fails"), F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    pair = pair.join(alone, F.expr("part = its_part and filter = its_filter"))
    orders = spark.createDataFrame(steps(filters), "filter_order string, step int, its_step string, from_subset int, to_subset int")
    told = pair.join(F.broadcast(orders), F.expr("filter = its_step and before = from_subset"))
    return told.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
