"""Language identification by rank order: the n-grams of a text, most frequent first, against a profile of each language.

The distance is "out of place" (Cavnar and Trenkle, 1994): over the text's most frequent n-grams, how far each stands
from its place in the profile; one that the profile lacks counts as PROFILE places. The nearest profile wins, ties by
name. N-grams are runs of one to three characters of words, a space standing for the edge of a word; each is one exact
64-bit number (three code points), so nothing is hashed.

Cases: a text that is null or has no letter is UNKNOWN with score 0; texts are read whole, whatever their length; equal
texts get equal answers and are learned from once a language; every language with a letter in its texts is learned; with one learned language that one wins with score 1; with none (no rows, or no letters in them) every
text is UNKNOWN; more than MOST_LANGUAGES raise ValueError; extra columns pass through, those named lang_pred or score raise
ValueError.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywacke.llm.common import bounded, cut, distinct_names, small_batches
from graywacke.llm.textvec import chunks

UNKNOWN = "und"
#: Places of a profile, and of what is compared with it.
PROFILE = 400
#: Different texts of a language that its profile is learned from, at most, and the shares that a hash deals texts into.
TEXTS_PER_LANGUAGE, SHARES = 500, 1_000_000_007
#: Languages, at most, a bound on what the driver holds: more are an error.
MOST_LANGUAGES = 1000


@cache
def folds() -> np.ndarray:
    """For each code point its lower case, if it is a letter, else a space."""
    table = np.full(sys.maxunicode + 1, 32, np.int64)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalpha():
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return table


def codes(text: str) -> np.ndarray:
    """The letters of a text in lower case, each other run of characters as one space, one at either end; empty without letters."""
    points = folds()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    points = points[~(space & np.append(False, space[:-1]))]
    return points if len(points) > 1 else points[:0]


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters and their counts; those with a space inside, or only a space, don't count."""
    one = points[points != 32]
    two = points[:-1] << 21 | points[1:]
    inner = points[1:-1] != 32
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inner]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(grams: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent, first; ties by the n-gram's number."""
    if len(n) > most:
        keep = n >= np.partition(n, len(n) - most)[len(n) - most]
        grams, n = grams[keep], n[keep]
    return grams[np.lexsort((grams, -n))][:most]


class Profiles:
    def __init__(self, ranked: dict[str, np.ndarray]):
        self.names = sorted(ranked)
        self.grams = [np.sort(ranked[k]) for k in self.names]
        self.places = [np.argsort(ranked[k]) for k in self.names]

    def nearest(self, text: str | None) -> tuple[str, float]:
        points = codes(text or "")
        if not len(points) or not self.names:
            return UNKNOWN, 0.0
        ranked = top(*ngrams(points))
        place = np.arange(len(ranked))
        away = []
        for grams, places in zip(self.grams, self.places):
            at = np.minimum(np.searchsorted(grams, ranked), len(grams) - 1)
            away.append(np.where(grams[at] == ranked, np.abs(places[at] - place), PROFILE).sum())
        best, *others = np.argsort(away, kind="stable")
        return self.names[best], float(1 - away[best] / max(1, away[others[0]])) if others else 1.0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = TEXTS_PER_LANGUAGE) -> Profiles:
    """Profiles from most different texts of each language, the first by a hash among those with a letter, counted in Spark.

    Equal texts of a language count once: else they would all be picked or missed together, and a language with few others be lost.
    The driver receives PROFILE n-grams a language.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    sizes = {r[0]: r[1] for r in known.select("lang", "text_hash").distinct().groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Profiles({})
    # A hash thins long lists out to about four times what is taken, so that no list that is put in order grows with the data.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, SHARES if n <= 8 * most else 4 * most * SHARES // n + 1)])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(2), "text_hash"), "text_hash")
    taken = known.filter(F.pmod(F.xxhash64(F.lit(1), "text_hash"), F.lit(SHARES)) < share).select("lang", "text_hash").distinct()
    taken = bounded(cut(taken.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")))
    picked = known.join(taken, ["lang", "text_hash"]).groupBy("lang", "text_hash").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                found = [ngrams(p) for t in group.text if len(p := codes(t))]
                if found:
                    grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    yield pd.DataFrame({"lang": name, "gram": grams, "n": np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)})

    total = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in total.withColumn("place", place).filter(F.col("place") <= PROFILE).orderBy("lang", "place").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles({k: np.array(v, np.int64) for k, v in profiles.items()})


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: how much nearer the winner is than the next, from 0 to 1."""
    distinct_names(docs, "lang_pred", "score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared.value.nearest(t) for t in batch], columns=["lang_pred", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), nearest(F.col(text)).alias("nearest"))
    return rows.select("row.*", "nearest.lang_pred", "nearest.score")
