"""Quality rules: statistics of each text, base rules on them, and an isolation forest for what the rules don't name.

A tree splits a random statistic at a random place, again and again; a document that few splits set apart from the rest
is an anomaly (Liu, Ting and Zhou, 2008). Every forest splits several statistics together. Which ones is learned from a bounded
sample of labelled documents that pass the base rules: from all statistics the one is dropped whose loss costs least or helps
most, until two are left, as statistics in which good documents vary widely hide what is odd in others. The forests of all
those steps are candidates; the score of each above which a document is rejected is calibrated on all labelled documents, from
counts by rounded score, and forests that catch nothing more are left out.

Cases: a null or empty text has no words and fails the base rules; texts of any length are measured whole; equal texts
get equal verdicts; without labelled rows of both kinds there is no forest and all that pass the base rules are kept; extra
columns pass through, a column named rules raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.llm.common import bounded, cut, distinct_names, known_labels, labelled_sample, small_batches
from graywacke.llm.textvec import SPACE, M, Texts, U, chunks, grams, mix, owners

#: Labelled texts from which the trees are grown, at most; thresholds are set on all labelled texts.
SAMPLE = 2000
#: Places of scores: counts by score stay few, and thresholds between them mean the same for all rows.
PLACES = 4
#: Trees of a forest, and the rows each is grown on: with few of them oddities don't hide each other.
TREES, GROW_ON = 100, 32
#: A threshold loses at most this share of the good rows and catches at least that share of the others; what a good row counts.
LOSS, LEAST, WEIGHT = 0.002, 0.01, 50
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: How many rates() gives.
STATISTICS = 7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_marks", "n_lines")

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), range(65, 91))
DIGIT = np.isin(np.arange(256), range(48, 58))
MARK = np.isin(np.arange(256), list(b"!\"'(),-./:;?@[\\]^_`{}~+="))
#: Bytes that begin a character.
HEAD = (np.arange(256) & 0xC0) != 0x80


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text."""
    batch = Texts(texts)
    data, many = batch.bytes, len(texts)
    starts, ends, first = batch.words()
    owner = owners(first)
    out = {"n_words": np.diff(first), "word_chars": batch.per_text(HEAD[data] & ~SPACE[data])}
    out |= {k: batch.per_text(table[data]) for k, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARK))}

    breaks = np.flatnonzero(data == 10)
    line_at, line_to = breaks[:-1] + 1, breaks[1:]
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    full = solid[line_to] > solid[line_at]
    line_at, line_to = line_at[full], line_to[full]
    line_owner = np.searchsorted(batch.to, line_at)
    keys = mix(batch.hashes(line_at, line_to) + line_owner.astype(U) * M)
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    out["n_lines"] = np.bincount(line_owner, minlength=many)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=many)

    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        keys = mix(grams(batch.hashes(starts, ends), 3)[at] + owner[at].astype(U) * M)
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        twice = at[order[np.append(equal, False) | np.append(False, equal)]]
        for k in range(3):
            repeated[twice + k] = True
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=many)
    return {k: v.astype(np.int64) for k, v in out.items()}


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def rates(m: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics that the trees split: rates, so that a document's length alone is no anomaly."""
    words, chars, lines = (np.maximum(m[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([chars / words, m["n_symbols"] / chars, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / chars, m["n_digits"] / chars, m["n_marks"] / chars])


def average_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    inner = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(inner) + np.euler_gamma) - 2 * inner / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: the statistic split (-1 at a leaf), the cut and the path length, by node."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    sample: int
    #: A document that scores above it is rejected.
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rounded; higher is more of an anomaly."""
        total = np.zeros(len(x))
        trees = np.arange(len(self.feature))[:, None]
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            rows, node = np.arange(len(part)), np.zeros((len(self.feature), len(part)), np.int64)
            for _ in range(int(np.log2(self.feature.shape[1] + 1)) - 1):
                split = self.feature[trees, node]
                node = np.where(split < 0, node, 2 * node + 2 - (part[rows, np.maximum(split, 0)] < self.cut[trees, node]))
            total[at : at + 1024] = self.path[trees, node].sum(0)
        return np.round(2 ** (-total / len(self.feature) / average_path(self.sample)), PLACES)


def grow(x: np.ndarray, use: list[int], trees: int = TREES, sample: int = GROW_ON, seed: int = 6) -> Forest:
    """Trees that split the statistics of the numbers in use, each on a sample of its own of the rows."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = int(np.ceil(np.log2(sample)))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), sample, replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(0), rows.max(0)
            wide = [f for f in use if high[f] > low[f]]
            if level == depth or not wide:
                path[t, node] = level + average_path(len(rows))
                continue
            f = rng.choice(wide)
            c = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, c
            left = rows[:, f] < c
            todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return Forest(feature, cut, path, sample)


def worth_on(scores: np.ndarray, good: np.ndarray) -> float:
    """The mean share of bad rows above the score that so many good rows are lost at, for several losses."""
    ordered = np.sort(scores[good])
    cuts = [ordered[max(0, int(np.ceil(len(ordered) * (1 - loss))) - 1)] for loss in (LOSS, 0.01, 0.05, 0.2)]
    return float(np.mean([(scores[~good] > c).mean() for c in cuts]))


def candidates(x: np.ndarray, good: np.ndarray) -> list[Forest]:
    """Forests on ever fewer statistics, two at least: at each step the statistic goes without which the rest does best."""
    use = list(range(x.shape[1]))
    grown = [grow(x, use)]
    while len(use) > 2:
        tried = [grow(x, [f for f in use if f != k]) for k in use]
        best = int(np.argmax([worth_on(f.scores(x), good) for f in tried]))
        del use[best]
        grown.append(tried[best])
    return grown


def threshold(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, of_good: int, of_bad: int) -> tuple[float, float]:
    """The score above which rows are rejected that is worth most, and that worth: the share of bad rows caught less
    WEIGHT times the share of good rows lost. good and bad are the numbers of rows by score, levels those scores, ascending.

    It stands in the middle of the gap between two scores; infinity, where none keeps within LOSS and catches LEAST.
    """
    lost = (good.sum() - np.cumsum(good)) / max(1, of_good)
    caught = (bad.sum() - np.cumsum(bad)) / max(1, of_bad)
    worth = np.where((lost <= LOSS) & (caught >= LEAST), caught - WEIGHT * lost, 0)
    best = int(np.argmax(worth)) if len(levels) else 0
    return (float((levels[best] + levels[best + 1]) / 2), float(worth[best])) if len(worth) and worth[best] > 0 else (np.inf, 0.0)


def scored(docs: DataFrame, labels: DataFrame, label: str, grown: list[Forest]) -> DataFrame:
    """(label, scores): the score of each forest for all labelled texts; null where the base rules fail. No filter on that here: Spark
    would push it below the function's result and measure each text twice.

    Only labelled texts are measured where their ids may be broadcast; else all are, so that no text is dealt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grown)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            bad, x = [np.zeros(0, bool)], [np.zeros((0, STATISTICS))]
            for run in chunks(batch):
                m = measure(run)
                bad.append(failed(m))
                x.append(rates(m))
            every = np.concatenate(x)
            each = np.column_stack([f.scores(every) for f in shared.value]).tolist()
            yield pd.Series([None if b else row for b, row in zip(np.concatenate(bad), each)], dtype="object")

    small_batches(docs.sparkSession)
    known, texts = cut(known_labels(labels, label)), docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    few = bounded(known)
    if few is known:
        rows = texts.select("doc_id", scores("text").alias("scores")).join(known, "doc_id")
    else:
        rows = texts.join(few, "doc_id").select("label", scores("text").alias("scores"))
    return cut(rows.select("label", "scores"))


def calibrate(rows: DataFrame, grown: list[Forest]) -> list[Forest]:
    """Forests with thresholds: of those grown the ones worth having, the best first. rows: as from scored().

    Each threshold is set on the rows that the forests before it leave, so that none is kept for what others catch. The driver
    gets counts by forest and rounded score.
    """
    rest, chosen, of = rows, [], None
    while True:
        each = rest.select("label", F.posexplode("scores").alias("forest", "score")).groupBy("forest", "score")
        counts = each.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).toPandas().sort_values("score")
        by_forest = [counts[counts.forest == k] for k in range(len(grown))]
        of = of or (int(by_forest[0].good.sum()), int(by_forest[0].bad.sum()))
        tried = [threshold(c.score.to_numpy(), c.good.to_numpy(), c.bad.to_numpy(), *of) for c in by_forest]
        best = int(np.argmax([worth for _, worth in tried]))
        if not tried[best][1] > 0:
            return chosen
        chosen.append(replace(grown[best], threshold=tried[best][0]))
        rest = rest.filter(F.col("scores")[best] <= tried[best][0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> list[Forest]:
    """Forests grown from at most `most` labelled texts, good and bad as they come; their thresholds from all labelled texts."""
    sample = labelled_sample(docs, labels, label, most)
    parts = [measure(run) for run in chunks(t for t, _ in sample)] or [{k: np.zeros(0, np.int64) for k in COUNTS + MORE}]
    m = {k: np.concatenate([part[k] for part in parts]) for k in parts[0]}
    fine = ~failed(m)
    x, good = rates(m)[fine], np.array([y for _, y in sample], int)[fine] == 1
    if good.all() or not good.any():
        return []
    grown = candidates(x, good)
    return calibrate(scored(docs, labels, label, grown), grown)


def judge(docs: DataFrame, forests: list[Forest], text: str = "text") -> DataFrame:
    """docs with a column rules: COUNTS and MORE, base_failed, anomaly (the largest score less its threshold) and kept."""
    distinct_names(docs, "rules")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forests)
    kind = ", ".join(f"{k} long" for k in COUNTS + MORE) + ", base_failed boolean, anomaly double, kept boolean"

    def judged(texts: pd.Series) -> pd.DataFrame:
        parts = [measure(run) for run in chunks(texts)] or [measure([])]
        m = {k: np.concatenate([part[k] for part in parts]) for k in parts[0]}
        bad, x = failed(m), rates(m)
        over = np.max([np.full(len(x), -1.0), *(f.scores(x) - f.threshold for f in shared.value)], axis=0)
        return pd.DataFrame({k: m[k] for k in COUNTS + MORE} | {"base_failed": bad, "anomaly": over, "kept": ~bad & (over <= 0)})

    @F.pandas_udf(kind)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judged(batch)

    return docs.withColumn("rules", rules(F.col(text)))
