"""Quality classifier: hashed word and character n-grams, each with a learned vector, averaged per document; softmax output.

The vectors and the output layer are fitted together by stochastic gradient descent in numpy, on a bounded sample of
labelled texts (PER_CLASS of either class). A fitted model scores any number of documents: as the output is linear in
the average, each n-gram's vector shrinks to one number, so that scoring is a look-up and a sum, all in numpy.

Cases: a null or empty text has no n-grams and gets the score of the bias alone; a text of any length is scored whole;
equal texts get equal scores; extra columns pass through, one named like the score raises ValueError; without labelled rows of
both classes the model is a constant, which scores 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.llm.common import distinct_names, labelled_sample, small_batches
from graywacke.llm.textvec import SPACE, M, Texts, U, chunks, grams, mix, owners

BUCKETS = 1 << 18
#: One feature besides the hashed ones, with a learned vector like theirs: a run of three words that the document has had before. An
#: average of n-grams doesn't know what repeats; the README has figures without it.
REPEATED = BUCKETS
#: Labelled texts of either class to fit on, at most.
PER_CLASS = 500
CHARACTERS = (3, 4, 5)


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (feature numbers, positions of a byte of their text): words, pairs of words, repeated triples, and character n-grams of words.

    A character n-gram may begin or end with the white space beside a word, never hold any inside.
    """
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    yield (words % U(BUCKETS)).astype(np.int64), starts
    owner = owners(first)
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        yield (grams(words, 2)[same] % U(BUCKETS)).astype(np.int64), starts[1:][same]
    if len(words) > 2:
        same = np.flatnonzero(owner[2:] == owner[:-2])
        keys = mix(grams(words, 3)[same] + owner[same].astype(U) * M)
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        again = starts[2:][same[again]]
        yield np.full(len(again), REPEATED), again
    gap = np.zeros(len(texts.bytes) + 1, np.int64)
    np.cumsum(SPACE[texts.bytes], out=gap[1:])
    for n in CHARACTERS:
        at = np.arange(len(texts.bytes) - n + 1)
        at = at[(gap[at + n - 1] == gap[at + 1])]
        yield (texts.hashes(at, at + n) % U(BUCKETS)).astype(np.int64), at + 1


@dataclass(frozen=True)
class Model:
    #: What each feature adds to the logit of label 1, before the average.
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        batch = Texts(texts)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for ids, at in features(batch):
            cuts = np.searchsorted(at, np.append(batch.at, len(batch.bytes)))
            run = np.zeros(len(ids) + 1)
            np.cumsum(self.weights[ids], out=run[1:])
            total += np.diff(run[cuts])
            n += np.diff(cuts)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(n, 1))))


def train(sample: list[tuple[str, int]], dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent, a document a step; the classes are drawn equally often, rate falls to zero."""
    by_class = [[t for t, y in sample if y == k] for k in (0, 1)]
    if not all(by_class):
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 1, dim))
    out = rng.normal(0, 0.1, (2, dim))
    bias = np.zeros(2)
    bags = []
    for k, texts in enumerate(by_class):
        for text in texts:
            ids = np.concatenate([ids for ids, _ in features(Texts([text]))])
            at, n = np.unique(ids, return_counts=True)
            bags.append((k, at.astype(np.int32), (n / max(1, len(ids))).astype(np.float32)))
    shares = np.array([1 / len(by_class[k]) for k, _, _ in bags])
    steps = epochs * len(bags)
    for step, i in enumerate(rng.choice(len(bags), steps, p=shares / shares.sum())):
        label, ids, part = bags[i]
        hidden = part @ vectors[ids]
        logits = out @ hidden + bias
        odds = np.exp(logits - logits.max())
        error = odds / odds.sum()
        error[label] -= 1
        pace = rate * (1 - step / steps)
        back = error @ out
        out -= pace * np.outer(error, hidden)
        bias -= 0.1 * pace * error
        # Divided by the norm of the bag and not by its length: else long documents hardly move their many vectors.
        vectors[ids] -= (pace / max(1e-9, np.sqrt(part @ part))) * np.outer(part, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """docs: doc_id and text; labels: doc_id and label. Fitted on at most per_class texts of either label."""
    return train(labelled_sample(docs, labels, label, per_class, balanced=True))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of the probability of label 1. The model is a megabyte of numbers, shipped to the tasks once."""
    distinct_names(docs, into)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([shared.value.scores(run) for run in chunks(batch)]) if len(batch) else np.zeros(0))

    return docs.withColumn(into, probability(F.col(text)))
