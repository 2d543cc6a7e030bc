"""URL filter: rules of hosts and paths, and a logistic regression on hashed character n-grams of host and path for the rest.

The regression is trained in numpy from a small labelled URL table (url_table.labelled_urls() or the caller's). A URL's features are
the n-grams of its host and of its path, each sort apart, all of one weight: 1 / sqrt(their number).

Cases: a null URL, or one without "://", has an empty host and path and is judged by the bias alone; equal URLs get equal
verdicts; a URL is read whole; extra columns pass through, those named like ADDED raise ValueError; an empty table
gives no rows; fit() of no rows, or of one label, gives a model that knows the bias alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywacke.llm.common import distinct_names

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Any digit is as good as another.
DIGITS = str.maketrans("123456789", "000000000")
#: Rules, at most: they are compiled into one CASE.
MOST_RULES = 1000
ADDED = ("host", "path", "rule", "unwanted", "verdict")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to /, ?, # or the end; A-Z lower-cased) and path (then up to ?, # or the end)."""
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, parts, 2)


@lru_cache(1 << 16)
def buckets(kind: str, text: str) -> np.ndarray:
    framed = f"{kind}^{text.translate(DIGITS)}$".encode()
    return np.array([zlib.crc32(framed[i : i + n], ord(kind)) % BUCKETS for n in SIZES for i in range(1, len(framed) - n + 1)], np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def unwanted(self, host: str, path: str) -> float:
        ids = np.concatenate([buckets("h", host), buckets("p", path)])
        return float(1 / (1 + np.exp(-(self.bias + self.weights[ids].sum() / np.sqrt(max(1, len(ids)))))))


def fit(rows: Sequence[tuple[str, int]], epochs: int = 30, rate: float = 2.0, ridge: float = 1e-5, seed: int = 5) -> Model:
    """Stochastic gradient descent on (url, label) rows: a small table, held by the driver."""
    rng = np.random.default_rng(seed)
    bags = []
    for url, label in rows:
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        ids, n = np.unique(np.concatenate([buckets("h", rest[:cut].lower()), buckets("p", path)]), return_counts=True)
        bags.append((ids, n / np.sqrt(max(1, n.sum())), label))
    weights, bias, steps = np.zeros(BUCKETS), 0.0, epochs * len(bags)
    for step in range(steps):
        if step % len(bags) == 0:
            order = rng.permutation(len(bags))
        ids, x, label = bags[order[step % len(bags)]]
        error = 1 / (1 + np.exp(-(bias + x @ weights[ids]))) - label
        pace = rate * (1 - step / steps)
        weights[ids] -= pace * (error * x + ridge * weights[ids])
        bias -= 0.05 * pace * error
    return Model(weights, bias)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules ("host/path", verdict) that fits, and its verdict; null where none does.

    A rule fits its host and the subdomains of it, where the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Model, url: str = "url") -> DataFrame:
    """pages with host, path, rule, unwanted (the regression's probability) and verdict (allow or block)."""
    distinct_names(pages, *ADDED)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([shared.value.unwanted(h, p) for h, p in zip(hosts, paths)], dtype="float64")

    host, path = split_url(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    which, said = rule_for(F.col("host"), F.col("path"), rules)
    scored = split.withColumns({"rule": which, "unwanted": unwanted("host", "path")})
    return scored.withColumn("verdict", F.coalesce(said, F.when(F.col("unwanted") >= 0.5, "block").otherwise("allow")))
