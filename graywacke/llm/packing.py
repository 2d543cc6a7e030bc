"""Best-fit packing with several capacities: tokens, documents and attention cost of a sequence.

Texts become token ids; only what is longer than a sequence is cut. Pieces are packed in decreasing length, each into the
open sequence that fits best: of those with room in every dimension, the one whose residual, with the piece in it, has the
least weighted norm (or, as an option, the greatest weighted dot product of residual and piece). Attention cost is the sum
of the squares of the pieces' lengths, as each piece attends to itself.

Pieces are dealt by hash into groups of about GROUP, and a group is packed in one task: its size is bounded, so is the
work, and of many sequences one in a group may stay less than full. Only (key, length) go through that shuffle.

Cases: a null or empty text is the end token alone; a text that fills sequences exactly leaves no empty piece; equal rows
are packed each; ties go to the sequence opened first, equal lengths by key; an empty table gives no rows.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graywacke.llm.common import Scratch, small_batches

END = 1
#: Pieces packed together in a task, about.
GROUP = 16_384
#: Words of which a worker keeps the ids; then it starts afresh.
KEPT_WORDS = 300_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold. Attention: the sum of squared lengths; None: no bound."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    #: Weights of the three dimensions in the norm or the dot product.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    dot_product: bool = False

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float)


@cache
def unsettled() -> np.ndarray:
    """For each code point whether Unicode may have changed what it is: those that Python's tables don't assign."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class WordIds:
    """Token ids of texts, word by word: tokens never cross white space, so the ids of a text are those of its words in turn.

    known maps each lower-case word met so far to its number (a plain dict: a subclass with __missing__ takes three times as long to ask); new ones go to the tokenizer's model by the pieces of its own
    split. Texts that the tokenizer may normalise otherwise than Python does, and those with its special tokens, go to it whole;
    so do all texts where the tokenizer's file has another normaliser, splitter or model than WORDWISE says.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The parts of a tokenizer's file for which words may be taken one by one (fixed values).
    WORDWISE = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "truncation": None, "padding": None, "post_processor": None,
    }
    #: Capital sigma has two small forms; the separators are white space to Python alone.
    ODD = ("Σ", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.wordwise = all(said.get(k) == v for k, v in self.WORDWISE.items()) and said["model"]["type"] == "BPE"
        # An added token begins with a character of these.
        self.odd = {*self.ODD, *(t["content"][:2] for t in said["added_tokens"])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.known: dict[str, int] = {}
        self.ids, self.at = array("I"), array("q", [0])

    def number(self, word: str) -> int:
        """The number of a word, known or new."""
        if (known := self.known.get(word)) is not None:
            return known
        ends = word[-1] in ".," and word[:-1].isalpha()
        if ends:
            stem, mark = self.number(word[:-1]), self.number(word[-1])
            self.ids.extend(self.ids[self.at[stem] : self.at[stem + 1]] + self.ids[self.at[mark] : self.at[mark + 1]])
        for piece in () if ends else (word,) if word.isalpha() else self.SPLIT.findall(word):
            shown = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode()))
            self.ids.extend([t.id for t in self.model.tokenize(shown)])
        self.at.append(len(self.ids))
        self.known[word] = n = len(self.at) - 2
        return n

    def plain(self, text: str) -> bool:
        """Whether the words of the text may be taken one by one."""
        if not self.wordwise or any(x in text for x in self.odd):
            return False
        return text.isascii() or unicodedata.is_normalized("NFC", text) and not unsettled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
            self.ids, self.at = array("I"), array("q", [0])
        each = []
        for text in texts:
            text = text or ""
            if not self.plain(text):
                each.append(None)
            else:
                words = text.lower().split()
                numbers = list(map(self.known.get, words))
                for k in [k for k, n in enumerate(numbers) if n is None]:
                    numbers[k] = self.number(words[k])
                each.append(np.array(numbers, np.int64))
        at, ids = np.frombuffer(self.at, np.int64), np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        out = []
        for words, text in zip(each, texts):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32))
                continue
            start, n = at[words], at[words + 1] - at[words]
            ends = np.cumsum(n)
            out.append(ids[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out


@cache
def word_ids(path: str) -> WordIds:
    """One to a worker, kept between tasks."""
    return WordIds(path)


def tokenized(docs: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids (unsigned 32-bit, little-endian)."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.append(ids, np.uint32(END)).astype("<u4").tobytes() for ids in word_ids(tokenizer).encode(batch)], dtype="object")

    small_batches(docs.sparkSession)
    n = F.expr("octet_length(every) div 4")
    rows = docs.select("doc_id", encoded("text").alias("every")).withColumn("n", n).select("doc_id", "every", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {most} as int)"))).alias("piece"))
    start = F.col("piece").cast("long") * most
    ids = F.substring("every", (4 * start + 1).cast("int"), F.lit(4 * most))
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - start).alias("length"), ids.alias("ids"))


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """For each length the number of its sequence and its place there; lengths are taken longest first, ties in order."""
    limits, weights = capacity.limits(), np.array(capacity.weights)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    # What is left in each open sequence, as shares of the limits; a full one is dropped from the list.
    left, names, filled, made = np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    n_open = 0
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1, size * size]) / limits
        if (need > 1 + 1e-12).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        after = left[:n_open] - need
        fits = (after >= -1e-12).all(1)
        if fits.any():
            worth = -(left[:n_open] * weights * need).sum(1) if capacity.dot_product else (after * after * weights).sum(1)
            at = int(np.argmin(np.where(fits, worth, np.inf)))
        else:
            if n_open == len(left):
                left, names, filled = (np.concatenate([x, np.zeros_like(x)]) for x in (left, names, filled))
            at, n_open = n_open, n_open + 1
            left[at], names[at], filled[at], made = 1.0, made, 0, made + 1
        sequence[i], offset[i] = names[at], filled[at]
        filled[at] += size
        left[at] -= need
        if (left[at] < 1 / limits - 1e-12).any():
            n_open -= 1
            left[at : n_open], names[at : n_open], filled[at : n_open] = left[at + 1 : n_open + 1].copy(), names[at + 1 : n_open + 1].copy(), filled[at + 1 : n_open + 1].copy()
    return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """pieces (any columns, with length) with sequence_id and offset. pieces should be narrow and saved: it is counted, then packed."""
    groups = max(1, round(pieces.count() / group))
    columns = pieces.columns

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in columns if c != "length")])
        number = rows.column("pack_group")[0].as_py()
        sequence, offset = best_fit(rows.column("length").to_numpy(), capacity)
        return rows.select(columns).append_column("sequence_id", pa.array(sequence * groups + number)).append_column("offset", pa.array(offset))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(*columns), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(packed, kind)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for the pieces of docs (doc_id, text)."""
    pieces = tokenized(docs, tokenizer, capacity.tokens).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(Scratch(docs.sparkSession, "packing").save("pieces", pieces), capacity, group)
