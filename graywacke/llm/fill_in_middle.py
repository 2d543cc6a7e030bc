"""Fill-in-the-middle: texts cut in three at token boundaries and written with the middle last, by succinct rank and select.

A batch of texts is one array of UTF-8 bytes with two bitvectors over it, packed in 64-bit words with a directory of ones before
each block: bits where tokens begin, and bits where code points begin. The ones of a text are its tokens, select of two ranks
gives the bytes where it is cut, rank over the second vector the code points of the parts. No list of tokens is built.

Tokens are runs of A-Z and a-z, or else single code points. Where a text is cut and whether it is changed at all depends on its
id only: four numbers from the SHA-256 of `seed:id`.

Cases: a null or empty text, and one that holds a sentinel, stays as it is (plain); a null id counts as an empty one; equal rows
get equal answers; texts are read whole; an empty table gives no rows; extra columns pass through, those that have the name of one in
ADDED raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graywacke.llm.common import distinct_names, small_batches

#: Of 100 texts, how many are changed, and how many of those have the suffix first.
CHANGED, SUFFIX_FIRST, SEED = 90, 20, 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}

LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Bytes that begin a code point.
HEAD = (np.arange(256) & 0xC0) != 0x80
#: Words of 64 bits in a block of the directory.
BLOCK = 8


class Bits:
    """A bitvector in packed words, with the ones before each block of BLOCK words."""

    def __init__(self, flags: np.ndarray):
        words = -(-len(flags) // 64)
        whole = BLOCK * (words // BLOCK + 1)  # at least one word more, so that rank(len) needs no case of its own
        packed = np.zeros(8 * whole, np.uint8)
        bits = np.packbits(flags, bitorder="little")
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK
        inner = self.words.reshape(-1, BLOCK)[block]
        counts = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], np.bitwise_count(inner), 0).sum(1, dtype=np.int64)
        return self.before[block] + counts + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of each one by its number, from 0; numbers beyond the last are not allowed."""
        block = np.searchsorted(self.before, rank, "right") - 1
        inner = np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]), 1, dtype=np.int64)
        left = rank - self.before[block]
        word = (inner <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(inner, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        place = block * BLOCK + word
        bits = np.unpackbits(self.words[place][:, None].view(np.uint8), axis=1, bitorder="little")
        return 64 * place + np.argmax(np.cumsum(bits, 1, dtype=np.int64) > left[:, None], 1)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """For texts data[offsets[i]:offsets[i + 1]]: n tokens, bytes where prefix and middle end, code points of prefix and middle."""
    letter, begins, ends = LETTER[data], offsets[:-1], offsets[1:]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[begins[begins < ends]] = False
    tokens, points = Bits(HEAD[data] & ~inside), Bits(HEAD[data])
    first = tokens.rank(begins)
    n = tokens.rank(ends) - first
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    at = []
    for units in (low, high):
        place = ends.copy()
        some = units < n
        place[some] = tokens.select((first + units)[some])
        at.append(place)
    start, prefix_end, middle_end = points.rank(begins), points.rank(at[0]), points.rank(at[1])
    return {"n": n, "prefix_end": at[0], "middle_end": at[1], "prefix_chars": prefix_end - start, "middle_chars": middle_end - prefix_end}


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows that end with a text, its form and two numbers: the rows, and what ADDED names."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        *columns, texts, forms, h1, h2 = batch.columns
        texts = texts.cast(pa.large_binary())
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(values or b"")
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        found = cuts(data, offsets, h1.to_numpy(), h2.to_numpy())
        output = []
        for form, a, b, c, d in zip(forms.to_pylist(), offsets[:-1], found["prefix_end"], found["middle_end"], offsets[1:]):
            prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
            output.append(raw[a:d].tobytes() if form == "plain" else b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
        plain = np.array(forms.to_pylist(), object) == "plain"
        sizes = (pa.array(found[k], pa.int64(), mask=plain) for k in ("prefix_chars", "middle_chars"))
        added = [pa.array(found["n"], pa.int64()), forms, *sizes, pa.array(output, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *added], [*batch.schema.names[:-4], *ADDED])


def transformed(docs: DataFrame, text: str = "text", id_column: str = "doc_id", seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    distinct_names(docs, *ADDED)
    small_batches(docs.sparkSession)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(text, F.lit("")).alias("our_text"), named.alias("our_hash"))
    h = [F.conv(F.substring("our_hash", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    held = F.contains("our_text", F.lit(PREFIX)) | F.contains("our_text", F.lit(SUFFIX)) | F.contains("our_text", F.lit(MIDDLE))
    form = F.when((F.col("our_text") == "") | held | (h[2] % 100 >= changed), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = row.select("row", "our_text", form.alias("our_form"), h[0].alias("our_h1"), h[1].alias("our_h2"))
    kind = T.StructType([T.StructField("row", docs.schema), *(T.StructField(k, t) for k, t in ADDED.items())])
    return rows.mapInArrow(written, kind).select("row.*", *ADDED)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text from an output and its form. A text that holds a sentinel is plain, so the first of each sentinel is the one written."""
    whole, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(whole, len(first) + 1, F.length(whole))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(whole))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(whole))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    after, before, between = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, after)).otherwise(whole)
