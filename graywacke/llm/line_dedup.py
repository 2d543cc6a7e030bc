"""Line dedup: lines that many documents share are dropped, the others put together again in their order.

Lines are exploded, normalised (white space at both ends gone, A-Z in lower case) and hashed; documents are counted per
hash, each once, with partial aggregation, so a line that half of all documents hold meets as counts. Hashes over the threshold
are joined back to (document, position), narrow rows without text; a text meets its positions once, and only texts that lose lines.

Two 64-bit hashes stand for a key. A key that is shorter than `least` code points always stays.

Cases: a null or empty text is one empty line; a null id counts, told apart by its text; rows of one id are one document in the count,
and each is answered by its own text; texts are read whole, whatever their length or number of lines; ties don't occur; an empty table
gives no rows; extra columns pass through, those named n_lines, n_dropped or kept_text raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graywacke.llm.common import BROADCAST_BYTES, HOT_SHARE, cut, distinct_names, small_batches, with_keys

#: Documents that make a line a shared one, and the shortest key that counts.
DOCUMENTS, LEAST = 10, 1
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_lines", "n_dropped", "kept_text")


def key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(docs: DataFrame, least: int, text: str) -> DataFrame:
    """(doc_id, text_hash, place, h1, h2) of all lines of docs whose keys count."""
    whole = F.coalesce(text, F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(whole).alias("text_hash"), F.posexplode(F.split(whole, "\n")).alias("place", "line"))
    keys = lines.select("doc_id", "text_hash", "place", key(F.col("line")).alias("key")).filter(F.length("key") >= least)
    return keys.select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_keys(lines: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, n_places) of keys found in so many documents or more."""
    who = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("nameless")
    once = lines.groupBy("h1", "h2", "doc_id", who).agg(F.count(F.lit(1)).alias("n"))
    counted = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_places"))
    return counted.filter(F.col("n_documents") >= documents).select("h1", "h2", "n_places")


def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows that end with a text and the sorted places of its lines to drop: the rows, counts of lines and what is kept of the text."""
    for batch in batches:
        *columns, texts, places = batch.columns
        n_lines, n_dropped, kept = [], [], []
        for text, gone in zip(texts.to_pylist(), places.to_pylist()):
            lines = text.split("\n")
            n_lines.append(len(lines))
            n_dropped.append(len(gone or ()))
            if gone:
                out = set(gone)
                text = "\n".join(line for k, line in enumerate(lines) if k not in out)
            kept.append(text)
        added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *added], [*batch.schema.names[:-2], *ADDED])


def deduplicated(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST, text: str = "text", most: int = BROADCAST_BYTES, share: int = HOT_SHARE) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; docs has doc_id and the text. most, share: when keys are broadcast."""
    distinct_names(docs, *ADDED)
    small_batches(docs.sparkSession)
    lines = keyed_lines(docs, least, text)
    keys = cut(shared_keys(lines, documents))
    gone = with_keys(lines, keys, ["h1", "h2"], "n_places", most, share).groupBy(F.col("doc_id").alias("their_id"), F.col("text_hash").alias("their_hash")).agg(F.array_sort(F.collect_set("place")).alias("their_places"))
    whole = F.coalesce(text, F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("our_id"), F.xxhash64(whole).alias("our_hash"), whole.alias("our_text"))
    met = row.join(gone, F.expr("our_id <=> their_id and our_hash = their_hash"), "left").select("row", "our_text", "their_places")
    kind = T.StructType([T.StructField("row", docs.schema), *(T.StructField(k, t) for k, t in zip(ADDED, (T.LongType(), T.LongType(), T.StringType())))])
    return met.mapInArrow(reassembled, kind).select("row.*", *ADDED)
