"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

write_archives() deduplicates by payload: of pages with equal payloads the one with the largest id is written as a
response, the others as revisit records that refer to it and hold its HTTP headers only. A task writes archives of about
ARCHIVE_BYTES into the shared folder under names of its own attempt; the manifest, a table beside them that Spark commits, lists
those of the attempts that count, so that what a lost attempt left is never read. read_archives() reads the listed ones, or all of
a folder without a manifest: it takes the dictionary from the first frame, walks from frame to frame by their block headers,
decodes each alone, and validates version, named headers, lengths and digests.

Cases: a null payload is empty; payloads shorter than the given least are all responses; rows of equal id and payload are
all responses, as none is the smaller; rows with a null id are written with the id "null", and read back as null; a null
or odd URL is written percent-encoded; extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.llm.common import bounded, cut, small_batches, with_keys

#: Compressed bytes after which a task begins another archive; an archive is read whole by one task.
ARCHIVE_BYTES = 16 << 20
#: Payloads for the dictionary, at most, and what is taken of each; the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 300, 8192, 64 << 10
#: The table of archives that count, and its columns; tasks that read archives, at most.
MANIFEST, MANIFEST_KIND, MOST_TASKS = "manifest", "archive string, n_records long", 100_000
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of a WARC record; refers_to: the id of the response that it revisits."""
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if again else http + payload
    name = lambda n: "<urn:page:null>" if n is None else f"<urn:page:{n}>"
    headers = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"), *([("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT)] if again else []),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; ValueError names what is wrong with it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1" or not gap:
        raise ValueError("not a WARC/1.1 record")
    headers = dict(line.split(": ", 1) for line in lines)
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"} - headers.keys():
        raise ValueError(f"no {', '.join(sorted(missing))}")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length is not its Content-Length")
    block = rest[:n]
    if headers.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:]) if k == "Content-Length"))
    response = headers["WARC-Type"] == "response"
    if response and (len(payload) != size or headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("the payload's length or digest differs")
    if not response and "WARC-Refers-To" not in headers:
        raise ValueError("a revisit that refers to nothing")
    number = lambda name: None if name is None or name == "<urn:page:null>" else int(name.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": number(headers["WARC-Record-ID"]), "url": unquote(headers.get("WARC-Target-URI", "")), "record_type": headers["WARC-Type"],
        "refers_to": number(headers.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if response else None,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its header and its blocks' headers (RFC 8878)."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("the archive ends inside a frame")
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
    if (at := at + 4 * checksum) > len(data):
        raise ValueError("the archive ends inside a frame")
    return at


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own."""
    data, at, shared = memoryview(archive), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("the archive ends inside its dictionary")
        plain = bytes(data[8 : 8 + size])
        if plain[:4] == struct.pack("<I", ZSTD_MAGIC):
            plain = zstandard.ZstdDecompressor().decompress(plain)
        shared, at = zstandard.ZstdCompressionDict(plain), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield decoder.decompress(data[at:end])
        at = end


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; empty where there are too few to train on."""
    rows = pages.select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).filter("html <> ''").limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r.html.encode()[:SAMPLE_BYTES] for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) in the folder, and their manifest: (archive, n_records) for each. Payloads of at least `least` bytes
    that equal another are written once."""
    small_batches(pages.sparkSession)
    dictionary = train_dictionary(pages)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    sums = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sum"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least)
    # Only ids and digests are shuffled; the decision comes back to the pages by their id.
    several = cut(sums.groupBy("sum").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n_rows")).filter("low < refers_to").drop("low"))
    again = cut(with_keys(sums, several, ["sum"], "n_rows").filter("page_id < refers_to").select(F.col("page_id").alias("again_id"), F.col("sum").alias("again_sum"), "refers_to").distinct())
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.join(bounded(again), (rows.page_id == again.again_id) & (F.unhex(F.sha1("payload")) == again.again_sum), "left")
    # Ids go to Python as text: a column of numbers and nulls would be one of doubles there.
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        encoder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        start = struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary if dictionary else b""
        done: list[tuple[str, int]] = []
        parts, size, n = [start], len(start), 0

        def close() -> None:
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):05d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as out:
                for part in parts:
                    out.write(part)
            done.append((name, n))

        for batch in batches:
            for page_id, url, data, refers_to in zip(*(batch[c].astype("object").where(batch[c].notna(), None) for c in ("page_id", "url", "payload", "refers_to"))):
                ids = (None if x is None else int(x) for x in (page_id, refers_to))
                parts.append(encoder.compress(record(next(ids), url, data, next(ids), date)))
                size, n = size + len(parts[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    parts, size, n = [start], len(start), 0
        if n:
            close()
        yield pd.DataFrame(done, columns=["archive", "n_records"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows.mapInPandas(write, MANIFEST_KIND).write.parquet(f"{folder}/{MANIFEST}")
    return pages.sparkSession.read.schema(MANIFEST_KIND).parquet(f"{folder}/{MANIFEST}")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the folder's archives that its manifest lists (all, where there is none): page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and payload (null for a revisit). A record that isn't valid stops the job with its archive's name and what is wrong."""
    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.archive:
                with store.open_input_stream(f"{root}/{path}") as source:
                    content = source.read()
                rows: list[dict] = []
                try:
                    for data in records(content):
                        rows.append(parse(data))
                        if len(rows) == 1000:
                            yield frame(rows)
                            rows = []
                except (ValueError, KeyError, StopIteration, zstandard.ZstdError) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({k: pd.array([r[k] for r in rows], "Int64") if k in ("page_id", "refers_to") else [r[k] for r in rows] for k in rows[0]})

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.Directory:
        names = spark.read.schema(MANIFEST_KIND).parquet(f"{folder}/{MANIFEST}").select("archive")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        names = files.select(F.substring_index("path", "/", -1).alias("archive"))
    return names.repartition(max(1, min(MOST_TASKS, names.count()))).mapInPandas(read, kind)
