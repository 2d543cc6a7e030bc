"""Text files by byte ranges: a source whose tasks read parts of a file, however large, and that says what it has read.

A record belongs to the range that it begins in; a task reads on past its range to the record's end. What is longer than the bound comes
cut, and marked as cut: report() tells for each file whether all its bytes were read, whole and decodable, so that a read
that isn't complete never passes for one that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a record at most, and of one read.
RANGE, MOST, CHUNK = 16 << 20, 64 << 20, 1 << 20
KIND = "file string, file_bytes long, range long, begins long, bytes long, value string, cut boolean, undecodable boolean"


class Range(InputPartition):
    def __init__(self, file: str, size: int, number: int, begin: int, end: int):
        self.file, self.size, self.number, self.begin, self.end = file, size, number, begin, end


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.separator = options.get("separator", "\n").encode()
        self.range, self.most = int(options.get("range_bytes", RANGE)), int(options.get("most_bytes", MOST))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        names = ((f, f.path.rpartition("/")[2]) for f in files)
        files = sorted((f.path, f.size) for f, name in names if f.type == fs.FileType.File and name[:1] not in "._" and name.endswith(self.suffix))
        # A file without bytes has a range too: it was read, and is empty.
        ranges = [Range(path, size, k, begin, min(begin + self.range, size)) for path, size in files for k, begin in enumerate(range(0, max(size, 1), self.range))]
        return ranges or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with store.open_input_file(part.file) as source:
            for begins, size, value, cut in self.records(source, part):
                rows.append((begins, size, value, cut))
                held += len(value)
                if held > CHUNK:
                    yield self.batch(part, rows, len(rows))
                    rows, held = [], 0
        yield self.batch(part, rows, len(rows))

    def records(self, source: pa.NativeFile, part: Range) -> Iterator[tuple[int, int, bytes, bool]]:
        """(begins, bytes with the separator, value without it, cut) of the records that begin in the range."""
        separator, width = self.separator, len(self.separator)
        # A record begins where a separator ends: a range looks back over one, so that one that straddles its border is seen.
        at = max(0, part.begin - width)
        source.seek(at)
        buffer, base = b"", at
        inside = part.begin == 0
        begins, kept, length = 0, [], 0
        if part.size == 0:
            return
        while True:
            found = buffer.find(separator)
            if found < 0:
                more = source.read(CHUNK)
                if more:
                    # All but what may be the start of a separator is settled.
                    settled = max(0, len(buffer) - width + 1)
                    if inside:
                        kept, length = self.keep(kept, length, buffer[:settled])
                    elif base + settled >= part.end:
                        return
                    buffer, base = buffer[settled:] + more, base + settled
                    continue
                if inside:
                    kept, length = self.keep(kept, length, buffer)
                    if length:
                        yield begins, length, b"".join(kept), length > self.most
                return
            if inside:
                kept, length = self.keep(kept, length, buffer[:found])
                yield begins, length + width, b"".join(kept), length > self.most
            buffer, base = buffer[found + width :], base + found + width
            inside, begins, kept, length = base >= part.begin, base, [], 0
            if base >= part.end:
                return

    def keep(self, kept: list[bytes], length: int, more: bytes) -> tuple[list[bytes], int]:
        if length < self.most:
            kept.append(more[: self.most - length])
        return kept, length + len(more)

    def batch(self, part: Range, rows: list[tuple[int, int, bytes, bool]], n: int) -> pa.RecordBatch:
        values, bad = [], []
        for _, _, value, cut in rows:
            try:
                values.append(value.decode())
                bad.append(False)
            except UnicodeDecodeError as e:
                # The last character of a value that was cut may be cut too.
                whole = cut and e.reason == "unexpected end of data"
                values.append(value[: e.start].decode() if whole else value.decode(errors="replace"))
                bad.append(not whole)
        same = lambda v: pa.array([v] * n)
        return pa.RecordBatch.from_arrays(
            [
                same(part.file).cast(pa.string()), same(part.size).cast(pa.int64()), same(part.number).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()), pa.array(values, pa.string()), pa.array([r[3] for r in rows], pa.bool_()), pa.array(bad, pa.bool_()),
            ],
            ["file", "file_bytes", "range", "begins", "bytes", "value", "cut", "undecodable"],
        )


class Lines(DataSource):
    """Options: path, suffix (of file names), separator, range_bytes, most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "graywacke_lines"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def records(spark: SparkSession, path: str, separator: str = "\n", suffix: str = "", range_bytes: int = RANGE, most_bytes: int = MOST) -> DataFrame:
    """(file, file_bytes, range, begins, bytes, value, cut, undecodable): the records of the files under path, in no order."""
    spark.dataSource.register(Lines)
    options = {"path": path, "separator": separator, "suffix": suffix, "range_bytes": str(range_bytes), "most_bytes": str(most_bytes)}
    return spark.read.format(Lines.name()).options(**options).load()


def numbered(found: DataFrame) -> DataFrame:
    """(file, line_no, line, cut, undecodable) from records(): lines numbered from 1 in their file; \\r ends a line as well as \\n and \\r\\n.

    Only ranges are counted up, a row each; a range's own lines are ordered within it.
    """
    value = F.regexp_replace("value", r"\r$", "")
    rows = found.withColumn("parts", F.split(value, "\r"))
    sizes = rows.groupBy("file", "range").agg(F.sum(F.size("parts")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).drop("n")
    order = Window.partitionBy("file", "range").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum(F.size("parts")).over(order), F.lit(0))).join(starts, ["file", "range"])
    lines = placed.select("file", "before", "ahead", "cut", "undecodable", F.posexplode("parts").alias("at", "line"))
    return lines.select("file", (F.col("before") + F.col("ahead") + F.col("at") + 1).alias("line_no"), "line", "cut", "undecodable")


def report(found: DataFrame) -> DataFrame:
    """(file, file_bytes, bytes_read, n_records, n_cut, n_undecodable, complete) from records(): complete where all bytes were read, none was cut off
    and all could be decoded. A file without bytes has no records and no row."""
    each = found.groupBy("file", "file_bytes").agg(F.sum("bytes").alias("bytes_read"), F.count(F.lit(1)).alias("n_records"), F.count_if("cut").alias("n_cut"), F.count_if("undecodable").alias("n_undecodable"))
    return each.withColumn("complete", F.expr("bytes_read = file_bytes and n_cut = 0 and n_undecodable = 0"))


class IncompleteReadError(ValueError):
    """Not all of what was to be read has been read."""


def complete(found: DataFrame) -> DataFrame:
    """found, if report() says that all files were read completely; else IncompleteReadError, which names some that weren't and why."""
    bad = report(found).filter("not complete").limit(10).collect()
    if bad:
        raise IncompleteReadError("; ".join(f"{r.file}: {r.bytes_read} of {r.file_bytes} bytes, {r.n_cut} records cut, {r.n_undecodable} undecodable" for r in bad))
    return found
