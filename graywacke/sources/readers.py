"""Readers of tables, text, references and office files, and a writer that never overwrites what it reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.sources import lines

#: Bytes of XML of one part of an office file, unpacked, at most: beyond that it is refused, not cut.
MOST_XML = 64 << 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the ending of its path: csv, tsv, json or Parquet. Line breaks inside quotes belong to the value."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end in ("csv", "tsv"):
        reader = spark.read.options(header=True, multiLine=True, escape='"', sep="\t" if end == "tsv" else ",", mode="PERMISSIVE")
        return (reader.schema(schema) if schema else reader).csv(path)
    if end == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    return spark.read.parquet(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files under path, with lines numbered from 1; an IncompleteReadError where a file can't be read whole."""
    return lines.numbered(lines.complete(lines.records(spark, path))).select("file", "line_no", "line")


#: A value in braces that may hold braces, three deep, or in quotes.
VALUE = r"(?:\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|\"([^\"]*)\"|(\w+))"


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, title, year, journal, doi) of the entries of BibTeX files; null where a field is absent. Files are split between entries, at a
    line that begins with @."""
    found = lines.complete(lines.records(spark, path, "\n@"))
    entries = found.select(F.when(F.col("begins") > 0, F.concat(F.lit("@"), "value")).otherwise(F.col("value")).alias("entry")).filter(r"entry rlike '^@\\w+\\s*[{]'")

    def field(name: str) -> Column:
        of = rf"(?is)[,\s]{name}\s*=\s*{VALUE}"
        return F.nullif(F.trim(F.concat(*(F.regexp_extract("entry", of, k) for k in (1, 2, 3)))), F.lit(""))

    head = r"^@(\w+)\s*\{\s*([^,\s]*)"
    return entries.select(F.lower(F.regexp_extract("entry", head, 1)).alias("kind"), F.regexp_extract("entry", head, 2).alias("key"), *(field(n).alias(n) for n in ("title", "year", "journal", "doi")))


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST_XML:
        raise ValueError(f"{name} is larger than {MOST_XML} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def paragraphs(content: bytes) -> tuple[list[str], bool]:
    """The paragraphs of a Word file as it reads with all changes accepted, and whether it holds tracked changes."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = _xml(archive, "word/document.xml")
    tracked = any(x.tag in (f"{WORD}ins", f"{WORD}del") for x in root.iter())
    return ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p")], tracked


def cells(content: bytes) -> list[tuple[str, str, str]]:
    """(sheet part, cell, value as text) of the filled cells of an Excel file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in _xml(archive, "xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
        out = []
        for name in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
            for c in _xml(archive, name).iter(f"{SHEET}c"):
                value = c.findtext(f"{SHEET}v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                if value is not None:
                    out.append((name.rpartition("/")[2][:-4], c.get("r"), value))
    return out


def _office(spark: SparkSession, path: str, kind: str, rows_of, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content):
                try:
                    rows, error = rows_of(content), None
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows, error = [(None,) * len(names)], f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(file, *r, error) for r in rows], columns=["file", *names, "error"])

    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=f"*.{kind}").load(path).select("path", "content")
    return files.mapInPandas(read, f"file string, {columns}, error string")


def word_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, para_no, text, tracked, error) of the docx files under path; what can't be read is one row with its error."""
    def rows(content: bytes) -> list[tuple]:
        texts, tracked = paragraphs(content)
        return [(n, t, tracked) for n, t in enumerate(texts, 1)]

    return _office(spark, path, "docx", rows, "para_no long, text string, tracked boolean")


def excel_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, cell, value, error) of the xlsx files under path; what can't be read is one row with its error."""
    return _office(spark, path, "xlsx", cells, "sheet string, cell string, value string")


def write_apart(df: DataFrame, path: str, inputs: list[str], kind: str = "csv") -> None:
    """Writes df to a path that must not exist and must lie neither in an input nor above one."""
    hadoop, conf = df.sparkSession._jvm.org.apache.hadoop.fs.Path, df.sparkSession._jsc.hadoopConfiguration()
    def real(p: str) -> str:
        at = hadoop(p)
        files = at.getFileSystem(conf)
        return str(files.resolvePath(at) if files.exists(at) else files.makeQualified(at)).rstrip("/") + "/"

    out = real(path)
    for given in map(real, inputs):
        if out.startswith(given) or given.startswith(out):
            raise ValueError(f"{path} and the input {given} overlap")
    df.write.mode("errorifexists").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)
