"""A manuscript against itself: figures and tables, citations in order, abbreviations, reporting style, sample sizes and length limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPTION = r"^\s*(Figure|Table)\s+(\d+)\s*[.:]"
MENTION = r"\b(?:Figures?|Figs?\.|Tables?)\s*\d+"


def exhibits(rows: DataFrame) -> DataFrame:
    """From lines (doc_id, line_no, line): (doc_id, kind, number, status) of figures and tables: not mentioned, no caption, or skipped (a number
    missing below the highest caption)."""
    captions = rows.filter(F.regexp_like("line", F.lit(CAPTION))).select("doc_id", F.regexp_extract("line", CAPTION, 1).alias("kind"), F.regexp_extract("line", CAPTION, 2).try_cast("int").alias("number")).distinct()
    raw = rows.filter(~F.regexp_like("line", F.lit(CAPTION))).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(MENTION), F.lit(0))).alias("raw"))
    mentions = raw.select("doc_id", F.when(F.col("raw").startswith("F"), "Figure").otherwise("Table").alias("kind"), F.regexp_extract("raw", r"(\d+)", 1).try_cast("int").alias("number")).distinct()
    keys = ["doc_id", "kind", "number"]
    wanted = captions.groupBy("doc_id", "kind").agg(F.max("number").alias("most")).select("doc_id", "kind", F.explode(F.sequence(F.lit(1), "most")).alias("number"))
    parts = (captions.join(mentions, keys, "left_anti"), "not mentioned"), (mentions.join(captions, keys, "left_anti"), "no caption"), (wanted.join(captions, keys, "left_anti"), "skipped")
    return parts[0][0].withColumn("status", F.lit(parts[0][1])).unionByName(parts[1][0].withColumn("status", F.lit(parts[1][1]))).unionByName(parts[2][0].withColumn("status", F.lit(parts[2][1])))


def citation_order(rows: DataFrame) -> DataFrame:
    """(doc_id, number, after): cited numbers [n] that are first cited after a higher one was."""
    found = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("nth", "raw")).select("doc_id", F.struct("line_no", "nth").alias("at"), F.col("raw").try_cast("int").alias("number"))
    first = found.groupBy("doc_id", "number").agg(F.min("at").alias("at"))
    highest = F.max("number").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("after", highest).filter("number < after").select("doc_id", "number", "after")


def abbreviations(rows: DataFrame, known: tuple[str, ...] = ("USA", "UK", "DNA", "CI", "SD")) -> DataFrame:
    """(doc_id, short, status): capital abbreviations that are used without a definition "words (ABC)", or before it, or defined twice."""
    words = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"\(?\b[A-Z]{2,6}\b\)?"), F.lit(0))).alias("nth", "raw"))
    cells = words.select("doc_id", F.struct("line_no", "nth").alias("at"), F.regexp_replace("raw", r"[()]", "").alias("short"), (F.col("raw").startswith("(") & F.col("raw").endswith(")")).alias("defines")).filter(~F.col("short").isin(*known))
    each = cells.groupBy("doc_id", "short").agg(F.min("at").alias("used"), F.min(F.when(F.col("defines"), F.col("at"))).alias("defined"), F.count_if("defines").alias("times"))
    status = F.when(F.col("times") == 0, "undefined").when(F.col("used") < F.col("defined"), "used before").when(F.col("times") > 1, "defined twice")
    return each.select("doc_id", "short", status.alias("status")).filter("status is not null")


def reporting(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, issue): p = 0.000, a p given only as below or above a threshold, a p without an effect size or interval in its line."""
    line = F.col("line")
    issues = F.array_compact(F.array(
        F.when(F.regexp_like(line, F.lit(r"\bp\s*=\s*0?\.0+(?!\d)")), "p of zero"), F.when(F.regexp_like(line, F.lit(r"\bp\s*[<>]\s*0?\.0?5\b")), "threshold only"),
        F.when(F.regexp_like(line, F.lit(r"\bp\s*[=<>]")) & ~F.regexp_like(line, F.lit(r"(?i)\bCI\b|cohen|hedges|\bd\s*=|\bg\s*=|η|\br\s*=|odds ratio|\bOR\b")), "no effect size"),
    ))
    return rows.select("doc_id", "line_no", F.explode(issues).alias("issue"))


def sections(rows: DataFrame, names: tuple[str, ...] = ("Abstract", "Introduction", "Methods", "Results", "Discussion", "References")) -> DataFrame:
    """rows with section, the last heading before or at the line, and heading: whether the line is one, one of the names alone."""
    heading = F.regexp_extract("line", rf"(?i)^\s*#*\s*({'|'.join(names)})\s*:?\s*$", 1)
    named = F.when(heading != "", F.initcap(heading))
    return rows.withColumn("heading", heading != "").withColumn("section", F.last(named, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def sample_sizes(rows: DataFrame) -> DataFrame:
    """(doc_id, n): sizes N = n of the abstract that its body never gives."""
    found = sections(rows).select("doc_id", "section", F.explode(F.regexp_extract_all("line", F.lit(r"\b[Nn]\s*=\s*(\d+)"), F.lit(1))).alias("raw")).select("doc_id", "section", F.col("raw").try_cast("int").alias("n"))
    body = found.filter("section is null or section <> 'Abstract'").select("doc_id", "n").distinct()
    return found.filter("section = 'Abstract'").select("doc_id", "n").distinct().join(body, ["doc_id", "n"], "left_anti")


def lengths(rows: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """(doc_id, section, words, most, over): words of each limited section, headings left out."""
    counted = sections(rows).withColumn("words", F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))).filter("not heading")
    each = counted.filter(F.col("section").isin(*limits)).groupBy("doc_id", "section").agg(F.sum("words").alias("words"))
    most = F.coalesce(*(F.when(F.col("section") == s, F.lit(n)) for s, n in limits.items()))
    return each.withColumn("most", most).withColumn("over", F.col("words") > F.col("most"))


def changes_in_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, kind, n_before, n_after) of figures, tables and listed references of two versions, where they differ."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        kind = F.when(F.regexp_like("line", F.lit(r"^\s*Figure\s+\d+\s*[.:]")), "figure").when(F.regexp_like("line", F.lit(r"^\s*Table\s+\d+\s*[.:]")), "table").when(F.regexp_like("line", F.lit(r"^\s*\[?\d+[\].]\s+\p{Lu}")), "reference")
        return rows.select("doc_id", kind.alias("kind")).filter("kind is not null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias(name))

    both = counted(before, "n_before").join(counted(after, "n_after"), ["doc_id", "kind"], "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.filter("n_before <> n_after")


def matched_metadata(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """cited (key, doi, title) with status against a snapshot of a registry (doi, title, retracted): no doi, not found, retracted, title differs, ok."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    known = registry.select(F.lower("doi").alias("its_doi"), F.col("title").alias("its_title"), "retracted")
    doi = F.lower(F.regexp_replace(F.trim("doi"), r"^(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    rows = cited.withColumn("plain_doi", F.when(doi != "", doi)).join(known, F.col("plain_doi") == F.col("its_doi"), "left")
    status = F.when(F.col("plain_doi").isNull(), "no doi").when(F.col("its_doi").isNull(), "not found").when(F.col("retracted"), "retracted").when(F.trim(plain(F.col("title"))) != F.trim(plain(F.col("its_title"))), "title differs").otherwise("ok")
    return rows.select("key", "doi", "title", status.alias("status"))
