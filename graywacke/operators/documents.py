"""Checks of documents: numbers with their places, recomputed percentages, possible means, citations and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number as written: sign, digits, point and exponent; 1.5e-05 is one number, and so is .07.
NUMBER = r"(?<![\w.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w]|\.\d)"


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no from 1, line)."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def numbers(rows: DataFrame) -> DataFrame:
    """From lines(): (doc_id, line_no, nth, raw, value, decimals) for each number."""
    found = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0))).alias("nth", "raw"))
    return found.withColumns({"value": F.col("raw").try_cast("double"), "decimals": F.length(F.regexp_extract("raw", r"\.(\d+)", 1))})


def may_round_to(value: Column, written: Column, decimals: Column) -> Column:
    """Whether a value written with that many decimals may stand for it, rounded up, down or to nearest."""
    scale = F.pow(F.lit(10.0), decimals)
    return (F.round(written * scale) >= F.floor(value * scale + 1e-9)) & (F.round(written * scale) <= F.ceil(value * scale - 1e-9))


def ratios(rows: DataFrame) -> DataFrame:
    """Claims like 23/48 (45.2%): (doc_id, line_no, part, whole, written, recomputed, ok); ok is null where the whole is 0."""
    claim = r"(\d+)\s*/\s*(\d+)\s*\((\d+(?:\.\d+)?)\s*%\)"
    found = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(claim), F.lit(0))).alias("raw"))
    part, whole, written = (F.regexp_extract("raw", claim, k) for k in (1, 2, 3))
    cells = found.select("doc_id", "line_no", part.cast("double").alias("part"), whole.cast("double").alias("whole"), written.alias("text"))
    cells = cells.withColumns({"recomputed": F.expr("100 * part / nullif(whole, 0)"), "written": F.col("text").cast("double"), "decimals": F.length(F.regexp_extract("text", r"\.(\d+)", 1))})
    return cells.withColumn("ok", may_round_to(F.col("recomputed"), F.col("written"), F.col("decimals"))).drop("text", "decimals")


def grim(claims: DataFrame, mean: str, n: str, decimals: str) -> DataFrame:
    """claims with possible: whether n whole numbers can have the mean as written (Brown and Heathers, 2017)."""
    total = F.col(mean) * F.col(n)
    ok = lambda t: may_round_to(t / F.col(n), F.col(mean), F.col(decimals))
    return claims.withColumn("possible", F.when(F.col(n) > 0, ok(F.floor(total)) | ok(F.ceil(total))))


def citations(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(number, status): cited numbers [n] that references (number) lacks, and references never cited."""
    cited = rows.select(F.explode(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("raw")).select(F.col("raw").try_cast("int").alias("number")).distinct()
    return cited.join(references, "number", "left_anti").withColumn("status", F.lit("not listed")).unionByName(references.select("number").distinct().join(cited, "number", "left_anti").withColumn("status", F.lit("never cited")))


def gaps(found: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number): numbers missing between the first and the last of a group, as 2-5 between 2-4 and 2-6."""
    span = found.groupBy(group).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    return span.select(group, F.explode(F.sequence("low", "high")).alias(number)).join(found.select(group, number), [group, number], "left_anti")
