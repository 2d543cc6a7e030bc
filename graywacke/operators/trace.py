"""Numbers of a manuscript against the numbers of result files: found, found but for the sign, stale, or without a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywacke.operators.documents import numbers

#: Tokens whose numbers aren't results, in the order they are taken out of a line.
SKIPPED = (
    ("trial number", r"\bNCT\d+"), ("doi", r"\b10\.\d{4,}/\S+"), ("p threshold", r"\bp\s*[<>≤≥]\s*\.?\d+\.?\d*"), ("interval level", r"\b\d+\s*%\s*CI\b"), ("citation", r"\[\d+(?:\s*[,–-]\s*\d+)*\]"),
    ("table or figure", r"\b(?:Table|Figure|Fig\.|Section|Appendix)\s*\d+"), ("scale name", r"\b[A-Z]{2,}-\d+\b"), ("ratio of arms", r"\b\d:\d\b"), ("duration", r"\b\d+\s*(?:weeks?|days?|months?|years?|hours?|minutes?|주|일|개월)(?!\w)"),
    ("date", r"\b(?:19|20)\d\d-\d\d-\d\d\b"), ("year", r"\b(?:19|20)\d\d\b"), ("software version", r"\b[vV]?\d+\.\d+\.\d+\b"),
)
#: Share of numbers without a source above which there is no verdict on the rest.
MOST_UNMATCHED = 0.3


def skipped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, line_no, line) without the tokens of SKIPPED, and (reason, n): how many of each were taken out."""
    line, counts = F.col("line"), []
    for reason, pattern in SKIPPED:
        counts.append(F.struct(F.lit(reason).alias("reason"), F.regexp_count(line, F.lit(pattern)).alias("n")))
        line = F.regexp_replace(line, pattern, " ")
    out = rows.select("doc_id", "line_no", line.alias("line"))
    found = rows.select(F.explode(F.array(*counts)).alias("c")).groupBy("c.reason").agg(F.sum("c.n").alias("n")).filter("n > 0")
    return out, found


def ways(value: Column, places: Column) -> Column:
    """What a value may be written as with that many places, in units of the last one: rounded half up, half even, half down, cut off or up."""
    x = value * F.pow(F.lit(10.0), places)
    half_down = F.when(F.abs(x - F.floor(x) - 0.5) < 1e-9, F.floor(x)).otherwise(F.round(x))
    return F.array_distinct(F.array(*(w.cast("long") for w in (F.round(x), F.bround(x), half_down, F.floor(x + 1e-9), F.ceil(x - 1e-9)))))


def sources(values: DataFrame, most_places: int) -> DataFrame:
    """From (file, value): (places, units, file) for each way to write a value with 0 to most_places decimals: keys for an equal join."""
    places = F.explode(F.sequence(F.lit(0), F.lit(most_places))).alias("places")
    rows = values.filter("value is not null and not isnan(value)").select("file", "value", places)
    return rows.select("file", "places", F.explode(ways(F.col("value"), F.col("places"))).alias("units")).groupBy("places", "units").agg(F.min("file").alias("file"))


def traced(rows: DataFrame, current: DataFrame, previous: DataFrame | None = None, most_places: int = 4) -> DataFrame:
    """Numbers of lines (doc_id, line_no, line): doc_id, line_no, nth, raw, file and status: found, sign (found but for its sign, a warning),
    stale (only in previous results) or no source. current and previous: (file, value). The meaning of columns is never guessed."""
    found = numbers(rows).filter(F.col("decimals") <= most_places).withColumn("places", F.col("decimals"))
    found = found.withColumn("units", F.round(F.col("value") * F.pow(F.lit(10.0), F.col("places"))).cast("long"))
    now = sources(current, most_places)
    joined = found.join(now, ["places", "units"], "left")
    other = now.select("places", (-F.col("units")).alias("units"), F.col("file").alias("other_file"))
    joined = joined.join(other, ["places", "units"], "left")
    before = F.lit(None).cast("string").alias("old_file")
    if previous is not None:
        joined = joined.join(sources(previous, most_places).withColumnRenamed("file", "old_file"), ["places", "units"], "left")
        before = F.col("old_file")
    status = F.when(F.col("file").isNotNull(), "found").when(F.col("other_file").isNotNull(), "sign").when(before.isNotNull(), "stale").otherwise("no source")
    return joined.select("doc_id", "line_no", "nth", "raw", F.coalesce("file", "other_file", before).alias("file"), status.alias("status"))


def verdict(rows: DataFrame) -> DataFrame:
    """(numbers, unmatched, undecidable) from traced(): undecidable where more than MOST_UNMATCHED have no source at all."""
    m = rows.agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("status") == "no source").alias("unmatched"))
    return m.withColumn("undecidable", F.col("unmatched") > MOST_UNMATCHED * F.col("numbers"))
