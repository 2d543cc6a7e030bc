"""Joins with an account of what they drop, and checks of visits against a protocol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graywacke.plans.result import AuditedResult, MissingSpecError, Verdict


def subject_id(raw: Column) -> Column:
    """An id in capitals, full-width characters made plain, without white space and with numbers free of leading zeros: "s 01" and "S1" are
    one subject, S01 and S02 never are."""
    plain = F.translate(raw, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
    return F.regexp_replace(F.upper(F.regexp_replace(plain, r"[\s\x{3000}]+", "")), r"(?<![0-9])0+(?=[0-9])", "")


def night(ts: Column, cutover_hours: int = 12) -> Column:
    """The date of the evening that a time belongs to: 23:40 and 03:20 of the next day are one night."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(cutover_hours)))


def number(raw: Column) -> Column:
    """A plainly written number; null for anything else, a decimal comma included."""
    return F.when(F.regexp_like(raw, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")), F.trim(raw).try_cast("double"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merged(sources: dict[str, DataFrame], keys: list[str]) -> AuditedResult:
    """A full outer join of sources by their keys. Keys that a source has more than once are left out of it and listed, so that no
    row is multiplied. coverage: rows in, rows with a null key, rows of repeated keys, rows used; issues: (source, keys, reason, n).

    Undecidable where sources share no key at all.
    """
    if not sources or not keys:
        raise MissingSpecError("sources and keys are needed")
    full = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    issues, used, flow = [], [], []
    for name, df in sources.items():
        many = duplicate_keys(df.filter(full), keys)
        issues += [many.select(F.lit(name).alias("source"), *keys, F.lit("repeated key").alias("reason"), "n"), df.filter(~full).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), *keys, F.lit("no key").alias("reason"), "n")]
        single = df.filter(full).join(many.select(*keys), keys, "left_anti")
        used.append(single.withColumn(f"in_{name}", F.lit(True)))
        flow.append(df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(~full).alias("no_key")).crossJoin(many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))).select(F.lit(name).alias("source"), "rows_in", "no_key", "repeated", F.expr("rows_in - no_key - repeated").alias("rows_used")))
    result = reduce(lambda a, b: a.join(b, keys, "full_outer"), used)
    all_issues = reduce(DataFrame.unionByName, issues)
    apart = len(used) > 1 and reduce(lambda a, b: a.join(b.select(*keys), keys, "left_semi"), used[1:], used[0]).isEmpty()
    verdict = Verdict.UNDECIDABLE if apart else Verdict.OK if all_issues.isEmpty() else Verdict.ISSUES
    return AuditedResult(result, reduce(DataFrame.unionByName, flow), all_issues, verdict)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys both tables have, and each alone."""
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full_outer")
    return both.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"))


def visit_windows(visits: DataFrame, baselines: DataFrame, protocol: DataFrame, as_of: str) -> DataFrame:
    """visits (subject, visit_code, visit_date) against protocol (visit_code, offset_days, before, after): scheduled, deviation_days
    (signed, 0 inside the window, which includes its ends) and status, stamped with as_of.

    status: on time, early, late, undecidable (no date, no baseline or no such visit). The protocol is one row for each visit.
    """
    if not as_of:
        raise MissingSpecError("as_of is needed")
    rows = visits.join(baselines, "subject", "left").join(F.broadcast(protocol), "visit_code", "left").withColumn("scheduled", F.expr("date_add(baseline, offset_days)"))
    rows = rows.withColumn("away", F.date_diff("visit_date", "scheduled"))
    deviation = F.when(F.col("away") < -F.col("before"), F.col("away") + F.col("before")).when(F.col("away") > F.col("after"), F.col("away") - F.col("after")).when(F.col("away").isNotNull(), 0)
    rows = rows.withColumn("deviation_days", deviation)
    status = F.when(F.col("deviation_days").isNull(), "undecidable").when(F.col("deviation_days") < 0, "early").when(F.col("deviation_days") > 0, "late").otherwise("on time")
    return rows.withColumns({"status": status, "as_of": F.lit(as_of).cast("date")}).select("subject", "visit_code", "visit_date", "scheduled", "deviation_days", "status", "as_of")


def missing_visits(visits: DataFrame, baselines: DataFrame, protocol: DataFrame, as_of: str) -> DataFrame:
    """(subject, visit_code, status): required visits that a subject lacks; not due where the window is still open on as_of."""
    expected = baselines.crossJoin(F.broadcast(protocol.filter("required")))
    absent = expected.join(visits.select("subject", "visit_code").distinct(), ["subject", "visit_code"], "left_anti")
    closes = F.date_add("baseline", F.col("offset_days") + F.col("after"))
    status = F.when(closes.isNull(), "undecidable").when(closes >= F.lit(as_of).cast("date"), "not due").otherwise("missing")
    return absent.select("subject", "visit_code", status.alias("status"))


def order_violations(visits: DataFrame, protocol: DataFrame) -> DataFrame:
    """Visits dated before the visit that the protocol plans ahead of them."""
    planned = Window.partitionBy("subject").orderBy("offset_days", "visit_code", "visit_date")
    rows = visits.join(F.broadcast(protocol), "visit_code").withColumn("before_date", F.lag("visit_date").over(planned))
    return rows.filter("visit_date < before_date").select("subject", "visit_code", "visit_date", "before_date")
