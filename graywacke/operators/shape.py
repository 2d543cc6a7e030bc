"""Tables brought into shape and looked over: long form, time zones, items, coverage, enrolment, inclusion, two stages, top rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str = "group", value: str = "value") -> DataFrame:
    """A row for each of the value columns of a row, nulls left out."""
    return df.unpivot(ids, values, name, value).filter(F.col(value).isNotNull())


def in_zone(ts: Column, zone: str) -> Column:
    """A UTC time as the clock of a zone shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def inspect(df: DataFrame) -> DataFrame:
    """(column, type, nulls, distinct, first) of each column; distinct counts are approximate."""
    parts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), F.approx_count_distinct(F.col(f"`{f.name}`").cast("string")).alias("distinct"), F.min(F.col(f"`{f.name}`").cast("string")).alias("first")) for f in df.schema]
    return df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def item_summary(answers: DataFrame, items: list[str], low: float, high: float) -> DataFrame:
    """(item, n, missing, mean, sd, least, most, outside): each item's answers, and how many lie outside its scale."""
    long = answers.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("v")) for c in items))).alias("x")).select("x.*")
    return long.groupBy("item").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(~F.col("v").between(low, high)).alias("outside"))


def subscale(answers: DataFrame, items: list[str], name: str, reverse: tuple[str, ...] = (), low: float = 0, high: float = 0, most_missing: int = 0) -> DataFrame:
    """answers with the mean of a subscale's items, those in reverse turned round; null where more than most_missing lack."""
    cells = [(F.lit(low + high) - F.col(c) if c in reverse else F.col(c)).cast("double") for c in items]
    have = F.filter(F.array(*cells), lambda x: x.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(have), F.lit(0))
    return answers.withColumn(name, F.when(F.size(have) >= len(items) - most_missing, mean))


def coverage_matrix(rows: DataFrame, subject: str, source: str, names: list[str]) -> DataFrame:
    """A row for each subject, a column for each named source: how many rows it has there."""
    return rows.groupBy(subject).agg(*(F.count_if(F.col(source) == n).alias(n) for n in names))


def two_stage(rows: DataFrame, subject: str, group: str, value: str) -> DataFrame:
    """(group, subjects, rows_each, mean, sd): subjects' means first, then the group's; rows_each above 1 warns of repeats taken for subjects."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("group"), subject).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("k"))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("subjects"), (F.sum("k") / F.count(F.lit(1))).alias("rows_each"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def enrolment(subjects: DataFrame, date: str, target: int) -> DataFrame:
    """(month, n, total, rate, months_left): enrolled by month, and at the mean rate so far how many months to the target. Few rows: months."""
    months = subjects.filter(F.col(date).isNotNull()).groupBy(F.trunc(F.to_date(date), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("month").over(Window.partitionBy())
    rows = months.withColumns({"total": F.sum("n").over(run), "spent": F.months_between("month", first) + 1})
    rows = rows.withColumn("rate", F.col("total") / F.col("spent"))
    return rows.select("month", "n", "total", "rate", F.greatest(F.lit(0.0), (target - F.col("total")) / F.col("rate")).alias("months_left"))


def rechecked(subjects: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """subjects with violations (names of rules, SQL conditions, that are false) and undecidable (those that are null, or compare a NaN)."""
    each = [F.struct(F.lit(n).alias("n"), F.expr(r).alias("ok")) for n, r in rules.items()]
    named = lambda keep: F.transform(F.filter(F.array(*each), keep), lambda x: x.n)
    return subjects.withColumns({"violations": named(lambda x: ~x.ok), "undecidable": named(lambda x: x.ok.isNull())})


def flow(subjects: DataFrame, stages: Mapping[str, str]) -> DataFrame:
    """(stage_no, stage, n, lost): subjects that fulfil this and all earlier conditions; an identity by construction, n + lost is the n before."""
    reached, sums = F.lit(True), []
    for condition in stages.values():
        reached = reached & F.coalesce(F.expr(condition), F.lit(False))
        sums.append(F.count_if(reached))
    counts = subjects.agg(F.array(F.count(F.lit(1)), *sums).alias("n"))
    names = F.array(*map(F.lit, stages))
    rows = counts.select("n", F.posexplode(names).alias("at", "stage"))
    return rows.select((F.col("at") + 1).alias("stage_no"), "stage", F.col("n")[F.col("at") + 1].alias("n"), (F.col("n")[F.col("at")] - F.col("n")[F.col("at") + 1]).alias("lost"))


def per_protocol(events: DataFrame, subject: str, reason: str) -> DataFrame:
    """(subject, reasons): who leaves the per-protocol set, each person once with all reasons, sorted."""
    return events.filter(F.col(reason).isNotNull()).groupBy(F.col(subject).alias("subject")).agg(F.array_join(F.sort_array(F.collect_set(F.col(reason).cast("string"))), "; ").alias("reasons"))


def top(rows: DataFrame, by: str, k: int, group: str | None = None, *ties: str) -> DataFrame:
    """The k rows with most, of each group if one is named; ties go by the columns in ties, so that equal tables give equal rows."""
    order = [F.desc(by), *ties]
    if group is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k).drop("place")


def yearly_trend(rows: DataFrame, topic: str, year: str) -> DataFrame:
    """(topic, n, years, slope): counts a year and whether they rise or fall."""
    each = rows.groupBy(F.col(topic).alias("topic"), F.col(year).cast("double").alias("year")).agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("topic").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("years"), F.expr("regr_slope(k, year)").alias("slope"))


def diary(nights: DataFrame, bed: str, asleep_minutes: str, awake_minutes: str, wake: str, rise: str) -> DataFrame:
    """nights with sol, waso, tib, tst, se (percent) and mid_sleep (minutes after midnight): clock times are minutes of the day, times after
    midnight included: what is earlier than going to bed is of the next day."""
    after = lambda t, start: F.pmod(F.col(t) - F.col(start), F.lit(1440))
    rows = nights.withColumns({"sol": F.col(asleep_minutes), "waso": F.col(awake_minutes), "tib": after(rise, bed), "span": after(wake, bed) - F.col(asleep_minutes)})
    rows = rows.withColumns({"tst": F.col("span") - F.col("waso"), "mid_sleep": F.pmod(F.col(bed) + F.col("sol") + F.col("span") / 2, F.lit(1440))})
    return rows.withColumn("se", 100.0 * F.col("tst") / F.nullif(F.col("tib"), F.lit(0))).drop("span")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; ValueError beyond most rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: not a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in found)])


def forest_plot(studies: DataFrame, name: str, low: str, estimate: str, high: str, width: int = 41) -> DataFrame:
    """(name, plot): a line of text for each study, its interval from < to > with the estimate as *, on one scale."""
    ends = studies.agg(F.min(low).alias("from"), F.max(high).alias("to"))
    at = lambda c: F.round((F.col(c) - F.col("from")) / F.nullif(F.col("to") - F.col("from"), F.lit(0.0)) * (width - 1)).cast("int")
    rows = studies.crossJoin(F.broadcast(ends)).select(F.col(name).alias("name"), at(low).alias("l"), at(estimate).alias("e"), at(high).alias("h"))
    mark = lambda i: F.when(i == F.col("e"), "*").when(i == F.col("l"), "<").when(i == F.col("h"), ">").when(i.between(F.col("l"), F.col("h")), "-").otherwise(" ")
    return rows.select("name", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), mark), "").alias("plot"))
