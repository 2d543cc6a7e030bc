"""Recomputes statistics that a document reports, and says where words, intervals and p values contradict each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graywacke.functions.special import chi2_upper, f_upper, normal_two_sided, t_two_sided
from graywacke.operators.documents import may_round_to

NUMBER = r"-?(?:\d+\.?\d*|\.\d+)"
#: t(28) = 2.10, p = .045; F(2, 57) = 4.1, p < .05; χ²(1) = 3.9, p = 0.048; z = 1.2, p = .23; r(30) = .41, p = .02
TEST = rf"(?<![\w])(t|F|χ²|χ2|chi2|z|r)\s*(?:\(\s*(\d+\.?\d*)\s*(?:,\s*(?:N\s*=\s*)?(\d+\.?\d*)\s*)?\))?\s*=\s*({NUMBER})\s*[,;]\s*p\s*([=<>])\s*(\.?\d+\.?\d*)"
#: Words by which a reported p may be right though it isn't the two-sided one of the degrees of freedom as written.
EXCUSES = r"(?i)one[- ](?:sided|tailed)|greenhouse|huynh|corrected|bonferroni|holm"
NOT_SIGNIFICANT = r"(?i)(?:not|non|no|in)[- ]*(?:statistically )?significan"
SIGNIFICANT = r"(?i)significan"
ALPHA = 0.05


@F.pandas_udf(DoubleType())
def p_of(kind: pd.Series, value: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Two-sided (F and chi squared: upper) p of a statistic; null where degrees of freedom lack or the value is impossible."""
    out = np.full(len(kind), np.nan)
    k, v, a, b = kind.to_numpy(object), *(s.to_numpy(float, na_value=np.nan) for s in (value, d1, d2))
    for name, has, p in (
        ("t", a > 0, lambda m: t_two_sided(v[m], a[m])), ("F", (a > 0) & (b > 0) & (v >= 0), lambda m: f_upper(v[m], a[m], b[m])), ("chi2", (a > 0) & (v >= 0), lambda m: chi2_upper(v[m], a[m])),
        ("z", np.isfinite(v), lambda m: normal_two_sided(v[m])), ("r", (a > 0) & (np.abs(v) < 1), lambda m: t_two_sided(v[m] * np.sqrt(a[m] / (1 - v[m] ** 2)), a[m])),
    ):
        mine = (k == name) & has
        if mine.any():
            out[mine] = p(mine)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def decimals(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def tests(rows: DataFrame) -> DataFrame:
    """From lines (doc_id, line_no, line): a row for each reported test with kind, value, d1, d2, sign, written (the p), p_low and p_high
    (recomputed at both ends of what the value as written may be), and status: impossible, skipped (nothing to compute from), consistent,
    inconsistent, or contradiction (the other side of ALPHA); severity is fatal, or a warning where the line holds an excuse."""
    found = rows.select("doc_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(TEST), F.lit(0))).alias("nth", "raw"))
    kind, d1, d2, value, sign, p = (F.regexp_extract("raw", TEST, k) for k in range(1, 7))
    cells = found.select(
        "doc_id", "line_no", "line", "nth", "raw", F.when(kind.isin("χ²", "χ2", "chi2"), "chi2").otherwise(kind).alias("kind"), value.try_cast("double").alias("value"), d1.try_cast("double").alias("d1"),
        d2.try_cast("double").alias("d2"), sign.alias("sign"), p.try_cast("double").alias("written"), F.pow(F.lit(10.0), -decimals(value)).alias("unit"), decimals(p).alias("places"),
    )
    size, half = F.abs("value"), F.col("unit") / 2
    ends = cells.withColumns({"p_high": p_of("kind", F.greatest(F.lit(0.0), size - half), "d1", "d2"), "p_low": p_of("kind", F.when(F.col("kind") == "r", F.least(F.lit(1 - 1e-12), size + half)).otherwise(size + half), "d1", "d2")})
    impossible = (F.col("kind") == "r") & (size > 1) | F.col("kind").isin("F", "chi2") & (F.col("value") < 0) | (F.col("d1") == 0) | (F.col("d2") == 0) & (F.col("kind") == "F") | (F.col("written") > 1)
    step = F.pow(F.lit(10.0), -F.col("places"))
    fits = F.when(F.col("sign") == "<", F.col("p_low") < F.col("written")).when(F.col("sign") == ">", F.col("p_high") > F.col("written")).otherwise((F.col("p_low") < F.col("written") + step) & (F.col("p_high") > F.col("written") - step))
    says = F.when(F.col("sign") == "=", F.col("written") < ALPHA).when(F.col("sign") == "<", F.when(F.col("written") <= ALPHA, True)).otherwise(F.when(F.col("written") >= ALPHA, False))
    flips = says & (F.col("p_low") >= ALPHA) | ~says & (F.col("p_high") < ALPHA)
    status = F.when(F.coalesce(impossible, F.lit(False)), "impossible").when(F.col("p_low").isNull() | F.col("written").isNull(), "skipped").when(fits, "consistent").when(F.coalesce(flips, F.lit(False)), "contradiction").otherwise("inconsistent")
    judged = ends.withColumn("status", status)
    bad = F.col("status").isin("impossible", "contradiction", "inconsistent")
    severity = F.when(bad, F.when((F.col("status") != "impossible") & F.regexp_like("line", F.lit(EXCUSES)) | (F.col("status") == "inconsistent"), "warning").otherwise("fatal"))
    return judged.withColumn("severity", severity).drop("line", "unit", "places")


def coverage(judged: DataFrame, least: int = 5) -> DataFrame:
    """(candidates, recomputed, skipped, undecidable) from tests(): undecidable where fewer than least could be recomputed."""
    m = judged.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") != "skipped").alias("recomputed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    return m.withColumn("undecidable", F.col("recomputed") < least)


INTERVAL = rf"({NUMBER})\s*\(\s*95\s*%\s*CI[:,]?\s*\[?({NUMBER})\s*(?:,|;|–|\bto\b)\s*({NUMBER})\]?\s*\)(?:\s*[,;]\s*p\s*([=<>])\s*(\.?\d+\.?\d*))?"


def intervals(rows: DataFrame, neutral: float = 0.0) -> DataFrame:
    """Estimates with 95 % intervals: (doc_id, line_no, estimate, low, high, written, inside, agrees): whether the estimate lies in its interval,
    and whether the p as written says the same of the neutral value as the interval does (null where it says nothing)."""
    found = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(INTERVAL), F.lit(0))).alias("raw"))
    part = lambda k: F.regexp_extract("raw", INTERVAL, k)
    cells = found.select("doc_id", "line_no", *(part(k).try_cast("double").alias(c) for k, c in ((1, "estimate"), (2, "low"), (3, "high"))), part(4).alias("sign"), part(5).try_cast("double").alias("written"))
    says = F.when(F.col("sign") == "=", F.col("written") < ALPHA).when((F.col("sign") == "<") & (F.col("written") <= ALPHA), True).when((F.col("sign") == ">") & (F.col("written") >= ALPHA), False)
    excludes = ~F.lit(neutral).between(F.least("low", "high"), F.greatest("low", "high"))
    return cells.withColumns({"inside": F.col("estimate").between(F.col("low"), F.col("high")), "agrees": says == excludes}).drop("sign")


def wording(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, written, claim): sentences that call a p of ALPHA or more significant, or a smaller one not significant."""
    sentence = F.explode(F.split("line", r"(?<=[.!?])\s+(?=\p{Lu})")).alias("sentence")
    p = rf"(?<![\w])p\s*=\s*(\.?\d+\.?\d*)"
    cells = rows.select("doc_id", "line_no", sentence).select("doc_id", "line_no", "sentence", F.regexp_extract("sentence", p, 1).try_cast("double").alias("written")).filter("written is not null")
    claim = F.when(F.regexp_like("sentence", F.lit(NOT_SIGNIFICANT)), F.when(F.col("written") < ALPHA, "called not significant")).when(F.regexp_like("sentence", F.lit(SIGNIFICANT)), F.when(F.col("written") >= ALPHA, "called significant"))
    return cells.withColumn("claim", claim).filter("claim is not null").select("doc_id", "line_no", "written", "claim")


CHANGE = rf"from\s+({NUMBER})\s+to\s+({NUMBER})\s*\(\s*(?:change|Δ)\s*[=:]?\s*({NUMBER})\s*\)"


def changes(rows: DataFrame) -> DataFrame:
    """Claims like "from 14.2 to 9.6 (change -4.6)": (doc_id, line_no, pre, post, written, recomputed, status): ok, sign (right but for its
    sign) or wrong, where each number may be off by half a unit of its last place."""
    found = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(CHANGE), F.lit(0))).alias("raw"))
    part = [F.regexp_extract("raw", CHANGE, k) for k in (1, 2, 3)]
    cells = found.select("doc_id", "line_no", *(p.try_cast("double").alias(c) for p, c in zip(part, ("pre", "post", "written"))), sum((F.pow(F.lit(10.0), -decimals(p)) / 2 for p in part[1:]), F.pow(F.lit(10.0), -decimals(part[0])) / 2).alias("slack"))
    d = F.col("post") - F.col("pre")
    near = lambda x: F.abs(x) <= F.col("slack") + 1e-9
    return cells.withColumns({"recomputed": d, "status": F.when(near(d - F.col("written")), "ok").when(near(d + F.col("written")), "sign").otherwise("wrong")}).drop("slack")


def grimmer(claims: DataFrame, mean: str, sd: str, n: str, places: str) -> DataFrame:
    """claims with possible_sd: whether n whole numbers with a mean as written can have the SD as written (Anaya, 2016): for some sum whose
    mean may be written so, some sum of squares within the SD's rounding is a whole number of the parity of the sum.

    There are several such sums where n is large against the places; all are tried.
    """
    unit = F.pow(F.lit(10.0), -F.col(places))
    count = F.col(n).cast("double")
    squares = lambda s, total: (count - 1) * s * s + total * total / count

    def fits(whole):
        total = whole.cast("double")
        low, high = F.ceil(squares(F.greatest(F.lit(0.0), F.col(sd) - unit / 2), total) - 1e-9), F.floor(squares(F.col(sd) + unit / 2, total) + 1e-9)
        return may_round_to(total / count, F.col(mean), F.col(places)) & (low + F.pmod(low - whole, F.lit(2)) <= high)

    totals = F.sequence(F.ceil(count * (F.col(mean) - unit)), F.floor(count * (F.col(mean) + unit)) + 1)
    return claims.withColumn("possible_sd", F.when(F.col(n) > 1, F.exists(totals, fits)))
