"""Linear models from one pass of sums: analysis of covariance, Quade's test on ranks, sphericity, mixed designs and trends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.functions.special import p_f, p_t
from graywacke.operators.ranks import mid_rank, value_ranks


def ancova(df: DataFrame, value: str, group: str, covariate: str) -> DataFrame:
    """(f, df_group, df_error, p, slope): groups compared at equal covariates, slopes taken as one. Sums within and over all groups come from
    one aggregate a group."""
    rows = df.select(F.col(group).alias("g"), F.col(covariate).cast("double").alias("x"), F.col(value).cast("double").alias("y")).dropna()
    each = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.expr("regr_sxx(y, x)").alias("xx"), F.expr("regr_sxy(y, x)").alias("xy"), F.expr("regr_syy(y, x)").alias("yy"))
    grand = each.agg((F.sum(F.expr("n * mx")) / F.sum("n")).alias("gx"), (F.sum(F.expr("n * my")) / F.sum("n")).alias("gy"))
    c = each.crossJoin(F.broadcast(grand))
    m = c.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[F.sum(s).alias(f"w{s}") for s in ("xx", "xy", "yy")],
        F.sum(F.expr("xx + n * pow(mx - gx, 2)")).alias("txx"), F.sum(F.expr("xy + n * (mx - gx) * (my - gy)")).alias("txy"), F.sum(F.expr("yy + n * pow(my - gy, 2)")).alias("tyy"),
    )
    m = m.selectExpr("cast(k - 1 as double) as df_group", "cast(n - k - 1 as double) as df_error", "wyy - wxy * wxy / nullif(wxx, 0) as error", "tyy - txy * txy / nullif(txx, 0) as total", "wxy / nullif(wxx, 0) as slope")
    return m.withColumn("f", F.expr("(total - error) / nullif(df_group, 0) / nullif(error / nullif(df_error, 0), 0)")).select("f", "df_group", "df_error", p_f("f", "df_group", "df_error").alias("p"), "slope")


def quade(df: DataFrame, value: str, group: str, covariate: str) -> DataFrame:
    """(f, df_between, df_within, p): Quade's rank analysis of covariance (1967), an ANOVA of the residuals of ranks on ranks."""
    rows = df.select(F.col(group).alias("g"), F.col(covariate).cast("double").alias("x"), F.col(value).cast("double").alias("y")).dropna()
    rx, ry = (value_ranks(rows, c).select(c, mid_rank().alias(f"r{c}")) for c in ("x", "y"))
    ranked = rows.join(rx, "x").join(ry, "y").select("g", "rx", "ry")
    line = ranked.agg(F.expr("regr_slope(ry, rx)").alias("b"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"))
    each = ranked.crossJoin(F.broadcast(line)).selectExpr("g", "ry - my - b * (rx - mx) as e").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    m = each.agg(F.sum(F.expr("n * m * m")).alias("between"), F.sum(F.expr("n * v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    m = m.selectExpr("between / nullif(k - 1, 0) / nullif(within / nullif(n - k, 0), 0) as f", "cast(k - 1 as double) as df_between", "cast(n - k as double) as df_within")
    return m.withColumn("p", p_f("f", "df_between", "df_within"))


def _complete(long: DataFrame, subject: str, time: str, value: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (s, t, x, more...) of the subjects that have all times, one value each, and the number of times."""
    x = long.select(F.col(subject).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"), *more).dropna()
    k = x.agg(F.count_distinct("t").alias("k"))
    whole = x.groupBy("s").agg(F.count(F.lit(1)).alias("have"), F.count_distinct("t").alias("times")).crossJoin(F.broadcast(k)).filter("have = k and times = k").select("s")
    return x.join(whole, "s", "left_semi"), k


def sphericity(long: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """(k, n, epsilon_gg, epsilon_hf): Greenhouse and Geisser's and Huynh and Feldt's corrections of repeated measures, from the covariances of
    all pairs of times, double-centred. Times are few: the pairs of one subject meet, never those of two."""
    x, _ = _complete(long, subject, time, value, [])
    pairs = x.alias("a").join(x.alias("b"), "s").select(F.col("a.t").alias("t"), F.col("b.t").alias("u"), F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    cov = pairs.groupBy("t", "u").agg(F.covar_samp("x", "y").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = cov.groupBy("t").agg(F.avg("c").alias("row"))
    grand = cov.agg(F.avg("c").alias("grand"))
    centred = cov.join(F.broadcast(rows), "t").join(F.broadcast(rows.select(F.col("t").alias("u"), F.col("row").alias("column"))), "u").crossJoin(F.broadcast(grand)).withColumn("d", F.expr("c - row - column + grand"))
    m = centred.agg(F.count_distinct("t").alias("k"), F.max("n").alias("n"), F.sum(F.expr("case when t = u then d else 0 end")).alias("trace"), F.sum(F.expr("d * d")).alias("squares"))
    m = m.withColumn("epsilon_gg", F.expr("trace * trace / nullif((k - 1) * squares, 0)"))
    return m.selectExpr("k", "n", "epsilon_gg", "least(1, (n * (k - 1) * epsilon_gg - 2) / nullif((k - 1) * (n - 1 - (k - 1) * epsilon_gg), 0)) as epsilon_hf")


def mixed_anova(long: DataFrame, subject: str, time: str, value: str, group: str) -> DataFrame:
    """(effect, f, df, df_error, p) of group, time and their interaction: subjects in groups, measured at all times; sums of squares weigh
    subjects alike."""
    x, _ = _complete(long, subject, time, value, [F.col(group).alias("g")])
    x = x.crossJoin(F.broadcast(x.agg(F.avg("x").alias("grand")))).selectExpr("s", "t", "g", "x - grand as x")
    mean = lambda *by: x.groupBy(*by).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * m * m")).alias("ss"), F.count(F.lit(1)).alias("levels"))
    parts = x.agg(F.sum(F.expr("x * x")).alias("total"))
    for name, by in (("s", ["s", "g"]), ("g", ["g"]), ("t", ["t"]), ("gt", ["g", "t"])):
        parts = parts.crossJoin(F.broadcast(mean(*by).select(F.col("ss").alias(f"ss_{name}"), F.col("levels").alias(f"n_{name}"))))
    rows = parts.selectExpr("*", "ss_s - ss_g as error_s", "cast(n_s - n_g as double) as df_s", "ss_gt - ss_g - ss_t as ss_i", "total - ss_s - ss_t - (ss_gt - ss_g - ss_t) as error_w", "cast((n_s - n_g) * (n_t - 1) as double) as df_w")
    effects = F.explode(F.array(
        F.expr("named_struct('effect', 'group', 'ss', ss_g, 'df', cast(n_g - 1 as double), 'error', error_s, 'df_error', df_s)"), F.expr("named_struct('effect', 'time', 'ss', ss_t, 'df', cast(n_t - 1 as double), 'error', error_w, 'df_error', df_w)"),
        F.expr("named_struct('effect', 'group x time', 'ss', ss_i, 'df', cast((n_g - 1) * (n_t - 1) as double), 'error', error_w, 'df_error', df_w)"),
    ))
    m = rows.select(effects.alias("e")).select("e.*").withColumn("f", F.expr("ss / nullif(df, 0) / nullif(error / nullif(df_error, 0), 0)"))
    return m.select("effect", "f", "df", "df_error", p_f("f", "df", "df_error").alias("p"))


def trend(long: DataFrame, subject: str, time: str, value: str, order: int = 1) -> DataFrame:
    """(n, mean, t, df, p): whether subjects' values follow a straight line (1), a parabola (2) ... over the times in their order, by the
    orthogonal polynomial of that order. Times are few: the driver holds them, not the subjects."""
    x, _ = _complete(long, subject, time, value, [])
    times = [r.t for r in x.select("t").distinct().orderBy("t").collect()]
    if len(times) <= order:
        raise ValueError(f"a trend of order {order} needs more than {order} times")
    q, _ = np.linalg.qr(np.vander(np.arange(len(times), dtype=float), order + 1, increasing=True))
    weights = q[:, order] * (1 if q[-1, order] > 0 else -1)
    table = long.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(times, weights)], x.select("t", F.lit(0.0).alias("w")).schema)
    each = x.join(F.broadcast(table), "t").groupBy("s").agg(F.sum(F.expr("w * x")).alias("c"))
    m = each.agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("sd")).selectExpr("n", "mean", "mean / nullif(sd / sqrt(n), 0) as t", "cast(n - 1 as double) as df")
    return m.withColumn("p", p_t("t", "df"))
