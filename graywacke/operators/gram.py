"""Linear models of any number of columns from one pass: means and centred cross-products, and a Cholesky solve on the small matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from graywacke.functions.special import p_t, p_z, t_two_sided

#: Columns of one matrix, at most: their number squared is what a row holds.
MOST_COLUMNS = 60
#: The cumulated Poisson(1) probabilities of 0 to 6.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
FIT = StructType([StructField("estimates", ArrayType(DoubleType())), StructField("errors", ArrayType(DoubleType())), StructField("ps", ArrayType(DoubleType())), StructField("df", DoubleType()), StructField("r2", DoubleType())])


def gram(df: DataFrame, columns: list[str], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., n, means, cross): of the rows without a null in columns their number, means, and centred sums of products, row by row.

    One aggregate with partial sums; a group's result is a row. With a weight (a whole number) a row counts so many times.
    """
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    keys, k = by or [], len(columns)
    rows = df.select(*keys, *([F.col(weight).cast("double").alias("w")] if weight else []), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))).dropna(subset=[f"v{i}" for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    if weight:
        m = rows.groupBy(*keys).agg(F.sum("w").alias("n"), *(F.sum(F.expr(f"w * v{i}")).alias(f"s{i}") for i in range(k)), *(F.sum(F.expr(f"w * v{i} * v{j}")).alias(f"c{i}_{j}") for i, j in pairs))
        m = m.withColumns({f"c{i}_{j}": F.expr(f"c{i}_{j} - s{i} * s{j} / n") for i, j in pairs}).withColumns({f"s{i}": F.expr(f"s{i} / n") for i in range(k)})
    else:
        m = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(f"v{i}").alias(f"s{i}") for i in range(k)), *(F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs))
        m = m.withColumns({f"c{i}_{j}": F.expr(f"c{i}_{j} * n") for i, j in pairs})
    return m.select(*keys, "n", F.array(*(f"s{i}" for i in range(k))).alias("means"), F.array(*(f"c{max(i, j)}_{min(i, j)}" for i in range(k) for j in range(k))).alias("cross"))


def fitted(columns: list[str], y: str, xs: list[str]) -> F.Column:
    """A column for rows of gram(): struct of estimates (intercept first), errors, ps, df and r2 of y on xs; all null where xs are collinear or rows too few."""
    at, mine, k = columns.index(y), [columns.index(x) for x in xs], len(columns)

    @F.pandas_udf(FIT)
    def fit(n: pd.Series, means: pd.Series, cross: pd.Series) -> pd.DataFrame:
        out = []
        for rows, m, c in zip(n, means, cross):
            m, c, df = np.array(m, float), np.array(c, float).reshape(k, k), rows - len(mine) - 1
            a, b = c[np.ix_(mine, mine)], c[mine, at]
            scale = np.sqrt(np.diag(a))
            try:
                if df <= 0 or not (scale > 0).all():
                    raise np.linalg.LinAlgError
                low = np.linalg.cholesky(a / np.outer(scale, scale))
                if (np.diag(low) < 1e-7).any():
                    raise np.linalg.LinAlgError
            except np.linalg.LinAlgError:
                out.append((None, None, None, None, None))
                continue
            inverse = np.linalg.inv(low) / scale
            inverse = inverse.T @ inverse
            slopes = inverse @ b
            left = max(0.0, c[at, at] - slopes @ b)
            s2 = left / df
            estimates = np.array([m[at] - slopes @ m[mine], *slopes])
            errors = np.sqrt(s2 * np.array([1 / rows + m[mine] @ inverse @ m[mine], *np.diag(inverse)]))
            with np.errstate(divide="ignore", invalid="ignore"):
                ps = t_two_sided(estimates / errors, df)
            out.append((estimates.tolist(), errors.tolist(), ps.tolist(), float(df), float(1 - left / c[at, at]) if c[at, at] > 0 else None))
        return pd.DataFrame(out, columns=FIT.names)

    return fit("n", "means", "cross")


def regression(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., term, estimate, se, t, df, p, r2, n) of y on xs, for each group; term is "intercept" or a name."""
    columns, keys = [y, *xs], by or []
    m = gram(df, columns, by).select(*keys, "n", fitted(columns, y, xs).alias("f"))
    terms = F.array(*(F.struct(F.lit(c).alias("term"), F.col("f.estimates")[i].alias("estimate"), F.col("f.errors")[i].alias("se"), F.col("f.ps")[i].alias("p")) for i, c in enumerate(["intercept", *xs])))
    rows = m.select(*keys, "n", "f.df", "f.r2", F.explode(terms).alias("e")).select(*keys, "e.*", "df", "r2", "n")
    return rows.select(*keys, "term", "estimate", "se", F.expr("estimate / nullif(se, 0)").alias("t"), "df", "p", "r2", F.col("n").cast("long").alias("n"))


def mediation(df: DataFrame, x: str, m: str, y: str, covariates: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n, a, b, direct, total, indirect, se, z, p) with all paths adjusted for the covariates; se and z of the indirect effect by
    Sobel's formula. One pass: the three regressions are solved from one matrix."""
    columns, keys = [x, m, y, *covariates], by or []
    g = gram(df, columns, by)
    f = g.select(*keys, "n", fitted(columns, m, [x, *covariates]).alias("fa"), fitted(columns, y, [x, m, *covariates]).alias("fb"), fitted(columns, y, [x, *covariates]).alias("ft"))
    e = f.select(*keys, F.col("n").cast("long").alias("n"), F.col("fa.estimates")[1].alias("a"), F.col("fb.estimates")[2].alias("b"), F.col("fb.estimates")[1].alias("direct"), F.col("ft.estimates")[1].alias("total"), F.col("fa.errors")[1].alias("ea"), F.col("fb.errors")[2].alias("eb"))
    e = e.withColumns({"indirect": F.expr("a * b"), "se": F.expr("sqrt(a * a * eb * eb + b * b * ea * ea)")}).withColumn("z", F.expr("indirect / nullif(se, 0)"))
    return e.select(*keys, "n", "a", "b", "direct", "total", "indirect", "se", "z", p_z("z").alias("p"))


def bootstrap_mediation(df: DataFrame, key: str, x: str, m: str, y: str, covariates: list[str], repeats: int, seed: int) -> DataFrame:
    """(rep, indirect) with the paths adjusted: in each repeat a row counts as often as a Poisson(1) draw from the hash of seed, repeat and key says.

    Rows are drawn where they are; a repeat is a sum, so that the shuffle has a row for each repeat and task.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    drawn = df.select(key, x, m, y, *covariates).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("u", u)
    drawn = drawn.withColumn("times", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON[1:]), F.when(F.col("u") >= POISSON[0], 1).otherwise(0))).filter("times > 0")
    columns = [x, m, y, *covariates]
    g = gram(drawn, columns, ["rep"], "times")
    f = g.select("rep", fitted(columns, m, [x, *covariates]).alias("fa"), fitted(columns, y, [x, m, *covariates]).alias("fb"))
    return f.select("rep", (F.col("fa.estimates")[1] * F.col("fb.estimates")[2]).alias("indirect"))


def percentile_interval(repeats: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """(repeats, low, high): the percentile interval of a bootstrap, whose repeats are few."""
    tail = (1 - level) / 2
    return repeats.agg(F.count(value).alias("repeats"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def time_pairs(wide: DataFrame, times: list[str]) -> DataFrame:
    """(first, second, n, mean, t, df, p, p_holm): paired comparisons of all pairs of columns, of rows without a null, from one matrix; Holm's p over the pairs."""
    g, k = gram(wide, times), len(times)
    pair = F.array(*(F.struct(F.lit(times[i]).alias("first"), F.lit(times[j]).alias("second"), (F.col("means")[j] - F.col("means")[i]).alias("mean"), (F.col("cross")[i * k + i] + F.col("cross")[j * k + j] - 2 * F.col("cross")[i * k + j]).alias("q")) for i in range(k) for j in range(i + 1, k)))
    rows = g.select("n", F.explode(pair).alias("e")).select("n", "e.*").selectExpr("first", "second", "cast(n as long) as n", "mean", "mean / nullif(sqrt(q / nullif(n - 1, 0) / n), 0) as t", "n - 1 as df").withColumn("p", p_t("t", "df"))
    # The pairs are as many as the columns allow: Holm's step is one over a short array.
    held = rows.agg(F.array_sort(F.collect_list(F.struct("p", "first", "second", "n", "mean", "t", "df"))).alias("r"))
    step = F.expr("transform(r, (e, i) -> struct(e.p as p, e.first as first, e.second as second, e.n as n, e.mean as mean, e.t as t, e.df as df, least(1D, array_max(transform(slice(r, 1, i + 1), (f, j) -> f.p * (size(r) - j)))) as p_holm))")
    return held.select(F.explode(step).alias("e")).select("e.first", "e.second", "e.n", "e.mean", "e.t", "e.df", "e.p", "e.p_holm")
