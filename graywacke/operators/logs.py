"""Event logs: sessions, activity, retention, funnels, episodes and co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """One row for each session of a user: a gap of more than gap_seconds between events begins another.

    Columns: user, session_no (from 1), started, ended, n_events. Rows without a user or a time are left out. One shuffle,
    by user; a session is a run of a user's sorted events.
    """
    known = events.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, ts)
    ordered = Window.partitionBy(user).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(ordered)
    begins = F.when(gap.isNull() | (gap > F.make_dt_interval(secs=F.lit(gap_seconds))), 1).otherwise(0)
    numbered = known.withColumn("begins", begins).withColumn("session_no", F.sum("begins").over(ordered))
    return numbered.groupBy(user, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n_events"))


def totals(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Events, users-independent sums and means of a value by the keys."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def active_users(events: DataFrame, unit: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct users by calendar day, week (from Monday) or month."""
    return events.filter(F.col(user).isNotNull()).groupBy(F.to_date(F.date_trunc(unit, ts)).alias("period")).agg(F.count_distinct(user).alias("users"))


def retention(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """cohort (a user's first day), day_n, users: how many of the cohort were active n days later, and of how many."""
    days = events.select(user, F.to_date(ts).alias("day")).filter(F.col(user).isNotNull()).distinct()
    dated = days.withColumn("cohort", F.min("day").over(Window.partitionBy(user)))
    counts = dated.groupBy("cohort", F.date_diff("day", "cohort").alias("day_n")).agg(F.count(F.lit(1)).alias("users"))
    return counts.withColumn("cohort_users", F.max(F.when(F.col("day_n") == 0, F.col("users"))).over(Window.partitionBy("cohort")))


def funnel(events: DataFrame, steps: list[str], user: str = "user_id", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """step_no, step, users: users whose first event of a step comes after their time at the step before it.

    Of each step the first time after the last is a minimum over a join by user, so that no user's events meet in one row.
    """
    rows = events.filter(F.col(kind).isin(*steps) & F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("u"), F.col(ts).alias("t"), F.col(kind).alias("kind"))
    reached, counts = None, []
    for i, step in enumerate(steps):
        of_step = rows.filter(F.col("kind") == step)
        if reached is not None:
            of_step = of_step.join(reached, "u").filter(F.col("t") > F.col("reached"))
        reached = of_step.groupBy("u").agg(F.min("t").alias("reached"))
        counts.append(reached.agg(F.count(F.lit(1)).alias("users")).select(F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"), "users"))
    return reduce(DataFrame.unionByName, counts)


def episodes(levels: DataFrame, threshold: float, key: str, ts: str = "ts", level: str = "level_db", gap_seconds: int = 1800) -> DataFrame:
    """Runs of rows at or above a threshold, parted by gaps; see sessions()."""
    return sessions(levels.filter(F.col(level) >= threshold), key, ts, gap_seconds)


def randomised(rows: DataFrame, seed: int, *ids: str) -> DataFrame:
    """rows with draw (0 to 1, from the hash of seed and ids, the same in every run and partitioning) and arm."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ids])
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("draw", draw).withColumn("arm", F.when(F.col("draw") < 0.5, "treated").otherwise("control"))


def overlap_seconds(start_a: str, end_a: str, start_b: str, end_b: str) -> Column:
    """How long two intervals overlap."""
    return F.greatest(F.lit(0), F.unix_seconds(F.least(F.col(end_a), F.col(end_b)).cast("timestamp")) - F.unix_seconds(F.greatest(F.col(start_a), F.col(start_b)).cast("timestamp")))


def count_ahead(events: DataFrame, key: str, ts: str = "ts", seconds: int = 180) -> DataFrame:
    """events with n_ahead: rows of the key from this row's time on, within the seconds after it."""
    ahead = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(0, seconds)
    return events.withColumn("n_ahead", F.count(F.lit(1)).over(ahead))


def silences(levels: DataFrame, key: str, ts: str, level: str, gap_seconds: int, same_rows: int) -> DataFrame:
    """Rows after a gap, or that end a run of same_rows equal levels: a source that has died."""
    order = Window.partitionBy(key).orderBy(ts)
    recent = order.rowsBetween(1 - same_rows, 0)
    gap = F.col(ts) - F.lag(ts).over(order) > F.make_dt_interval(secs=F.lit(gap_seconds))
    constant = (F.count(level).over(recent) == same_rows) & (F.min(level).over(recent) == F.max(level).over(recent))
    return levels.withColumns({"after_gap": F.coalesce(gap, F.lit(False)), "constant": constant}).filter("after_gap or constant")


def lift(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """Pairs of items that share baskets: n_a, n_b, n_ab and lift, n_ab * N / (n_a * n_b).

    The self-join is by basket; a basket should be short, as an article's subjects or an order's brands are.
    """
    rows = baskets.select(basket, item).dropna().distinct()
    n = rows.select(basket).distinct().agg(F.count(F.lit(1)).alias("n_baskets"))
    each = rows.groupBy(item).agg(F.count(F.lit(1)).alias("k"))
    pairs = rows.toDF("k0", "a").join(rows.toDF("k0", "b"), "k0").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    named = pairs.join(each.toDF("a", "n_a"), "a").join(each.toDF("b", "n_b"), "b").crossJoin(F.broadcast(n))
    return named.withColumn("lift", F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")))
