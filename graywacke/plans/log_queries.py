"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import episodes, logs
from graywacke.plans.registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "lg03_sessions",
    """
    with marked as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as begins from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)),
    numbered as (select *, sum(begins) over (partition by user_id order by ts) as session_no from marked)
    select user_id, session_no::bigint as session_no, min(ts) as started, max(ts) as ended, count(*) as n_events from numbered group by all""",
)
def lg03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sessions(_table(spark, sf_dir, "events"))


@register("agg02_totals", "select user_id, event_type, count(*) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean from events group by 1, 2")
def agg02_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.totals(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")
    return rows.withColumns({c: F.round(c, 6) for c in ("total", "mean")})


@register("agg03_active_users", " union all ".join(f"select '{u}' as unit, date_trunc('{u}', ts)::date as period, count(distinct user_id) as users from events where user_id is not null group by 2" for u in ("day", "week", "month")))
def agg03_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    parts = [logs.active_users(events, u).select(F.lit(u).alias("unit"), "period", "users") for u in ("day", "week", "month")]
    return parts[0].union(parts[1]).union(parts[2])


@register("lg05_retention", """with d as (select distinct user_id, ts::date as day from events where user_id is not null), c as (select *, min(day) over (partition by user_id) as cohort from d),
    n as (select cohort, (day - cohort)::int as day_n, count(*) as users from c group by 1, 2) select *, max(users) filter (day_n = 0) over (partition by cohort) as cohort_users from n""")
def lg05_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.retention(_table(spark, sf_dir, "events"))


@register("lg04_funnel", """with a as (select user_id, min(ts) as t from events where event_type = 'view' group by 1), b as (select user_id, min(e.ts) as t from events e join a using (user_id) where event_type = 'click' and e.ts > a.t group by 1),
    c as (select user_id, min(e.ts) as t from events e join b using (user_id) where event_type = 'purchase' and e.ts > b.t group by 1)
    select 1 as step_no, 'view' as step, count(*) as users from a union all select 2, 'click', count(*) from b union all select 3, 'purchase', count(*) from c""")
def lg04_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.funnel(_table(spark, sf_dir, "events"), ["view", "click", "purchase"])


@register("lg09_randomised", "with d as (select event_id, ('0x' || substr(md5('42|' || event_id), 1, 8))::bigint / 2 ** 32 as draw from events) select event_id, draw, case when draw < 0.5 then 'treated' else 'control' end as arm from d")
def lg09_randomised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.randomised(_table(spark, sf_dir, "events").select("event_id"), 42, "event_id")


@register("agg19_count_ahead", "select event_id, count(*) over (partition by user_id order by floor(epoch(ts)) range between current row and 86400 following) as n_ahead from events")
def agg19_count_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.count_ahead(_table(spark, sf_dir, "events"), "user_id", seconds=86400).select("event_id", "n_ahead")


@register("lg06_lift", """with r as (select distinct l_orderkey as k, p_brand as i from lineitem join part on p_partkey = l_partkey), n as (select count(distinct k) as n_baskets from r), e as (select i, count(*) as c from r group by 1),
    p as (select x.i as a, y.i as b, count(*) as n_ab from r x join r y on x.k = y.k and x.i < y.i group by 1, 2)
    select a, b, n_ab, ea.c as n_a, eb.c as n_b, n_baskets, round(n_ab * n_baskets / (ea.c::double * eb.c), 6) as lift from p join e ea on ea.i = a join e eb on eb.i = b, n""")
def lg06_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand")
    return logs.lift(rows, "l_orderkey", "p_brand").withColumn("lift", F.round("lift", 6))


@register("lg11_modes", """with recursive e as (select event_type as key, epoch_us(ts) as us from events where ts is not null and event_type is not null), n as (select *, row_number() over (partition by key order by us) as i from e),
    w as (select key, i, us, us as started from n where i = 1 union all select n.key, n.i, n.us, case when n.us >= w.started + 3600000000 then n.us else w.started end from w join n on n.key = w.key and n.i = w.i + 1),
    f as (select key, started, count(*) as n_events from w group by 1, 2), d as (select *, ('0x' || substr(md5('5|' || key || '|' || started), 1, 8))::bigint / 4294967296.0 as draw from f), m as (select unnest(['observe', 'always', 'randomised']) as mode)
    select mode, key, make_timestamp(started) as started, n_events, draw, case when mode = 'always' or mode = 'randomised' and draw < 0.5 then 'treated' else 'control' end as arm, mode = 'always' or mode = 'randomised' and draw < 0.5 as played from d, m""")
def lg11_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = [episodes.episodes(events, "event_type", "ts", mode, 5, 3600).withColumn("mode", F.lit(mode)) for mode in episodes.MODES]
    return found[0].union(found[1]).union(found[2]).withColumn("started", F.col("started").cast("timestamp_ntz"))
