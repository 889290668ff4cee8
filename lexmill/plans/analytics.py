"""Operational rollups over ``events`` and account tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import exprs
from lexmill.operators import sequential
from lexmill.sources import load

DAYS = 30


def _recent(spark, d, days: int = DAYS) -> DataFrame:
    """Events of the trailing window that ends with the newest day in the data."""
    events = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = max(1, min(days, 365))
    return events.where(F.col("day") >= F.date_sub(load(spark, d, "events").agg(F.to_date(F.max("ts"))).scalar(), days - 1))


def a01_daily(spark, d):
    by = _recent(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"))
    return by.withColumn("mean", F.when(F.col("requests") > 0, exprs.rounded(F.col("total") / F.col("requests"), 1)).otherwise(0.0))


def a01_totals(spark, d):
    sums = _recent(spark, d).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.coalesce(F.max("value"), F.lit(0.0)).alias("most"), F.countDistinct("day").alias("days"))
    return sums


def a02_by_type(spark, d):
    by = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return by.orderBy(F.desc("n"), F.desc("total"), "event_type")


def a03_new_per_day(spark, d):
    return load(spark, d, "custom_dict_entries").where("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def a04_filtered_count(spark, d):
    return load(spark, d, "custom_dict_entries").agg(F.count_if(F.lower("source").isin("assistant", "manual")).alias("n"), F.count(F.lit(1)).alias("n_rows"))


def a05_unique_visitors(spark, d):
    hashed = load(spark, d, "events").where("user_id is not null").select(F.to_date("ts").alias("day"), F.sha2(F.col("user_id").cast("string"), 256).alias("visitor"))
    return hashed.groupBy("day").agg(F.countDistinct("visitor").alias("visitors"))


def b01_timings(spark, d):
    whole = F.round("value").cast("bigint")
    waits = F.col("ms") >= 1
    timed = load(spark, d, "events").select(F.to_date("ts").alias("day"), whole.alias("ms"))
    return timed.groupBy("day").agg(F.count(F.lit(1)).alias("runs"), F.sum("ms").alias("ms_total"), F.count_if(waits).alias("waits"), F.coalesce(F.max(F.when(waits, F.col("ms"))), F.lit(0)).alias("ms_most"))


def b03_limited(spark, d):
    """Events of each user admitted at most twice per hour."""
    rows = load(spark, d, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", "ts")
    return sequential.stepped(rows, ["user_id"], ["ts", "event_id"], "user_id bigint, event_id bigint, admitted boolean", sequential.limiter(2, 3600.0))


def d01_window(spark, d):
    """First and last day of the trailing window, and its events."""
    return _recent(spark, d).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def b04_evictions(spark, d):
    """Events kept in a bounded store per kind: with a time to live, a budget of bytes and the least recently used first to go."""
    rows = load(spark, d, "events").where("event_type is not null and ts is not null").select("event_type", "event_id", "ts", F.length("props").alias("size"))
    return sequential.stepped(rows, ["event_type"], ["ts", "event_id"], "event_type string, event_id bigint, n_evicted int, held int", sequential.bounded_store(200, 3600.0))


def d02_daily_counter(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))


def d03_periods(spark, d):
    rows = load(spark, d, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    return sequential.stepped(rows, ["user_id"], ["ts", "event_id"], "user_id bigint, event_id bigint, period_start timestamp_ntz, used double", sequential.rollover(7))


def d04_epochs(spark, d):
    return load(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))


def d05_safe_numbers(spark, d):
    k = F.get_json_object("props", "$.k")
    return load(spark, d, "events").select("event_id", exprs.clamp(exprs.safe_int(k), 0, 50).alias("k"))


def a20_group_stats(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("p10"), F.min("value").alias("least"))


def a21_percentiles(spark, d):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(q.alias("q")).select("day", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


def a22_weighted_mean(spark, d):
    weight = F.coalesce(F.length("props"), F.lit(0))
    sums = load(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("value") * weight).alias("wx"), F.sum(weight).alias("w"), F.avg("value").alias("plain"))
    return sums.select("event_type", F.round(F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("plain")), 6).alias("mean"))


def w06_cumulative_share(spark, d):
    counts = load(spark, d, "form_tags_flat").groupBy("db", "form_tag").agg(F.sum(F.coalesce("occurrence_count", F.lit(0))).alias("n")).where("db is not null and form_tag is not null")
    w = Window.partitionBy("db").orderBy(F.desc("n"), "form_tag")
    whole = F.sum("n").over(Window.partitionBy("db"))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("db", "form_tag", "n", F.round(100 * F.col("n") / whole, 6).alias("percent"), F.round(100 * upto / whole, 6).alias("cumulative")).where(F.col("percent").isNotNull())


def _dated(f):
    """The query with its day written as text."""

    def run(spark, d):
        df = f(spark, d)
        return df.withColumn("day", F.col("day").cast("string")) if "day" in df.columns else df

    return run


QUERIES = {f.__name__: _dated(f) for f in (a01_daily, a01_totals, a02_by_type, a03_new_per_day, a04_filtered_count, a05_unique_visitors, b01_timings, b03_limited, d01_window, b04_evictions, d02_daily_counter, d03_periods, d04_epochs, d05_safe_numbers, a20_group_stats, a21_percentiles, a22_weighted_mean, w06_cumulative_share)}

_RECENT = "with r as (select *, cast(ts as date) as day from events where cast(ts as date) >= (select cast(max(ts) as date) from events) - 29)"

_STEPS = """
        with recursive o as (select user_id, event_id, ts, coalesce(value, 0) as value, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null),"""

SQL = {
    "d01_window": "select min(cast(ts as date)) as first_seen, max(cast(ts as date)) as last_seen, count(*) as n from events where cast(ts as date) >= (select cast(max(ts) as date) - 29 from events)",
    "b03_limited": _STEPS + """
        c as (select user_id, event_id, k, true as admitted, null::timestamp as t1, ts as t2 from o where k = 1
          union all select o.user_id, o.event_id, o.k, a.ok, case when a.ok then c.t2 else c.t1 end, case when a.ok then o.ts else c.t2 end from c join o on o.user_id = c.user_id and o.k = c.k + 1,
            lateral (select c.t1 is null or epoch_us(o.ts) - epoch_us(c.t1) >= 3600000000 as ok) a)
        select user_id, event_id, admitted from c""",
    "d03_periods": _STEPS + """
        c as (select user_id, event_id, k, ts as period_start, value as used from o where k = 1
          union all select o.user_id, o.event_id, o.k, case when a.fresh then o.ts else c.period_start end, case when a.fresh then o.value else c.used + o.value end from c join o on o.user_id = c.user_id and o.k = c.k + 1,
            lateral (select epoch_us(o.ts) - epoch_us(c.period_start) >= 7 * 86400000000 as fresh) a)
        select user_id, event_id, period_start, round(used, 6) as used from c""",
    "a01_daily": _RECENT + """
        select day, count(*) as requests, count(distinct user_id) as users, round(sum(value), 4) as total, max(value) as most,
          round_even(round(sum(value), 4) / count(*), 1) as mean from r group by day""",
    "a01_totals": _RECENT + "select count(*) as requests, count(distinct user_id) as users, round(sum(value), 4) as total, max(value) as most, count(distinct day) as days from r",
    "a02_by_type": "select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1",
    "a03_new_per_day": "select cast(created_at as date) as day, count(*) as n from custom_dict_entries where created_at is not null group by 1",
    "a04_filtered_count": "select count(*) filter (where lower(source) in ('assistant', 'manual')) as n, count(*) as n_rows from custom_dict_entries",
    "a05_unique_visitors": "select cast(ts as date) as day, count(distinct sha256(cast(user_id as varchar))) as visitors from events where user_id is not null group by 1",
    "b01_timings": """
        select day, count(*) as runs, cast(sum(ms) as bigint) as ms_total, count(*) filter (where ms >= 1) as waits, coalesce(max(ms) filter (where ms >= 1), 0) as ms_most
        from (select cast(ts as date) as day, cast(round(value) as bigint) as ms from events) group by day""",
    "d02_daily_counter": "select user_id, cast(ts as date) as day, count(*) as used from events group by 1, 2",
    "d04_epochs": "select event_id, cast(floor(epoch(ts)) as bigint) as epoch from events",
    "d05_safe_numbers": "select event_id, greatest(least(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0), 50), 0) as k from events",
    "a20_group_stats": "select event_type, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_cont(value, 0.1), 6) as p10, min(value) as least from events group by 1",
    "a21_percentiles": "select cast(ts as date) as day, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "a22_weighted_mean": "select event_type, round(sum(value * coalesce(length(props), 0)) / sum(coalesce(length(props), 0)), 6) as mean from events group by 1",
    "w06_cumulative_share": """
        with c as (select db, form_tag, sum(coalesce(occurrence_count, 0)) as n from form_tags_flat where db is not null and form_tag is not null group by 1, 2)
        select db, form_tag, cast(n as bigint) as n, round(100 * n / sum(n) over (partition by db), 6) as percent,
          round(100 * sum(n) over (partition by db order by n desc, form_tag rows unbounded preceding) / sum(n) over (partition by db), 6) as cumulative from c""",
}
for _name in ("a01_daily", "a03_new_per_day", "a05_unique_visitors", "a21_percentiles", "b01_timings", "d02_daily_counter"):
    SQL[_name] = SQL[_name].replace("cast(ts as date) as day", "cast(cast(ts as date) as varchar) as day").replace("cast(created_at as date) as day", "cast(cast(created_at as date) as varchar) as day")
