"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.plans.registry import query
from veridelta.session import read
from veridelta.streaming import daily


@query("""select cast(date_trunc('day', ts) as date) "day", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, as the stream leaves them at its end."""
    out = daily.replay(spark, daily.daily_counts(daily.event_stream(spark, sf_dir)), "complete")
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select user_id, event_type, count(*) n from (select distinct event_id, user_id, event_type from events) group by 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted once an id, as the stream leaves them."""
    out = daily.replay(spark, daily.dedup(daily.event_stream(spark, sf_dir), ["event_id"]).select("event_id", "user_id", "event_type"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end s from events), g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, count(distinct k) sessions, count(*) events from g group by 1""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of six hours, by the session window."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
