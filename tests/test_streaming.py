import datetime as dt

import pytest
from pyspark.sql import functions as F

from veridelta.streaming import daily


@pytest.fixture
def folder(spark, tmp_path):
    """Three files in order of arrival; the last holds a row days too late and a repeated id."""
    def put(name, rows):
        df = spark.createDataFrame([(i, dt.datetime(2024, 1, d, h), 1, "view", 1.0, "{}") for i, d, h in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    put("a", [(1, 1, 1), (2, 1, 5)])
    put("b", [(3, 9, 1), (3, 9, 1)])
    put("c", [(4, 1, 9), (5, 20, 1)])
    return str(tmp_path)


def test_counts_in_complete_mode_hold_everything(spark, folder):
    out = daily.replay(spark, daily.daily_counts(daily.event_stream(spark, folder)), "complete")
    assert {(r.w.start.day, r.n) for r in out.collect()} == {(1, 3), (9, 2), (20, 1)}


def test_append_drops_what_comes_behind_the_watermark(spark, folder):
    out = daily.replay(spark, daily.daily_counts(daily.event_stream(spark, folder, files_per_trigger=1), "2 days"), "append")
    got = {r.w.start.day: r.n for r in out.collect()}
    assert got[1] == 2 or got[1] == 3  # files of one second may come in either order
    assert 20 not in got


def test_dedup(spark, folder):
    s = daily.dedup(daily.event_stream(spark, folder), ["event_id"], "40 days").select("event_id")
    assert sorted(r.event_id for r in daily.replay(spark, s).collect()) == [1, 2, 3, 4, 5]


def test_sessions_close_behind_the_watermark(spark, folder):
    out = daily.replay(spark, daily.sessions(daily.event_stream(spark, folder), "6 hours", "1 day"), "append")
    assert {(r.w.start.day, r.n) for r in out.collect()} >= {(9, 2)}


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    out = daily.replay(spark, daily.daily_counts(daily.event_stream(spark, str(tmp_path))), "append")
    assert out.count() == 0
