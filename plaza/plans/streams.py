"""Streams over the action log, and state as a fold of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.operators.rank import top_per_group
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table
from plaza.streaming import events as E

#: Timed events: name, first step, steps, archetype, strength.
TIMED = [("launch", 3, 4, "all", 0.5), ("outage", 6, 2, "misinfo", 1.0), ("election", 10, 8, "conspiracy", 0.75), ("holiday", 12, 3, "all", 0.25)]
_TIMED = "tm(name, first, steps, archetype, strength) AS (VALUES " + ", ".join(f"('{n}', {a}, {s}, '{t}', {w})" for n, a, s, t, w in TIMED) + ")"


def timed(spark: SparkSession) -> DataFrame:
    """TIMED as a table."""
    return spark.createDataFrame(TIMED, "name string, first int, steps int, archetype string, strength double")


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("stream_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
    def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.tumbling(spark, sf_dir).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"))

    @reg.add("stream_sliding", "WITH w AS (SELECT unnest([0, 1]) AS k), t AS (SELECT make_timestamp((epoch_us(ts) // 1800000000 - k) * 1800000000) AS window_start, value FROM events, w) SELECT window_start, count(*) AS n, count(*) FILTER (WHERE value > 95) AS errors FROM t GROUP BY 1")
    def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.sliding(spark, sf_dir).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "errors")

    @reg.add("stream_last_action", "SELECT user_id, last_event, last_type, n FROM (SELECT user_id, event_id AS last_event, event_type AS last_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
    def stream_last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.last_action(spark, sf_dir)

    @reg.add("follow_state", with_sql("f", "a AS (SELECT follower_id, followee_id, count(*) AS n, min(created_at) AS since FROM f WHERE followee_id IS NOT NULL AND follower_id <> followee_id GROUP BY ALL)") + "SELECT follower_id, followee_id, since, n - 1 AS rejected FROM a")
    def follow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = rows(spark, sf_dir, "f").filter("followee_id IS NOT NULL AND follower_id <> followee_id").groupBy("follower_id", "followee_id").agg(F.count("*").alias("n"), F.min("created_at").alias("since"))
        return a.select("follower_id", "followee_id", "since", (F.col("n") - 1).alias("rejected"))

    @reg.add("like_counters", with_sql("l", "a AS (SELECT DISTINCT user_id, post_id FROM l WHERE post_id IS NOT NULL)") + "SELECT post_id, count(*) AS num_likes FROM a GROUP BY post_id")
    def like_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "l").filter("post_id IS NOT NULL").select("user_id", "post_id").distinct().groupBy("post_id").agg(F.count("*").alias("num_likes"))

    @reg.add("timed_events_active", f"WITH {_TIMED}, s AS (SELECT name, archetype, strength, unnest(range(first, first + steps)) AS step FROM tm) SELECT CAST(step AS INTEGER) AS step, archetype, round(CAST(sum(strength) AS DOUBLE), 6) AS total, CAST(max(strength) AS DOUBLE) AS strongest, string_agg(name, ',' ORDER BY name) AS names FROM s GROUP BY ALL")
    def timed_events_active(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = timed(spark).select("name", "archetype", "strength", F.explode(F.sequence("first", F.col("first") + F.col("steps") - 1)).alias("step"))
        return s.groupBy("step", "archetype").agg(F.round(F.sum("strength"), 6).alias("total"), F.max("strength").cast("double").alias("strongest"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))

    @reg.add("timed_events_upcoming", f"WITH {_TIMED} SELECT name, first FROM tm WHERE first > 5 AND first <= 10")
    def timed_events_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
        return timed(spark).filter("first > 5 AND first <= 10").select("name", "first")

    @reg.add("recent_buffer", "SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
    def recent_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
        return top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "rank")

    @reg.add("sessions", "WITH t AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
    def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
        return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")
