"""Ordered computations: numbering, spreading, running values and gaps.

Groups of any size are numbered and summed through ``grouped_rank``; only
windows over already aggregated values run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.operators.rank import grouped_rank, top_per_group
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table


def micros(c):
    """Microseconds of a time without zone."""
    return F.unix_micros(c.cast("timestamp"))


def moment(c):
    """A time without zone from microseconds."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("row_numbers", with_sql("p") + "SELECT post_id, row_number() OVER (ORDER BY created_at NULLS LAST, post_id) AS row_num, count(*) OVER () AS total FROM p")
    def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").select("post_id", "created_at", F.lit(0).alias("one"))
        total = p.agg(F.count("*").alias("total"))
        ranked = grouped_rank(p, ["one"], [F.col("created_at").asc_nulls_last(), F.col("post_id").asc()])
        return ranked.join(F.broadcast(total)).select("post_id", (F.col("rank") + 1).alias("row_num"), "total")

    @reg.add("spread_timestamps", with_sql("p", "t AS (SELECT post_id, row_number() OVER (ORDER BY created_at NULLS LAST, post_id) AS k, count(*) OVER () AS n FROM p)") + "SELECT post_id, TIMESTAMP '2025-01-01' + to_microseconds(k * 604800000000 // greatest(n, 1)) AS new_ts FROM t")
    def spread_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").select("post_id", "created_at", F.lit(0).alias("one"))
        total = p.agg(F.count("*").alias("n"))
        ranked = grouped_rank(p, ["one"], [F.col("created_at").asc_nulls_last(), F.col("post_id").asc()], "k").join(F.broadcast(total))
        return ranked.select("post_id", moment(F.lit(1735689600000000) + F.expr("(k + 1) * 604800000000 div greatest(n, 1)")).alias("new_ts"))

    @reg.add("step_offsets", with_sql("p", "t AS (SELECT post_id, CAST(created_at AS DATE) AS step FROM p WHERE created_at IS NOT NULL)") + "SELECT post_id, CAST(step AS TIMESTAMP) + to_seconds(30 * (row_number() OVER (PARTITION BY step ORDER BY CAST(post_id AS VARCHAR)) - 1)) AS new_ts FROM t")
    def step_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").filter("created_at IS NOT NULL").select("post_id", F.to_date("created_at").alias("step"))
        k = grouped_rank(p, ["step"], [F.col("post_id").cast("string").asc()], "k")
        return k.select("post_id", moment(micros(F.col("step").cast("timestamp_ntz")) + F.col("k") * 30_000_000).alias("new_ts"))

    @reg.add("backdate", with_sql("p", "m AS (SELECT max(created_at) AS top FROM p)") + "SELECT post_id, CASE WHEN created_at >= top - INTERVAL 2 DAYS THEN created_at - INTERVAL 7 DAYS ELSE created_at END AS new_ts FROM p, m")
    def backdate(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = table(spark, sf_dir, "post").agg(F.max("created_at").alias("top"))
        p = rows(spark, sf_dir, "p").join(F.broadcast(top))
        return p.select("post_id", F.expr("CASE WHEN created_at >= top - INTERVAL 2 DAYS THEN created_at - INTERVAL 7 DAYS ELSE created_at END").alias("new_ts"))

    @reg.add("running_index", with_sql("c") + "SELECT comment_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at NULLS LAST, comment_id) - 1 AS user_index FROM c")
    def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rows(spark, sf_dir, "c").select("comment_id", "user_id", "created_at")
        return grouped_rank(c, ["user_id"], [F.col("created_at").asc_nulls_last(), F.col("comment_id").asc()], "user_index").select("comment_id", "user_index")

    @reg.add("running_history", with_sql("c", "t AS (SELECT comment_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY comment_id) AS k FROM c)") + "SELECT a.comment_id, string_agg(CAST(b.comment_id AS VARCHAR), ',' ORDER BY b.k) AS previous FROM t a JOIN t b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 3 AND a.k - 1 GROUP BY a.comment_id")
    def running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The last three before each row: every row is sent to its three successors, so no history is gathered whole.
        c = grouped_rank(rows(spark, sf_dir, "c").select("comment_id", "user_id"), ["user_id"], [F.col("comment_id").asc()], "k")
        sent = c.select("user_id", F.col("comment_id").alias("prev"), F.col("k").alias("at"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + 3)).alias("k"))
        both = c.join(sent, ["user_id", "k"]).groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("at", "prev"))).alias("h"))
        return both.select("comment_id", F.array_join(F.transform("h", lambda x: x["prev"].cast("string")), ",").alias("previous"))

    @reg.add("running_clock", with_sql("c") + "SELECT comment_id, CAST(sum(1 + comment_id % 7) OVER (PARTITION BY user_id ORDER BY comment_id) AS BIGINT) AS clock FROM c")
    def running_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rows(spark, sf_dir, "c").select("comment_id", "user_id", (1 + F.col("comment_id") % 7).alias("minutes"))
        return grouped_rank(c, ["user_id"], [F.col("comment_id").asc()], "k", {"clock": "minutes"}).select("comment_id", F.col("clock").cast("long").alias("clock"))

    @reg.add("thread_chunks", with_sql("r", "t AS (SELECT post_id, row_number() OVER (ORDER BY post_id) - 1 AS k FROM r)") + "SELECT post_id, k // 4 AS chunk FROM t")
    def thread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = rows(spark, sf_dir, "r").select("post_id", F.lit(0).alias("one"))
        return grouped_rank(r, ["one"], [F.col("post_id").asc()], "k").select("post_id", F.expr("k div 4").alias("chunk"))

    @reg.add("degree_ccdf", with_sql("f", "d AS (SELECT followee_id, count(*) AS k FROM f WHERE followee_id IS NOT NULL GROUP BY 1)", "h AS (SELECT k, count(*) AS n FROM d GROUP BY k)") + "SELECT k, round(sum(n) OVER (ORDER BY k DESC) * 1.0 / sum(n) OVER (), 6) AS ccdf FROM h")
    def degree_ccdf(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = rows(spark, sf_dir, "f").filter("followee_id IS NOT NULL").groupBy("followee_id").agg(F.count("*").alias("k"))
        h = d.groupBy("k").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
        return h.select("k", F.round(above / F.sum("n").over(Window.partitionBy()), 6).alias("ccdf"))

    @reg.add("padded_series", "WITH h AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h) + 5)) AS hour) SELECT s.hour, last_value(h.n IGNORE NULLS) OVER (ORDER BY s.hour) AS n FROM s LEFT JOIN h ON s.hour = h.hour")
    def padded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
        hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long")
        h = table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
        spine = h.agg(F.explode(F.sequence(F.min("hour"), F.max("hour") + 5)).alias("hour"))
        w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
        return spine.join(h, "hour", "left").select("hour", F.last("n", ignorenulls=True).over(w).alias("n"))

    @reg.add("last_likes", with_sql("l") + "SELECT user_id, CAST(rank AS INTEGER) AS rank, post_id FROM (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, like_id DESC) AS rank FROM l WHERE post_id IS NOT NULL) WHERE rank <= 5")
    def last_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
        likes = rows(spark, sf_dir, "l").filter("post_id IS NOT NULL")
        return top_per_group(likes, ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("like_id").desc()], 5).select("user_id", "rank", "post_id")

    @reg.add("last_posts_ascending", with_sql("p") + "SELECT post_id FROM (SELECT post_id FROM p ORDER BY post_id DESC LIMIT 20) ORDER BY post_id")
    def last_posts_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id").orderBy(F.desc("post_id")).limit(20).orderBy("post_id")

    @reg.add("upload_order", with_sql("r") + "SELECT post_id, row_number() OVER (PARTITION BY split ORDER BY parent_id IS NOT NULL, post_id) - 1 AS position FROM r")
    def upload_order(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = rows(spark, sf_dir, "r").select("post_id", "split", F.col("parent_id").isNotNull().alias("reply"))
        return grouped_rank(r, ["split"], [F.col("reply").asc(), F.col("post_id").asc()], "position").select("post_id", "position")
