"""Structured Streaming over the action log.

Each function runs a stream over a directory or file of Parquet to its end
(``availableNow``) and returns the last state of its result as a table of the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.lineage import drop_path, scratch_path
from plaza.operators.rank import grouped_rank
from plaza.sources.tables import table

#: How late an event may be and still count in its window.
LATENESS = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its schema is read from the table."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run an aggregating stream over all input there is; its last result."""
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
        .start()
    )
    query.awaitTermination()
    drop_path(spark, state)
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, mean) per tumbling window."""
    s = event_stream(spark, sf_dir).withWatermark("ts", LATENESS)
    agg = s.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return finished(spark, agg.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean"), "tumbling")


def sliding(spark: SparkSession, sf_dir: str, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """(window_start, n, errors) per sliding window."""
    s = event_stream(spark, sf_dir).withWatermark("ts", LATENESS)
    agg = s.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 95, 1)).alias("errors"))
    return finished(spark, agg.select(F.col("window.start").alias("window_start"), "n", "errors"), "sliding")


def last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, last_event, last_type, n): the state of each user as a fold of the log."""
    s = event_stream(spark, sf_dir)
    agg = s.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n"))
    return finished(spark, agg.select("user_id", F.col("last.event_id").alias("last_event"), F.col("last.event_type").alias("last_type"), "n"), "last")


def dispatch(spark: SparkSession, stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], key: str, checkpoint: str) -> None:
    """Give each micro-batch's rows to the handler of their action."""

    def each(df: DataFrame, _: int) -> None:
        df.persist()
        for name, handle in handlers.items():
            handle(df.filter(F.col(key) == name))
        df.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def poll(table_: DataFrame, since: int | None, key: str = "id", most: int | None = None) -> tuple[DataFrame, int | None]:
    """Rows of ``table_`` above ``since`` in order of ``key``, at most ``most``, and the greatest key of them to poll from next.

    Without new rows ``since`` stays as it is; null keys are never returned.
    """
    new = table_.filter(F.col(key).isNotNull() if since is None else F.col(key) > since).orderBy(key)
    if most is not None:
        new = new.limit(most)
    top = new.agg(F.max(key)).first()[0]
    return new, since if top is None else top


def active_events(events: DataFrame, step: int, most: int = 3) -> DataFrame:
    """(topic, strength, ends) of the coordinated events in force at ``step``.

    ``events`` is (topic, starts, lasts, strength).  Events of one topic that
    overlap at the step are one, of the greatest strength and the latest end;
    expired ones are left out; of the others the ``most`` strongest stay, ties
    by topic.
    """
    now = events.withColumn("ends", F.col("starts") + F.col("lasts")).filter((F.col("starts") <= step) & (F.col("ends") > step))
    merged = now.groupBy("topic").agg(F.max("strength").alias("strength"), F.max("ends").alias("ends"))
    return merged.orderBy(F.desc("strength"), "topic").limit(most)


def percentiles_every(rows: DataFrame, order: str, value: str, every: int = 100) -> DataFrame:
    """(upto, p50, p95): exact percentiles of ``value`` over each full run of ``every`` rows by ``order``, refreshed when it is complete."""
    ranked = grouped_rank(rows.select(order, value).dropna().withColumn("_one", F.lit(0)), ["_one"], [F.col(order).asc(), F.col(value).asc()], "_k")
    run = ranked.groupBy(((F.floor(F.col("_k") / every) + 1) * every).alias("upto"))
    got = run.agg(F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.count(F.lit(1)).alias("_n"))
    return got.filter(F.col("_n") == every).drop("_n")
