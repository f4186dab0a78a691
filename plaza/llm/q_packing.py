"""Problem 8: documents in containers of the capacities of pack_specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.packing import pack
from plaza.llm.tokenizer import token_lengths
from plaza.registry import Registry
from plaza.sources.tables import table

#: Capacities one run may have.
MAX_CAPACITIES = 1000


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    specs = table(spark, sf_dir, "pack_specs")
    caps = [r.c for r in specs.select(F.col("capacity_tokens").alias("c")).filter("c > 0").distinct().limit(MAX_CAPACITIES + 1).collect()]
    if len(caps) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    return pack(token_lengths(table(spark, sf_dir, "documents"), ["doc_id"], "text", name="length"), "doc_id", caps)


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p8_packing")
    def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packed(spark, sf_dir)

    @reg.add("p8_report")
    def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        boxes = packed(spark, sf_dir).groupBy("capacity", "step", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
        steps = boxes.groupBy("capacity", "step").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("used").alias("used"))
        fill = lambda used, c: F.round(used / (c * F.col("capacity")), 6)
        steps = steps.withColumn("fill", fill(F.col("used"), F.col("c")))
        return steps.groupBy("capacity").agg(
            F.sum("c").alias("n_containers"),
            F.sum("n").alias("n_pieces"),
            F.sum("used").alias("tokens"),
            F.round(F.sum("used") / (F.sum("c") * F.col("capacity")), 6).alias("fill"),
            F.count(F.lit(1)).alias("n_steps"),
            F.min("fill").alias("least_step_fill"),
            F.max("fill").alias("most_step_fill"),
        )
