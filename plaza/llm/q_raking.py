"""Problem 5: samples of post_record and persona_config with the shares of label_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.raking import Sample
from plaza.registry import Registry
from plaza.sources.tables import table

_LABELS = """
labels AS (
  SELECT DISTINCT 'post_record' AS scope, post_id AS id, category_labels[1] AS label FROM post_record
  UNION SELECT 'persona_config', persona_id, primary_label FROM persona_config),
available AS (
  SELECT scope, replace(replace(lower(trim(label)), '-', '_'), ' ', '_') AS category, count(DISTINCT id) AS n
  FROM labels WHERE trim(label) <> '' GROUP BY ALL)"""

FOUND_SQL = f"""WITH {_LABELS}
SELECT DISTINCT t.scope, t.category FROM label_targets t LEFT JOIN available a ON t.scope = a.scope AND t.category = a.category
WHERE coalesce(a.n, 0) < greatest(t.min_count, floor(t.target_pct * t.sample_size / 100.0))"""


COUNTS_SQL = f"""WITH {_LABELS}
SELECT DISTINCT t.scope, t.category, t.target_pct, CAST(greatest(t.min_count, floor(t.target_pct * t.sample_size / 100.0)) AS BIGINT) AS need,
  coalesce(a.n, 0) AS available, greatest(0, CAST(greatest(t.min_count, floor(t.target_pct * t.sample_size / 100.0)) AS BIGINT) - coalesce(a.n, 0)) AS shortfall
FROM label_targets t LEFT JOIN available a ON t.scope = a.scope AND t.category = a.category"""


def sample(spark: SparkSession, sf_dir: str) -> Sample:
    """Both samples; the second margin is the split, or the cap of the label mode."""
    posts = table(spark, sf_dir, "post_record").select(F.lit("post_record").alias("scope"), F.col("post_id").alias("id"), F.get("category_labels", F.lit(0)).alias("category"), F.col("split").alias("level"))
    personas = table(spark, sf_dir, "persona_config").select(F.lit("persona_config").alias("scope"), F.col("persona_id").alias("id"), F.col("primary_label").alias("category"), F.col("label_mode_cap").alias("level"))
    return Sample(posts.unionByName(personas), table(spark, sf_dir, "label_targets"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p5_found", FOUND_SQL)
    def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sample(spark, sf_dir).report().filter("shortfall > 0").select("scope", "category").distinct()

    @reg.add("p5_sample")
    def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sample(spark, sf_dir).chosen

    @reg.add("p5_report")
    def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sample(spark, sf_dir).report()

    @reg.add("p5_shortfalls", COUNTS_SQL)
    def p5_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sample(spark, sf_dir).report().select("scope", "category", "target_pct", "need", "available", "shortfall")
