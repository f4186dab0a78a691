"""Problem 10: documents that are template residue, filler or error pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.residue import residue
from plaza.registry import Registry
from plaza.sources.tables import table


def source_name(c):
    """A source in one spelling; null and blank become ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_"), F.lit("")), F.lit("unknown"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p10_found")
    def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        return residue(docs, "doc_id", "text").filter("is_residue").select("doc_id").distinct()

    @reg.add("p10_kept")
    def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        return residue(docs, "doc_id", "text").filter("NOT is_residue").select("doc_id").distinct()

    @reg.add("p10_report")
    def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        rows = residue(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
        n = F.count(F.when(F.col("is_residue"), 1))
        return rows.groupBy(source_name(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_residue"), F.round(n / F.count(F.lit(1)), 6).alias("rate"))
