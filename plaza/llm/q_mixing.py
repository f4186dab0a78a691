"""Problem 9: documents mixed to the weights of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.mixing import Mixture
from plaza.llm.tokenizer import token_lengths
from plaza.registry import Registry
from plaza.sources.tables import table


def mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    """The mixture of all documents."""
    docs = token_lengths(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return Mixture(docs.select(F.col("doc_id").alias("id"), "source", "tokens"), table(spark, sf_dir, "mix_targets"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p9_mixture")
    def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mixture(spark, sf_dir).items.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")

    @reg.add("p9_shares")
    def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mixture(spark, sf_dir).report()
