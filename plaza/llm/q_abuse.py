"""Problem 1: abusive language in posts, comments, post records and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.abuse import THRESHOLD, fit, heldout, score
from plaza.llm.q_residue import source_name
from plaza.registry import Registry
from plaza.sources.tables import table

TEXTS = [("post", "post_id", "content"), ("post_comment", "comment_id", "content"), ("post_record", "post_id", "text"), ("documents", "doc_id", "text")]

#: Words the list may have.
MAX_TERMS = 100_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, text) of the four tables."""
    out = None
    for name, key, text in TEXTS:
        part = table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def fitted(spark: SparkSession, sf_dir: str):
    """The records and what was learnt from them."""
    rows = records(spark, sf_dir)
    return rows, fit(rows, table(spark, sf_dir, "abuse_labels"), listed_terms(spark, sf_dir))


def listed_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    """The words of the list, an error if there are more than MAX_TERMS."""
    terms = [r.term for r in table(spark, sf_dir, "abuse_terms").select("term").filter("term IS NOT NULL").distinct().orderBy("term").limit(MAX_TERMS + 1).collect()]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return terms


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p1_found")
    def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, (linear, lex, _, _) = fitted(spark, sf_dir)
        return score(rows, linear, lex).filter(F.col("score") >= THRESHOLD).select("record_table", "record_id").distinct()

    @reg.add("p1_scores")
    def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, (linear, lex, _, _) = fitted(spark, sf_dir)
        return score(rows, linear, lex).groupBy("record_table", "record_id").agg(F.round(F.max("score"), 6).alias("score"))

    @reg.add("p1_rates")
    def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, (linear, lex, _, _) = fitted(spark, sf_dir)
        worst = score(rows, linear, lex).groupBy("record_table", "record_id").agg(F.max("score").alias("score"))
        docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_id"), source_name(F.col("source")).alias("source"))
        named = worst.join(docs, ["record_table", "record_id"], "left").withColumn("source", F.coalesce("source", "record_table"))
        n = F.count(F.when(F.col("score") >= THRESHOLD, 1))
        return named.groupBy("record_table", "source").agg(F.count(F.lit(1)).alias("n_records"), n.alias("n_abusive"), F.round(n / F.count(F.lit(1)), 6).alias("rate"))

    @reg.add("p1_voters")
    def p1_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, (_, _, model, (patterns, counts)) = fitted(spark, sf_dir)
        rows = [(a, int(n), round(x, 6)) for a, n, x in model.accuracy(patterns, counts)]
        return spark.createDataFrame(rows, "voter string, n_passages long, accuracy double")

    @reg.add("p1_heldout")
    def p1_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
        return heldout(records(spark, sf_dir), table(spark, sf_dir, "abuse_labels"), listed_terms(spark, sf_dir))
