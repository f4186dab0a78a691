"""Splits, samples, quotas and label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaza.functions.hashing import hash_order
from plaza.operators.rank import grouped_rank


def clean_labels(c: Column) -> Column:
    """Labels in one spelling; null is no label."""
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.translate(F.lower(F.trim(x)), "- ", "__"))


def share(n: Column, total: Column) -> Column:
    """A ratio to six places, 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(n, total), F.lit(0.0)), 6)


def split(df: DataFrame, key: str, strata: list[str], seed: str, cuts: list[tuple[str, int]]) -> DataFrame:
    """``df`` with ``split``: within each stratum, rows in hash order are cut at whole percents; the last name takes the rest."""
    rows = df.withColumn("_h", hash_order(seed, F.col(key)))
    n = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    ranked = grouped_rank(rows, strata, [F.col("_h").asc(), F.col(key).asc()], "_k").join(n, strata)
    out = F.lit(cuts[-1][0])
    for name, upto in reversed(cuts[:-1]):
        out = F.when(F.col("_k") < F.expr(f"_n * {upto} div 100"), name).otherwise(out)
    return ranked.withColumn("split", out).drop("_h", "_k", "_n")


def balanced(df: DataFrame, key: str, group: str, seed: str) -> DataFrame:
    """As many rows of every group as the smallest has, in hash order."""
    rows = df.withColumn("_h", hash_order(seed, F.col(key)))
    least = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("_m"))
    ranked = grouped_rank(rows, [group], [F.col("_h").asc(), F.col(key).asc()], "_k")
    return ranked.join(F.broadcast(least)).filter("_k < _m").drop("_h", "_k", "_m")


def apportion(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, n): ``total`` shared out by ``weight``, the largest remainders rounded up; a table of few rows."""
    whole = F.sum(weight).over(Window.partitionBy())
    x = df.select(key, (F.col(weight) / whole * total).alias("_want"))
    x = x.select(key, F.floor(F.col("_want") + 1e-9).alias("_base"), F.round(F.col("_want") - F.floor(F.col("_want") + 1e-9), 9).alias("_rest"))
    y = x.withColumns({"_k": F.row_number().over(Window.orderBy(F.desc("_rest"), key)), "_left": total - F.sum("_base").over(Window.partitionBy())})
    return y.select(key, (F.col("_base") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).alias("n"))


def class_metrics(df: DataFrame) -> DataFrame:
    """(class, support, f1) of rows (truth, guess); classes are those of either side.

    Each pair of classes counts for its true and for its guessed class, where a
    join would meet every class with every row.
    """
    zero = F.lit(0).cast("long")
    pairs = df.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    as_truth = F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), zero.alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"))
    as_guess = F.struct(F.col("guess").alias("class"), zero.alias("t"), F.col("n").alias("g"), zero.alias("tp"))
    sides = pairs.select(F.inline(F.array(as_truth, as_guess)))
    return sides.groupBy("class").agg(F.sum("t").alias("support"), share(2 * F.sum("tp"), F.sum("t") + F.sum("g")).alias("f1"))


def multilabel_rate(df: DataFrame, labels: str) -> DataFrame:
    """(harmful, multi, rate, benign_only): records with a label other than ``benign``, with two, their ratio, and benign singletons."""
    t = df.select(clean_labels(F.col(labels)).alias("labels"))
    t = t.withColumn("harm", F.size(F.filter("labels", lambda x: x != "benign")))
    n = lambda c: F.count(F.when(c, 1))
    return t.agg(
        n(F.col("harm") > 0).alias("harmful"), n(F.col("harm") > 1).alias("multi"), share(n(F.col("harm") > 1), n(F.col("harm") > 0)).alias("rate"), n(F.col("labels") == F.array(F.lit("benign"))).alias("benign_only")
    )
