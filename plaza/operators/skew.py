"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys above this share of the rows are hot; there can be no more than 1/HOT_SHARE of them.
HOT_SHARE = 0.005
#: Tasks that share the rows of a hot key where both sides have several rows a key.
SPREAD = 32


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the non-null rows of ``df``.

    The counts are combined before the shuffle, so a hot key sends one row per
    task.  The result has fewer than ``1 / share`` rows whatever the input.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_all") * share).select(*keys)


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: list[tuple], spread: list[str], skip: Column | None = None
) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row per key, on ``keys``, in one pass over ``left``.

    ``hot_rows`` are the hot keys of ``left`` (at most ``1 / HOT_SHARE``): their
    partners are broadcast.  Rows served so, and rows for which ``skip`` holds,
    take part in the shuffle under a salt made of the columns ``spread``, so no
    key gathers them; all others meet ``right`` by key.  Null keys find no partner.
    """
    spark = left.sparkSession
    names = [c for c in right.columns if c not in keys]
    cold = ~F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(True)
    if hot_rows:
        hot = F.broadcast(spark.createDataFrame(hot_rows, left.select(*keys).schema))
        hot_right = right.join(hot, keys, "left_semi").withColumnsRenamed({c: f"_hot_{c}" for c in names})
        left = left.join(F.broadcast(hot.join(hot_right, keys, "left").withColumn("_is_hot", F.lit(True))), keys, "left")
        cold = cold & F.col("_is_hot").isNull()
    any_key = F.lit(True)
    for k in keys:
        any_key = any_key & F.col(k).isNotNull()
    salt = F.when(cold & any_key, 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1)
    out = left.withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left").drop("_salt")
    if hot_rows:
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_hot_{c}")) for c in names}).drop("_is_hot", *[f"_hot_{c}" for c in names])
    return out


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: list[tuple], spread: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join of tables that may both have several rows a key.

    Rows of ``left`` with a hot key (``hot_rows``, as of ``collect_hot``) are
    spread by a salt made of the columns ``spread``; their partners are repeated
    for each of the SPREAD salts, so no task pairs all rows of a hot key.
    """
    if not hot_rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot_rows, left.select(*keys).schema).distinct().withColumn("_is_hot", F.lit(True)))
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*spread), F.lit(SPREAD)).cast("int")).otherwise(0)
    salts = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_is_hot")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_is_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def collect_hot(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """The hot keys as rows on the driver: fewer than ``1 / share``."""
    return [tuple(r) for r in hot_keys(df, keys, share).collect()]
