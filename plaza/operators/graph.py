"""Measures of a follow graph (src, dst)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.rank import grouped_rank
from plaza.operators.skew import collect_hot, spread_join


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: each pair of linked nodes once, without loops."""
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree) of undirected pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def triangles(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, triangles).

    Every edge points from the end of lower degree to the other, so a hub of
    any degree starts few paths and no node starts more than sqrt(2 m).
    """
    d = lambda c: degree.select(F.col("node").alias(c), F.struct("degree", "node").alias(f"k_{c}"))
    e = pairs.join(d("a"), "a").join(d("b"), "b")
    up = e.select(F.when(F.col("k_a") < F.col("k_b"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("k_a") < F.col("k_b"), F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = up.join(up.withColumnRenamed("y", "z"), "x").filter("y < z")
    closed = wedge.join(pairs.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def assortativity(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """(assortativity): correlation of the degrees at both ends, over both directions."""
    d = lambda c: degree.select(F.col("node").alias(c), F.col("degree").cast("double").alias(f"d_{c}"))
    e = pairs.join(d("a"), "a").join(d("b"), "b")
    both = e.select("d_a", "d_b").union(e.select("d_b", "d_a"))
    return both.agg(F.corr("d_a", "d_b").alias("assortativity"))


def two_hop(edges: DataFrame) -> DataFrame:
    """(s, t, common): pairs with a node between them (s -> via -> t), not linked and not the same, and the number of such nodes.

    Edges into a hot middle node are spread by salt; the counts are combined before the shuffle.
    """
    e = cut(edges.filter("src <> dst").distinct(), "edges")
    first = e.select(F.col("src").alias("s"), F.col("dst").alias("via"))
    second = e.select(F.col("src").alias("via"), F.col("dst").alias("t"))
    hot = collect_hot(first, ["via"]) + collect_hot(second, ["via"])
    hop = spread_join(first, second, ["via"], hot, ["s"]).filter("t <> s").groupBy("s", "t").agg(F.count("*").alias("common"))
    return hop.join(e.select(F.col("src").alias("s"), F.col("dst").alias("t")), ["s", "t"], "left_anti")


def random_edges(nodes: DataFrame, node: str, n: int, seed: int = 0) -> DataFrame:
    """(src, dst): ``n`` different directed edges without loops between the nodes, drawn by hash, or all there are.

    Edge numbers are drawn without repeats from the ``m * (m - 1)`` possible
    ones by a stride prime to their number, so no edge is drawn twice and none
    has to be looked up.
    """
    ranked = cut(grouped_rank(nodes.select(F.col(node).alias("v")).dropna().distinct().withColumn("one", F.lit(0)), ["one"], [F.col("v").asc()], "k").select("k", "v"), "nodes")
    m = ranked.count()
    every = m * (m - 1)
    want = min(n, every)
    if not want:
        return ranked.select(F.col("v").alias("src"), F.col("v").alias("dst")).limit(0)
    stride = next(s for s in range(int(every * 0.6180339887) | 1, every * 2 + 3) if math.gcd(s, every) == 1)
    at = F.pmod(F.col("id").cast("decimal(38,0)") * stride + seed, F.lit(every).cast("decimal(38,0)")).cast("long")
    drawn = nodes.sparkSession.range(want).select(at.alias("e"))
    a, rest = F.floor(F.col("e") / (m - 1)).cast("long"), F.pmod("e", F.lit(m - 1)).cast("long")
    ends = drawn.select(a.alias("a"), (rest + F.when(rest >= a, 1).otherwise(0)).alias("b"))
    ends = ends.join(ranked.select(F.col("k").alias("a"), F.col("v").alias("src")), "a").join(ranked.select(F.col("k").alias("b"), F.col("v").alias("dst")), "b")
    return ends.select("src", "dst")
