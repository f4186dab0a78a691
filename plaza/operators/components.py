"""Connected components of an edge table.

Every task first contracts its own edges with union-find, then large-star and
small-star rounds run until nothing changes; a node of any degree is spread by
``lookup_join``.

Defined cases: null ends are ignored; loops make their node a component of its
own; an empty table gives no rows; the component is its least node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import drop_path, written
from plaza.operators.skew import collect_hot, lookup_join


#: Edges that a task contracts at once, and edges up to which hot nodes are not looked for.
CONTRACT_ROWS, FEW_ROWS = 1_000_000, 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the given edges, by hooking and pointer jumping on whole arrays."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def run() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        n, root = union_find(t.column(0).to_numpy(), t.column(1).to_numpy())
        keep = n != root
        return pa.RecordBatch.from_pydict({"a": pa.array(n[keep], pa.int64()), "b": pa.array(root[keep], pa.int64())})

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CONTRACT_ROWS:
            yield run()
            held.clear()
    if held:
        yield run()


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star round over so many edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = lookup_join(both, least, ["a"], collect_hot(both, ["a"]) if rows > FEW_ROWS else [], ["b"])
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node (a long) that occurs in an edge."""
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    ends, path = written(ends, "edges")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    now, at = written(ends.mapInArrow(_contract, "a long, b long").distinct(), "star")
    old = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == old or not mark[0]:
            break
        old = tuple(mark)
        mid, mid_at = written(_star(now, True, mark[0]), "star")
        new, new_at = written(_star(mid, False, mark[0]), "star")
        drop_path(spark, at)
        drop_path(spark, mid_at)
        now, at = new, new_at
    out = lookup_join(nodes, now.select(F.col("a").alias("node"), F.col("b").alias("component")), ["node"], [], ["node"])
    return out.select("node", F.coalesce("component", "node").alias("component"))
