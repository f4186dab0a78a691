"""Problem 4: trees of posts and of exported post records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.operators.hierarchy import descendants, forests, hierarchy
from plaza.registry import Registry
from plaza.sources.tables import table

LINKS = [("post", "post_id", "original_post_id"), ("post_record", "post_id", "parent_id")]

_TREE = """
links AS (
  SELECT 'post' AS table_name, CAST(node AS VARCHAR) AS node, CAST(parent AS VARCHAR) AS parent
  FROM (SELECT post_id AS node, min(original_post_id) AS parent FROM post GROUP BY post_id)
  UNION ALL SELECT 'post_record', post_id, min(parent_id) FROM post_record GROUP BY post_id),
known AS (SELECT l.table_name, l.node, p.node AS parent FROM links l LEFT JOIN links p ON l.table_name = p.table_name AND l.parent = p.node),
tree AS (
  SELECT table_name, node, node AS root, 0 AS depth, node AS path, [node] AS ids FROM known WHERE parent IS NULL
  UNION ALL SELECT k.table_name, k.node, t.root, t.depth + 1, t.path || '>' || k.node, list_append(t.ids, k.node)
  FROM known k JOIN tree t ON k.table_name = t.table_name AND k.parent = t.node)"""

TREE_SQL = f"""WITH RECURSIVE {_TREE},
below AS (SELECT table_name, node, count(*) AS n FROM (SELECT table_name, unnest(ids[1:len(ids) - 1]) AS node FROM tree) GROUP BY table_name, node)
SELECT t.table_name, t.node AS node_id, t.root AS root_id, t.depth, t.path, coalesce(b.n, 0) AS n_descendants
FROM tree t LEFT JOIN below b ON t.table_name = b.table_name AND t.node = b.node"""

DESCENDANTS_SQL = f"""WITH RECURSIVE {_TREE},
up AS (SELECT table_name, node, depth, unnest(ids) AS ancestor, generate_subscripts(ids, 1) - 1 AS at_depth FROM tree)
SELECT table_name, ancestor AS ancestor_id, node AS descendant_id, CAST(depth - at_depth AS INTEGER) AS distance FROM up WHERE at_depth < depth"""

FOUND_SQL = f"""WITH RECURSIVE {_TREE},
stuck AS (SELECT k.* FROM known k LEFT JOIN tree t ON k.table_name = t.table_name AND k.node = t.node WHERE t.node IS NULL),
reach AS (
  SELECT table_name, node, parent AS at_node FROM stuck
  UNION SELECT r.table_name, r.node, s.parent FROM reach r JOIN stuck s ON r.table_name = s.table_name AND r.at_node = s.node),
ring AS (SELECT table_name, node FROM reach WHERE node = at_node),
onto AS (SELECT r.table_name, r.node, r.at_node FROM reach r JOIN ring g ON r.table_name = g.table_name AND r.at_node = g.node)
SELECT table_name, node AS node_id,
  CASE WHEN table_name = 'post' THEN CAST(min(TRY_CAST(at_node AS BIGINT)) AS VARCHAR) ELSE min(at_node) END AS cycle_id
FROM onto GROUP BY table_name, node"""


def tree(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The hierarchy of one linked table."""
    node, parent = next((n, p) for t, n, p in LINKS if t == name)
    return hierarchy(table(spark, sf_dir, name).select(node, parent), node, parent)


def trees(spark: SparkSession, sf_dir: str, paths: bool = True) -> list[tuple[str, DataFrame]]:
    """The hierarchy of each linked table."""
    return list(forests({t: (table(spark, sf_dir, t).select(n, p), n, p) for t, n, p in LINKS}, paths).items())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p4_found", FOUND_SQL)
    def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _union(
            [
                t.filter("cycle IS NOT NULL").select(F.lit(n).alias("table_name"), F.col("node").cast("string").alias("node_id"), F.col("cycle").cast("string").alias("cycle_id"))
                for n, t in trees(spark, sf_dir, paths=False)
            ]
        )

    @reg.add("p4_hierarchy", TREE_SQL)
    def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _union(
            [
                t.filter("root IS NOT NULL").select(
                    F.lit(n).alias("table_name"),
                    F.col("node").cast("string").alias("node_id"),
                    F.col("root").cast("string").alias("root_id"),
                    "depth",
                    F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
                    "n_descendants",
                )
                for n, t in trees(spark, sf_dir)
            ]
        )

    @reg.add("p4_descendants", DESCENDANTS_SQL)
    def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _union(
            [
                descendants(t).select(
                    F.lit(n).alias("table_name"), F.col("ancestor").cast("string").alias("ancestor_id"), F.col("descendant").cast("string").alias("descendant_id"), "distance"
                )
                for n, t in trees(spark, sf_dir)
            ]
        )
