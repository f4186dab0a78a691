"""Problem 6: posts and comments that are copies of another with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.neardup import NearDuplicates
from plaza.registry import Registry
from plaza.sources.tables import table

TEXTS = [("post", "post_id"), ("post_comment", "comment_id")]

FOUND_SQL = """WITH t AS (
  SELECT 'post' AS table_name, post_id AS id, max(content) AS x FROM post GROUP BY post_id
  UNION ALL SELECT 'post_comment', comment_id, max(content) FROM post_comment GROUP BY comment_id),
s AS (SELECT table_name, id, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS ws FROM t),
w AS (SELECT table_name, id, len(ws) AS n, unnest(ws) AS word FROM s WHERE len(ws) >= 18),
p AS (SELECT a.table_name, a.id AS id_a, b.id AS id_b, a.n + b.n AS both_n, count(*) AS shared
  FROM w a JOIN w b ON a.table_name = b.table_name AND a.word = b.word AND a.id < b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL)
SELECT table_name, id_a, id_b FROM p WHERE 10 * shared >= 7 * (both_n - shared)"""


_PAIRS = FOUND_SQL.removeprefix("WITH ").rsplit("\nSELECT", 1)[0] + """,
f AS (SELECT table_name, id_a, id_b FROM p WHERE 10 * shared >= 7 * (both_n - shared)),
e AS (SELECT table_name, id_a AS id, id_b AS other FROM f UNION ALL SELECT table_name, id_b, id_a FROM f)"""
LINKS_SQL = f"WITH {_PAIRS} SELECT table_name, id, count(*) AS n_links FROM e GROUP BY table_name, id"
GROUPS_SQL = f"""WITH RECURSIVE {_PAIRS},
r AS (SELECT table_name, id, id AS to_id FROM e UNION SELECT r.table_name, r.id, e.other FROM r JOIN e ON r.table_name = e.table_name AND r.to_id = e.id),
g AS (SELECT table_name, id, min(to_id) AS group_id FROM r GROUP BY table_name, id)
SELECT table_name, id, group_id, count(*) OVER (PARTITION BY table_name, group_id) AS n_records FROM g"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, id, text) of both tables."""
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(k).alias("id"), F.col("content").alias("text")) for n, k in TEXTS]
    return parts[0].unionByName(parts[1])


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p6_found", FOUND_SQL)
    def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return NearDuplicates(rows(spark, sf_dir)).pairs()

    @reg.add("p6_groups", GROUPS_SQL)
    def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        return NearDuplicates(rows(spark, sf_dir)).groups()

    @reg.add("p6_link_counts", LINKS_SQL)
    def p6_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return NearDuplicates(rows(spark, sf_dir)).link_counts()
