"""Problem 3: references of the domain tables to posts and users that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.operators.orphans import find_orphans, orphan_report, parents
from plaza.registry import Registry
from plaza.sources.tables import table

POST, USER, AGENT = 0, 1, 2
#: table, id, reference, time, kind of parent
REFERENCES = [
    ("post_like", "like_id", "post_id", "created_at", POST),
    ("post_comment", "comment_id", "post_id", "created_at", POST),
    ("follow_edge", "follow_id", "followee_id", "created_at", USER),
    ("group_messages", "message_id", "sender_id", "sent_at", AGENT),
]

_PARENTS = """
parent AS (
  SELECT 0 AS kind, post_id AS ref, min(created_at) AS created_at FROM post GROUP BY post_id
  UNION ALL SELECT 1, user_id, min(created_at) FROM platform_user GROUP BY user_id
  UNION ALL SELECT 2, agent_id, min(created_at) FROM platform_user WHERE agent_id IS NOT NULL GROUP BY agent_id),
gone AS (
  SELECT kind, ref, min(removed_at) AS removed_at FROM (
    SELECT 0 AS kind, record_key AS ref, removed_at FROM removed_keys WHERE table_name = 'post'
    UNION ALL SELECT 1, record_key, removed_at FROM removed_keys WHERE table_name = 'platform_user'
    UNION ALL SELECT 2, u.agent_id, r.removed_at FROM removed_keys r JOIN platform_user u ON r.record_key = u.user_id
      WHERE r.table_name = 'platform_user' AND u.agent_id IS NOT NULL) GROUP BY kind, ref),
refs AS (
  SELECT 'post_like' AS table_name, like_id AS record_id, 0 AS kind, post_id AS ref, created_at AS ts FROM post_like
  UNION ALL SELECT 'post_comment', comment_id, 0, post_id, created_at FROM post_comment
  UNION ALL SELECT 'follow_edge', follow_id, 1, followee_id, created_at FROM follow_edge
  UNION ALL SELECT 'group_messages', message_id, 2, sender_id, sent_at FROM group_messages),
judged AS (
  SELECT r.table_name, r.record_id, r.ts,
    CASE WHEN p.ref IS NULL THEN 'missing' WHEN p.created_at > r.ts THEN 'later' WHEN g.removed_at <= r.ts THEN 'removed' END AS reason
  FROM refs r LEFT JOIN parent p ON r.kind = p.kind AND r.ref = p.ref LEFT JOIN gone g ON p.kind = g.kind AND p.ref = g.ref
  WHERE r.ref IS NOT NULL)"""

FOUND_SQL = f"WITH {_PARENTS} SELECT DISTINCT table_name, record_id FROM judged WHERE reason IS NOT NULL"
REPORT_SQL = f"""WITH {_PARENTS},
one AS (SELECT table_name, record_id, min(ts) AS ts, max(reason) AS reason FROM judged GROUP BY table_name, record_id)
SELECT table_name, strftime(ts, '%Y-%m') AS month, count(*) AS n_references, count(reason) AS n_orphans,
  count(*) FILTER (WHERE reason = 'missing') AS n_missing, count(*) FILTER (WHERE reason = 'later') AS n_later,
  count(*) FILTER (WHERE reason = 'removed') AS n_removed
FROM one GROUP BY table_name, month"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references in one shape, each table scanned once for three columns."""
    out = None
    for name, key, ref, at, kind in REFERENCES:
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.lit(kind).alias("kind"), F.col(ref).alias("ref"), F.col(at).alias("at")
        )
        out = part if out is None else out.unionByName(part)
    return out


def parent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, users and agents with creation and removal time."""
    post, user, gone = (table(spark, sf_dir, t) for t in ("post", "platform_user", "removed_keys"))
    users = user.select("user_id", "agent_id", "created_at")
    created = (
        post.select(F.lit(POST).alias("kind"), F.col("post_id").alias("ref"), "created_at")
        .unionByName(users.select(F.lit(USER).alias("kind"), F.col("user_id").alias("ref"), "created_at"))
        .unionByName(users.select(F.lit(AGENT).alias("kind"), F.col("agent_id").alias("ref"), "created_at"))
    )
    gone = gone.select("table_name", F.col("record_key").alias("ref"), "removed_at")
    gone_users = gone.filter("table_name = 'platform_user'")
    removed = (
        gone.filter("table_name = 'post'").select(F.lit(POST).alias("kind"), "ref", "removed_at")
        .unionByName(gone_users.select(F.lit(USER).alias("kind"), "ref", "removed_at"))
        .unionByName(gone_users.join(users, F.col("ref") == F.col("user_id")).select(F.lit(AGENT).alias("kind"), F.col("agent_id").alias("ref"), "removed_at"))
    )
    return parents(created, removed)


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p3_found", FOUND_SQL)
    def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        judged = find_orphans(references(spark, sf_dir), parent_keys(spark, sf_dir))
        return judged.filter("reason IS NOT NULL").select("table_name", "record_id").distinct()

    @reg.add("p3_orphan_report", REPORT_SQL)
    def p3_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return orphan_report(find_orphans(references(spark, sf_dir), parent_keys(spark, sf_dir)))
