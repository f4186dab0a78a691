"""Problem 2: threads of post_record as ordered conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.conversations import conversations
from plaza.registry import Registry
from plaza.sources.tables import table

_ROWS = """
one AS (SELECT DISTINCT post_id, thread_id, parent_id, user_id, text FROM post_record),
lift AS (
  SELECT post_id, thread_id, parent_id AS up FROM one
  UNION SELECT l.post_id, o.thread_id, o.parent_id FROM lift l JOIN one o ON l.up = o.post_id WHERE l.thread_id IS NULL),
rows_ AS (
  SELECT o.post_id, o.parent_id, o.user_id, max(l.thread_id) AS thread,
    (o.text IS NULL OR NOT regexp_matches(o.text, '[^\\s]') OR regexp_matches(o.text, '^\\s*\\[\\s*(removed|deleted)[^\\]]*\\]\\s*$', 'i')) AS blank
  FROM one o JOIN lift l ON o.post_id = l.post_id GROUP BY ALL HAVING max(l.thread_id) IS NOT NULL),
reach AS (
  SELECT thread, post_id FROM rows_ WHERE parent_id IS NULL
  UNION SELECT r.thread, r.post_id FROM rows_ r JOIN reach p ON r.thread = p.thread AND r.parent_id = p.post_id)"""

FOUND_SQL = f"""WITH RECURSIVE {_ROWS},
opener AS (SELECT thread, min(user_id) AS opener FROM rows_ WHERE parent_id IS NULL GROUP BY thread),
per AS (
  SELECT r.thread, count(*) FILTER (WHERE r.parent_id IS NULL) AS roots, bool_and(r.blank) AS empty_,
    bool_or(NOT r.blank AND r.user_id IS NOT NULL AND r.user_id IS DISTINCT FROM o.opener) AS answered,
    bool_or(q.post_id IS NULL) AS unreached
  FROM rows_ r LEFT JOIN opener o ON r.thread = o.thread LEFT JOIN reach q ON r.thread = q.thread AND r.post_id = q.post_id GROUP BY r.thread)
SELECT thread AS thread_id FROM per WHERE roots <> 1 OR empty_ OR NOT answered OR unreached"""


_PER = """,
opener AS (SELECT thread, min(user_id) AS opener FROM rows_ WHERE parent_id IS NULL GROUP BY thread),
per AS (
  SELECT r.thread, count(*) AS n_rows, count(*) FILTER (WHERE r.parent_id IS NULL) AS roots, bool_and(r.blank) AS empty_,
    bool_or(NOT r.blank AND r.user_id IS NOT NULL AND r.user_id IS DISTINCT FROM o.opener) AS answered,
    bool_or(r.parent_id IS NOT NULL AND p.post_id IS NULL) AS orphan, bool_or(q.post_id IS NULL) AS unreached
  FROM rows_ r LEFT JOIN opener o ON r.thread = o.thread LEFT JOIN rows_ p ON r.thread = p.thread AND r.parent_id = p.post_id
  LEFT JOIN reach q ON r.thread = q.thread AND r.post_id = q.post_id GROUP BY r.thread),
judged AS (
  SELECT thread, n_rows, CASE WHEN roots <> 1 THEN 'roots' WHEN orphan THEN 'orphan' WHEN unreached THEN 'cycle' WHEN empty_ THEN 'empty'
    WHEN NOT answered THEN 'unanswered' ELSE 'sound' END AS verdict FROM per)"""

VERDICTS_SQL = f"WITH RECURSIVE {_ROWS}{_PER} SELECT verdict, count(*) AS n_threads, sum(n_rows) AS n_rows FROM judged GROUP BY verdict"

CONVERSATIONS_SQL = f"""WITH RECURSIVE {_ROWS}{_PER},
texts AS (SELECT post_id, max(text) AS text, min(trim("timestamp")) AS t FROM post_record GROUP BY post_id),
timed AS (
  SELECT post_id, text, CASE WHEN regexp_matches(t, '^\\d{{9,11}}$') THEN to_timestamp(CAST(t AS BIGINT))
    WHEN regexp_matches(t, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN TRY_CAST(t AS TIMESTAMPTZ) ELSE TRY_CAST(t || 'Z' AS TIMESTAMPTZ) END AS at_ FROM texts),
good AS (SELECT r.*, t.text, t.at_ FROM rows_ r JOIN judged j ON r.thread = j.thread AND j.verdict = 'sound' JOIN timed t ON r.post_id = t.post_id),
root AS (SELECT thread, user_id AS opener, at_ AS root_at FROM good WHERE parent_id IS NULL)
SELECT g.thread AS thread_id, row_number() OVER (PARTITION BY g.thread ORDER BY g.parent_id IS NOT NULL, CASE WHEN g.at_ IS NULL THEN NULL ELSE greatest(g.at_, o.root_at) END NULLS LAST, g.post_id) - 1 AS position,
  g.post_id, g.user_id, CASE WHEN g.user_id IS NOT DISTINCT FROM o.opener THEN 'opener' ELSE 'responder' END AS role, g.text
FROM good g JOIN root o ON g.thread = o.thread"""


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p2_found", FOUND_SQL)
    def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        verdicts = conversations(table(spark, sf_dir, "post_record")).verdicts
        return verdicts.filter("verdict IS NOT NULL").select(F.col("thread").alias("thread_id")).distinct()

    @reg.add("p2_conversations", CONVERSATIONS_SQL)
    def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "post_record")
        text = df.select("post_id", "text").groupBy("post_id").agg(F.max("text").alias("text"))
        rows = conversations(df).messages.join(text, "post_id")
        return rows.select(F.col("thread").alias("thread_id"), "position", "post_id", "user_id", "role", "text")

    @reg.add("p2_verdicts", VERDICTS_SQL)
    def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
        verdicts = conversations(table(spark, sf_dir, "post_record")).verdicts
        return verdicts.groupBy(F.coalesce("verdict", F.lit("sound")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_threads"), F.sum("n_rows").alias("n_rows"))

    @reg.add("p2_lateness")
    def p2_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
        verdicts = conversations(table(spark, sf_dir, "post_record")).verdicts
        return verdicts.groupBy(F.when(F.col("by_stream"), "stream").otherwise("late rows").alias("judged_by")).agg(F.count(F.lit(1)).alias("n_threads"), F.sum("n_rows").alias("n_rows"))
