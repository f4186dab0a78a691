"""The domain tables with one row per id, in Spark and as SQL.

Repeated rows of an id agree but for counters, of which the newest is the
largest; so ``min`` keeps every other column and ``max`` the counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.sources.tables import table

#: name, table, key, columns taken by min, counters taken by max
_TABLES = {
    "p": ("post", "post_id", ["user_id", "original_post_id", "content", "quote_content", "created_at"], ["num_likes", "num_dislikes", "num_shares", "num_reports"]),
    "c": ("post_comment", "comment_id", ["post_id", "user_id", "content", "created_at"], ["num_likes", "num_dislikes"]),
    "l": ("post_like", "like_id", ["user_id", "post_id", "created_at"], []),
    "f": ("follow_edge", "follow_id", ["follower_id", "followee_id", "created_at"], []),
    "u": ("platform_user", "user_id", ["agent_id", "user_name", "name", "bio", "created_at"], ["num_followings", "num_followers"]),
    "g": ("group_messages", "message_id", ["group_id", "sender_id", "content", "sent_at"], []),
    "r": ("post_record", "post_id", ["thread_id", "user_id", "parent_id", "timestamp", "text", "category_labels", "split", "provenance", "generation_seed", "persona_id", "needs_thread_context"], []),
    "k": ("persona_config", "persona_id", ["primary_label", "allowed_labels", "label_mode_cap", "trajectory_stage", "slang_fluency", "benign_on_none_prob", "max_labels_per_post"], []),
    "d": ("documents", "doc_id", ["text", "lang", "source", "n_chars", "user_id", "persona_label", "created_at", "loaded_at"], []),
}


def rows(spark: SparkSession, sf_dir: str, name: str, where: Column | str | None = None) -> DataFrame:
    """One row per id of the table called ``name`` above; unused columns are pruned.

    ``where`` is a condition on the columns taken by min: repeated rows agree on
    them, so it is applied in the scan, before the rows of an id are brought together.
    """
    source, key, low, high = _TABLES[name]
    aggs = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high]
    df = table(spark, sf_dir, source)
    return (df if where is None else df.filter(where)).groupBy(key).agg(*aggs)


def with_sql(names: str, *more: str) -> str:
    """``WITH`` clause of the tables in ``names`` (one letter each) and further common tables."""
    parts = []
    for n in names:
        source, key, low, high = _TABLES[n]
        cols = ", ".join([f"min({c}) AS {c}" if c != "timestamp" else 'min("timestamp") AS "timestamp"' for c in low] + [f"max({c}) AS {c}" for c in high])
        parts.append(f"{n} AS (SELECT {key}, {cols} FROM {source} GROUP BY {key})")
    return "WITH " + ", ".join([*parts, *more]) + " "
