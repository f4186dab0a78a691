"""Recommendations for users, and the action log of the platform as validated changes of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.operators.actions import counters, outcomes
from plaza.operators.recommend import DIMENSIONS, LEAST, POOL, SPAN, coarse_pool, liked_vectors, recommend, text_vectors
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql

#: Posts in a user's list.
LIST = 5

_VEC = "CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % {d}".format(d=DIMENSIONS)
_REC = (
    f"pool AS (SELECT post_id, user_id AS author_id, content, created_at FROM p WHERE created_at IS NOT NULL ORDER BY md5('coarse:' || post_id), post_id LIMIT {POOL})",
    f"pw AS (SELECT post_id, {_VEC} AS d, count(*) AS x FROM (SELECT post_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM p) GROUP BY ALL)",
    "pv AS (SELECT post_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY post_id)) AS x FROM pw)",
    f"uw AS (SELECT user_id, {_VEC} AS d, count(*) AS x FROM (SELECT user_id, unnest(regexp_extract_all(lower(bio), '[a-z0-9]+')) AS w FROM u) GROUP BY ALL)",
    "uv AS (SELECT user_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM uw)",
    "lk AS (SELECT user_id, post_id FROM (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, like_id DESC) AS k FROM l WHERE post_id IS NOT NULL) WHERE k <= 5)",
    "lk2 AS (SELECT DISTINCT user_id, post_id, count(*) AS times FROM lk WHERE post_id IN (SELECT post_id FROM pv) GROUP BY ALL)",
    "lv AS (SELECT k.user_id, v.d, sum(v.x * k.times) / any_value(n.n) AS x FROM lk2 k JOIN pv v ON k.post_id = v.post_id JOIN (SELECT user_id, sum(times) AS n FROM lk2 GROUP BY user_id) n ON k.user_id = n.user_id GROUP BY ALL)",
    "b AS (SELECT a.user_id, v.post_id, sum(a.x * v.x) AS s FROM uv a JOIN pv v ON a.d = v.d WHERE v.post_id IN (SELECT post_id FROM pool) GROUP BY ALL)",
    "m AS (SELECT a.user_id, v.post_id, sum(a.x * v.x) AS s FROM lv a JOIN pv v ON a.d = v.d WHERE v.post_id IN (SELECT post_id FROM pool) GROUP BY ALL)",
    "f AS (SELECT u.user_id, q.post_id, q.author_id, q.created_at, coalesce(b.s, 0) AS base, coalesce(m.s, 0) AS liked FROM u CROSS JOIN pool q LEFT JOIN b ON u.user_id = b.user_id AND q.post_id = b.post_id LEFT JOIN m ON u.user_id = m.user_id AND q.post_id = m.post_id)",
    "g AS (SELECT *, max(base) OVER (PARTITION BY user_id) - min(base) OVER (PARTITION BY user_id) AS span, (epoch_us(max(created_at) OVER ()) - epoch_us(created_at)) // 86400000000 AS age FROM f)",
)


def _ranked(score: str) -> str:
    return with_sql("pul", *_REC, f"h AS (SELECT user_id, post_id, round({score}, 6) + 0.0 AS score FROM g WHERE author_id IS DISTINCT FROM user_id)") + (
        f"SELECT user_id, CAST(rank AS INTEGER) AS rank, post_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, post_id) AS rank FROM h) WHERE rank <= {LIST}"
    )


_RECENCY = f"ln(greatest({SPAN} - age, {LEAST}) / 100)"

_ACTIONS = (
    "lg AS (SELECT 'sign_up' AS action, user_id AS id, user_id AS actor, 'agent' AS kind, agent_id AS target, created_at AS at_, FALSE AS forbid, FALSE AS once FROM u"
    " UNION ALL SELECT CASE WHEN original_post_id IS NULL THEN 'create_post' WHEN coalesce(quote_content, '') = '' THEN 'repost' ELSE 'quote_post' END, post_id, user_id, CASE WHEN original_post_id IS NULL THEN 'user' ELSE 'post' END, coalesce(original_post_id, user_id), created_at, FALSE, FALSE FROM p"
    " UNION ALL SELECT 'create_comment', comment_id, user_id, 'post', post_id, created_at, FALSE, FALSE FROM c"
    " UNION ALL SELECT 'like_post', like_id, user_id, 'post', post_id, created_at, TRUE, TRUE FROM l"
    " UNION ALL SELECT 'follow', follow_id, follower_id, 'user', followee_id, created_at, TRUE, TRUE FROM f"
    " UNION ALL SELECT 'send_to_group', message_id, sender_id, 'agent', sender_id, sent_at, FALSE, FALSE FROM g)",
    "kn AS (SELECT 'post' AS kind, post_id AS target, user_id AS owner FROM p UNION ALL SELECT 'user', user_id, user_id FROM u UNION ALL SELECT 'agent', agent_id, min(user_id) FROM u WHERE agent_id IS NOT NULL GROUP BY agent_id)",
    "tn AS (SELECT *, row_number() OVER (PARTITION BY action, actor, target ORDER BY at_ NULLS LAST, id) AS turn FROM lg)",
    "oc AS (SELECT t.*, CASE WHEN k.target IS NULL THEN 'missing' WHEN t.forbid AND k.owner = t.actor THEN 'own' WHEN t.once AND t.turn > 1 THEN 'repeated' ELSE 'accepted' END AS outcome FROM tn t LEFT JOIN kn k ON t.kind = k.kind AND t.target = k.target)",
)


def action_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All actions of the domain tables, and the targets that exist."""
    p, c, li, f, u, g = (rows(spark, sf_dir, x) for x in "pclfug")

    def part(df: DataFrame, action, key: str, actor: str, kind, target, at: str = "created_at", forbid: bool = False, once: bool = False) -> DataFrame:
        col = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(col(action).alias("action"), F.col(key).alias("id"), F.col(actor).alias("actor"), col(kind).alias("kind"), target.alias("target"), F.col(at).alias("at"), F.lit(forbid).alias("forbid_own"), F.lit(once).alias("once"))

    root = F.col("original_post_id").isNull()
    what = F.when(root, "create_post").when(F.coalesce("quote_content", F.lit("")) == "", "repost").otherwise("quote_post")
    parts = [
        part(u, "sign_up", "user_id", "user_id", "agent", F.col("agent_id")),
        part(p, what, "post_id", "user_id", F.when(root, "user").otherwise("post"), F.coalesce("original_post_id", "user_id")),
        part(c, "create_comment", "comment_id", "user_id", "post", F.col("post_id")),
        part(li, "like_post", "like_id", "user_id", "post", F.col("post_id"), forbid=True, once=True),
        part(f, "follow", "follow_id", "follower_id", "user", F.col("followee_id"), forbid=True, once=True),
        part(g, "send_to_group", "message_id", "sender_id", "agent", F.col("sender_id"), "sent_at"),
    ]
    log = parts[0]
    for x in parts[1:]:
        log = log.unionByName(x)
    known = p.select(F.lit("post").alias("kind"), F.col("post_id").alias("target"), F.col("user_id").alias("owner"))
    known = known.unionByName(u.select(F.lit("user").alias("kind"), F.col("user_id").alias("target"), F.col("user_id").alias("owner")))
    agents = u.filter("agent_id IS NOT NULL").groupBy("agent_id").agg(F.min("user_id").alias("owner"))
    return log, known.unionByName(agents.select(F.lit("agent").alias("kind"), F.col("agent_id").alias("target"), "owner"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    def ranked(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
        p, u = rows(spark, sf_dir, "p"), rows(spark, sf_dir, "u")
        users = u.select("user_id").join(text_vectors(u, "user_id", "bio"), "user_id", "left")
        if how.get("liking"):
            users = users.join(liked_vectors(rows(spark, sf_dir, "l"), text_vectors(p, "post_id", "content")), "user_id", "left")
        else:
            users = users.withColumn("liked", F.lit(None).cast("array<struct<i:int,x:double>>"))
        return recommend(users, coarse_pool(p), LIST, **how)

    @reg.add("rec_bio_cosine", _ranked("base"))
    def rec_bio_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(spark, sf_dir)

    @reg.add("rec_recency_users", _ranked(f"base * {_RECENCY}"))
    def rec_recency_users(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(spark, sf_dir, recency=True)

    @reg.add("rec_liked_users", _ranked("base + liked * span / 2"))
    def rec_liked_users(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(spark, sf_dir, liking=True)

    @reg.add("action_outcomes", with_sql("pclfug", *_ACTIONS) + "SELECT action, outcome, count(*) AS n FROM oc GROUP BY ALL")
    def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outcomes(*action_log(spark, sf_dir)).groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("n"))

    @reg.add("action_counters", with_sql("pclfug", *_ACTIONS) + "SELECT target AS post_id, action, count(*) AS n FROM oc WHERE kind = 'post' AND outcome = 'accepted' GROUP BY ALL")
    def action_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counters(outcomes(*action_log(spark, sf_dir)), "post").withColumnRenamed("target", "post_id")
