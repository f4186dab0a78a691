"""Feeds, search, trends and the relational reads of the platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.functions.text import display_name, render_post
from plaza.operators.feeds import contains, following_feed, post_type, roots, trend
from plaza.operators.rank import grouped_rank, neighbours, top_per_group
from plaza.operators.skew import collect_hot, lookup_join
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

_NAME = "CASE WHEN trim({u}name) <> '' THEN {u}name WHEN trim({u}user_name) <> '' THEN {u}user_name ELSE 'user_' || {u}user_id END"
_TYPE = "CASE WHEN {p}original_post_id IS NULL THEN 'common' WHEN coalesce({p}quote_content, '') = '' THEN 'repost' ELSE 'quote' END"


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("post_columns", with_sql("p") + "SELECT post_id AS id, original_post_id AS parent_id, user_id, num_likes - num_dislikes AS score, 'p_' || post_id AS label, CAST(NULL AS VARCHAR) AS text_imputed FROM p")
    def post_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p")
        return p.select(
            F.col("post_id").alias("id"), F.col("original_post_id").alias("parent_id"), "user_id", (F.col("num_likes") - F.col("num_dislikes")).alias("score"), F.concat(F.lit("p_"), F.col("post_id")).alias("label"), F.lit(None).cast("string").alias("text_imputed")
        )

    @reg.add("display_name", with_sql("u") + f"SELECT user_id, {_NAME.format(u='')} AS display_name FROM u")
    def q_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "u").select("user_id", display_name(F.col("name"), F.col("user_name"), F.col("user_id")).alias("display_name"))

    @reg.add("post_type", with_sql("p") + f"SELECT {_TYPE.format(p='')} AS post_type, count(*) AS n_posts FROM p GROUP BY 1")
    def q_post_type(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").groupBy(post_type(F.col("original_post_id"), F.col("quote_content")).alias("post_type")).agg(F.count(F.lit(1)).alias("n_posts"))

    @reg.add(
        "repost_root",
        with_sql("p", f"t AS (SELECT *, CASE WHEN {_TYPE.format(p='')} = 'repost' THEN original_post_id ELSE post_id END AS root_id FROM p)")
        + "SELECT a.post_id, a.root_id, b.content AS root_content, b.num_likes AS root_likes FROM t a LEFT JOIN p b ON a.root_id = b.post_id",
    )
    def repost_root(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p")
        t = roots(p).select("post_id", "root_id")
        root = p.select(F.col("post_id").alias("root_id"), F.col("content").alias("root_content"), F.col("num_likes").alias("root_likes"))
        return lookup_join(t, root, ["root_id"], collect_hot(t, ["root_id"]), ["post_id"]).select("post_id", "root_id", "root_content", "root_likes")

    @reg.add(
        "rendered_feed",
        with_sql("pu", f"n AS (SELECT user_id, {_NAME.format(u='')} AS who FROM u)", f"t AS (SELECT p.*, {_TYPE.format(p='')} AS kind, n.who FROM p LEFT JOIN n ON p.user_id = n.user_id)")
        + """SELECT t.post_id, CASE WHEN t.num_reports >= 2 THEN '[Warning: This post has been reported ' || t.num_reports || ' times]' || chr(10) ELSE '' END ||
        CASE t.kind WHEN 'repost' THEN coalesce(t.who, '?') || ' reposted a post from ' || coalesce(o.who, '?') || '. Repost content: ' || coalesce(o.content, '') || '.'
        WHEN 'quote' THEN coalesce(t.who, '?') || ' quoted a post from ' || coalesce(o.who, '?') || '. Quote content: ' || t.quote_content || '. Original Content: ' || coalesce(o.content, '')
        ELSE coalesce(t.content, '') END AS feed_text FROM t LEFT JOIN t o ON t.original_post_id = o.post_id""",
    )
    def rendered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = rows(spark, sf_dir, "u").select("user_id", display_name(F.col("name"), F.col("user_name"), F.col("user_id")).alias("who"))
        p = rows(spark, sf_dir, "p").withColumn("kind", post_type(F.col("original_post_id"), F.col("quote_content")))
        t = lookup_join(p, u, ["user_id"], collect_hot(p, ["user_id"]), ["post_id"])
        root = t.select(F.col("post_id").alias("original_post_id"), F.col("who").alias("root_who"), F.col("content").alias("root_content"))
        both = lookup_join(t, root, ["original_post_id"], collect_hot(p, ["original_post_id"]), ["post_id"])
        return both.select("post_id", render_post(2).alias("feed_text"))

    @reg.add(
        "feed_following_topn",
        with_sql("pf", "e AS (SELECT DISTINCT follower_id, followee_id FROM f WHERE followee_id IS NOT NULL)")
        + """SELECT follower_id, rank, post_id, num_likes FROM (
        SELECT e.follower_id, p.post_id, p.num_likes, CAST(row_number() OVER (PARTITION BY e.follower_id ORDER BY p.num_likes DESC, p.post_id) AS INTEGER) AS rank
        FROM e JOIN p ON p.user_id = e.followee_id) WHERE rank <= 3""",
    )
    def feed_following_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return following_feed(rows(spark, sf_dir, "p"), rows(spark, sf_dir, "f"), 3)

    @reg.add(
        "feed_comments",
        with_sql("pcu", f"n AS (SELECT user_id, {_NAME.format(u='')} AS who FROM u)")
        + "SELECT c.post_id, row_number() OVER (PARTITION BY c.post_id ORDER BY c.comment_id) - 1 AS position, c.comment_id, coalesce(n.who, '?') AS who, c.num_likes - c.num_dislikes AS score FROM p JOIN c ON p.post_id = c.post_id LEFT JOIN n ON c.user_id = n.user_id",
    )
    def feed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").select("post_id").withColumn("there", F.lit(True))
        u = rows(spark, sf_dir, "u").select("user_id", display_name(F.col("name"), F.col("user_name"), F.col("user_id")).alias("who"))
        c = rows(spark, sf_dir, "c")
        c = lookup_join(c.select("comment_id", "post_id", "user_id", (F.col("num_likes") - F.col("num_dislikes")).alias("score")), p, ["post_id"], collect_hot(c, ["post_id"]), ["comment_id"]).filter("there")
        named = lookup_join(c, u, ["user_id"], collect_hot(c, ["user_id"]), ["comment_id"])
        named = named.select("post_id", "comment_id", F.coalesce("who", F.lit("?")).alias("who"), "score")
        return grouped_rank(named, ["post_id"], [F.col("comment_id").asc()], "position").select("post_id", "position", "comment_id", "who", "score")

    @reg.add("search_posts", with_sql("p") + "SELECT post_id, user_id FROM p WHERE content ILIKE '%77 %' OR CAST(post_id AS VARCHAR) LIKE '%77 %' OR CAST(user_id AS VARCHAR) LIKE '%77 %' UNION SELECT post_id, user_id FROM p WHERE content ILIKE '%kettle%'")
    def search_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = ["post_id", "user_id"]
        return rows(spark, sf_dir, "p", contains("77 ", ["content"], ids) | contains("kettle", ["content"], [])).select(*ids)

    @reg.add("search_users", with_sql("u") + "SELECT user_id FROM u WHERE user_name ILIKE '%99%' OR name ILIKE '%99%' OR bio ILIKE '%99%' OR CAST(user_id AS VARCHAR) LIKE '%99%'")
    def search_users(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "u", contains("99", ["user_name", "name", "bio"], ["user_id"])).select("user_id")

    @reg.add("trend_week", with_sql("p", "m AS (SELECT max(created_at) AS top FROM p)") + "SELECT post_id, num_likes FROM p, m WHERE created_at >= top - INTERVAL 7 DAYS ORDER BY num_likes DESC, post_id LIMIT 10")
    def trend_week(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The newest time is read from the scan first, so that only the rows of the week are brought together.
        newest = table(spark, sf_dir, "post").agg(F.max("created_at")).first()[0]
        return trend(rows(spark, sf_dir, "p", F.expr("created_at >= :newest - INTERVAL 7 DAYS".replace(":newest", f"TIMESTAMP_NTZ '{newest}'")) if newest else None), 7, 10).select("post_id", "num_likes")

    @reg.add("top_liked", with_sql("pl", "n AS (SELECT post_id, count(*) AS likes FROM l GROUP BY post_id)") + "SELECT p.post_id, coalesce(n.likes, 0) AS likes FROM p LEFT JOIN n ON p.post_id = n.post_id ORDER BY likes DESC, p.post_id DESC LIMIT 15")
    def top_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = rows(spark, sf_dir, "l").groupBy("post_id").agg(F.count(F.lit(1)).alias("likes"))
        both = rows(spark, sf_dir, "p").select("post_id").join(n, "post_id", "left").withColumn("likes", F.coalesce("likes", F.lit(0)))
        return both.orderBy(F.desc("likes"), F.desc("post_id")).limit(15)

    @reg.add("latest_roots", with_sql("p") + "SELECT post_id, user_id FROM p WHERE original_post_id IS NULL ORDER BY post_id DESC LIMIT 50")
    def latest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p", "original_post_id IS NULL").orderBy(F.desc("post_id")).limit(50).select("post_id", "user_id")

    @reg.add("removed_posts", with_sql("p") + "SELECT post_id, num_reports FROM p WHERE post_id IN (SELECT record_key FROM removed_keys WHERE table_name = 'post')")
    def removed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
        gone = table(spark, sf_dir, "removed_keys").filter("table_name = 'post'").select(F.col("record_key").alias("post_id"))
        return rows(spark, sf_dir, "p").join(gone, "post_id", "left_semi").select("post_id", "num_reports")

    @reg.add("comments_in_list", with_sql("c") + "SELECT comment_id, post_id FROM c WHERE post_id IN (1, 2, 3, 5, 8, 13)")
    def comments_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "c", F.col("post_id").isin(1, 2, 3, 5, 8, 13)).select("comment_id", "post_id")

    @reg.add("others_likes", with_sql("pl") + "SELECT l.like_id, l.user_id, p.user_id AS author_id FROM l JOIN p ON l.post_id = p.post_id WHERE l.user_id <> p.user_id")
    def others_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
        author = rows(spark, sf_dir, "p").select("post_id", F.col("user_id").alias("author_id"))
        likes = rows(spark, sf_dir, "l").select("like_id", "user_id", "post_id")
        both = lookup_join(likes, author, ["post_id"], collect_hot(likes, ["post_id"]), ["like_id"])
        return both.filter("user_id <> author_id").select("like_id", "user_id", "author_id")

    @reg.add("own_likes", with_sql("pl") + "SELECT l.like_id, l.user_id FROM l JOIN p ON l.post_id = p.post_id WHERE l.user_id = p.user_id")
    def own_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
        author = rows(spark, sf_dir, "p").select("post_id", "user_id").withColumn("own", F.lit(True))
        return rows(spark, sf_dir, "l").join(author, ["post_id", "user_id"], "left_semi").select("like_id", "user_id")

    @reg.add("repeat_likes", with_sql("l") + "SELECT user_id, post_id, count(*) - 1 AS rejected FROM l WHERE post_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
    def repeat_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = rows(spark, sf_dir, "l", "post_id IS NOT NULL").groupBy("user_id", "post_id").agg((F.count(F.lit(1)) - 1).alias("rejected"))
        return n.filter("rejected > 0")

    @reg.add("clean_follows", with_sql("f") + "SELECT DISTINCT follower_id, followee_id FROM f WHERE follower_id <> followee_id")
    def clean_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "f").filter("follower_id <> followee_id").select("follower_id", "followee_id").distinct()

    @reg.add("label_tokens_left", with_sql("pc") + "SELECT 'post' AS table_name, post_id AS id FROM p WHERE contains(content, 'LBL:') UNION ALL SELECT 'post_comment', comment_id FROM c WHERE contains(content, 'LBL:')")
    def label_tokens_left(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda n, t, k: rows(spark, sf_dir, n).filter(F.col("content").contains("LBL:")).select(F.lit(t).alias("table_name"), F.col(k).alias("id"))
        return part("p", "post", "post_id").unionByName(part("c", "post_comment", "comment_id"))

    @reg.add("null_or_empty", with_sql("r") + "SELECT count(*) FILTER (WHERE coalesce(text, '') = '') AS n_empty, count(*) FILTER (WHERE coalesce(text, '') <> '') AS n_full, count(*) FILTER (WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10)) = '') AS n_blank FROM r")
    def null_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.coalesce("text", F.lit(""))
        return rows(spark, sf_dir, "r").agg(
            F.count(F.when(t == "", 1)).alias("n_empty"), F.count(F.when(t != "", 1)).alias("n_full"), F.count(F.when(F.regexp_replace(t, "[ \t\n]", "") == "", 1)).alias("n_blank")
        )

    @reg.add("text_coalesce", with_sql("p") + "SELECT post_id, coalesce(nullif(trim(quote_content), ''), nullif(trim(content), ''), '') AS text FROM p")
    def text_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
        full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
        return rows(spark, sf_dir, "p").select("post_id", F.coalesce(full("quote_content"), full("content"), F.lit("")).alias("text"))

    @reg.add("union_items", with_sql("pc") + "SELECT 'p_' || post_id AS item, user_id, content FROM p UNION ALL SELECT 'c_' || comment_id, user_id, content FROM c")
    def union_items(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda n, k: rows(spark, sf_dir, n).select(F.concat(F.lit(k[0] + "_"), F.col(k)).alias("item"), "user_id", "content")
        return part("p", "post_id").unionByName(part("c", "comment_id"))

    @reg.add(
        "set_operations",
        with_sql("plf", "a AS (SELECT DISTINCT user_id FROM p)", "b AS (SELECT DISTINCT user_id FROM l)")
        + "SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    )
    def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (rows(spark, sf_dir, n).select("user_id").distinct() for n in "pl")
        n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except"))

    @reg.add("group_reach", with_sql("gu") + "SELECT g.group_id, count(*) AS n_messages, count(DISTINCT u.user_id) AS n_members, max(g.sent_at) AS last_at FROM g JOIN u ON g.sender_id = u.agent_id GROUP BY g.group_id")
    def group_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = rows(spark, sf_dir, "u").select(F.col("agent_id").alias("sender_id"), "user_id").filter("sender_id IS NOT NULL")
        g = rows(spark, sf_dir, "g").select("message_id", "group_id", "sender_id", "sent_at")
        return lookup_join(g, u, ["sender_id"], collect_hot(g, ["sender_id"]), ["message_id"]).filter("user_id IS NOT NULL").groupBy("group_id").agg(
            F.count(F.lit(1)).alias("n_messages"), F.countDistinct("user_id").alias("n_members"), F.max("sent_at").alias("last_at")
        )

    @reg.add("comment_chain", with_sql("pcu") + "SELECT c.comment_id, p.post_id, p.user_id AS author_id, u.user_name FROM c JOIN p ON c.post_id = p.post_id JOIN u ON p.user_id = u.user_id")
    def comment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = rows(spark, sf_dir, "u").select(F.col("user_id").alias("author_id"), "user_name", F.lit(True).alias("known"))
        p = rows(spark, sf_dir, "p").select("post_id", F.col("user_id").alias("author_id"))
        p = lookup_join(p, u, ["author_id"], collect_hot(p, ["author_id"]), ["post_id"])
        c = rows(spark, sf_dir, "c").select("comment_id", "post_id")
        return lookup_join(c, p, ["post_id"], collect_hot(c, ["post_id"]), ["comment_id"]).filter("known").select("comment_id", "post_id", "author_id", "user_name")

    @reg.add("persona_of_user", with_sql("uk") + "SELECT u.user_id, k.persona_id, k.primary_label FROM u LEFT JOIN k ON lower(trim(u.user_name)) = k.persona_id")
    def persona_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "k").select("persona_id", "primary_label", F.col("persona_id").alias("key"))
        u = rows(spark, sf_dir, "u").select("user_id", F.lower(F.trim("user_name")).alias("key"))
        return u.join(k, "key", "left").select("user_id", "persona_id", "primary_label")

    @reg.add("overlapping_labels", with_sql("k") + "SELECT persona_id FROM k WHERE list_has_any(allowed_labels, ['misinfo', 'conspiracy'])")
    def overlapping_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = F.arrays_overlap("allowed_labels", F.array(F.lit("misinfo"), F.lit("conspiracy")))
        return rows(spark, sf_dir, "k").filter(hit).select("persona_id")

    @reg.add(
        "key_coverage",
        with_sql("pcf") + "SELECT (SELECT max(post_id) FROM p) AS max_post, (SELECT count(*) FROM p) AS n_posts, (SELECT max(post_id) FROM c) AS max_commented, (SELECT max(greatest(follower_id, followee_id)) FROM f) AS max_follow, (SELECT coalesce(max(comment_id), 0) FROM c) AS max_comment",
    )
    def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = lambda n, *a: rows(spark, sf_dir, n).agg(*a)
        p = one("p", F.max("post_id").alias("max_post"), F.count(F.lit(1)).alias("n_posts"))
        c = one("c", F.max("post_id").alias("max_commented"), F.coalesce(F.max("comment_id"), F.lit(0)).alias("max_comment"))
        f = one("f", F.max(F.greatest("follower_id", "followee_id")).alias("max_follow"))
        return p.join(F.broadcast(c)).join(F.broadcast(f)).select("max_post", "n_posts", "max_commented", "max_follow", "max_comment")

    @reg.add("update_names", with_sql("uk") + "SELECT u.user_id, coalesce(k.primary_label, u.name) AS name FROM u LEFT JOIN k ON u.user_name = k.persona_id")
    def update_names(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "k").select(F.col("persona_id").alias("user_name"), "primary_label")
        return rows(spark, sf_dir, "u").join(k, "user_name", "left").select("user_id", F.coalesce("primary_label", "name").alias("name"))

    @reg.add("delete_removed", with_sql("p") + "SELECT post_id FROM p WHERE NOT EXISTS (SELECT 1 FROM removed_keys r WHERE r.table_name = 'post' AND r.record_key = p.post_id)")
    def delete_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
        gone = table(spark, sf_dir, "removed_keys").filter("table_name = 'post'").select(F.col("record_key").alias("post_id"))
        return rows(spark, sf_dir, "p").select("post_id").join(gone, "post_id", "left_anti")

    @reg.add("incremental_scan", with_sql("p", "w AS (SELECT max(post_id) // 2 AS last_id FROM p)") + "SELECT post_id FROM p, w WHERE post_id > last_id AND contains(content, 'LBL:') ORDER BY post_id LIMIT 50")
    def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        last = table(spark, sf_dir, "post").agg(F.expr("max(post_id) div 2").alias("last_id"))
        p = rows(spark, sf_dir, "p").join(F.broadcast(last)).filter(F.col("post_id") > F.col("last_id"))
        return p.filter(F.col("content").contains("LBL:")).orderBy("post_id").limit(50).select("post_id")

    @reg.add("thread_context", with_sql("c") + "SELECT post_id, CAST(rank AS INTEGER) AS rank, comment_id FROM (SELECT post_id, comment_id, row_number() OVER (PARTITION BY post_id ORDER BY comment_id DESC) AS rank FROM c WHERE post_id IS NOT NULL) WHERE rank <= 2")
    def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rows(spark, sf_dir, "c").filter("post_id IS NOT NULL").select("post_id", "comment_id")
        return top_per_group(c, ["post_id"], [F.col("comment_id").desc()], 2).select("post_id", "rank", "comment_id")

    @reg.add("latest_two_times", with_sql("p", "t AS (SELECT DISTINCT created_at FROM (SELECT created_at FROM p WHERE created_at IS NOT NULL ORDER BY post_id DESC LIMIT 2))") + "SELECT count(*) AS n_posts FROM p WHERE created_at IN (SELECT created_at FROM t)")
    def latest_two_times(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").select("post_id", "created_at")
        last = p.filter("created_at IS NOT NULL").orderBy(F.desc("post_id")).limit(2).select("created_at").distinct()
        return p.join(F.broadcast(last), "created_at", "left_semi").agg(F.count(F.lit(1)).alias("n_posts"))

    @reg.add("post_gaps", with_sql("p", "t AS (SELECT post_id, epoch_us(created_at) // 1000000 AS s, lag(epoch_us(created_at) // 1000000) OVER (PARTITION BY user_id ORDER BY created_at, post_id) AS before FROM p WHERE created_at IS NOT NULL)") + "SELECT post_id, CASE WHEN before IS NULL THEN NULL ELSE CAST(least(300, greatest(1, s - before)) AS BIGINT) END AS gap_s FROM t")
    def post_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").filter("created_at IS NOT NULL").select("post_id", "user_id", "created_at", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("s"))
        both = neighbours(p, ["user_id"], [F.col("created_at").asc(), F.col("post_id").asc()], ["s"])
        gap = F.least(F.lit(300), F.greatest(F.lit(1), F.col("s") - F.col("prev_s")))
        return both.select("post_id", F.when(F.col("prev_s").isNotNull(), gap).otherwise(F.lit(None)).cast("long").alias("gap_s"))
