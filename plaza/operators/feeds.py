"""Feeds, search and trends over tables of posts, users and follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions.hashing import distinct_draw, hash_order
from plaza.lineage import cut
from plaza.operators.rank import grouped_rank, top_per_group
from plaza.operators.skew import collect_hot, lookup_join, spread_join

#: Primes above any number of posts taken as strides, so that steps of one stride meet each place once.
STRIDES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]


def contains(needle: str, texts: list[str], ids: list[str]) -> Column:
    """Whether ``needle`` occurs in a text (any case; ``%`` and ``_`` are wildcards) or in the digits of an id."""
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    for c in ids:
        hit = hit | F.coalesce(F.col(c).cast("string").contains(needle), F.lit(False))
    return hit


def search(df: DataFrame, needle: str, texts: list[str], ids: list[str]) -> DataFrame:
    """Rows of ``df`` for which ``contains`` holds."""
    return df.filter(contains(needle, texts, ids))


def trend(posts: DataFrame, days: int, k: int, now: Column | None = None) -> DataFrame:
    """The ``k`` most liked posts (post_id, num_likes, created_at) of the last ``days`` before ``now``, or before the newest."""
    if now is None:
        top = F.broadcast(posts.agg(F.max("created_at").alias("_now")))
        posts = posts.join(top)
    else:
        posts = posts.withColumn("_now", now)
    recent = posts.filter(F.expr(f"created_at >= _now - INTERVAL {days} DAYS")).drop("_now")
    return recent.orderBy(F.desc("num_likes"), "post_id").limit(k)


def following_feed(posts: DataFrame, follows: DataFrame, n: int) -> DataFrame:
    """(follower_id, rank, post_id, num_likes): each follower's ``n`` most liked posts of followed authors.

    No follower sees more than ``n`` posts of one author, so each author brings
    at most ``n`` rows to the join.
    """
    order = [F.col("num_likes").desc(), F.col("post_id").asc()]
    best = top_per_group(posts.select(F.col("user_id").alias("followee_id"), "post_id", "num_likes"), ["followee_id"], order, n).drop("rank")
    edges = follows.filter("followee_id IS NOT NULL").select("follower_id", "followee_id").distinct()
    seen = spread_join(edges, best, ["followee_id"], collect_hot(edges, ["followee_id"]), ["follower_id"])
    return top_per_group(seen, ["follower_id"], order, n).select("follower_id", "rank", "post_id", "num_likes")


def post_type(original: Column, quote: Column) -> Column:
    """``common``, ``repost`` or ``quote``."""
    return F.when(original.isNull(), "common").when(F.coalesce(quote, F.lit("")) == "", "repost").otherwise("quote")


def roots(posts: DataFrame) -> DataFrame:
    """``posts`` with ``root_id``: what a repost or quote of a row would point at.

    A repost resolves to the post it repeats, a quote stands for itself.
    """
    kind = post_type(F.col("original_post_id"), F.col("quote_content"))
    return posts.withColumn("root_id", F.when(kind == "repost", F.col("original_post_id")).otherwise(F.col("post_id")))


def random_posts(users: DataFrame, posts: DataFrame, k: int, seed: int) -> DataFrame:
    """(user_id, post_id): for each user ``k`` different posts drawn by hash, or all where there are no more."""
    ranked = grouped_rank(posts.select("post_id").distinct().withColumn("one", F.lit(0)), ["one"], [F.col("post_id").asc()], "k").select("k", "post_id")
    n = ranked.agg(F.count("*").alias("n"))
    draw = distinct_draw(F.col("n"), k, F.lit(seed), F.col("user_id"))
    drawn = users.select("user_id").distinct().join(F.broadcast(n)).select("user_id", F.explode(draw).alias("k"))
    return drawn.join(ranked, "k").select("user_id", "post_id")


def refresh(rec: DataFrame, posts: DataFrame, follows: DataFrame, n_rec: int, n_following: int) -> DataFrame:
    """(user_id, post_id): ``n_rec`` posts of each user's list ``rec`` drawn by hash, and their ``n_following`` most liked of followed authors; each once."""
    drawn = rec.withColumn("_h", hash_order("refresh", F.concat_ws(":", "user_id", "post_id")))
    drawn = top_per_group(drawn, ["user_id"], [F.asc("_h"), F.asc("post_id")], n_rec).select("user_id", "post_id")
    followed = following_feed(posts, follows, n_following).select(F.col("follower_id").alias("user_id"), "post_id")
    return drawn.unionByName(followed).distinct()


def with_comments(feed: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A row for each comment on each post of ``feed`` (user_id, post_id), and one with null comment columns for posts without any.

    A repost shows the content and the comments of the post it repeats.
    """
    p = roots(posts).select("post_id", "root_id", F.col("user_id").alias("author_id"))
    shown = posts.select(F.col("post_id").alias("root_id"), "content", "quote_content", "created_at", "num_likes", "num_dislikes", "num_shares")
    p = cut(lookup_join(p, shown, ["root_id"], collect_hot(p, ["root_id"]), ["post_id"]), "shown")
    feed = cut(feed, "feed")
    feed = cut(lookup_join(feed, p, ["post_id"], collect_hot(feed, ["post_id"]), ["user_id"]).filter("root_id IS NOT NULL"), "feed")
    c = comments.select(F.col("post_id").alias("root_id"), "comment_id", F.col("user_id").alias("comment_author_id"), F.col("content").alias("comment"))
    hot = collect_hot(feed, ["root_id"]) + collect_hot(c, ["root_id"])
    return spread_join(feed, c, ["root_id"], hot, ["user_id"], "left")


def matrix_rows(users: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user_id, position, post_id): all posts of ``pairs`` of each user in order of id, from 0; one row of nulls for users with none."""
    ranked = grouped_rank(pairs.select("user_id", "post_id").dropna().distinct(), ["user_id"], [F.col("post_id").asc()], "position")
    ranked = cut(ranked, "matrix")
    u = users.select("user_id").distinct()
    known = lookup_join(ranked, u.withColumn("_known", F.lit(True)), ["user_id"], collect_hot(ranked, ["user_id"]), ["post_id"]).filter("_known")
    none = u.join(ranked.select("user_id").distinct(), "user_id", "left_anti")
    nulls = [F.lit(None).cast(ranked.schema[c].dataType).alias(c) for c in ("position", "post_id")]
    return known.select("user_id", "position", "post_id").unionByName(none.select("user_id", *nulls))


def swapped(pairs: DataFrame, posts: DataFrame, tenths: int, seed: int) -> DataFrame:
    """(user_id, position, post_id, is_swapped): each user's whole list, ``tenths`` tenths of it (rounded down) replaced by other posts drawn by hash.

    Which places are swapped is drawn by hash too.  The j-th swap of a user
    takes the post j strides behind a start of the user's own in the ranked
    posts, so no user draws a post twice; a draw may be in the list already.
    """
    ranked = cut(grouped_rank(posts.select("post_id").distinct().withColumn("one", F.lit(0)), ["one"], [F.col("post_id").asc()], "k").select("k", F.col("post_id").alias("new_id")), "posts")
    n_posts = F.broadcast(ranked.agg(F.count("*").alias("_posts")))
    t = grouped_rank(pairs.select("user_id", "post_id").dropna().distinct(), ["user_id"], [F.col("post_id").asc()], "position")
    t = t.withColumn("_h", F.xxhash64(F.lit(seed), "user_id", "post_id"))
    t = cut(grouped_rank(t, ["user_id"], [F.col("_h").asc(), F.col("post_id").asc()], "_j"), "lists")
    sizes = t.groupBy("user_id").agg(F.floor(F.count("*") * tenths / 10).alias("_swaps"))
    t = lookup_join(t, sizes, ["user_id"], collect_hot(t, ["user_id"]), ["post_id"])
    keep = t.filter("_j >= _swaps").select("user_id", "position", "post_id", F.lit(False).alias("is_swapped"))
    stride = F.get(F.array(*[F.lit(x) for x in STRIDES]), F.pmod(F.xxhash64(F.lit(seed + 1), "user_id"), F.lit(len(STRIDES))).cast("int")).cast("long")
    swap = t.filter("_j < _swaps").join(n_posts).withColumn("k", F.pmod(F.pmod(F.xxhash64(F.lit(seed + 2), "user_id"), F.col("_posts")) + F.col("_j") * stride, F.col("_posts")))
    swap = swap.join(ranked, "k", "left").select("user_id", "position", F.coalesce("new_id", "post_id").alias("post_id"), F.col("new_id").isNotNull().alias("is_swapped"))
    return keep.unionByName(swap)
