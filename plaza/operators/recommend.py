"""Posts recommended to users from vectors of profiles, posts and liked posts.

The pool of posts that are ranked is a coarse sample of bounded size (POOL), so
it may be broadcast; every user is ranked against all of it by one matrix
product a batch of users, in the task that holds them.

Defined cases: a user or post without words has no length and scores 0 with
everything; a user's own posts are left out where ``own`` is not set; ties go to
the lesser post; a pool of fewer than ``k`` posts gives all of it; an empty pool
or no users give no rows; repeated users are not expected (one row per id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.rank import top_per_group
from plaza.operators.skew import collect_hot, lookup_join

#: Places of a text's vector, and posts that are ranked for every user.
DIMENSIONS, POOL = 64, 400
#: Steps after which a post's recency weight would vanish, and the least that is left of them.
SPAN, LEAST = 271.8, 0.8


def text_vectors(df: DataFrame, key: str, text: str, size: int = DIMENSIONS) -> DataFrame:
    """(key, vec): counts of a text's words (``a-z0-9``, lower case) by hash place, divided by their length, as (i, x); no row without words."""
    words = df.select(key, F.explode(F.array_remove(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), "")).alias("w"))
    place = F.pmod(F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("int"), F.lit(size))
    counts = words.groupBy(key, place.alias("i")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    both = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return both.select(key, F.transform("v", lambda s: F.struct(s["i"].alias("i"), (s["x"] / F.col("n")).alias("x"))).alias("vec"))


def liked_vectors(likes: DataFrame, vectors: DataFrame, last: int = 5) -> DataFrame:
    """(user_id, liked): the mean vector, as (i, x), of each user's ``last`` liked posts that have words; ``vectors`` is (post_id, vec)."""
    order = [F.col("created_at").desc_nulls_last(), F.col("like_id").desc()]
    top = top_per_group(likes.filter("post_id IS NOT NULL"), ["user_id"], order, last).select("user_id", "post_id", "like_id")
    known = lookup_join(top, vectors, ["post_id"], collect_hot(top, ["post_id"]), ["like_id"]).filter("vec IS NOT NULL")
    places = known.select("user_id", F.inline("vec")).groupBy("user_id", "i").agg(F.sum("x").alias("x"))
    n = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return places.join(n, "user_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("liked"))


def recommend(users: DataFrame, pool: DataFrame, k: int, recency: bool = False, liking: bool = False, own: bool = False) -> DataFrame:
    """(user_id, rank, post_id, score): the ``k`` best posts of ``pool`` for each of ``users`` (user_id, vec, liked).

    ``pool`` is (post_id, author_id, vec, age) with at most POOL rows.  The score
    is the cosine of profile and post; times the logarithm of what is left of
    SPAN after the post's age where ``recency`` is set; plus the similarity to
    the liked posts times half the span of the user's cosines where ``liking`` is.
    """
    rows = pool.orderBy("post_id").limit(POOL + 1).collect()
    if len(rows) > POOL:
        raise ValueError(f"a pool of more than {POOL} posts")
    matrix = np.zeros((len(rows), DIMENSIONS))
    for at, r in enumerate(rows):
        for i, x in r.vec or []:
            matrix[at, i] = x
    post, author = np.array([r.post_id for r in rows], np.int64), np.array([-1 if r.author_id is None else r.author_id for r in rows], np.int64)
    left = np.log(np.maximum(SPAN - np.array([r.age or 0.0 for r in rows]), LEAST) / 100) if recency else np.ones(len(rows))
    shared = users.sparkSession.sparkContext.broadcast((matrix, post, author, left))

    def dense(c: pa.Array) -> np.ndarray:
        out = np.zeros((len(c), DIMENSIONS))
        i, x = c.flatten().flatten()
        out[pc.list_parent_indices(c).to_numpy(), i.to_numpy()] = x.to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids, authors, weight = shared.value
        for b in batches:
            user = b.column(0).to_numpy()
            for i in range(0, len(user) if len(ids) else 0, 4096):
                part = slice(i, i + 4096)
                base = dense(b.column(1).slice(i, 4096)) @ m.T
                score = base * weight
                if liking:
                    score = score + (dense(b.column(2).slice(i, 4096)) @ m.T) * (base.max(1) - base.min(1))[:, None] / 2
                score = np.round(score, 6) + 0.0
                if not own:
                    score = np.where(authors[None, :] == user[part][:, None], -np.inf, score)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # the pool is in order of post, so ties go to the lesser
                got = np.take_along_axis(score, best, 1)
                row, rank = np.nonzero(np.isfinite(got))
                cols = [pa.array(user[part][row]), pa.array((rank + 1).astype(np.int32)), pa.array(ids[best[row, rank]]), pa.array(got[row, rank])]
                yield pa.RecordBatch.from_arrays(cols, ["user_id", "rank", "post_id", "score"])

    return users.select("user_id", "vec", "liked").mapInArrow(run, "user_id long, rank int, post_id long, score double")


def coarse_pool(posts: DataFrame, seed: str = "coarse", size: int = POOL) -> DataFrame:
    """(post_id, author_id, vec, age): ``size`` posts with a time in the order of their hashes; ``age`` counts days to the newest of them."""
    some = posts.filter("created_at IS NOT NULL").orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("post_id").cast("string"))), "post_id").limit(size)
    some = cut(some.select("post_id", F.col("user_id").alias("author_id"), "created_at", "content"), "pool")
    newest = F.broadcast(some.agg(F.max("created_at").alias("newest")))
    days = F.floor((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000)
    dated = some.join(newest).select("post_id", "author_id", days.cast("double").alias("age"))
    return dated.join(text_vectors(some, "post_id", "content"), "post_id", "left")


#: How the recommenders differ, by name.
METHODS = {"profile": {}, "recency": {"recency": True, "own": True}, "liked": {"liking": True}, "recency_liked": {"recency": True, "liking": True, "own": True}}


def recommend_by(method: str, users: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """``recommend`` by the method of a name; an unknown name raises."""
    if method not in METHODS:
        raise KeyError(f"no recommender {method}")
    return recommend(users, pool, k, **METHODS[method])
