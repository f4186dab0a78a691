"""Feeds, search, trends, splits and metrics on small literal tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaza.operators.datasets import apportion, balanced, class_metrics, multilabel_rate, split
from plaza.operators.feeds import following_feed, post_type, roots, search, trend
from plaza.operators.tfidf import hits, search as text_search, weights
from plaza.sources.registry import Source, load
from plaza.streaming.events import dispatch

POSTS = "post_id long, user_id long, original_post_id long, content string, quote_content string, created_at timestamp_ntz, num_likes int"
START = dt.datetime(2025, 1, 10)


def posts(spark, rows):
    return spark.createDataFrame(rows, POSTS)


def test_search_by_text_and_id(spark):
    p = posts(spark, [(1, 1, None, "Hello World from Alice!", None, START, 100), (2, 2, None, "Bob's first post!", None, START, 150), (3, 3, None, "Charlie says hi!", None, START, 200), (25, 9, None, None, None, None, 0)])
    found = lambda needle: {r.post_id for r in search(p, needle, ["content"], ["post_id", "user_id"]).collect()}
    assert found("bob") == {2}
    assert found("2") == {2, 25}
    assert found("zzz") == set()
    assert found("H%i!") == {3}


def test_trend_window_and_order(spark):
    p = posts(spark, [(k, 1, None, f"Post {k}", None, START - dt.timedelta(days=k), k) for k in range(10)])
    later = F.lit(START + dt.timedelta(minutes=1)).cast("timestamp_ntz")
    assert [r.content for r in trend(p, 7, 1, later).collect()] == ["Post 6"]
    assert [r.content for r in trend(p, 7, 2).collect()] == ["Post 7", "Post 6"]
    assert trend(p.limit(0), 7, 1).count() == 0


def test_following_feed_ties_and_limits(spark):
    p = posts(spark, [(i, i % 2 + 1, None, "x", None, START, 5 if i < 4 else i) for i in range(8)])
    f = spark.createDataFrame([(7, 1), (7, 2), (7, 1), (8, 2), (9, None), (10, 99)], "follower_id long, followee_id long")
    got = {(r.follower_id, r["rank"], r.post_id) for r in following_feed(p, f, 3).collect()}
    assert got == {(7, 1, 7), (7, 2, 6), (7, 3, 0), (8, 1, 7), (8, 2, 1), (8, 3, 3)}


def test_types_and_roots_of_a_chain(spark):
    p = posts(
        spark,
        [(1, 1, None, "a", None, START, 0), (2, 2, 1, None, None, START, 0), (3, 1, 1, None, "q", START, 0), (4, 2, 1, None, "q2", START, 0), (5, 1, 3, None, "", START, 0), (6, 2, 3, None, "q3", START, 0)],
    )
    kinds = {r.post_id: r.k for r in p.select("post_id", post_type(F.col("original_post_id"), F.col("quote_content")).alias("k")).collect()}
    assert kinds == {1: "common", 2: "repost", 3: "quote", 4: "quote", 5: "repost", 6: "quote"}
    assert {r.post_id: r.root_id for r in roots(p).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6}



def test_split_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(f"k{i}", "ab"[i % 2]) for i in range(40)], "key string, s string")
    names = [("train", 70), ("test", 85), ("holdout", 100)]
    got = split(df, "key", ["s"], "42", names)
    assert {(r.s, r.split): r["count"] for r in got.groupBy("s", "split").count().collect()} == {(s, n): c for s in "ab" for n, c in (("train", 14), ("test", 3), ("holdout", 3))}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, split(df, "key", ["s"], "42", names).collect()))


def test_balanced(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(50)], "key int, harmful boolean")
    assert {r.harmful: r["count"] for r in balanced(df, "key", "harmful", "1").groupBy("harmful").count().collect()} == {True: 10, False: 10}


@pytest.mark.parametrize(("weights_", "total", "want"), [({"a": 1.0, "b": 1.0, "c": 1.0}, 10, {"a": 4, "b": 3, "c": 3}), ({"a": 0.5, "b": 0.25, "c": 0.25}, 7, {"a": 3, "b": 2, "c": 2}), ({"a": 1.0}, 5, {"a": 5})])
def test_apportion(spark, weights_, total, want):
    df = spark.createDataFrame(list(weights_.items()), "k string, w double")
    assert {r.k: r.n for r in apportion(df, "k", "w", total).collect()} == want


def test_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "")], "truth string, guess string")
    assert {(r["class"], r.support, r.f1) for r in class_metrics(df).collect()} == {("a", 2, 0.666667), ("b", 1, 0.666667), ("c", 1, 0.0), ("", 0, 0.0)}


def test_multilabel_rate(spark):
    df = spark.createDataFrame([(["benign"],), (["Misinfo", "conspiracy"],), (["alpha"],), ([],), (None,), (["benign", "alpha"],)], "l array<string>")
    assert tuple(multilabel_rate(df, "l").first()) == (3, 1, 0.333333, 1)
    assert tuple(multilabel_rate(df.limit(0), "l").first()) == (0, 0, 0.0, 0)


def test_tfidf_search(spark):
    docs = spark.createDataFrame([(1, "red fox red fox den"), (2, "blue fox sea"), (3, "sea shell sea"), (4, None), (5, "")], "id long, t string")
    w, idf = weights(docs, "id", "t", min_df=1, max_df=1.0)
    length = {r.id: r.s for r in w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()}
    assert length == {i: pytest.approx(1.0) for i in (1, 2, 3)}
    q = spark.createDataFrame([(0, "fox"), (1, "sea fox"), (2, "nothing")], "query_id int, text string")
    best = {(r.query_id, r["rank"]): r.id for r in text_search(docs, "id", "t", q, 1).collect()}
    assert best[0, 1] in (1, 2) and best[1, 1] == 2 and (2, 1) not in best
    assert hits(docs, "id", "t", q).count() == 5
    assert idf.count() == 3 or idf.count() == 6


def test_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,l\nx,1\n")
    (tmp_path / "b.jsonl").write_text('{"t": "y"}\n')
    sources = {"a": Source(f"{tmp_path}/a.csv", "csv", "t", "l"), "b": Source(f"{tmp_path}/b.jsonl", "jsonl", "t"), "c": Source("x", "xml", "t")}
    assert [tuple(r) for r in load(spark, sources, "a").collect()] == [("x", "1")]
    assert [tuple(r) for r in load(spark, sources, "b").collect()] == [("y", None)]
    with pytest.raises(ValueError, match="xml"):
        load(spark, sources, "c")
    with pytest.raises(KeyError):
        load(spark, sources, "d")


def test_dispatch_by_action(spark, tmp_path):
    spark.createDataFrame([(1, "like"), (2, "follow"), (3, "like")], "id int, action string").write.parquet(f"{tmp_path}/in")
    seen: dict[str, list[int]] = {"like": [], "follow": []}
    handlers = {k: (lambda df, k=k: seen[k].extend(r.id for r in df.collect())) for k in seen}
    dispatch(spark, spark.readStream.schema("id int, action string").parquet(f"{tmp_path}/in"), handlers, "action", f"{tmp_path}/state")
    assert {k: sorted(v) for k, v in seen.items()} == {"like": [1, 3], "follow": [2]}
