"""Recommendations, platform actions, configuration, keyed JSON and table changes on small literal inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaza.functions import harm
from plaza.functions.text import enforced
from plaza.operators.actions import counters, outcomes
from plaza.operators.graph import random_edges
from plaza.operators.recommend import coarse_pool, liked_vectors, recommend, recommend_by, text_vectors
from plaza.sources.config import read_mappings, read_phrases, read_sources, read_yaml
from plaza.sources.registry import Source, load_pair
from plaza.sources.sinks import add_column, append_rows, backup, reset_column, write_by_split
from plaza.sources.tables import read_json_keyed
from plaza.streaming.events import active_events, percentiles_every, poll

T0 = dt.datetime(2025, 1, 1)
POSTS = [(1, 0, "I like dogs"), (2, 1, "I like cats"), (3, 9, "birds"), (4, 9, None), (5, None, "")]


def pool(spark, rows=POSTS):
    df = spark.createDataFrame([(p, u, x, T0 + dt.timedelta(days=p), "clash") for p, u, x in rows], "post_id long, user_id long, content string, created_at timestamp_ntz, vec string")
    return coarse_pool(df)


def users(spark, bios):
    u = spark.createDataFrame(bios, "user_id long, bio string")
    return u.select("user_id").join(text_vectors(u, "user_id", "bio"), "user_id", "left").withColumn("liked", F.lit(None).cast("array<struct<i:int,x:double>>"))


def lists(df):
    out: dict[int, list[int]] = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append(r.post_id)
    return out


def test_recommend_by_profile(spark):
    got = lists(recommend(users(spark, [(0, "I like cats"), (1, "I like dogs"), (7, None)]), pool(spark), 2))
    assert got == {0: [2, 3], 1: [1, 3], 7: [1, 2]}  # own posts are left out, ties go to the lesser post
    assert lists(recommend(users(spark, [(0, "I like cats")]), pool(spark), 2, own=True)) == {0: [2, 1]}
    assert lists(recommend(users(spark, [(0, "x")]), pool(spark, POSTS[:1]), 50)) == {}
    assert recommend(users(spark, []), pool(spark), 2).count() == 0
    assert recommend(users(spark, [(0, "x")]), pool(spark, []), 2).count() == 0


def test_recommend_all_posts_where_there_are_no_more(spark):
    got = lists(recommend(users(spark, [(20, "a"), (21, None)]), pool(spark, POSTS[:2]), 2))
    assert {u: sorted(p) for u, p in got.items()} == {20: [1, 2], 21: [1, 2]}


def test_recommend_by_likes_and_recency(spark):
    likes = spark.createDataFrame([(1, 0, 3, T0), (2, 0, None, T0), (3, 0, 99, T0), (4, 0, 4, T0)], "like_id long, user_id long, post_id long, created_at timestamp_ntz")
    p = spark.createDataFrame([(i, x) for i, _, x in POSTS], "post_id long, content string")
    liked = liked_vectors(likes, text_vectors(p, "post_id", "content"))
    both = users(spark, [(0, "I like cats"), (1, "I like cats")]).drop("liked").join(liked, "user_id", "left")
    score = {(r.user_id, r.post_id): r.score for r in recommend(both, pool(spark), 5, liking=True, own=True).collect()}
    assert score[0, 3] > score[1, 3] == 0 and score[0, 2] == score[1, 2]
    old = {r.post_id: r.score for r in recommend(users(spark, [(0, "I like cats")]), pool(spark), 5, recency=True, own=True).collect()}
    assert old[2] > 0 and old[2] != score[0, 2]


def test_pool_is_bounded(spark):
    with pytest.raises(ValueError):
        recommend(users(spark, [(0, "x")]), spark.range(500).select(F.col("id").alias("post_id"), F.lit(1).cast("long").alias("author_id"), F.lit(None).cast("array<struct<i:int,x:double>>").alias("vec"), F.lit(0.0).alias("age")), 2)


def test_action_outcomes(spark):
    log = [
        ("like", 1, 5, "post", 10, T0, True, True), ("like", 2, 5, "post", 10, T0 - dt.timedelta(days=1), True, True), ("like", 3, 6, "post", 10, None, True, True), ("like", 4, 7, "post", 10, T0, True, True),
        ("like", 5, 7, "post", 99, T0, True, True), ("like", 6, 7, "post", None, T0, True, True), ("comment", 1, 7, "post", 10, T0, False, False), ("comment", 2, 7, "post", 10, T0, False, False), ("like", 1, 5, "post", 10, T0, True, True),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in log], "action string, id long, actor long, kind string, target long, at timestamp_ntz, forbid_own boolean, once boolean, found string")
    known = spark.createDataFrame([("post", 10, 7)], "kind string, target long, owner long")
    done = outcomes(df, known)
    assert {(r.action, r.id): r.outcome for r in done.collect()} == {
        ("like", 1): "repeated", ("like", 2): "accepted", ("like", 3): "accepted", ("like", 4): "own", ("like", 5): "missing", ("like", 6): "missing", ("comment", 1): "accepted", ("comment", 2): "accepted",
    }
    assert {tuple(r) for r in counters(done, "post").collect()} == {(10, "like", 2), (10, "comment", 2)}
    assert outcomes(df.limit(0), known).count() == 0 and {r.outcome for r in outcomes(df, known.limit(0)).collect()} == {"missing"}


def test_second_categories_and_enforced_tokens(spark):
    df = spark.createDataFrame([("kys sheeple", ["LBL:A", "LBL:B"]), ("x <LBL:OLD>y</LBL:OLD>", []), (None, ["LBL:A"])], "t string, w array<string>")
    assert [r[0] for r in df.select(harm.second_categories(F.col("t"))).collect()] == [["bullying", "misinfo"], ["benign"], ["benign"]]
    assert [r[0] for r in df.select(enforced(F.col("t"), F.col("w"))).collect()] == ["kys sheeple LBL:A LBL:B", "x  y", None]


def test_random_edges_of_exact_number(spark):
    nodes = spark.createDataFrame([(i * 3,) for i in range(40)] + [(0,), (None,)], "v long")
    got = [tuple(r) for r in random_edges(nodes, "v", 500).collect()]
    assert len(got) == len(set(got)) == 500 and all(a != b for a, b in got)
    assert len({a for a, _ in got}) > 30 and len({b for _, b in got}) > 30
    assert random_edges(nodes, "v", 10_000).distinct().count() == 40 * 39
    assert random_edges(nodes.limit(1), "v", 5).count() == random_edges(nodes.limit(0), "v", 5).count() == 0


def test_yaml_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("datasets:\n  a:\n    source: {path: p.csv, format: csv, text_column: t, label_columns: [l, m]}\n  b: {}\n")
    (tmp_path / "p.yaml").write_text("LBL:A:\n  - one\n  - 'two'\nLBL:B:\n")
    (tmp_path / "m.yaml").write_text("label_mappings:\n  toxic:\n    archetypes:\n      - {archetype: x, weight: 0.7, tokens: [LBL:X]}\n      - {archetype: y}\n")
    (tmp_path / "e.yaml").write_text("")
    s = read_sources(f"{tmp_path}/r.yaml")
    assert set(s) == {"a"} and (s["a"].path, s["a"].format, s["a"].text, s["a"].label) == ("p.csv", "csv", "t", "l")
    assert [tuple(r) for r in read_phrases(spark, f"{tmp_path}/p.yaml").orderBy("at").collect()] == [("LBL:A", 0, "one"), ("LBL:A", 1, "two")]
    assert [tuple(r) for r in read_mappings(spark, f"{tmp_path}/m.yaml").orderBy("archetype").collect()] == [("toxic", "x", 0.7, ["LBL:X"]), ("toxic", "y", 1.0, [])]
    assert read_yaml(f"{tmp_path}/e.yaml") == {} and read_phrases(spark, f"{tmp_path}/e.yaml").count() == 0


def test_keyed_json_and_table_changes(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"a": {"n": 1, "tags": ["x"]},\n "b": {"n": 2}, "c": 3}')
    got = {r.id: (r.n, r.tags) for r in read_json_keyed(spark, f"{tmp_path}/k.json", "n int, tags array<string>", "id").collect()}
    assert got == {"a": (1, ["x"]), "b": (2, None), "c": (None, None)}
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, split string")
    path = f"{tmp_path}/t"
    assert backup(df, path) == 2 and backup(df.filter("id = 1"), path) == 1
    append_rows(spark.createDataFrame([(5,)], "id long"), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "x"), (5, None)}
    with pytest.raises(ValueError):
        append_rows(df.withColumn("other", F.lit(1)), path)
    assert [tuple(r) for r in reset_column(add_column(add_column(df, "n", "int", 3), "n", "int", 9), "split").collect()] == [(1, None, 3), (2, None, 3)]
    write_by_split(df, "split", f"{tmp_path}/s", f"{tmp_path}/all")
    assert spark.read.json(f"{tmp_path}/s").count() == spark.read.json(f"{tmp_path}/all").count() == 2


def test_recommenders_by_name(spark):
    u = users(spark, [(0, "I like cats")])
    assert lists(recommend_by("profile", u, pool(spark), 1)) == {0: [2]}
    assert lists(recommend_by("recency", u, pool(spark), 1)) == {0: [2]}
    with pytest.raises(KeyError):
        recommend_by("none", u, pool(spark), 1)


def test_poll_keeps_the_greatest_key(spark):
    t = spark.createDataFrame([(3,), (1,), (None,), (7,)], "id long")
    new, since = poll(t, None, most=2)
    assert [r.id for r in new.collect()] == [1, 3] and since == 3
    new, since = poll(t, since)
    assert [r.id for r in new.collect()] == [7] and since == 7
    new, since = poll(t, since)
    assert new.count() == 0 and since == 7


def test_coordinated_events_expire_and_merge(spark):
    e = spark.createDataFrame([("a", 1, 5, 0.2), ("a", 3, 9, 0.1), ("b", 1, 2, 0.9), ("c", 4, 1, 0.2), ("d", 4, 2, 0.5), ("e", 4, 2, 0.1)], "topic string, starts int, lasts int, strength double")
    assert [tuple(r) for r in active_events(e, 4).collect()] == [("d", 0.5, 6), ("a", 0.2, 12), ("c", 0.2, 5)]
    assert active_events(e, 99).count() == 0


def test_percentiles_are_refreshed_every_so_many_rows(spark):
    df = spark.range(250).select(F.col("id").alias("at"), (F.col("id") % 10).cast("double").alias("v"))
    assert [tuple(r) for r in percentiles_every(df, "at", "v").orderBy("upto").collect()] == [(100, 4.5, 9.0), (200, 4.5, 9.0)]
    assert percentiles_every(df.limit(5), "at", "v").count() == 0


def test_pairs_of_data_sets(spark, tmp_path):
    for n in ("train", "test"):
        (tmp_path / f"{n}.jsonl").write_text(f'{{"t": "{n}"}}\n')
    s = {f"x_{n}": Source(f"{tmp_path}/{n}.jsonl", "jsonl", "t") for n in ("train", "test")}
    assert [df.first().text for df in load_pair(spark, s, "x")] == ["train", "test"]
