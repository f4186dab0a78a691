"""Queries and operators give the whole result: every user, every pair, every row."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from plaza.operators.feeds import matrix_rows, random_posts, refresh, swapped, with_comments
from plaza.operators.graph import two_hop
from plaza.operators.skew import spread_join
from plaza.operators.tfidf import best_phrases
from plaza.plans.extras import BANK
from plaza.sources.domain import rows

DIR = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, DIR).collect()


def ids(spark, name, key):
    return {r[0] for r in rows(spark, DIR, name).select(key).collect()}


def test_rec_random_posts_serves_every_user(spark):
    got = defaultdict(list)
    for r in run(spark, "rec_random_posts"):
        got[r.user_id].append(r.post_id)
    posts = ids(spark, "p", "post_id")
    assert set(got) == ids(spark, "u", "user_id")
    assert all(len(x) == len(set(x)) == 5 and set(x) <= posts for x in got.values())


@pytest.mark.parametrize("n", [0, 1, 3, 4, 40])
def test_random_posts_without_repeats(spark, n):
    users = spark.createDataFrame([(i,) for i in range(400)] + [(7,)], "user_id long")
    posts = spark.createDataFrame([(100 + i,) for i in range(n)], "post_id long")
    got = [tuple(r) for r in random_posts(users, posts, 4, 1).collect()]
    assert len(got) == len(set(got)) == 400 * min(n, 4)
    if n == 40:
        assert all(15 <= c <= 75 for c in Counter(p for _, p in got).values())  # 40 expected


def test_feed_refresh_serves_every_user(spark):
    got, shown = set(), defaultdict(set)
    for r in run(spark, "feed_refresh_comments"):
        got.add((r.user_id, r.post_id))
        shown[r.root_id].add(r.comment_id)
    rec = {tuple(r) for r in run(spark, "rec_random_posts")}
    liked = {(r.post_id, r.user_id): r.num_likes for r in rows(spark, DIR, "p").collect()}
    follows = {(r.follower_id, r.followee_id) for r in rows(spark, DIR, "f").collect() if r.followee_id is not None}
    comments = defaultdict(set)
    for r in rows(spark, DIR, "c").collect():
        comments[r.post_id].add(r.comment_id)
    users = ids(spark, "u", "user_id")
    assert {u for u, _ in got} >= users
    best = defaultdict(list)
    for u, a in follows:
        best[u] += [(-n, p) for (p, w), n in liked.items() if w == a]
    best = {(u, p) for u, x in best.items() for _, p in sorted(x)[:2]}
    assert best <= got
    assert got - best <= rec
    assert all(sum(x in got for x in rec if x[0] == u) >= 3 for u in list(users)[:20])
    assert all(c == comments[p] or (c == {None} and not comments[p]) for p, c in shown.items())


def test_refresh_on_literal_tables(spark):
    post = "post_id long, user_id long, original_post_id long, content string, quote_content string, created_at timestamp_ntz, num_likes int, num_dislikes int, num_shares int"
    posts = spark.createDataFrame([(1, 10, None, "a", None, None, 5, 0, 0), (2, 10, None, "b", None, None, 9, 0, 0), (3, 11, 1, None, None, None, 1, 0, 0), (4, 12, None, "d", None, None, 7, 0, 0)], post)
    comments = spark.createDataFrame([(50, 1, 20, "x"), (51, 1, 21, "y"), (52, 4, 20, "z")], "comment_id long, post_id long, user_id long, content string")
    follows = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (2, None)], "follower_id long, followee_id long")
    rec = spark.createDataFrame([(1, 2), (1, 4), (3, 2)], "user_id long, post_id long")
    feed = refresh(rec, posts, follows, 5, 1)
    assert sorted(tuple(r) for r in feed.collect()) == [(1, 2), (1, 4), (2, 3), (3, 2)]
    got = {(r.user_id, r.post_id, r.root_id, r.content, r.comment_id) for r in with_comments(feed, posts, comments).collect()}
    assert got == {(1, 2, 2, "b", None), (1, 4, 4, "d", 52), (2, 3, 1, "a", 50), (2, 3, 1, "a", 51), (3, 2, 2, "b", None)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_of_hot_keys(spark, how):
    left = spark.createDataFrame([(i, i % 5 if i < 50 else 1) for i in range(120)] + [(900, 77), (901, None)], "a long, k long")
    right = spark.createDataFrame([(i, i % 4) for i in range(30)], "b long, k long")
    order = lambda df: sorted(tuple(str(x) for x in r) for r in df.select("k", "a", "b").collect())
    assert order(spread_join(left, right, ["k"], [(1,), (77,), (1,)], ["a"], how)) == order(left.join(right, ["k"], how))


def brute_two_hop(edges):
    e = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    return Counter((a, d) for a, b in e for c, d in e if b == c and a != d and (a, d) not in e)


def test_two_hop_links_of_every_source(spark):
    edges = [(r.follower_id, r.followee_id) for r in rows(spark, DIR, "f").collect()]
    got = {(r.s, r.t): r.common for r in run(spark, "two_hop_links")}
    assert got == brute_two_hop(edges)
    assert any(s % 20 for s, _ in got)


def test_two_hop_with_a_hot_middle_node(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)] + [(i, 0) for i in range(60)] * 2 + [(0, i) for i in range(30, 40)] + [(1, None), (None, 2)]
    got = {(r.s, r.t): r.common for r in two_hop(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_two_hop(edges)
    assert two_hop(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_matrix_rows_hold_lists_of_any_length(spark):
    pairs = [(1, p) for p in range(300)] * 2 + [(2, 5), (2, None), (None, 5), (9, 1)]
    users = spark.createDataFrame([(1,), (2,), (3,), (3,)], "user_id long")
    pairs = [(u, p, None) for u, p in pairs]  # other columns may be null
    got = {tuple(r) for r in matrix_rows(users, spark.createDataFrame(pairs, "user_id long, post_id long, created_at timestamp_ntz")).collect()}
    assert got == {(1, p, p) for p in range(300)} | {(2, 0, 5), (3, None, None)}


def test_rec_matrix_rows_keep_every_pair(spark):
    likes = {(r.user_id, r.post_id) for r in rows(spark, DIR, "l").collect() if r.user_id is not None and r.post_id is not None}
    users = ids(spark, "u", "user_id")
    got = [(r.user_id, r.post_id) for r in run(spark, "rec_matrix_rows")]
    assert len(got) == len(set(got))
    assert {x for x in got if x[1] is not None} == {x for x in likes if x[0] in users}
    assert {u for u, _ in got} == users


def brute_phrase(bank, token, text, key):
    phrases = bank.get(token, [])
    if not phrases:
        return f"<{token}>"
    split = lambda x: Counter(re.findall(r"\w\w+", x.lower()))
    docs = [split(x) for x in phrases]
    df = Counter(t for d in docs for t in d)
    if not df:
        return phrases[int(hashlib.md5(f"{key}-{token}".encode()).hexdigest(), 16) % len(phrases)]
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    context = split(text)
    dot = lambda d: sum(n * idf[t] ** 2 * context[t] for t, n in d.items())
    score = [round(dot(d) / math.sqrt(sum((n * idf[t]) ** 2 for t, n in d.items())), 9) if d else 0 for d in docs]
    return phrases[score.index(max(score))]


def test_best_phrases_against_brute_force(spark):
    bank = {"LBL:A": ["green tea and honey", "red wine", "tea tea pot", "na\u00efve tea"], "LBL:B": ["x", "y", "z"], "LBL:C": []}
    texts = ["red pots <LBL:A> of wine", "tea pot <LBL:A> and <LBL:A> or <LBL:B>", "nothing <LBL:A>", "na\u00efve <LBL:A> <LBL:C> <LBL:D>", "no token, honey", None, "honey <LBL:B>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(t, i, x) for t, v in bank.items() for i, x in enumerate(v)], "token string, at int, phrase string")
    got = sorted(tuple(r) for r in best_phrases(docs, "id", "text", table).collect())
    want = [(i, k, t, brute_phrase(bank, t, x, i)) for i, x in enumerate(texts) for k, t in enumerate(re.findall("<(LBL:[A-z0-9_]+)>", x or ""))]
    assert got == want
    assert got[0][3] == "red wine"


def test_phrase_by_text_of_every_token(spark):
    want = [(r.post_id, k, t, brute_phrase(BANK, t, r.content, r.post_id)) for r in rows(spark, DIR, "p").collect() for k, t in enumerate(re.findall("<(LBL:[A-z0-9_]+)>", r.content or ""))]
    assert sorted(tuple(r) for r in run(spark, "phrase_by_text")) == sorted(want)
    assert want


def test_swapped_lists(spark):
    lists = {1: range(40), 2: range(9), 3: range(10, 25), 4: range(600)}
    pairs = spark.createDataFrame([(u, p, None) for u, x in lists.items() for p in x] + [(1, None, None), (None, 3, None)], "user_id long, post_id long, created_at timestamp_ntz")
    posts = spark.createDataFrame([(p,) for p in range(1000, 1100)], "post_id long")
    got = defaultdict(dict)
    for r in swapped(pairs, posts, 1, 5).collect():
        got[r.user_id][r.position] = (r.post_id, r.is_swapped)
    assert set(got) == set(lists)
    for u, x in lists.items():
        assert sorted(got[u]) == list(range(len(x)))
        new = [p for p, s in got[u].values() if s]
        assert len(new) == len(set(new)) == len(x) // 10
        assert all(1000 <= p < 1100 for p in new)
        assert all(p == x[i] for i, (p, s) in got[u].items() if not s)
    assert not any(s for r in [swapped(pairs, posts.limit(0), 1, 5)] for *_, s in r.collect())


def test_diversity_swap_posts_draws_real_posts(spark):
    likes = Counter(u for u, _ in {(r.user_id, r.post_id) for r in rows(spark, DIR, "l").collect() if r.user_id is not None and r.post_id is not None})
    posts = ids(spark, "p", "post_id")
    got = run(spark, "diversity_swap_posts")
    assert Counter(r.user_id for r in got) == likes
    assert Counter(r.user_id for r in got if r.is_swapped) == Counter({u: n // 10 for u, n in likes.items() if n >= 10})
    assert all(r.post_id in posts for r in got if r.is_swapped)
