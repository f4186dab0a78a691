"""Operators of the core against brute force and on odd inputs."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaza.operators import bloom
from plaza.operators.components import connected_components
from plaza.operators.graph import degrees, triangles, undirected
from plaza.operators.hierarchy import descendants, hierarchy, walk
from plaza.operators.nested import blank, flatten_fields, flatten_lists, flatten_objects, json_text, list_children, pair_value, parse_object, parse_records, text_list
from plaza.operators.orphans import find_orphans, orphan_report, parents
from plaza.operators.rank import grouped_rank, neighbours, top_per_group
from plaza.operators.search import nearest
from plaza.operators.select import smallest_per_group
from plaza.operators.skew import collect_hot, lookup_join

T0 = dt.datetime(2025, 1, 1)
REFS = "table_name string, record_id long, kind int, ref long, at timestamp_ntz, created_at string"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def orphans(spark, refs, created, removed, **more):
    r = spark.createDataFrame([("t", i, 0, k, day(a), "clash") for i, k, a in refs], REFS)
    c = spark.createDataFrame([(0, k, day(a)) for k, a in created], "kind int, ref long, created_at timestamp_ntz")
    g = spark.createDataFrame([(0, k, day(a)) for k, a in removed], "kind int, ref long, removed_at timestamp_ntz")
    return find_orphans(r, parents(c, g), **more)


def test_orphans_cases(spark):
    refs = [(1, 10, 5), (2, 99, 5), (3, 10, 0), (4, None, 5), (5, 11, 5), (6, 11, 1), (7, 10, None), (8, 11, None), (9, 12, 5), (1, 10, 5), (10, 13, 5)]
    created = [(10, 2), (10, 3), (11, 1), (12, None)]
    removed = [(11, 4), (13, 1), (13, None)]
    got = {r.record_id: r.reason for r in orphans(spark, refs, created, removed).collect()}
    assert got == {1: None, 2: "missing", 3: "later", 5: "removed", 6: None, 7: None, 8: None, 9: None, 10: "missing"}


def test_orphans_empty_tables(spark):
    assert orphans(spark, [], [(1, 1)], []).count() == 0
    assert [r.reason for r in orphans(spark, [(1, 5, 1)], [], []).collect()] == ["missing"]


def test_orphans_hot_key(spark):
    rng = random.Random(1)
    refs = [(i, 7 if i % 3 == 0 else rng.randrange(400), rng.randrange(10)) for i in range(3000)]
    created = [(k, rng.randrange(6)) for k in range(0, 400, 2)] + [(7, 3)]
    removed = [(k, rng.randrange(10)) for k in range(0, 400, 7)]
    born, gone = {}, {}
    for k, a in created:
        born[k] = min(a, born.get(k, a))
    for k, a in removed:
        gone[k] = a
    want = {i: "missing" if k not in born else "later" if born[k] > a else "removed" if k in gone and gone[k] <= a else None for i, k, a in refs}
    assert {r.record_id: r.reason for r in orphans(spark, refs, created, removed).collect()} == want
    assert bloom.shards_for(201, 1200) == 3  # more keys than one filter holds: several filters, a pass each
    assert {r.record_id: r.reason for r in orphans(spark, refs, created, removed, max_bits=1200).collect()} == want


def test_orphan_report(spark):
    rows = orphans(spark, [(1, 10, 5), (2, 99, 40), (2, 99, 40), (3, 99, None)], [(10, 1)], [])
    got = {r.month: (r.n_references, r.n_orphans) for r in orphan_report(rows).collect()}
    assert got == {"2025-01": (1, 0), "2025-02": (1, 1), None: (1, 1)}


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(0, 20000, 3).select(F.col("id").alias("k"))
    h1, h2 = bloom.hashes(F.col("k"))
    bits = bloom.build(keys, h1, h2, 6667)
    rows = spark.range(30000).select("id", *[h.alias(n) for h, n in zip(bloom.hashes(F.col("id")), "ab", strict=True)]).toPandas()
    hit = bloom.contains(bits, rows["a"].to_numpy(), rows["b"].to_numpy())
    inside = (rows["id"] < 20000) & (rows["id"] % 3 == 0)
    assert hit[inside].all()
    assert hit[~inside].mean() < 0.01


def test_bloom_size_is_bounded():
    assert bloom.blocks_for(10**12) * bloom.BLOCK_BITS <= 2 * bloom.MAX_BITS
    assert bloom.blocks_for(0) == 1


def brute_tree(links):
    up = {}
    for n, p in links:
        if n is not None:
            up[n] = p if up.get(n) is None or p is None else min(up[n], p)
    out = {}
    for n in up:
        path, seen = [n], {n}
        while up[path[-1]] is not None and up[path[-1]] in up:
            p = up[path[-1]]
            if p in seen:
                ring = path[path.index(p):]
                out[n] = (None, None, None, min(ring))
                break
            seen.add(p)
            path.append(p)
        else:
            out[n] = (path[-1], len(path) - 1, tuple(reversed(path)), None)
    return out


def tree(spark, links, kind="long", **more):
    df = spark.createDataFrame([(n, p, "x") for n, p in links], f"id {kind}, up {kind}, node string")
    return hierarchy(df, "id", "up", **more)


@pytest.mark.parametrize("limit", [100_000, 3])
def test_hierarchy_against_brute_force(spark, limit):
    rng = random.Random(5)
    links = [(i, None if i % 17 == 0 else rng.randrange(0, 260)) for i in range(220)] + [(300, 301), (301, 302), (302, 300), (303, 300), (304, 304), (305, 303), (0, None), (5000, 4999)]
    links += [(1000 + i, 1000 + i - 1 if i else None) for i in range(40)]
    got = {r.node: (r.root, r.depth, None if r.path is None else tuple(r.path), r.cycle) for r in tree(spark, links, max_component=limit).collect()}
    assert got == brute_tree(links)


def test_hierarchy_descendants_and_counts(spark):
    t = tree(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), (None, "a"), ("b", "a")], "string")
    assert {(r.node, r.n_descendants) for r in t.collect()} == {("a", 3), ("b", 1), ("c", 0), ("d", 0)}
    assert {tuple(r) for r in descendants(t).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_hierarchy_empty(spark):
    assert tree(spark, []).count() == 0
    assert tree(spark, [(None, None), (None, 1)]).count() == 0


def test_walk_deep_chain():
    order, depth, below, cycles, cycle = walk([-1, *range(199_999)])
    assert order == depth == list(range(200_000)) and below[0] == 199_999 and not cycles and set(cycle) == {-1}
    assert walk([1, 2, 0, 0, 4]) == ([], [-1] * 5, [0] * 5, [[0, 1, 2], [4]], [0, 0, 0, 0, 1])


def test_hierarchy_of_a_chain_of_200_000_nodes(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    got = hierarchy(df, "id", "up", paths=False).agg(F.count("*"), F.countDistinct("root"), F.count("cycle")).first()
    assert tuple(got) == (200_000, 1, 0)
    ring = df.withColumn("up", F.coalesce("up", F.lit(199_999)))
    assert {tuple(r) for r in hierarchy(ring, "id", "up", paths=False).select("cycle").distinct().collect()} == {(0,)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (7, 7), (None, 3), (3, 1), (10, 9), (9, 8), (8, 5)]
    df = spark.createDataFrame(edges, "x long, y long")
    assert {tuple(r) for r in connected_components(df, "x", "y").collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 5), (9, 5), (10, 5), (7, 7)}
    assert connected_components(df.limit(0), "x", "y").count() == 0


def test_components_long_chain_over_partitions(spark):
    df = spark.range(400).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).repartition(7, "x")
    assert connected_components(df, "x", "y").filter("component <> 0").count() == 0


def test_list_children_offsets():
    col = pa.array([["a", "b"], None, [], ["c", None]], pa.list_(pa.string()))
    parent, ordinal, values = list_children(col.slice(0, 4))
    assert (parent.to_pylist(), ordinal.to_pylist(), values.to_pylist()) == ([0, 0, 3, 3], [0, 1, 0, 1], ["a", "b", "c", None])
    parent, ordinal, values = list_children(col.slice(3, 1))
    assert (parent.to_pylist(), ordinal.to_pylist(), values.to_pylist()) == ([0, 0], [0, 1], ["c", None])


def test_flatten(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [("x", 1)], "field"), (2, None, [], "f"), (3, [None], None, "f")], "id long, l array<string>, o array<struct<n:string,v:int>>, field string")
    assert {tuple(r) for r in flatten_lists(df, ["id"], {"l": "L"}).collect()} == {(1, "L", 0, "a"), (1, "L", 1, "b"), (3, "L", 0, None)}
    assert {tuple(r) for r in flatten_objects(df, ["id"], "o").collect()} == {(1, 0, "x", 1)}
    assert flatten_lists(df.limit(0), ["id"], {"l": "L"}).count() == 0


def test_json_shapes(spark):
    one = {"a": {"b": [1, {"name": "n"}]}, "t": "x"}
    raw = json.dumps(one)
    payloads = [raw, json.dumps(raw), f"[{raw}]", f"```json\n{raw}\n```", f"Sure! {raw}", raw[:-3], "", None, "null", f"[{raw},{raw}]", "  "]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = df.select("i", parse_object(json_text(F.col("p")), "a string, t string").alias("r")).filter("r.t = 'x'")
    assert sorted(r.i for r in got.collect()) == [0, 1, 2, 3, 4]


def test_parse_records_reads_a_payload_once(spark):
    raw = json.dumps({"S": {"g": ["a"], "d": {"e": 1}}, "P": json.dumps({"g": "z", "d": "no object"}), "t": "x"})
    payloads = [raw, json.dumps(raw), f"[{raw}]", f"```json\n{raw}\n```", raw[:-3], "", None, "null", "[]", json.dumps({"S": 3}), json.dumps({"S": "[1"})]
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "i int, p string, S string")
    ddl = "g string, d struct<e:string>"
    out = parse_records(df, "p", ["i"], ["t"], {"S": ddl, "P": ddl})
    rows = {r.i: r for r in out.collect()}
    assert [i for i in rows if rows[i].whole] == [0, 1, 2, 3, 9, 10]
    for i in range(4):
        assert (rows[i].t, rows[i].S.g, rows[i].S.d.e, rows[i].P.g, rows[i].P.d) == ("x", '["a"]', "1", "z", None)
    assert rows[9].P is None and all(rows[9].S[c] is None for c in ("g", "d"))
    flat = flatten_fields(out.select("i", text_list(F.col("S.g")).alias("g"), F.col("S.d.e").alias("e")), ["i"], {"g": "G"}, {"e": "E"})
    assert {tuple(r) for r in flat.collect()} == {(i, f, 0, v) for i in range(4) for f, v in (("G", "a"), ("E", "1"))}
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 8
    assert flatten_fields(out.limit(0).select("i", "t"), ["i"], {}, {"t": "T"}).count() == 0


def test_json_values(spark):
    df = spark.createDataFrame([("[\"a\", {\"name\": \"b\"}, null, {\"x\": 1}]",), ("one",), (None,), ("[]",)], "c string")
    assert [r[0] for r in df.select(text_list(F.col("c"))).collect()] == [["a", "b", None, None], ["one"], None, []]
    df = spark.createDataFrame([('{"k": 1.5}',), ('[{"name": "k", "value": "2"}]',), ("[]",), ("bad",), (None,)], "c string")
    assert [r[0] for r in df.select(pair_value(F.col("c"), "k")).collect()] == ["1.5", "2", None, None, None]
    df = spark.createDataFrame([(None,), (" \t",), ("x",), (" ",)], "c string")
    assert [r[0] for r in df.select(blank(F.col("c"))).collect()] == [True, True, False, True]


def test_grouped_rank_and_sums(spark):
    rng = random.Random(2)
    rows = [(0 if i % 2 else rng.randrange(5), rng.randrange(100), i) for i in range(500)] + [(None, 1, 900), (None, 0, 901)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r.id: (r["rank"], r.s) for r in grouped_rank(df, ["g"], [F.col("v").asc(), F.col("id").asc()], sums={"s": "v"}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for k, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            total += v
            want[i] = (k, total)
    assert got == want


def test_neighbours(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 9)], "g string, t int, v int")
    assert {(r.g, r.t, r.prev_v) for r in neighbours(df, ["g"], [F.col("t").asc()], ["v"]).collect()} == {("a", 1, None), ("a", 2, 5), ("b", 1, None)}


def test_top_per_group_plans_a_limit_before_the_shuffle(spark):
    df = top_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], [F.desc("id")], 2)
    assert {(r.g, r.id) for r in df.collect()} == {(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)}
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_smallest_per_group(spark):
    rng = random.Random(3)
    rows = [("a" if i < 700 else "b", rng.choice([0.25, rng.random()]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double, id int").withColumn("q", F.when(F.col("g") == "a", 250).otherwise(5))
    got = sorted(r.id for r in smallest_per_group(df, ["g"], "v", "id", "q").collect())
    want = sorted(i for g, n in (("a", 250), ("b", 5)) for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:n])
    assert got == want


def test_lookup_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, None if i % 10 == 0 else (1 if i % 2 else i)) for i in range(400)], "id int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 400, 4)] + [(1, "hot")], "k int, v string")
    hot = collect_hot(left, ["k"], 0.1)
    assert hot == [(1,)]
    got = {r.id: r.v for r in lookup_join(left, right, ["k"], hot, ["id"]).collect()}
    assert got == {r.id: (None if r.k is None else "hot" if r.k == 1 else f"v{r.k}" if r.k % 4 == 0 else None) for r in left.collect()}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = {}
    for r in nearest(df, df.filter("id % 20 = 0"), 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    u = np.asarray(x, np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == [int(i) for i in np.argsort(-s, kind="stable")[:3]]
    assert nearest(df, df.limit(0), 3).count() == 0


def test_triangles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 4), (None, 1)], "src long, dst long")
    p = undirected(e)
    d = degrees(p)
    assert {tuple(r) for r in d.collect()} == {(1, 2), (2, 2), (3, 3), (4, 1)}
    assert {tuple(r) for r in triangles(p, d).collect()} == {(1, 1), (2, 1), (3, 1)}
