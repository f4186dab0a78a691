"""Follow graph, interactions and propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.graph import assortativity, degrees, random_edges, triangles, two_hop, undirected
from plaza.operators.rank import grouped_rank
from plaza.operators.skew import collect_hot, lookup_join
from plaza.plans.hierarchies import _TREE, tree
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql

_PAIRS = "pr AS (SELECT DISTINCT least(follower_id, followee_id) AS a, greatest(follower_id, followee_id) AS b FROM f WHERE follower_id <> followee_id)"
_DEG = "dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pr UNION ALL SELECT b FROM pr) GROUP BY node)"
_CCDF = "h AS (SELECT degree, count(*) AS n FROM dg GROUP BY degree), cc AS (SELECT degree, sum(n) OVER (ORDER BY degree DESC) * 1.0 / sum(n) OVER () AS y FROM h)"
_INTER = """
i AS (SELECT l.user_id AS src, p.user_id AS dst, 1.0 AS w FROM l JOIN p ON l.post_id = p.post_id
  UNION ALL SELECT c.user_id, p.user_id, 1.5 FROM c JOIN p ON c.post_id = p.post_id
  UNION ALL SELECT q.user_id, p.user_id, CASE WHEN coalesce(q.quote_content, '') = '' THEN 2.0 ELSE 1.5 END FROM p q JOIN p ON q.original_post_id = p.post_id),
iw AS (SELECT src, dst, sum(w) AS weight FROM i WHERE src <> dst GROUP BY ALL)"""


def follow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of the follow table."""
    return rows(spark, sf_dir, "f").select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst"))


def ccdf(degree: DataFrame) -> DataFrame:
    """(degree, y): share of nodes of at least that degree; one row per distinct degree."""
    h = degree.groupBy("degree").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    return h.select("degree", (above / F.sum("n").over(Window.partitionBy())).alias("y"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): likes 1, reposts 2, quotes and comments 1.5, without one's own."""
    p = rows(spark, sf_dir, "p")
    part = lambda df, k, w: df.select("user_id", F.col(k).alias("post_id"), w.alias("w"))
    quote = F.when(F.coalesce("quote_content", F.lit("")) == "", 2.0).otherwise(1.5)
    acts = (
        part(rows(spark, sf_dir, "l"), "post_id", F.lit(1.0)).unionByName(part(rows(spark, sf_dir, "c"), "post_id", F.lit(1.5))).unionByName(part(p.filter("original_post_id IS NOT NULL"), "original_post_id", quote))
    )
    # Summed per user and post first, so that a hot post joins once per user.
    acts = cut(acts.groupBy("user_id", "post_id").agg(F.sum("w").alias("w")), "acts")
    author = p.select("post_id", F.col("user_id").alias("dst"))
    both = lookup_join(acts, author, ["post_id"], collect_hot(acts, ["post_id"]), ["user_id"])
    return both.filter("dst IS NOT NULL AND user_id <> dst").groupBy(F.col("user_id").alias("src"), "dst").agg(F.sum("w").alias("weight"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("degree_distribution", with_sql("f", _PAIRS, _DEG) + "SELECT degree, count(*) AS n FROM dg GROUP BY degree")
    def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
        return degrees(undirected(follow_edges(spark, sf_dir))).groupBy("degree").agg(F.count("*").alias("n"))

    @reg.add("assortativity", with_sql("f", _PAIRS, _DEG, "e AS (SELECT x.degree AS d1, y.degree AS d2 FROM pr JOIN dg x ON pr.a = x.node JOIN dg y ON pr.b = y.node)", "bo AS (SELECT d1, d2 FROM e UNION ALL SELECT d2, d1 FROM e)") + "SELECT round(corr(d1, d2), 6) AS assortativity, corr(d1, d2) BETWEEN 0.18 AND 0.32 AS in_range FROM bo")
    def q_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = undirected(follow_edges(spark, sf_dir))
        a = assortativity(pairs, degrees(pairs))
        return a.select(F.round("assortativity", 6).alias("assortativity"), F.col("assortativity").between(0.18, 0.32).alias("in_range"))

    @reg.add(
        "clustering_local",
        with_sql("f", _PAIRS, _DEG, "bo AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr)", "t AS (SELECT u.x AS node, count(*) AS t FROM bo u JOIN bo v ON u.x = v.x AND u.y < v.y JOIN pr ON pr.a = u.y AND pr.b = v.y GROUP BY u.x)")
        + "SELECT round(avg(coalesce(2.0 * t.t / (degree * (degree - 1)), 0)), 6) AS clustering FROM dg LEFT JOIN t ON dg.node = t.node WHERE degree >= 2",
    )
    def clustering_local(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = cut(undirected(follow_edges(spark, sf_dir)), "pairs")
        d = degrees(pairs)
        both = d.filter("degree >= 2").join(triangles(pairs, d), "node", "left")
        c = 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))
        return both.agg(F.round(F.avg(c), 6).alias("clustering"))

    @reg.add("powerlaw_slope", with_sql("f", _PAIRS, _DEG, _CCDF) + "SELECT round(abs(regr_slope(ln(y), ln(degree))), 6) AS slope, count(*) AS n_points FROM cc WHERE degree >= 3")
    def powerlaw_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = ccdf(degrees(undirected(follow_edges(spark, sf_dir)))).filter("degree >= 3")
        return c.agg(F.round(F.abs(F.regr_slope(F.log("y"), F.log("degree"))), 6).alias("slope"), F.count("*").alias("n_points"))

    @reg.add("graph_counts", with_sql("uf") + "SELECT (SELECT count(*) FROM u) AS n_nodes, count(*) AS n_edges, count(DISTINCT follower_id) AS n_sources, count(DISTINCT followee_id) AS n_targets FROM (SELECT DISTINCT follower_id, followee_id FROM f WHERE followee_id IS NOT NULL)")
    def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = follow_edges(spark, sf_dir).filter("dst IS NOT NULL").distinct()
        n = rows(spark, sf_dir, "u").agg(F.count("*").alias("n_nodes"))
        c = e.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))
        return n.join(F.broadcast(c))

    @reg.add("two_hop_links", with_sql("f", "e AS (SELECT DISTINCT follower_id AS s, followee_id AS t FROM f WHERE follower_id <> followee_id)", "w AS (SELECT x.s, y.t, count(*) AS common FROM e x JOIN e y ON x.t = y.s WHERE y.t <> x.s GROUP BY ALL)") + "SELECT w.s, w.t, w.common FROM w LEFT JOIN e ON w.s = e.s AND w.t = e.t WHERE e.s IS NULL")
    def two_hop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
        return two_hop(follow_edges(spark, sf_dir))

    @reg.add("interaction_edges", with_sql("plc", _INTER.strip()) + "SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM iw")
    def interaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        return interactions(spark, sf_dir)

    @reg.add("interaction_network", with_sql("plc", _INTER.strip(), "ig AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM iw UNION ALL SELECT dst FROM iw) GROUP BY node)") + "SELECT iw.src, iw.dst, x.degree AS src_degree, y.degree AS dst_degree FROM iw JOIN ig x ON iw.src = x.node JOIN ig y ON iw.dst = y.node WHERE x.degree >= 30 AND y.degree >= 30")
    def interaction_network(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = cut(interactions(spark, sf_dir), "interactions")
        d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).filter("degree >= 30")
        side = lambda c: d.select(F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
        return e.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_degree", "dst_degree")

    @reg.add("propagation_levels", f"WITH RECURSIVE {_TREE} SELECT root AS root_id, depth, count(*) AS breadth FROM tree WHERE table_name = 'post' GROUP BY ALL")
    def propagation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tree(spark, sf_dir, "post").filter("root IS NOT NULL")
        return t.groupBy(F.col("root").cast("string").alias("root_id"), "depth").agg(F.count("*").alias("breadth"))

    @reg.add(
        "structural_virality",
        f"WITH RECURSIVE {_TREE}, x AS (SELECT table_name, root, unnest(ids) AS node FROM tree WHERE table_name = 'post_record'), s AS (SELECT root, node, count(*) AS s FROM x GROUP BY ALL), n AS (SELECT root, max(s) AS n FROM s WHERE root = node GROUP BY root) SELECT s.root AS root_id, max(n.n) AS size, round(sum(CASE WHEN s.node <> s.root THEN s.s * (n.n - s.s) ELSE 0 END) * 2.0 / (max(n.n) * (max(n.n) - 1)), 6) AS virality FROM s JOIN n ON s.root = n.root WHERE n.n > 1 GROUP BY s.root",
    )
    def structural_virality(spark: SparkSession, sf_dir: str) -> DataFrame:
        # An edge above a subtree of s of n nodes lies on s * (n - s) of the shortest paths of the tree.
        t = tree(spark, sf_dir, "post_record").filter("root IS NOT NULL").select("root", "node", (F.col("n_descendants") + 1).alias("s"))
        n = t.filter("root = node").select("root", F.col("s").alias("n")).filter("n > 1")
        both = lookup_join(t, n, ["root"], collect_hot(t, ["root"]), ["node"]).filter("n IS NOT NULL")
        paths = F.sum(F.when(F.col("node") != F.col("root"), F.col("s") * (F.col("n") - F.col("s"))).otherwise(0))
        g = both.groupBy(F.col("root").alias("root_id")).agg(F.max("n").alias("size"), paths.alias("paths"))
        return g.select("root_id", "size", F.round(F.col("paths") * 2.0 / (F.col("size") * (F.col("size") - 1)), 6).alias("virality"))

    @reg.add("cumulative_scale", with_sql("p", "t AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM p WHERE original_post_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1)") + "SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS scale FROM t")
    def cumulative_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "p").filter("original_post_id IS NOT NULL AND created_at IS NOT NULL").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
        return t.select("day", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("scale"))

    @reg.add("component_sizes")
    def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
        from plaza.operators.components import connected_components

        c = connected_components(follow_edges(spark, sf_dir), "src", "dst").groupBy("component").agg(F.count("*").alias("size"))
        return c.groupBy("size").agg(F.count("*").alias("n"))

    @reg.add("block_model_edges")
    def block_model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Each node draws targets by hash; a draw stands with the chance of its blocks, so pairs are never enumerated.
        u = grouped_rank(rows(spark, sf_dir, "u").select("user_id", (F.col("user_id") % 5).alias("block"), F.lit(0).alias("one")), ["one"], [F.col("user_id").asc()], "k")
        n = u.agg(F.count("*").alias("n"))
        draw = u.join(F.broadcast(n)).select("user_id", "block", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.lit(i), "user_id"), F.col("n")).alias("k")) for i in range(10)])).alias("d"))
        both = draw.select("user_id", "block", "d.i", "d.k").join(u.select("k", F.col("user_id").alias("dst"), F.col("block").alias("dst_block")), "k")
        chance = F.pmod(F.xxhash64(F.lit(99), "user_id", "dst"), F.lit(1000)) < F.when(F.col("block") == F.col("dst_block"), 625).otherwise(375)
        return both.filter(chance & (F.col("user_id") != F.col("dst"))).select(F.col("user_id").alias("src"), "dst").distinct()

    @reg.add("preferential_edges")
    def preferential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The end of an edge drawn by hash is a node drawn by its in-degree.
        e = grouped_rank(follow_edges(spark, sf_dir).filter("src <> dst").distinct().withColumn("one", F.lit(0)), ["one"], [F.col("src").asc(), F.col("dst").asc()], "k")
        m = e.agg(F.count("*").alias("m"))
        u = rows(spark, sf_dir, "u").select("user_id").join(F.broadcast(m)).select("user_id", F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "user_id"), F.col("m")) for i in range(4)])).alias("k"))
        return u.join(e.select("k", "dst"), "k").filter("user_id <> dst").select(F.col("user_id").alias("src"), "dst").distinct()

    @reg.add("graph_pipeline")
    def graph_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Blocks, then preferential attachment, then closure of two-hop pairs by the number of common neighbours; each edge once.
        base = cut(block_model_edges(spark, sf_dir).unionByName(preferential_edges(spark, sf_dir)).distinct(), "base")
        closing = F.pmod(F.xxhash64(F.lit(7), "s", "t"), F.lit(1000)) < F.least(F.lit(500), F.col("common") * 25)
        closed = two_hop(base).filter(closing).select(F.col("s").alias("src"), F.col("t").alias("dst"))
        return base.withColumn("stage", F.lit("base")).unionByName(closed.withColumn("stage", F.lit("closure")))

    @reg.add("random_edge_set", with_sql("u") + "SELECT least(2 * count(*), count(*) * (count(*) - 1)) AS n_edges, CAST(0 AS BIGINT) AS n_loops FROM u")
    def random_edge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = rows(spark, sf_dir, "u").select("user_id")
        edges = random_edges(u, "user_id", 2 * u.count(), 314159)
        return edges.distinct().agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
