"""Recommenders and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.functions.scores import hot_score
from plaza.lineage import cut
from plaza.operators.feeds import matrix_rows, random_posts, refresh, with_comments
from plaza.operators.rank import top_per_group
from plaza.operators.search import nearest
from plaza.operators.tfidf import hits, search, weights
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

#: Texts searched for in the corpus.
QUERIES = ["noisy kettle market", "vaccine paperwork", "recovery journals and sleep", "community radio telescope", "thermostat footbridge", "indie games", "exam stress", "fact checking search rankings"]
#: Posts that a user is recommended, and those shown at a refresh from that list and from followed authors.
REC_LEN, REFRESH_REC, REFRESH_FOLLOWING = 5, 3, 2
_Q = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUERIES))
_TFIDF = """
t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: length(w) > 1)) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), nn AS (SELECT count(*) AS n FROM d),
idf AS (SELECT term, ln((1 + n) / (1.0 + count(*))) + 1 AS idf FROM tf, nn GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= n * 0.95),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
len AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM raw GROUP BY doc_id),
w AS (SELECT raw.doc_id, term, w / length AS w FROM raw JOIN len ON raw.doc_id = len.doc_id)"""
_SEARCH = _TFIDF + f""",
qs(query_id, text) AS (VALUES {_Q}),
qt AS (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: length(w) > 1)) AS term FROM qs),
qf AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL),
qr AS (SELECT query_id, term, tf * idf AS qw FROM qf JOIN idf USING (term)),
ql AS (SELECT query_id, sqrt(sum(qw * qw)) AS length FROM qr GROUP BY query_id),
hits AS (SELECT qr.query_id, w.doc_id, round(sum(w.w * qr.qw / ql.length), 9) AS score FROM w JOIN qr ON w.term = qr.term JOIN ql ON qr.query_id = ql.query_id GROUP BY ALL),
best AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits WHERE score > 0)"""

def query_frame(spark: SparkSession) -> DataFrame:
    """(query_id, text) of QUERIES."""
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("rec_hot", with_sql("p", "h AS (SELECT post_id, round(sign(num_likes - num_dislikes) * log10(greatest(abs(num_likes - num_dislikes), 1)) + (epoch_us(created_at) / 1000000.0 - 1134028003) / 45000, 4) AS hot FROM p WHERE created_at IS NOT NULL)") + "SELECT post_id, hot FROM h ORDER BY hot DESC, post_id LIMIT 50")
    def rec_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").filter("created_at IS NOT NULL")
        return p.select("post_id", F.round(hot_score(F.col("num_likes"), F.col("num_dislikes"), F.col("created_at")), 4).alias("hot")).orderBy(F.desc("hot"), "post_id").limit(50)

    @reg.add("rec_random_posts")
    def rec_random_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return random_posts(rows(spark, sf_dir, "u"), rows(spark, sf_dir, "p"), REC_LEN, 11)

    @reg.add("vector_search", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS id, list_cosine_similarity(q.e, r.e) AS c FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) SELECT query, id, round(c, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s) WHERE rank <= 5")
    def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return nearest(e, e.filter("id % 20 = 0"), 5).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")

    @reg.add("liked_history", with_sql("l", "t AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, like_id DESC) AS k FROM l WHERE post_id IS NOT NULL)") + "SELECT user_id, string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY k) || repeat(',0', CAST(5 - count(*) AS INTEGER)) AS history FROM t WHERE k <= 5 GROUP BY user_id")
    def liked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
        likes = rows(spark, sf_dir, "l").filter("post_id IS NOT NULL")
        top = top_per_group(likes, ["user_id"], [F.col("created_at").desc_nulls_last(), F.col("like_id").desc()], 5, "k")
        h = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "post_id"))).alias("h"))
        ids = F.transform("h", lambda s: s["post_id"].cast("string"))
        return h.select("user_id", F.array_join(F.concat(ids, F.array_repeat(F.lit("0"), 5 - F.size("h"))), ",").alias("history"))

    @reg.add("trace_contents", with_sql("pl") + "SELECT post_id, content FROM p WHERE post_id IN (SELECT post_id FROM l)")
    def trace_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", "content").join(rows(spark, sf_dir, "l").select("post_id").distinct(), "post_id", "left_semi")

    @reg.add("rec_matrix_rows", with_sql("ul", "t AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY post_id) - 1 AS position FROM (SELECT DISTINCT user_id, post_id FROM l WHERE post_id IS NOT NULL))") + "SELECT u.user_id, t.position, t.post_id FROM u LEFT JOIN t ON u.user_id = t.user_id")
    def rec_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matrix_rows(rows(spark, sf_dir, "u"), rows(spark, sf_dir, "l"))

    @reg.add("tfidf_weights", with_sql("d", _TFIDF.strip()) + "SELECT doc_id, term, round(w, 6) AS weight, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM w) WHERE k <= 10")
    def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, _ = weights(rows(spark, sf_dir, "d"), "doc_id", "text")
        return top_per_group(w.withColumn("r", F.round("w", 9)), ["doc_id"], [F.desc("r"), F.asc("term")], 10).select("doc_id", "term", F.round("w", 6).alias("weight"), "rank")

    @reg.add("tfidf_search", with_sql("d", _SEARCH.strip()) + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best WHERE rank <= 5")
    def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(rows(spark, sf_dir, "d"), "doc_id", "text", query_frame(spark), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    @reg.add("best_dataset", with_sql("d", _SEARCH.strip(), "s AS (SELECT h.query_id, coalesce(lower(trim(d.source)), 'unknown') AS dataset, max(h.score) AS score FROM hits h JOIN d ON h.doc_id = d.doc_id WHERE h.score > 0 GROUP BY ALL)") + "SELECT query_id, dataset, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset) AS k FROM s) WHERE k = 1")
    def best_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rows(spark, sf_dir, "d")
        top = hits(docs, "doc_id", "text", query_frame(spark)).join(docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("dataset")), "doc_id")
        s = top.groupBy("query_id", "dataset").agg(F.max("score").alias("score"))
        return top_per_group(s, ["query_id"], [F.desc("score"), F.asc("dataset")], 1).select("query_id", "dataset", F.round("score", 6).alias("score"))

    @reg.add("fallback_chain", with_sql("d", _SEARCH.strip(), "m AS (SELECT query_id, 0 AS priority, 'tfidf' AS method, doc_id FROM best WHERE rank = 1 AND score > 0.3 UNION ALL SELECT query_id, 1, 'loose', doc_id FROM best WHERE rank = 1 UNION ALL SELECT query_id, 2, 'static', -1 FROM qs)") + "SELECT query_id, method, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority) AS k FROM m) WHERE k = 1")
    def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = search(rows(spark, sf_dir, "d"), "doc_id", "text", query_frame(spark), 1)
        stage = lambda df, p, m, d="doc_id": df.select("query_id", F.lit(p).alias("priority"), F.lit(m).alias("method"), F.col(d).cast("long").alias("doc_id") if isinstance(d, str) else d.alias("doc_id"))
        every = stage(best.filter("score > 0.3"), 0, "tfidf").unionByName(stage(best, 1, "loose")).unionByName(stage(query_frame(spark), 2, "static", F.lit(-1).cast("long")))
        return top_per_group(every, ["query_id"], [F.asc("priority")], 1).select("query_id", "method", "doc_id")

    @reg.add("feed_refresh_comments")
    def feed_refresh_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = cut(rows(spark, sf_dir, "p"), "posts")
        rec = random_posts(rows(spark, sf_dir, "u"), p, REC_LEN, 11)
        return with_comments(refresh(rec, p, rows(spark, sf_dir, "f"), REFRESH_REC, REFRESH_FOLLOWING), p, rows(spark, sf_dir, "c"))

    @reg.add("kmeans_clusters")
    def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=12, seed=7, maxIter=10).fit(e)
        return model.transform(e).groupBy("prediction").agg(F.count("*").alias("n"))

    @reg.add("baseline_classifier")
    def baseline_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer

        r = rows(spark, sf_dir, "r").filter("trim(text) <> '' AND size(category_labels) > 0")
        first = F.translate(F.lower(F.trim(F.get("category_labels", F.lit(0)))), "- ", "__")
        data = r.select("post_id", "text", F.when(first == "benign", 0.0).otherwise(1.0).alias("label"))
        test = F.pmod(F.xxhash64("post_id"), F.lit(5)) == 0
        steps = [
            RegexTokenizer(inputCol="text", outputCol="words", pattern="[^a-z0-9]+"),
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT post_id, label, concat(words, pairs) AS terms FROM __THIS__"),
            HashingTF(inputCol="terms", outputCol="tf", numFeatures=1 << 14),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(maxIter=10, regParam=0.01),
        ]
        guess = Pipeline(stages=steps).fit(data.filter(~test)).transform(data.filter(test))
        return guess.groupBy("label", "prediction").agg(F.count("*").alias("n"))

    @reg.add("liked_rank_window", with_sql("p") + "SELECT user_id, max(num_likes) AS most, min(num_likes) AS least, max(num_likes) - min(num_likes) AS span FROM p GROUP BY user_id")
    def liked_rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").groupBy("user_id").agg(F.max("num_likes").alias("most"), F.min("num_likes").alias("least"), (F.max("num_likes") - F.min("num_likes")).alias("span"))
