"""TF-IDF weights and search with smooth inverse document frequencies and unit-length documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.functions.hashing import md5_choice
from plaza.lineage import cut
from plaza.operators.rank import top_per_group


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of the lower-case words of two letters and more."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 1)
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _frequencies(tf: DataFrame, docs: DataFrame, key: str, min_df: int, max_df: float) -> DataFrame:
    """(term, idf) of the postings ``tf``: ``ln((1 + n) / (1 + df)) + 1``."""
    n = docs.select(key).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    return df.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(docs: DataFrame, key: str, text: str, min_df: int = 2, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) and (term, idf): ``tf * idf``, each document of length 1."""
    tf = cut(postings(docs, key, text), "postings")
    idf = cut(_frequencies(tf, docs, key, min_df, max_df), "idf")
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("w")), idf


def hits(docs: DataFrame, key: str, text: str, queries: DataFrame, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(query_id, key, score): all documents that share a term with a query (query_id, text).

    The postings are made once; weights are worked out for the terms of the
    queries only, and lengths for the documents that hold one of them.
    """
    tf = cut(postings(docs, key, text), "postings")
    idf = cut(_frequencies(tf, docs, key, min_df, max_df), "idf")
    q = postings(queries, "query_id", "text").join(idf, "term").select("query_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    length = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("length"))
    q = cut(q.join(length, "query_id").select("query_id", "term", (F.col("idf") * F.col("qw") / F.col("length")).alias("qw")), "query")
    met = cut(tf.join(q, "term").groupBy("query_id", key).agg(F.sum(F.col("tf") * F.col("qw")).alias("s")), "met")
    own = tf.join(met.select(key).distinct(), key, "left_semi").join(idf, "term")
    lengths = own.groupBy(key).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) * (F.col("tf") * F.col("idf")))).alias("length"))
    return met.join(lengths, key).select("query_id", key, F.round(F.col("s") / F.col("length"), 9).alias("score")).filter("score > 0")


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best documents of each query."""
    return top_per_group(hits(docs, key, text, queries), ["query_id"], [F.desc("score"), F.asc(key)], k)


def best_phrases(docs: DataFrame, key: str, text: str, bank: DataFrame) -> DataFrame:
    """(key, position, token, phrase): for each ``<LBL:...>`` token of a text the phrase of ``bank`` (token, at, phrase) closest to that text.

    Each token's phrases are a corpus of their own, with all terms; the best
    cosine wins, ties and texts without a common term go to the first phrase.
    Tokens whose phrases have no terms take one by hash, tokens without phrases
    stand for themselves.  The bank is a small fixed table and is broadcast.
    """
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w\w+)"), F.lit(1))
    tokens = F.regexp_extract_all(F.col(text), F.lit("<(LBL:[A-z0-9_]+)>"), F.lit(1))
    sizes = bank.groupBy("token").agg(F.count("*").alias("n"))
    tf = bank.select("token", "at", F.explode(terms(F.col("phrase"))).alias("term")).groupBy("token", "at", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token", "term").agg(F.count("*").alias("df")).join(sizes, "token")
    idf = df.select("token", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, ["token", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    length = raw.groupBy("token", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # The length of the text is the same for all phrases of a token, so it is left out.
    w = raw.join(length, ["token", "at"]).select("token", "term", "at", (F.col("w") / F.col("length") * F.col("idf")).alias("w"))
    found = docs.filter(F.size(tokens) > 0).select(key, F.explode(F.array_distinct(tokens)).alias("token"), terms(F.col(text)).alias("_terms"))
    found = found.select(key, "token", F.explode("_terms").alias("term")).groupBy(key, "token", "term").agg(F.count("*").alias("tf"))
    score = found.join(F.broadcast(w), ["token", "term"]).groupBy(key, "token", "at").agg(F.round(F.sum(F.col("tf") * F.col("w")), 9).alias("score"))
    best = score.groupBy(key, "token").agg(F.max(F.struct("score", (-F.col("at")).alias("_at"))).alias("_best")).select(key, "token", (-F.col("_best._at")).alias("_best"))
    known = sizes.join(w.select("token").distinct().withColumn("_terms", F.lit(True)), "token", "left")
    all_tokens = docs.filter(F.size(tokens) > 0).select(key, F.posexplode(tokens).alias("position", "token")).join(F.broadcast(known), "token", "left").join(best, [key, "token"], "left")
    drawn = md5_choice(F.concat_ws("-", F.col(key).cast("string"), "token"), F.col("n"))
    at = F.when(F.col("_terms"), F.coalesce("_best", F.lit(0))).otherwise(drawn).cast("int")
    out = all_tokens.withColumn("at", at).join(F.broadcast(bank), ["token", "at"], "left")
    return out.select(key, "position", "token", F.coalesce("phrase", F.concat(F.lit("<"), "token", F.lit(">"))).alias("phrase"))
