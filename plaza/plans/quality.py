"""Harm detection and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.functions import harm as H
from plaza.functions import text as X
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql

_CATS = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN {c} ELSE [] END" for p, c in H.PATTERNS) + "])))"
_N = " + ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i'))" for p, _ in H.PATTERNS)
_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"
_DET = f"a AS (SELECT doc_id, source, {_CATS} AS found, {_N} AS n, {_WORDS} AS words FROM d), dt AS (SELECT doc_id, source, CASE WHEN len(found) = 0 THEN ['benign'] ELSE found END AS cats, CASE WHEN n = 0 THEN 0.8 ELSE least(0.9, 0.3 + n * 2.0 / words) END AS conf FROM a)"
_SEV = "sv(category, severity, act) AS (VALUES " + ", ".join(f"('{k}', {s}, {H.ACTIONS.index(a)})" for k, (s, a) in H.SEVERITY.items()) + ")"
_JUDGED = "jd AS (SELECT doc_id, max(severity) AS severity, max(act) AS act FROM (SELECT doc_id, unnest(cats) AS category FROM dt) JOIN sv USING (category) GROUP BY doc_id)"


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, cats, conf, severity, action) of all documents."""
    t = F.col("text")
    # The counts are a column of their own, used more than once above, so no pattern is tried twice.
    d = rows(spark, sf_dir, "d").select("doc_id", "source", H.counts(t).alias("found"), H.n_words(t).alias("words"))
    d = d.select("doc_id", "source", H.categories(F.col("found")).alias("cats"), H.matches(F.col("found")).alias("n"), "words")
    return d.select("doc_id", "source", "cats", H.confidence(F.col("n"), F.col("words")).alias("conf"), H.severity(F.col("cats")).alias("severity"), H.action(F.col("cats")).alias("action"))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("harm_detect", with_sql("d", _DET) + "SELECT doc_id, array_to_string(cats, ',') AS categories, round(conf, 6) AS confidence FROM dt")
    def harm_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detected(spark, sf_dir).select("doc_id", F.array_join("cats", ",").alias("categories"), F.round("conf", 6).alias("confidence"))

    @reg.add("harm_severity", with_sql("d", _DET, _SEV, _JUDGED) + f"SELECT doc_id, severity, list_extract({H.ACTIONS}, act + 1) AS action FROM jd WHERE severity >= 2")
    def harm_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detected(spark, sf_dir).filter("severity >= 2").select("doc_id", "severity", "action")

    @reg.add("category_breakdown", with_sql("d", _DET) + "SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM dt) GROUP BY category")
    def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detected(spark, sf_dir).select(F.explode("cats").alias("category")).groupBy("category").agg(F.count("*").alias("n"))

    @reg.add("severity_breakdown", with_sql("d", _DET, _SEV, _JUDGED) + "SELECT severity, count(*) AS n FROM jd GROUP BY severity")
    def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detected(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))

    @reg.add("detection_export", with_sql("d", _DET, _SEV, _JUDGED) + "SELECT doc_id, 'detection' AS kind, array_to_string(cats, ',') AS body FROM dt UNION ALL SELECT doc_id, 'reply', 'severity ' || severity FROM jd WHERE severity >= 4")
    def detection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = detected(spark, sf_dir)
        a = d.select("doc_id", F.lit("detection").alias("kind"), F.array_join("cats", ",").alias("body"))
        return a.unionByName(d.filter("severity >= 4").select("doc_id", F.lit("reply").alias("kind"), F.concat(F.lit("severity "), F.col("severity")).alias("body")))

    count = lambda xs: "len(list_filter([" + ", ".join(f"'{x}'" for x in xs) + "], lambda x: contains(lower(text), x)))"

    @reg.add("spectrum", with_sql("d", f"s AS (SELECT doc_id, {count(H.EXPLICIT)} AS e, {count(H.IMPLICIT)} AS i FROM d)") + "SELECT doc_id, CASE WHEN e > 2 THEN 'explicit_hate' WHEN i > 2 AND e < 2 THEN 'implicit_hate' WHEN e = 0 AND i < 2 THEN 'neutral' ELSE 'unknown' END AS kind FROM s")
    def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "d").select("doc_id", H.spectrum(F.col("text")).alias("kind"))

    strip_sql = "content"
    for pattern, to in X.STRIPS:
        strip_sql = f"regexp_replace({strip_sql}, '{pattern}', '{to}', 'g')"
    any_issue = lambda c: " OR ".join(f"regexp_matches({c}, '{p}')" for p in X.ISSUES.values())

    @reg.add("issue_recount", with_sql("p", f"x AS (SELECT content AS a, trim({strip_sql}) AS b FROM p WHERE content IS NOT NULL)") + f"SELECT count(*) AS n, count(*) FILTER (WHERE {any_issue('a')}) AS before_n, count(*) FILTER (WHERE {any_issue('b')}) AS after_n FROM x")
    def issue_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = rows(spark, sf_dir, "p").filter("content IS NOT NULL").select(F.col("content").alias("a"), X.strip_leftovers(F.col("content")).alias("b"))
        bad = lambda c: F.count(F.when(F.size(X.issues(F.col(c))) > 0, 1))
        return x.agg(F.count("*").alias("n"), bad("a").alias("before_n"), bad("b").alias("after_n"))

    @reg.add("choice_parse", with_sql("c") + "SELECT CASE WHEN contains(lower(content), 'overrated') THEN 'negative' WHEN contains(lower(content), 'lovely') OR contains(lower(content), 'charming') THEN 'positive' ELSE 'neutral' END AS choice, count(*) AS n FROM c GROUP BY 1")
    def choice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.lower("content")
        choice = F.when(t.contains("overrated"), "negative").when(t.contains("lovely") | t.contains("charming"), "positive").otherwise("neutral")
        return rows(spark, sf_dir, "c").groupBy(choice.alias("choice")).agg(F.count("*").alias("n"))
