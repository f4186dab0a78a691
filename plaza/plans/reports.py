"""Reports: counts, distributions, rates and metrics over a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.operators.datasets import class_metrics as metrics_of
from plaza.operators.datasets import clean_labels, share
from plaza.operators.datasets import multilabel_rate as multilabel
from plaza.operators.rank import grouped_rank, top_per_group
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

#: Labels of the wide score table and their tiers (fixed values).
BENIGN, RECOVERY = ["benign"], ["recovery_ed"]
RISKY = ["ed_risk", "pro_ana", "bullying", "hate_speech", "incel_misogyny", "extremist", "misinfo", "conspiracy", "gamergate", "alpha", "trad"]
#: Two-sided 95 % quantiles of Student's t by degrees of freedom; beyond 30 that of the normal distribution.
T975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
_LABEL = "replace(replace(lower(trim({x})), '-', '_'), ' ', '_')"
_CLEAN = "list_transform(coalesce(category_labels, []), lambda x: " + _LABEL.format(x="x") + ")"


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("table_counts", with_sql("pclfugrk") + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in "pclfugrk"))
    def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for n in "pclfugrk":
            part = rows(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
            out = part if out is None else out.unionByName(part)
        return out

    @reg.add("action_summary", "SELECT event_type AS action, count(*) AS n_actions, count(DISTINCT user_id) AS n_users FROM events WHERE event_type <> 'signup' GROUP BY 1")
    def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
        return e.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n_actions"), F.countDistinct("user_id").alias("n_users"))

    @reg.add("run_summary", with_sql("pcu", "e AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'signup')") + "SELECT (SELECT count(*) FROM u) AS n_users, (SELECT count(*) FROM p) AS n_posts, (SELECT count(*) FROM c) AS n_comments, n AS n_actions, users AS n_active, round(n * 1.0 / users, 6) AS per_user FROM e")
    def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = lambda t, a: F.broadcast(rows(spark, sf_dir, t).agg(F.count("*").alias(a)))
        e = table(spark, sf_dir, "events").filter("event_type <> 'signup'").agg(F.count("*").alias("n_actions"), F.countDistinct("user_id").alias("n_active"))
        both = e.join(n("u", "n_users")).join(n("p", "n_posts")).join(n("c", "n_comments"))
        return both.select("n_users", "n_posts", "n_comments", "n_actions", "n_active", F.round(F.col("n_actions") / F.col("n_active"), 6).alias("per_user"))

    bucket = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' ELSE '50+' END"

    @reg.add("comment_histogram", with_sql("pc", "n AS (SELECT p.post_id, count(c.comment_id) AS n FROM p LEFT JOIN c ON p.post_id = c.post_id GROUP BY p.post_id)") + f"SELECT {bucket} AS bucket, count(*) AS n_posts, round(100.0 * count(*) / (SELECT count(*) FROM n), 6) AS percent FROM n GROUP BY 1")
    def comment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rows(spark, sf_dir, "c").groupBy("post_id").agg(F.count("*").alias("n"))
        n = rows(spark, sf_dir, "p").select("post_id").join(c, "post_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
        b = n.groupBy(F.expr(bucket).alias("bucket")).agg(F.count("*").alias("n_posts"))
        total = b.agg(F.sum("n_posts").alias("all_posts"))
        return b.join(F.broadcast(total)).select("bucket", "n_posts", F.round(100.0 * F.col("n_posts") / F.col("all_posts"), 6).alias("percent"))

    @reg.add(
        "engagement",
        with_sql("plc", "a AS (SELECT post_id, count(DISTINCT user_id) AS likers FROM l GROUP BY post_id)", "b AS (SELECT post_id, count(DISTINCT user_id) AS commenters FROM c GROUP BY post_id)", "s AS (SELECT original_post_id AS post_id, count(DISTINCT user_id) AS sharers FROM p GROUP BY 1)")
        + "SELECT p.post_id, coalesce(likers, 0) AS likers, coalesce(commenters, 0) AS commenters, coalesce(sharers, 0) AS sharers FROM p LEFT JOIN a ON p.post_id = a.post_id LEFT JOIN b ON p.post_id = b.post_id LEFT JOIN s ON p.post_id = s.post_id",
    )
    def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = lambda t, k, a: rows(spark, sf_dir, t).groupBy(F.col(k).alias("post_id")).agg(F.countDistinct("user_id").alias(a))
        out = rows(spark, sf_dir, "p").select("post_id")
        for part in (n("l", "post_id", "likers"), n("c", "post_id", "commenters"), n("p", "original_post_id", "sharers")):
            out = out.join(part, "post_id", "left")
        return out.na.fill(0, ["likers", "commenters", "sharers"])

    @reg.add("label_distribution", with_sql("r", f"t AS (SELECT unnest({_CLEAN}) AS label FROM r)") + "SELECT label, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY label")
    def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = rows(spark, sf_dir, "r").select(F.explode(clean_labels(F.col("category_labels"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
        return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))

    @reg.add("thread_stats", with_sql("r") + "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT thread_id) AS n_threads, count(DISTINCT split) AS n_splits FROM r")
    def thread_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "r").agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(n) for c, n in (("user_id", "n_users"), ("thread_id", "n_threads"), ("split", "n_splits"))])

    @reg.add("multilabel_rate", with_sql("r", f"t AS (SELECT {_CLEAN} AS labels FROM r)", "h AS (SELECT labels, len(list_filter(labels, lambda x: x <> 'benign')) AS harm FROM t)") + "SELECT count(*) FILTER (WHERE harm > 0) AS harmful, count(*) FILTER (WHERE harm > 1) AS multi, round(coalesce(count(*) FILTER (WHERE harm > 1) * 1.0 / nullif(count(*) FILTER (WHERE harm > 0), 0), 0), 6) AS rate, count(*) FILTER (WHERE labels = ['benign']) AS benign_only FROM h")
    def multilabel_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
        return multilabel(rows(spark, sf_dir, "r"), "category_labels")

    @reg.add("label_pairs", with_sql("r", f"t AS (SELECT list_sort(list_filter({_CLEAN}, lambda x: x <> 'benign')) AS h FROM r)") + "SELECT h[1] || '+' || h[2] AS pair, count(*) AS n FROM t WHERE len(h) > 1 GROUP BY 1 ORDER BY n DESC, pair LIMIT 10")
    def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = F.array_sort(F.filter(clean_labels(F.col("category_labels")), lambda x: x != "benign"))
        t = rows(spark, sf_dir, "r").select(h.alias("h")).filter("size(h) > 1")
        return t.groupBy(F.array_join(F.slice("h", 1, 2), "+").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(10)

    check = "CASE WHEN post_id IS NULL OR user_id IS NULL OR thread_id IS NULL THEN 'missing_keys' WHEN contains(coalesce(text, ''), '<LBL:') THEN 'has_tokens' WHEN {size} = 0 THEN 'empty_labels' ELSE 'ok' END"

    @reg.add("record_validation", with_sql("r") + f"SELECT {check.format(size='coalesce(len(category_labels), 0)')} AS verdict, count(*) AS n FROM r GROUP BY 1")
    def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "r").groupBy(F.expr(check.format(size="coalesce(size(category_labels), 0)")).alias("verdict")).agg(F.count("*").alias("n"))

    @reg.add("label_priors", with_sql("k") + f"SELECT {_LABEL.format(x='primary_label')} AS label, count(*) AS n, round(avg(benign_on_none_prob), 8) AS mean, round(stddev_pop(benign_on_none_prob), 8) AS std, min(benign_on_none_prob) AS low, max(benign_on_none_prob) AS high FROM k WHERE primary_label IS NOT NULL GROUP BY 1")
    def label_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "k").filter("primary_label IS NOT NULL")
        v = F.col("benign_on_none_prob")
        return k.groupBy(F.translate(F.lower(F.trim("primary_label")), "- ", "__").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(v), 8).alias("mean"), F.round(F.stddev_pop(v), 8).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))

    @reg.add("text_stats", with_sql("d") + "SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_length, min(length(text)) AS shortest, max(length(text)) AS longest, count(*) FILTER (WHERE lang IS NULL) AS no_lang, count(*) FILTER (WHERE source IS NULL) AS no_source, count(*) FILTER (WHERE user_id IS NULL) AS no_user FROM d")
    def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.length("text").cast("long")
        return rows(spark, sf_dir, "d").agg(
            F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.min(n).alias("shortest"), F.max(n).alias("longest"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(a) for c, a in (("lang", "no_lang"), ("source", "no_source"), ("user_id", "no_user"))]
        )

    @reg.add("majority_vote", "WITH v AS (SELECT record_table, record_id, abusive, count(*) AS n, min(annotator) AS first_by FROM abuse_labels WHERE abusive IS NOT NULL GROUP BY ALL) SELECT record_table, record_id, abusive AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY record_table, record_id ORDER BY n DESC, first_by) AS k FROM v) WHERE k = 1")
    def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = ["record_table", "record_id"]
        v = table(spark, sf_dir, "abuse_labels").filter("abusive IS NOT NULL").groupBy(*key, "abusive").agg(F.count("*").alias("n"), F.min("annotator").alias("first_by"))
        return top_per_group(v, key, [F.desc("n"), F.asc("first_by")], 1).select(*key, F.col("abusive").alias("label"), "n")

    truth = f"coalesce({_LABEL.format(x='category_labels[1]')}, '') AS truth, coalesce({_LABEL.format(x='persona_id')}, '') AS guess"

    @reg.add(
        "class_metrics",
        with_sql("r", f"t AS (SELECT {truth} FROM r)", "k AS (SELECT truth AS class FROM t UNION SELECT guess FROM t)")
        + "SELECT class, count(*) FILTER (WHERE truth = class) AS support, round(coalesce(2.0 * count(*) FILTER (WHERE truth = class AND guess = class) / nullif(count(*) FILTER (WHERE truth = class) + count(*) FILTER (WHERE guess = class), 0), 0), 6) AS f1 FROM k JOIN t ON truth = class OR guess = class GROUP BY class",
    )
    def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
        clean = lambda c: F.coalesce(F.translate(F.lower(F.trim(c)), "- ", "__"), F.lit(""))
        t = rows(spark, sf_dir, "r").select(clean(F.get("category_labels", F.lit(0))).alias("truth"), clean(F.col("persona_id")).alias("guess"))
        return metrics_of(t)

    wide = [*BENIGN, *RECOVERY, *RISKY]
    tiers = {**{x: "tier_benign" for x in BENIGN}, **{x: "tier_recovery" for x in RECOVERY}, **{x: "tier_risky" for x in RISKY}}
    values = ", ".join(f"('{x}', '{tiers[x]}')" for x in wide)

    @reg.add(
        "hybrid_f1",
        with_sql("r", f"w(label, tier) AS (VALUES {values})", f"t AS (SELECT post_id, {_CLEAN} AS truth, [persona_id] AS guess FROM r)", "cells AS (SELECT post_id, label, tier, CAST(list_contains(truth, label) AS INT) AS t, CAST(list_contains(guess, label) AS INT) AS g FROM t, w)")
        + """, a AS (SELECT label, coalesce(2.0 * sum(t * g) / nullif(sum(t) + sum(g), 0), 0) AS f1 FROM cells GROUP BY label),
        b AS (SELECT tier, coalesce(2.0 * sum(t * g) / nullif(sum(t) + sum(g), 0), 0) AS f1 FROM (SELECT post_id, tier, max(t) AS t, max(g) AS g FROM cells GROUP BY ALL) GROUP BY tier)
        SELECT round((SELECT avg(f1) FROM a), 6) AS persona_f1, round((SELECT avg(f1) FROM b), 6) AS tier_f1, round(0.7 * (SELECT avg(f1) FROM b) + 0.3 * (SELECT avg(f1) FROM a), 6) AS score""",
    )
    def hybrid_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "r").select(clean_labels(F.col("category_labels")).alias("truth"), F.array("persona_id").alias("guess"))
        has = lambda c, x: F.array_contains(c, x).cast("int")
        any_of = lambda c, xs: F.greatest(*[has(c, x) for x in xs], F.lit(0))
        f1 = lambda a, b: F.coalesce(F.try_divide(2 * F.sum(a * b), F.sum(a) + F.sum(b)), F.lit(0.0))
        labels = [f1(F.coalesce(has("truth", x), F.lit(0)), F.coalesce(has("guess", x), F.lit(0))).alias(f"l_{x}") for x in wide]
        groups = [f1(any_of("truth", g), any_of("guess", g)).alias(f"t_{i}") for i, g in enumerate((BENIGN, RECOVERY, RISKY))]
        one = t.agg(*labels, *groups)
        mean = lambda p: sum((F.col(c) for c in one.columns if c.startswith(p)), F.lit(0.0)) / sum(c.startswith(p) for c in one.columns)
        return one.select(F.round(mean("l_"), 6).alias("persona_f1"), F.round(mean("t_"), 6).alias("tier_f1"), F.round(0.7 * mean("t_") + 0.3 * mean("l_"), 6).alias("score"))

    @reg.add("submission_check", "SELECT count(*) AS n, count(*) FILTER (WHERE abusive IS NULL) AS n_null, count(*) FILTER (WHERE abusive NOT IN (0, 1)) AS n_invalid FROM abuse_labels")
    def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "abuse_labels").agg(F.count("*").alias("n"), F.count(F.when(F.col("abusive").isNull(), 1)).alias("n_null"), F.count(F.when(~F.col("abusive").isin(0, 1), 1)).alias("n_invalid"))

    @reg.add("mean_ci_t", "WITH s AS (SELECT event_type, user_id % 20 AS part, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)) * " + f"CASE WHEN count(*) - 1 <= 30 THEN {T975}[count(*) - 1] ELSE 1.96 END, 6) AS half_width FROM s GROUP BY event_type")
    def mean_ci_t(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 20).alias("part")).agg(F.avg("value").alias("v"))
        t = F.coalesce(F.get(F.array(*[F.lit(x) for x in T975]), (F.count("*") - 2).cast("int")), F.lit(1.96))
        return s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")) * t, 6).alias("half_width"))

    @reg.add("mean_ci_normal", "SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS half_width FROM events GROUP BY 1")
    def mean_ci_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("day"))
        return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(1.96 * F.stddev_pop("value") / F.sqrt(F.count("*")), 6).alias("half_width"))

    @reg.add("nrmse", "WITH h AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT day, avg(n) AS r FROM h GROUP BY day) SELECT event_type, round(sqrt(avg((n - r) * (n - r))) / max(r), 6) AS error FROM h JOIN m ON h.day = m.day GROUP BY event_type")
    def nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
        m = h.groupBy("day").agg(F.avg("n").alias("r"))
        d = F.col("n") - F.col("r")
        return h.join(m, "day").groupBy("event_type").agg(F.round(F.sqrt(F.avg(d * d)) / F.max("r"), 6).alias("error"))

    @reg.add("day_counts", with_sql("p") + "SELECT CAST(created_at AS DATE) AS day, count(*) AS n, min(post_id) AS first_id, max(post_id) AS last_id FROM p WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY day DESC LIMIT 14")
    def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").filter("created_at IS NOT NULL").groupBy(F.to_date("created_at").alias("day"))
        return p.agg(F.count("*").alias("n"), F.min("post_id").alias("first_id"), F.max("post_id").alias("last_id")).orderBy(F.desc("day")).limit(14)

    @reg.add("value_counts", with_sql("d") + "SELECT lower(trim(source)) AS source, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM d GROUP BY 1")
    def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = rows(spark, sf_dir, "d").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))
        return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))

    @reg.add("sales_rollforward", "SELECT p.p_partkey, p.p_name, CAST(coalesce(sum(l.l_quantity), 0) AS BIGINT) AS sales FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY ALL")
    def sales_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
        sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
        return table(spark, sf_dir, "part").join(sold, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("q", F.lit(0.0)).cast("long").alias("sales"))

    @reg.add(
        "counter_recompute",
        with_sql("uf", "e AS (SELECT DISTINCT follower_id, followee_id FROM f WHERE followee_id IS NOT NULL)", "a AS (SELECT follower_id AS user_id, count(*) AS n FROM e GROUP BY 1)", "b AS (SELECT followee_id AS user_id, count(*) AS n FROM e GROUP BY 1)")
        + "SELECT u.user_id, coalesce(a.n, 0) AS followings, coalesce(b.n, 0) AS followers, u.num_followers - coalesce(b.n, 0) AS drift FROM u LEFT JOIN a ON u.user_id = a.user_id LEFT JOIN b ON u.user_id = b.user_id",
    )
    def counter_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = rows(spark, sf_dir, "f").filter("followee_id IS NOT NULL").select("follower_id", "followee_id").distinct()
        n = lambda k, a: e.groupBy(F.col(k).alias("user_id")).agg(F.count("*").alias(a))
        u = rows(spark, sf_dir, "u").select("user_id", "num_followers").join(n("follower_id", "followings"), "user_id", "left").join(n("followee_id", "followers"), "user_id", "left")
        u = u.na.fill(0, ["followings", "followers"])
        return u.select("user_id", "followings", "followers", (F.col("num_followers") - F.col("followers")).alias("drift"))

    @reg.add("latency_ranks", "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE k = n // 2) AS p50, max(value) FILTER (WHERE k = CAST(floor(n * 0.75) AS BIGINT)) AS p75, max(value) FILTER (WHERE k = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(value) FILTER (WHERE k = CASE WHEN n > 100 THEN CAST(floor(n * 0.99) AS BIGINT) ELSE n - 1 END) AS p99 FROM t GROUP BY event_type")
    def latency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
        n = e.groupBy("event_type").agg(F.count("*").alias("n"))
        t = grouped_rank(e, ["event_type"], [F.col("value").asc(), F.col("event_id").asc()], "k").join(F.broadcast(n), "event_type")
        at = lambda i: F.max(F.when(F.col("k") == i, F.col("value")))
        part = lambda q: F.floor(F.col("n") * q)
        return t.groupBy("event_type").agg(
            at(F.expr("n div 2")).alias("p50"), at(part(0.75)).alias("p75"), at(part(0.95)).alias("p95"), at(F.when(F.col("n") > 100, part(0.99)).otherwise(F.col("n") - 1)).alias("p99")
        )

    @reg.add("method_comparison", "SELECT event_type AS method, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success, round(avg(CASE WHEN value > 0 THEN value END), 6) AS positive_mean FROM events GROUP BY 1")
    def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("value")
        return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(
            F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(F.when(v > 50, 1.0).otherwise(0.0)), 6).alias("success"), F.round(F.avg(F.when(v > 0, v)), 6).alias("positive_mean")
        )

    @reg.add("archetype_performance", with_sql("r", "t AS (SELECT persona_id, length(text) AS n, unnest(category_labels) AS label FROM r)", "k AS (SELECT persona_id, label, count(*) AS n FROM t GROUP BY ALL)") + "SELECT persona_id, CAST(rank AS INTEGER) AS rank, label, n FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, label) AS rank FROM k) WHERE rank <= 5")
    def archetype_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "r").select("persona_id", F.explode("category_labels").alias("label")).groupBy("persona_id", "label").agg(F.count("*").alias("n"))
        return top_per_group(k, ["persona_id"], [F.desc("n"), F.asc("label")], 5).select("persona_id", "rank", "label", "n")

    @reg.add("mapping_coverage", with_sql("r", f"t AS (SELECT DISTINCT unnest({_CLEAN}) AS label FROM r)") + "SELECT label FROM t WHERE label NOT IN (SELECT category FROM label_targets)")
    def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "r").select(F.explode(clean_labels(F.col("category_labels"))).alias("label")).distinct()
        return t.join(table(spark, sf_dir, "label_targets").select(F.col("category").alias("label")), "label", "left_anti")

    @reg.add("progress", with_sql("r", "t AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS done FROM r GROUP BY split)") + "SELECT split, n, done, round(least(100.0, 100.0 * done / n), 6) AS percent FROM t")
    def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "r").groupBy("split").agg(F.count("*").alias("n"), F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", 1)).alias("done"))
        return t.withColumn("percent", F.round(F.least(F.lit(100.0), 100.0 * F.col("done") / F.col("n")), 6))

    @reg.add("detection_rate", "WITH t AS (SELECT record_table, record_id, max(abusive) AS y FROM abuse_labels GROUP BY ALL) SELECT record_table, count(*) AS n, round(100.0 * count(*) FILTER (WHERE y = 1) / count(*), 6) AS percent FROM t GROUP BY 1")
    def detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "abuse_labels").groupBy("record_table", "record_id").agg(F.max("abusive").alias("y"))
        return t.groupBy("record_table").agg(F.count("*").alias("n"), F.round(100.0 * F.count(F.when(F.col("y") == 1, 1)) / F.count("*"), 6).alias("percent"))

    @reg.add("top_reporters", with_sql("l") + "SELECT user_id, count(*) AS n FROM l GROUP BY user_id HAVING count(*) > 0 ORDER BY n DESC, user_id LIMIT 5")
    def top_reporters(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "l").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)

    @reg.add("endpoint_rates", "SELECT event_type AS endpoint, count(*) FILTER (WHERE value <= 80) AS ok, count(*) FILTER (WHERE value > 80 AND value <= 95) AS limited, count(*) FILTER (WHERE value > 95) AS errors, min(CASE WHEN value > 80 THEN event_id END) AS first_limit, round(count(*) * 60.0 / greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 6) AS per_minute FROM events GROUP BY 1")
    def endpoint_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, s = F.col("value"), (lambda c: F.unix_micros(c.cast("timestamp")) / 1e6)
        n = lambda c: F.count(F.when(c, 1))
        return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("endpoint")).agg(
            n(v <= 80).alias("ok"), n((v > 80) & (v <= 95)).alias("limited"), n(v > 95).alias("errors"), F.min(F.when(v > 80, F.col("event_id"))).alias("first_limit"),
            F.round(F.count("*") * 60.0 / F.greatest(F.lit(1.0), s(F.max("ts")) - s(F.min("ts"))), 6).alias("per_minute"),
        )

    @reg.add("quality_controller", with_sql("r", f"t AS (SELECT len(list_filter({_CLEAN}, lambda x: x <> 'benign')) AS harm FROM r)", "x AS (SELECT coalesce(count(*) FILTER (WHERE harm > 1) * 1.0 / nullif(count(*) FILTER (WHERE harm > 0), 0), 0) AS rate FROM t)", "y AS (SELECT least(0.5, greatest(0.05, 0.1 + 0.5 * (0.25 - rate))) AS double_p FROM x)") + "SELECT round((1 - double_p) * 0.55, 6) AS none_p, round((1 - double_p) * 0.45, 6) AS single_p, round(double_p, 6) AS double_p FROM y")
    def quality_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
        harm = F.size(F.filter(clean_labels(F.col("category_labels")), lambda x: x != "benign"))
        t = rows(spark, sf_dir, "r").select(harm.alias("harm"))
        rate = F.coalesce(F.try_divide(F.count(F.when(F.col("harm") > 1, 1)), F.count(F.when(F.col("harm") > 0, 1))), F.lit(0.0))
        d = F.col("d")
        return t.agg(F.least(F.lit(0.5), F.greatest(F.lit(0.05), 0.1 + 0.5 * (0.25 - rate))).alias("d")).select(F.round((1 - d) * 0.55, 6).alias("none_p"), F.round((1 - d) * 0.45, 6).alias("single_p"), F.round(d, 6).alias("double_p"))
