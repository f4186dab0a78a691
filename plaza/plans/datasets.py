"""Dataset building: exports, splits, samples, quotas and label mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.functions.hashing import hash_order
from plaza.functions.text import squeeze
from plaza.operators.datasets import apportion, balanced, clean_labels, split
from plaza.operators.rank import grouped_rank, top_per_group
from plaza.operators.skew import collect_hot, lookup_join
from plaza.plans.reports import _CLEAN, _LABEL
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

RISKY = ["extremist", "hate_speech", "bullying", "incel_misogyny"]
_IN = "('" + "', '".join(RISKY) + "')"


def label(c):
    """A label in one spelling."""
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add(
        "export_records",
        with_sql("pc") + "SELECT 'p_' || post_id AS post_id, 'p_' || coalesce(original_post_id, post_id) AS thread_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN original_post_id IS NOT NULL THEN 'p_' || original_post_id END AS parent_id, coalesce(nullif(trim(content), ''), quote_content) AS text FROM p UNION ALL SELECT 'c_' || comment_id, 'p_' || post_id, CAST(user_id AS VARCHAR), 'p_' || post_id, content FROM c",
    )
    def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = lambda k, c: F.concat(F.lit(k + "_"), c.cast("string"))
        p, c = rows(spark, sf_dir, "p"), rows(spark, sf_dir, "c")
        a = p.select(
            name("p", F.col("post_id")).alias("post_id"), name("p", F.coalesce("original_post_id", "post_id")).alias("thread_id"), F.col("user_id").cast("string").alias("user_id"), name("p", F.col("original_post_id")).alias("parent_id"), F.coalesce(F.nullif(F.trim("content"), F.lit("")), "quote_content").alias("text")
        )
        b = c.select(name("c", F.col("comment_id")).alias("post_id"), name("p", F.col("post_id")).alias("thread_id"), F.col("user_id").cast("string").alias("user_id"), name("p", F.col("post_id")).alias("parent_id"), F.col("content").alias("text"))
        return a.unionByName(b)

    @reg.add(
        "label_precedence",
        with_sql("rk", f"t AS (SELECT post_id, list_filter({_CLEAN}, lambda x: x <> '') AS own, persona_id FROM r)")
        + "SELECT t.post_id, CASE WHEN len(own) > 0 THEN array_to_string(own, ',') WHEN k.primary_label IS NOT NULL THEN lower(trim(k.primary_label)) ELSE 'benign' END AS labels FROM t LEFT JOIN k ON t.persona_id = k.persona_id",
    )
    def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = F.filter(clean_labels(F.col("category_labels")), lambda x: x != "")
        r = rows(spark, sf_dir, "r").select("post_id", own.alias("own"), "persona_id")
        k = rows(spark, sf_dir, "k").select("persona_id", F.lower(F.trim("primary_label")).alias("main"))
        both = lookup_join(r, k, ["persona_id"], collect_hot(r, ["persona_id"]), ["post_id"])
        return both.select("post_id", F.when(F.size("own") > 0, F.array_join("own", ",")).otherwise(F.coalesce("main", F.lit("benign"))).alias("labels"))

    @reg.add("text_precedence", with_sql("p") + "SELECT post_id, CASE WHEN trim(quote_content) <> '' THEN 'rag-llm' WHEN trim(content) <> '' THEN 'skip' ELSE 'v0-mvp' END AS provenance FROM p")
    def text_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.when(F.trim("quote_content") != "", "rag-llm").when(F.trim("content") != "", "skip").otherwise("v0-mvp").alias("provenance"))

    cut_sql = "CASE WHEN k < n * 70 // 100 THEN 'train' WHEN k < n * 85 // 100 THEN 'test' ELSE 'holdout' END"

    @reg.add("split_stratified", with_sql("k", f"t AS (SELECT persona_id, coalesce({_LABEL.format(x='primary_label')}, '') AS stratum FROM k)", "s AS (SELECT persona_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || persona_id), persona_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM t)") + f"SELECT persona_id, stratum, {cut_sql} AS split FROM s")
    def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "k").select("persona_id", F.coalesce(label(F.col("primary_label")), F.lit("")).alias("stratum"))
        return split(t, "persona_id", ["stratum"], "42", [("train", 70), ("test", 85), ("holdout", 100)])

    @reg.add("split_global", with_sql("u", "s AS (SELECT user_id, row_number() OVER (ORDER BY md5('7:' || user_id), user_id) - 1 AS k, count(*) OVER () AS n FROM u)") + "SELECT user_id, CASE WHEN k < n * 75 // 100 THEN 'train' WHEN k < n * 90 // 100 THEN 'val' ELSE 'test' END AS split FROM s")
    def split_global(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = rows(spark, sf_dir, "u").select("user_id", F.lit(0).alias("one"))
        return split(u, "user_id", ["one"], "7", [("train", 75), ("val", 90), ("test", 100)]).select("user_id", "split")

    @reg.add("sample_balanced", with_sql("k", f"t AS (SELECT persona_id, {_LABEL.format(x='primary_label')} <> 'benign' AS harmful FROM k WHERE primary_label IS NOT NULL)", "s AS (SELECT *, row_number() OVER (PARTITION BY harmful ORDER BY md5('1:' || persona_id), persona_id) AS k FROM t)", "m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM t GROUP BY harmful))") + "SELECT persona_id, harmful FROM s, m WHERE k <= m")
    def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "k").filter("primary_label IS NOT NULL").select("persona_id", (label(F.col("primary_label")) != "benign").alias("harmful"))
        return balanced(t, "persona_id", "harmful", "1")

    @reg.add("sample_quota", with_sql("r", f"t AS (SELECT post_id, CASE WHEN coalesce({_LABEL.format(x='category_labels[1]')}, 'benign') = 'benign' THEN 0 ELSE 1 END AS harmful FROM r)", "s AS (SELECT *, row_number() OVER (PARTITION BY harmful ORDER BY md5('9:' || post_id), post_id) AS k FROM t)") + "SELECT post_id, harmful FROM s WHERE k <= CASE harmful WHEN 1 THEN 200 ELSE 800 END")
    def sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.coalesce(label(F.get("category_labels", F.lit(0))), F.lit("benign"))
        t = rows(spark, sf_dir, "r").select("post_id", F.when(first == "benign", 0).otherwise(1).alias("harmful")).withColumn("h", hash_order("9", F.col("post_id")))
        return top_per_group(t, ["harmful"], [F.asc("h"), F.asc("post_id")], 800, "k").filter("k <= CASE harmful WHEN 1 THEN 200 ELSE 800 END").select("post_id", "harmful")

    @reg.add("sample_weighted", with_sql("k", f"t AS (SELECT persona_id, {_LABEL.format(x='primary_label')} AS label FROM k WHERE primary_label IS NOT NULL)", "w AS (SELECT category AS label, target_pct AS n FROM label_targets WHERE scope = 'persona_config')", "s AS (SELECT t.*, w.n, row_number() OVER (PARTITION BY t.label ORDER BY md5('3:' || persona_id), persona_id) AS k FROM t JOIN w ON t.label = w.label)") + "SELECT persona_id, label FROM s WHERE k <= n")
    def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = table(spark, sf_dir, "label_targets").filter("scope = 'persona_config'").select(F.col("category").alias("label"), F.col("target_pct").alias("n"))
        t = rows(spark, sf_dir, "k").filter("primary_label IS NOT NULL").select("persona_id", label(F.col("primary_label")).alias("label")).withColumn("h", hash_order("3", F.col("persona_id")))
        return top_per_group(t.join(w, "label"), ["label"], [F.asc("h"), F.asc("persona_id")], 100, "k").filter("k <= n").select("persona_id", "label")

    @reg.add("dedup_clean_text", with_sql("d") + "SELECT min(doc_id) AS doc_id FROM d GROUP BY trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))")
    def dedup_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = rows(spark, sf_dir, "d").select("doc_id", squeeze(F.col("text")).alias("t"))
        # Equal texts meet by two hashes, so whole texts are not shuffled.
        return d.groupBy(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(3), "t").alias("b")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")

    @reg.add("rule_mapping", with_sql("r", f"t AS (SELECT post_id, {_CLEAN} AS l FROM r)") + f"SELECT post_id, CASE WHEN list_contains(l, 'misinfo') AND list_contains(l, 'conspiracy') THEN 'deep_conspiracy' WHEN list_has_any(l, {RISKY}) AND NOT list_contains(l, 'benign') THEN 'hostile' WHEN len(l) > 0 THEN l[1] ELSE 'fallback' END AS archetype FROM t")
    def rule_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
        has = lambda x: F.array_contains("l", x)
        t = rows(spark, sf_dir, "r").select("post_id", clean_labels(F.col("category_labels")).alias("l"))
        out = F.when(has("misinfo") & has("conspiracy"), "deep_conspiracy").when(F.arrays_overlap("l", F.array(*[F.lit(x) for x in RISKY])) & ~has("benign"), "hostile").when(F.size("l") > 0, F.get("l", F.lit(0))).otherwise("fallback")
        return t.select("post_id", out.alias("archetype"))

    @reg.add("conflict_mapping", with_sql("r", f"t AS (SELECT post_id, list_sort(list_distinct({_CLEAN})) AS l FROM r)", "x AS (SELECT post_id, CASE WHEN list_contains(l, 'conspiracy') THEN list_filter(l, lambda x: x <> 'misinfo') ELSE l END AS l FROM t)") + "SELECT post_id, CASE WHEN list_contains(l, 'benign') AND len(l) > 1 THEN 'benign' ELSE array_to_string(l, ',') END AS labels FROM x")
    def conflict_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "r").select("post_id", F.array_sort(F.array_distinct(clean_labels(F.col("category_labels")))).alias("l"))
        t = t.withColumn("l", F.when(F.array_contains("l", "conspiracy"), F.array_except("l", F.array(F.lit("misinfo")))).otherwise(F.col("l")))
        return t.select("post_id", F.when(F.array_contains("l", "benign") & (F.size("l") > 1), "benign").otherwise(F.array_join("l", ",")).alias("labels"))

    @reg.add("score_override", with_sql("p") + "SELECT post_id, CASE WHEN num_reports >= 3 THEN 'severe' WHEN num_reports >= 1 THEN 'moderate' WHEN num_dislikes >= 2 THEN 'mild' ELSE 'none' END AS level FROM p")
    def score_override(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.when(F.col("num_reports") >= 3, "severe").when(F.col("num_reports") >= 1, "moderate").when(F.col("num_dislikes") >= 2, "mild").otherwise("none").alias("level"))

    @reg.add("training_export", with_sql("pcuk", "n AS (SELECT u.user_id, u.user_name, coalesce(k.primary_label, 'unknown') AS label FROM u LEFT JOIN k ON lower(trim(u.user_name)) = k.persona_id)", "a AS (SELECT 'post' AS type, post_id AS id, user_id, content FROM p UNION ALL SELECT 'comment', comment_id, user_id, content FROM c)") + "SELECT a.type, a.id, n.user_name, a.content, coalesce(n.label, 'unknown') AS label FROM a LEFT JOIN n ON a.user_id = n.user_id WHERE trim(a.content) <> ''")
    def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "k").select(F.col("persona_id").alias("key"), "primary_label")
        n = rows(spark, sf_dir, "u").select("user_id", "user_name", F.lower(F.trim("user_name")).alias("key")).join(k, "key", "left").select("user_id", "user_name", F.coalesce("primary_label", F.lit("unknown")).alias("label"))
        part = lambda t, name, key: rows(spark, sf_dir, t).select(F.lit(name).alias("type"), F.col(key).alias("id"), "user_id", "content")
        a = part("p", "post", "post_id").unionByName(part("c", "comment", "comment_id")).filter("trim(content) <> ''")
        both = lookup_join(a, n, ["user_id"], collect_hot(a, ["user_id"]), ["type", "id"])
        return both.select("type", "id", "user_name", "content", F.coalesce("label", F.lit("unknown")).alias("label"))

    @reg.add("action_log", with_sql("pclf") + "SELECT 'post' AS source, CASE WHEN original_post_id IS NULL THEN 'create_post' WHEN coalesce(quote_content, '') = '' THEN 'repost' ELSE 'quote_post' END AS action, user_id, post_id AS target_id, created_at FROM p UNION ALL SELECT 'comment', 'create_comment', user_id, post_id, created_at FROM c UNION ALL SELECT 'like', 'like_post', user_id, post_id, created_at FROM l UNION ALL SELECT 'follow', 'follow', follower_id, followee_id, created_at FROM f")
    def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
        from plaza.operators.feeds import post_type

        kind = post_type(F.col("original_post_id"), F.col("quote_content"))
        p = rows(spark, sf_dir, "p").select(F.lit("post").alias("source"), F.when(kind == "common", "create_post").when(kind == "repost", "repost").otherwise("quote_post").alias("action"), "user_id", F.col("post_id").alias("target_id"), "created_at")
        part = lambda t, s, a, u, k: rows(spark, sf_dir, t).select(F.lit(s).alias("source"), F.lit(a).alias("action"), F.col(u).alias("user_id"), F.col(k).alias("target_id"), "created_at")
        return p.unionByName(part("c", "comment", "create_comment", "user_id", "post_id")).unionByName(part("l", "like", "like_post", "user_id", "post_id")).unionByName(part("f", "follow", "follow", "follower_id", "followee_id"))

    @reg.add("difficulty_buckets", with_sql("k", f"t AS (SELECT persona_id, {_LABEL.format(x='primary_label')} AS label FROM k)") + f"SELECT CASE WHEN label IN {_IN} THEN 'easy' WHEN label IN ('misinfo', 'conspiracy', 'gamergate') THEN 'medium' WHEN label IS NULL THEN 'none' ELSE 'hard' END AS bucket, count(*) AS n FROM t GROUP BY 1")
    def difficulty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = label(F.col("primary_label"))
        b = F.when(x.isin(*RISKY), "easy").when(x.isin("misinfo", "conspiracy", "gamergate"), "medium").when(x.isNull(), "none").otherwise("hard")
        return rows(spark, sf_dir, "k").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))

    @reg.add("corpus_union", with_sql("pcd") + "SELECT 'post' AS dataset, CAST(post_id AS VARCHAR) AS id, content AS text, CAST(NULL AS VARCHAR) AS lang FROM p UNION ALL SELECT 'comment', CAST(comment_id AS VARCHAR), content, NULL FROM c UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), text, lang FROM d")
    def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda t, n, k, c: rows(spark, sf_dir, t).select(F.lit(n).alias("dataset"), F.col(k).cast("string").alias("id"), F.col(c).alias("text"))
        a = part("p", "post", "post_id", "content").unionByName(part("c", "comment", "comment_id", "content"))
        d = rows(spark, sf_dir, "d").select(F.lit("document").alias("dataset"), F.col("doc_id").cast("string").alias("id"), "text", "lang")
        return a.unionByName(d, allowMissingColumns=True)

    @reg.add("persona_snippets", with_sql("u") + "SELECT user_id, 'primary' AS kind, coalesce(bio, '') AS text FROM u UNION ALL SELECT user_id, 'backup', 'I am ' || coalesce(name, 'someone') FROM u")
    def persona_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
        pair = F.array(F.struct(F.lit("primary").alias("kind"), F.coalesce("bio", F.lit("")).alias("text")), F.struct(F.lit("backup").alias("kind"), F.concat(F.lit("I am "), F.coalesce("name", F.lit("someone"))).alias("text")))
        return rows(spark, sf_dir, "u").select("user_id", F.inline(pair))

    @reg.add("new_terms", with_sql("c", "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '([a-z]+)', 1)) AS term FROM c)") + "SELECT term FROM w WHERE length(term) > 8 AND term NOT IN (SELECT lower(term) FROM abuse_terms) ORDER BY term LIMIT 40")
    def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = rows(spark, sf_dir, "c").select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]+)"), F.lit(1))).alias("term")).filter("length(term) > 8").distinct()
        known = table(spark, sf_dir, "abuse_terms").select(F.lower("term").alias("term"))
        return w.join(known, "term", "left_anti").orderBy("term").limit(40)

    @reg.add("apportion_weighted", "WITH t AS (SELECT source, target_weight * 1000 AS want FROM mix_targets), x AS (SELECT source, CAST(floor(want + 1e-9) AS BIGINT) AS base, round(want - floor(want + 1e-9), 9) AS rest FROM t), y AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS k, 1000 - sum(base) OVER () AS left_over FROM x) SELECT source, base + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS n FROM y")
    def apportion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apportion(table(spark, sf_dir, "mix_targets"), "source", "target_weight", 1000)

    @reg.add("apportion_uniform", "WITH t AS (SELECT category, row_number() OVER (ORDER BY category) AS k, count(*) OVER () AS n FROM label_targets WHERE scope = 'post_record') SELECT category, 100 // n + CASE WHEN k <= 100 % n THEN 1 ELSE 0 END AS quota FROM t")
    def apportion_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "label_targets").filter("scope = 'post_record'")
        t = t.select("category", F.row_number().over(Window.orderBy("category")).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
        return t.select("category", (F.expr("100 div n") + F.when(F.col("k") <= 100 % F.col("n"), 1).otherwise(0)).alias("quota"))

    @reg.add("population_expansion", "SELECT category, CAST(i AS INTEGER) AS i, category || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS name FROM (SELECT category, unnest(range(1, target_pct + 1)) AS i FROM label_targets WHERE scope = 'persona_config')")
    def population_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "label_targets").filter("scope = 'persona_config' AND target_pct > 0")
        return t.select("category", F.explode(F.sequence(F.lit(1), "target_pct")).alias("i")).select("category", "i", F.format_string("%s_%05d", "category", "i").alias("name"))

    @reg.add("topic_pairs", "WITH t AS (SELECT category AS c FROM label_targets WHERE scope = 'post_record') SELECT a.c AS one, b.c AS two FROM t a JOIN t b ON a.c < b.c")
    def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "label_targets").filter("scope = 'post_record'")
        # The categories of one small fixed table, paired within one sorted array.
        a = t.agg(F.array_sort(F.collect_set("category")).alias("s")).select("s", F.posexplode("s").alias("i", "one"))
        return a.select("one", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("two"))

    @reg.add("label_alias", with_sql("k") + "SELECT persona_id, coalesce(CASE lower(trim(primary_label)) WHEN 'recovery_ed' THEN 'recovery' WHEN 'hate_speech' THEN 'hate' END, primary_label) AS label FROM k")
    def label_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
        alias = F.create_map(F.lit("recovery_ed"), F.lit("recovery"), F.lit("hate_speech"), F.lit("hate"))
        return rows(spark, sf_dir, "k").select("persona_id", F.coalesce(alias[F.lower(F.trim("primary_label"))], "primary_label").alias("label"))

    @reg.add("identity_cues", with_sql("u") + "SELECT user_id, nullif(regexp_extract(bio, 'I (told|kept|lost|shared|printed) ([^.;,]+)', 0), '') AS cue FROM u")
    def identity_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "u").select("user_id", F.nullif(F.regexp_extract("bio", "I (told|kept|lost|shared|printed) ([^.;,]+)", 0), F.lit("")).alias("cue"))

    @reg.add("label_term_union", "SELECT category, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT DISTINCT category, lower(term) AS term FROM abuse_terms) GROUP BY category")
    def label_term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "abuse_terms").groupBy("category").agg(F.array_join(F.array_sort(F.collect_set(F.lower("term"))), ",").alias("terms"))

    @reg.add("index_documents", with_sql("d") + "SELECT doc_id, coalesce(text, '') AS document, coalesce(source, '') AS source, coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(lang, '') AS lang FROM d")
    def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        return rows(spark, sf_dir, "d").select("doc_id", e("text").alias("document"), e("source").alias("source"), e("user_id").alias("user_id"), e("lang").alias("lang"))

    @reg.add("extra_tokens", with_sql("r") + "SELECT post_id, array_to_string(coalesce(category_labels, []), ',') || CASE WHEN list_contains(category_labels, 'extra') THEN '' WHEN coalesce(len(category_labels), 0) = 0 THEN 'extra' ELSE ',extra' END AS labels FROM r")
    def extra_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.coalesce("category_labels", F.array().cast("array<string>"))
        return rows(spark, sf_dir, "r").select("post_id", F.array_join(F.when(F.array_contains(c, "extra"), c).otherwise(F.array_append(c, "extra")), ",").alias("labels"))

    @reg.add("reactions_never_own")
    def reactions_never_own(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Each post gets up to three users drawn by hash from the user ids; its author is skipped.
        u = grouped_rank(rows(spark, sf_dir, "u").select("user_id", F.lit(0).alias("one")), ["one"], [F.col("user_id").asc()], "k")
        n = u.agg(F.count("*").alias("n"))
        draws = F.array(*[F.pmod(F.xxhash64(F.lit(i), "post_id"), F.col("n")) for i in range(3)])
        p = rows(spark, sf_dir, "p").select("post_id", F.col("user_id").alias("author_id")).join(F.broadcast(n)).select("post_id", "author_id", F.explode(F.array_distinct(draws)).alias("k"))
        return p.join(u, "k").filter("user_id <> author_id").select("post_id", "user_id")
