"""Further operators: token enforcement, quotas, draws, scenarios, coordination and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.functions import harm as H
from plaza.functions.hashing import hash_order, seed32, uniform
from plaza.functions.text import enforced
from plaza.lineage import cut
from plaza.operators.datasets import split
from plaza.operators.feeds import swapped
from plaza.operators.rank import grouped_rank, top_per_group
from plaza.operators.tfidf import best_phrases, hits
from plaza.plans.datasets import label
from plaza.plans.ranking import _SEARCH, query_frame
from plaza.plans.reports import _LABEL
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

#: Extra shares of the stages drawn for personas.
STAGES = [("curious", 0.5), ("active", 0.3), ("entrenched", 0.2)]
#: Phrases of the label tokens that the tables hold, from data/label_tokens_static_bank.yaml of the reference.
BANK = {
    "LBL:MISINFO_CLAIM": ["experts are hiding the real numbers", "they don't want you to know the truth", "mainstream media censors all dissent", "wake up, the evidence is right there", "do your own research, it's obvious", "independent analysts proved it months ago", "peer reviews are being suppressed", "the data got 'corrected' after backlash", "insiders leaked documents contradicting the narrative", "they changed definitions to fit the agenda", "whistleblowers are silenced or ignored", "big platforms shadow-ban inconvenient facts", "the official story has too many holes", "coincidentally all the evidence disappeared", "fact-checkers are compromised", "they memory-holed the original reports", "the numbers don't add up if you look closely", "alternative sources tell a different story", "the narrative keeps shifting suspiciously", "they're gaslighting the entire population"],
    "LBL:SUPPORTIVE": ["sending you strength—take it one step at a time", "you're not alone; we're here for you", "progress isn't linear, but it's still progress", "be gentle with yourself today", "proud of you for speaking up and sharing", "it's okay to ask for help—that's real courage", "small steps count; keep going", "you deserve support and respect", "thank you for your honesty; it helps others too", "healing takes time—stay patient with yourself", "celebrating the little wins with you", "we're rooting for you; you've got this", "your feelings are valid and heard", "reaching out takes strength", "you matter more than you know", "this community has your back", "take care of yourself first", "recovery looks different for everyone"],
    "LBL:GATEKEEPING": ["real fans know the difference", "casuals ruining everything as usual", "you're not a true fan if you don't know this", "the community was better before they showed up", "gatekeeping exists for a reason", "fake fans need to be called out", "you haven't earned the right to an opinion", "bandwagon fans are the worst", "prove you're actually part of the community", "tourists need to leave", "you don't belong here", "real ones remember when...", "normies are ruining everything", "this isn't for you, move along", "you haven't put in the time"],
    "LBL:BENIGN": ["just sharing some thoughts", "interesting perspective on this", "thanks for the discussion", "good points all around", "appreciate the conversation", "that's a fair take", "makes you think", "hadn't considered that angle", "solid point there", "worth discussing further", "reasonable take honestly", "can see both sides here", "food for thought", "fair enough", "interesting to consider"],
}
_UNI = "CAST('0x' || substr(sha256('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("catalog_columns")
    def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = ["post", "post_comment", "post_like", "follow_edge", "platform_user", "group_messages", "post_record", "persona_config", "documents"]
        found = [(n, f.name, f.dataType.simpleString()) for n in names for f in table(spark, sf_dir, n).schema.fields]
        return spark.createDataFrame(found, "table_name string, column_name string, type string")

    @reg.add("token_enforce", with_sql("p") + "SELECT post_id, rtrim(regexp_replace(regexp_replace(regexp_replace(content, '<LBL:([A-Z_]+)>', ' LBL:$1', 'g'), '</LBL:[A-Z_]+>', '', 'g'), 'LBL:[A-Z_$0-9]+', '', 'g')) || ' LBL:BENIGN' AS content FROM p WHERE contains(content, 'LBL:')")
    def token_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = rows(spark, sf_dir, "p", F.col("content").contains("LBL:"))
        return held.select("post_id", enforced(F.col("content"), F.array(F.lit("LBL:BENIGN"))).alias("content"))

    want = "list_transform(list_filter(list_transform(coalesce(category_labels, []), lambda x: replace(replace(lower(trim(x)), '-', '_'), ' ', '_')), lambda x: x <> '' AND x <> 'benign'), lambda x: 'LBL:' || upper(x))"
    bare_sql = "regexp_replace(regexp_replace(regexp_replace(text, '<LBL:([A-Z_]+)>', ' LBL:$1', 'g'), '</LBL:[A-Z_]+>', '', 'g'), 'LBL:[A-Z_$0-9]+', '', 'g')"

    @reg.add("token_enforce_records", with_sql("r", f"t AS (SELECT post_id, {bare_sql} AS bare, {want} AS w FROM r WHERE text IS NOT NULL)") + "SELECT post_id, CASE WHEN len(w) = 0 THEN bare ELSE rtrim(bare) || ' ' || array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') END AS text FROM t")
    def token_enforce_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = rows(spark, sf_dir, "r").filter("text IS NOT NULL").select("post_id", "text", "category_labels")
        named = F.transform(F.coalesce("category_labels", F.array().cast("array<string>")), label)
        tokens = F.array_distinct(F.transform(F.filter(named, lambda x: (x != "") & (x != "benign")), lambda x: F.concat(F.lit("LBL:"), F.upper(x))))
        return r.select("post_id", enforced(F.col("text"), tokens).alias("text"))

    @reg.add("zip_rows", with_sql("p", "a AS (SELECT post_id, row_number() OVER (ORDER BY post_id) AS k FROM p)", "b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents)") + "SELECT a.post_id, b.doc_id FROM a JOIN b ON a.k = b.k")
    def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        number = lambda df, k: grouped_rank(df.select(k, F.lit(0).alias("one")), ["one"], [F.col(k).asc()], "k").select(k, "k")
        return number(rows(spark, sf_dir, "p"), "post_id").join(number(rows(spark, sf_dir, "d"), "doc_id"), "k").select("post_id", "doc_id")

    @reg.add("active_everywhere", with_sql("plc") + "SELECT DISTINCT user_id FROM p WHERE user_id IN (SELECT user_id FROM l) AND user_id IN (SELECT user_id FROM c)")
    def active_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rows(spark, sf_dir, "p").select("user_id").distinct()
        for t in "lc":
            out = out.join(rows(spark, sf_dir, t).select("user_id"), "user_id", "left_semi")
        return out

    @reg.add("dataset_stats", with_sql("pcd") + "SELECT 'post' AS dataset, count(*) AS n, round(avg(length(content)), 6) AS mean_length FROM p UNION ALL SELECT 'comment', count(*), round(avg(length(content)), 6) FROM c UNION ALL SELECT 'document', count(*), round(avg(length(text)), 6) FROM d")
    def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda t, n, c: rows(spark, sf_dir, t).agg(F.count("*").alias("n"), F.round(F.avg(F.length(c)), 6).alias("mean_length")).select(F.lit(n).alias("dataset"), "n", "mean_length")
        return part("p", "post", "content").unionByName(part("c", "comment", "content")).unionByName(part("d", "document", "text"))

    @reg.add("cluster_labels", "WITH t AS (SELECT vec_id % 12 AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL) SELECT cluster, label, n, round(n * 1.0 / sum(n) OVER (PARTITION BY cluster), 3) AS share FROM t")
    def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 12).alias("cluster"), "label").agg(F.count("*").alias("n"))
        whole = t.groupBy("cluster").agg(F.sum("n").alias("whole"))
        return t.join(whole, "cluster").select("cluster", "label", "n", F.round(F.col("n") / F.col("whole"), 3).alias("share"))

    @reg.add("merged_search", with_sql("d", _SEARCH.strip(), "s AS (SELECT h.query_id, coalesce(lower(trim(d.source)), 'unknown') AS dataset, h.doc_id, h.score FROM hits h JOIN d ON h.doc_id = d.doc_id WHERE h.score > 0.05)", "a AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset ORDER BY score DESC, doc_id) AS k FROM s)") + "SELECT query_id, dataset, doc_id, round(score, 6) AS score FROM a WHERE k <= 2")
    def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rows(spark, sf_dir, "d")
        found = hits(docs, "doc_id", "text", query_frame(spark)).filter("score > 0.05")
        named = found.join(docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("dataset")), "doc_id")
        return top_per_group(named, ["query_id", "dataset"], [F.desc("score"), F.asc("doc_id")], 2).select("query_id", "dataset", "doc_id", F.round("score", 6).alias("score"))

    @reg.add("phrase_by_text")
    def phrase_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
        bank = spark.createDataFrame([(t, i, x) for t, phrases in BANK.items() for i, x in enumerate(phrases)], "token string, at int, phrase string")
        return best_phrases(rows(spark, sf_dir, "p"), "post_id", "content", bank)

    @reg.add("coarse_sample", with_sql("p") + "SELECT post_id FROM p ORDER BY md5('coarse:' || post_id), post_id LIMIT 400")
    def coarse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id").orderBy(hash_order("coarse", F.col("post_id")), "post_id").limit(400)

    @reg.add("diversity_swap_posts")
    def diversity_swap_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return swapped(rows(spark, sf_dir, "l"), rows(spark, sf_dir, "p"), 1, 23)

    harm = "('extremist', 'hate_speech', 'bullying')"

    @reg.add("mixed_scenario", with_sql("k", f"t AS (SELECT persona_id, {_LABEL.format(x='primary_label')} AS label FROM k)", f"x AS (SELECT persona_id, CASE WHEN label IN {harm} THEN 'explicit' WHEN label IN ('incel_misogyny', 'conspiracy') THEN 'implicit' WHEN label = 'benign' THEN 'neutral' END AS kind FROM t)", "s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('mix:' || persona_id), persona_id) AS k FROM x WHERE kind IS NOT NULL)") + "SELECT persona_id, kind, CASE kind WHEN 'neutral' THEN 0 ELSE 1 END AS label FROM s WHERE k <= 20")
    def mixed_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = label(F.col("primary_label"))
        kind = F.when(x.isin("extremist", "hate_speech", "bullying"), "explicit").when(x.isin("incel_misogyny", "conspiracy"), "implicit").when(x == "benign", "neutral")
        t = rows(spark, sf_dir, "k").select("persona_id", kind.alias("kind")).filter("kind IS NOT NULL").withColumn("h", hash_order("mix", F.col("persona_id")))
        return top_per_group(t, ["kind"], [F.asc("h"), F.asc("persona_id")], 20).select("persona_id", "kind", F.when(F.col("kind") == "neutral", 0).otherwise(1).alias("label"))

    @reg.add("split_two_keys", with_sql("d", "t AS (SELECT doc_id, coalesce(lang, '') || '|' || coalesce(lower(trim(source)), '') AS stratum FROM d)", "s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('80:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM t)") + "SELECT doc_id, CASE WHEN k < n * 80 // 100 THEN 'train' ELSE 'test' END AS split FROM s")
    def split_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = lambda c: F.coalesce(c, F.lit(""))
        t = rows(spark, sf_dir, "d").select("doc_id", F.concat(e(F.col("lang")), F.lit("|"), e(F.lower(F.trim("source")))).alias("stratum"))
        return split(t, "doc_id", ["stratum"], "80", [("train", 80), ("test", 100)]).select("doc_id", "split")

    @reg.add("quota_plan", "WITH t AS (SELECT category, target_pct, greatest(1, CAST(floor(target_pct * 200 / 100.0) AS INTEGER)) AS quota FROM label_targets WHERE scope = 'post_record') SELECT category, quota, CAST(sum(quota) OVER (ORDER BY quota DESC, category) AS BIGINT) AS upto FROM t")
    def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "label_targets").filter("scope = 'post_record'").select("category", F.greatest(F.lit(1), F.floor(F.col("target_pct") * 200 / 100).cast("int")).alias("quota"))
        return t.select("category", "quota", F.sum("quota").over(Window.orderBy(F.desc("quota"), "category").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))

    @reg.add("weighted_draw", with_sql("u", f"t AS (SELECT user_id, {_UNI.format(seed='stage', key='user_id')} AS x FROM u)") + "SELECT user_id, CASE WHEN x < 0.5 THEN 'curious' WHEN x < 0.8 THEN 'active' ELSE 'entrenched' END AS stage FROM t")
    def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, upto, out = uniform(F.lit("stage"), F.col("user_id").cast("string")), 0.0, None
        for name, share in STAGES[:-1]:
            upto = round(upto + share, 9)
            out = F.when(x < upto, name) if out is None else out.when(x < upto, name)
        return rows(spark, sf_dir, "u").select("user_id", out.otherwise(STAGES[-1][0]).alias("stage"))

    @reg.add("enriched_personas", with_sql("k", f"t AS (SELECT persona_id, benign_on_none_prob AS base, {_UNI.format(seed='boost', key='persona_id')} AS x FROM k)") + "SELECT persona_id, round(least(1.0, greatest(0.0, base + (x - 0.5) * 0.2)), 6) AS rate FROM t")
    def enriched_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
        rate = F.col("benign_on_none_prob") + (uniform(F.lit("boost"), F.col("persona_id")) - 0.5) * 0.2
        return rows(spark, sf_dir, "k").select("persona_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)), 6).alias("rate"))

    @reg.add("gold_scores")
    def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = lambda s: (seed32(F.lit(s), F.col("post_id")) + 1).cast("double") / float((1 << 32) + 1)
        normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
        mean = F.when(F.coalesce(label(F.get("category_labels", F.lit(0))), F.lit("benign")) == "benign", 0.1).otherwise(0.7)
        return rows(spark, sf_dir, "r").select("post_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean + 0.1 * normal)), 4).alias("score"))

    @reg.add("label_queue", "WITH t AS (SELECT category, unnest(range(target_pct)) AS i FROM label_targets WHERE scope = 'post_record'), q AS (SELECT category, row_number() OVER (ORDER BY category, i) - 1 AS k FROM t), s AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT term FROM abuse_terms)) SELECT q.k AS position, q.category, s.term AS seed FROM q JOIN s ON q.k % s.n = s.k")
    def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "label_targets").filter("scope = 'post_record' AND target_pct > 0").select("category", F.explode(F.sequence(F.lit(0), F.col("target_pct") - 1)).alias("i"), F.lit(0).alias("one"))
        q = grouped_rank(t, ["one"], [F.col("category").asc(), F.col("i").asc()], "position").select("position", "category")
        s = grouped_rank(table(spark, sf_dir, "abuse_terms").select("term").distinct().withColumn("one", F.lit(0)), ["one"], [F.col("term").asc()], "k").select("k", F.col("term").alias("seed"))
        n = s.agg(F.count("*").alias("n"))
        return q.join(F.broadcast(n)).withColumn("k", F.col("position") % F.col("n")).join(s, "k").select("position", "category", "seed")

    second = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{'|'.join(ps)}', 'i') THEN '{c}' END" for c, ps in H.SECOND.items()) + "], lambda x: x IS NOT NULL)"

    @reg.add("second_detector", with_sql("d", f"t AS (SELECT doc_id, {second} AS found FROM d)") + "SELECT doc_id, CASE WHEN len(found) = 0 THEN 'benign' ELSE array_to_string(found, ',') END AS categories FROM t")
    def second_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.coalesce(H.second_categories(F.col("text")), F.array(F.lit("benign")))
        return rows(spark, sf_dir, "d").select("doc_id", F.array_join(found, ",").alias("categories"))

    @reg.add("reply_template", with_sql("d") + "SELECT doc_id, CASE WHEN regexp_matches(text, 'vaccine|blood test', 'i') THEN 'health' WHEN regexp_matches(text, 'election', 'i') THEN 'politics' ELSE 'general' END || '_' || (CAST('0x' || substr(sha256('reply:' || doc_id), 1, 8) AS BIGINT) % 3) AS template FROM d")
    def reply_template(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.col("text")
        kind = F.when(t.rlike("(?i)vaccine|blood test"), "health").when(t.rlike("(?i)election"), "politics").otherwise("general")
        return rows(spark, sf_dir, "d").select("doc_id", F.concat(kind, F.lit("_"), F.pmod(seed32(F.lit("reply"), F.col("doc_id").cast("string")), F.lit(3)).cast("string")).alias("template"))

    @reg.add("lexicon_spans", with_sql("r", "t AS (SELECT post_id, split, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS span FROM r)") + "SELECT split, CAST(rank AS INTEGER) AS rank, post_id FROM (SELECT split, post_id, row_number() OVER (PARTITION BY split ORDER BY post_id) AS rank FROM t WHERE len(string_split(span, ' ')) BETWEEN 6 AND 200) WHERE rank <= 250")
    def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
        span = F.trim(F.regexp_replace("text", r"\s+", " "))
        t = rows(spark, sf_dir, "r").filter(F.size(F.split(span, " ")).between(6, 200)).select("split", "post_id")
        return top_per_group(t, ["split"], [F.asc("post_id")], 250).select("split", "rank", "post_id")

    @reg.add("coordination", with_sql("p", "t AS (SELECT CAST(created_at AS DATE) AS day, original_post_id AS post_id, count(*) AS n FROM p WHERE original_post_id IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL)") + "SELECT day, CAST(rank AS INTEGER) AS rank, post_id, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, post_id) AS rank FROM t) WHERE rank <= 3")
    def coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = rows(spark, sf_dir, "p").filter("original_post_id IS NOT NULL AND created_at IS NOT NULL")
        t = p.groupBy(F.to_date("created_at").alias("day"), F.col("original_post_id").alias("post_id")).agg(F.count("*").alias("n"))
        return top_per_group(t, ["day"], [F.desc("n"), F.asc("post_id")], 3).select("day", "rank", "post_id", "n")

    @reg.add("expected_detected", with_sql("p", "t AS (SELECT post_id, len(list_distinct(regexp_extract_all(coalesce(content, ''), 'LBL:[A-Z_]+'))) AS detected, CASE WHEN num_reports > 0 THEN 1 ELSE 0 END AS expected FROM p)") + "SELECT expected, detected, count(*) AS n FROM t GROUP BY ALL")
    def expected_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("(LBL:[A-Z_]+)"), F.lit(1)))).cast("long")
        return rows(spark, sf_dir, "p").groupBy(F.when(F.col("num_reports") > 0, 1).otherwise(0).alias("expected"), n.alias("detected")).agg(F.count("*").alias("n"))

    @reg.add("json_step_groups", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS step, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 GROUP BY 1")
    def json_step_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").try_cast("long")
        return table(spark, sf_dir, "events").filter(k != 0).groupBy((k % 10).alias("step")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))

    @reg.add("profile_ingest", with_sql("uf") + "SELECT u.user_id, trim(u.user_name) AS user_name, count(DISTINCT f.followee_id) AS n_following FROM u LEFT JOIN f ON u.user_id = f.follower_id GROUP BY ALL")
    def profile_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = rows(spark, sf_dir, "f").groupBy(F.col("follower_id").alias("user_id")).agg(F.countDistinct("followee_id").alias("n"))
        u = rows(spark, sf_dir, "u").select("user_id", F.trim("user_name").alias("user_name"))
        return u.join(n, "user_id", "left").select("user_id", "user_name", F.coalesce("n", F.lit(0)).alias("n_following"))

    @reg.add("pool_sample", with_sql("k", f"t AS (SELECT persona_id, {_LABEL.format(x='primary_label')} AS label FROM k WHERE primary_label IS NOT NULL)") + "SELECT label, persona_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('pool:' || persona_id), persona_id) AS k FROM t) WHERE k <= 3")
    def pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rows(spark, sf_dir, "k").filter("primary_label IS NOT NULL").select("persona_id", label(F.col("primary_label")).alias("label")).withColumn("h", hash_order("pool", F.col("persona_id")))
        return top_per_group(t, ["label"], [F.asc("h"), F.asc("persona_id")], 3).select("label", "persona_id")

    @reg.add("topic_stars", with_sql("c") + "SELECT DISTINCT c.user_id, t.source AS star FROM c JOIN (SELECT DISTINCT lower(trim(source)) AS source, substr(lower(trim(source)), 1, 1) AS letter FROM documents WHERE source IS NOT NULL) t ON substr(lower(c.content), 1, 1) = t.letter WHERE CAST('0x' || substr(sha256('star:' || c.user_id || ':' || t.source), 1, 8) AS BIGINT) / 4294967296.0 < 0.2")
    def topic_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
        stars = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.lower(F.trim("source")).alias("star")).distinct().withColumn("letter", F.substring("star", 1, 1))
        users = rows(spark, sf_dir, "c").select("user_id", F.substring(F.lower("content"), 1, 1).alias("letter")).distinct()
        keep = uniform(F.lit("star"), F.col("user_id").cast("string"), F.col("star")) < 0.2
        return users.join(stars, "letter").filter(keep).select("user_id", "star").distinct()

    @reg.add("rewired_edges")
    def rewired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Pairs of edges are drawn by hash; their targets are swapped where that brings the degrees of the ends closer.
        e = rows(spark, sf_dir, "f").filter("followee_id IS NOT NULL AND follower_id <> followee_id").select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst")).distinct()
        d = e.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
        side = lambda c: d.select(F.col("n").alias(c), F.col("d").alias(f"d_{c}"))
        k = e.join(side("src"), "src").join(side("dst"), "dst").withColumns({"one": F.lit(0), "h": F.xxhash64("src", "dst")})
        k = cut(grouped_rank(k, ["one"], [F.col("h").asc(), F.col("src").asc(), F.col("dst").asc()], "k"), "edges")
        a = k.filter("k % 2 = 0").select((F.col("k") / 2).cast("long").alias("p"), *[F.col(c).alias(f"a_{c}") for c in ("src", "dst", "d_src", "d_dst")])
        b = k.filter("k % 2 = 1").select(((F.col("k") - 1) / 2).cast("long").alias("p"), *[F.col(c).alias(f"b_{c}") for c in ("src", "dst", "d_src", "d_dst")])
        gap = lambda x, y: F.abs(F.col(f"{x}_d_src") - F.col(f"{y}_d_dst"))
        swap = (gap("a", "b") + gap("b", "a") < gap("a", "a") + gap("b", "b")) & (F.col("a_src") != F.col("b_dst")) & (F.col("b_src") != F.col("a_dst"))
        both = a.join(b, "p", "left").withColumn("swap", F.coalesce(swap, F.lit(False)))
        pairs = F.array(
            F.struct(F.col("a_src").alias("src"), F.when(F.col("swap"), F.col("b_dst")).otherwise(F.col("a_dst")).alias("dst")),
            F.struct(F.col("b_src").alias("src"), F.when(F.col("swap"), F.col("a_dst")).otherwise(F.col("b_dst")).alias("dst")),
        )
        return both.select(F.inline(pairs)).filter("src IS NOT NULL").distinct()
