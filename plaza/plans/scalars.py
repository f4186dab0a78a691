"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.functions import hashing as H
from plaza.functions import scores as S
from plaza.functions import text as X
from plaza.registry import Registry
from plaza.sources.domain import rows, with_sql
from plaza.sources.tables import table

_SQUEEZE = "trim(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def _hexmod(h: str, n: str, digits: int) -> str:
    """SQL: a hex digest modulo ``n``, folded 15 digits at a time."""
    out = "CAST(0 AS HUGEINT)"
    for at in range(1, digits + 1, 15):
        size = min(15, digits - at + 1)
        out = f"(({out} % {n}) * (CAST({16**size} AS HUGEINT) % {n}) + CAST(CAST('0x' || substr({h}, {at}, {size}) AS BIGINT) AS HUGEINT)) % {n}"
    return f"CAST({out} AS BIGINT)"


_TEMPLATES = ["one", "two", "three", "four", "five", "six", "seven"]
_FIRST = ["alex", "sam", "jo", "kim", "lee", "max", "pat", "ray", "sky", "val"]
_LAST = ["smith", "river", "stone", "field", "brook", "hill", "marsh"]
#: Label tokens and the categories they stand for.
TOKEN_CATEGORIES = {
    "LBL:MISINFO_CLAIM": ["misinfo"],
    "LBL:CONSPIRACY": ["conspiracy", "misinfo"],
    "LBL:SUPPORTIVE": ["benign", "recovery_ed"],
    "LBL:BENIGN": ["benign"],
    "LBL:GATEKEEPING": ["gamergate"],
    "LBL:ED_RISK": ["ed_risk"],
}
#: First parts of user names that name a persona (fixed values).
PREFIXES = ["incel", "misinfo", "benign", "conspiracy", "recovery", "edrisk", "ed_risk", "trad", "gamergate", "pro_ana", "alpha", "extremist", "hate_speech", "bullying"]
_TOKENS_SQL = "regexp_extract_all(coalesce({c}, ''), '<(LBL:[A-Z0-9_]+)>', 1)"


def _map(d: dict[str, list[str]]):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def register(reg: Registry) -> None:
    """Add the queries of this module."""
    docs = lambda spark, d: rows(spark, d, "d")

    def text_query(name: str, expression, sql: str, source: str = "d", key: str = "doc_id", column: str = "text") -> None:
        @reg.add(name, with_sql(source) + f"SELECT {key}, {sql} AS result FROM {source}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rows(spark, sf_dir, source).select(key, expression(F.col(column)).alias("result"))

    text_query("ws_normalise", X.squeeze, _SQUEEZE.format(c="text"))
    text_query("clean_truncate", X.shorten, f"CASE WHEN length({_SQUEEZE.format(c='text')}) > 500 THEN substr({_SQUEEZE.format(c='text')}, 1, 497) || '...' ELSE {_SQUEEZE.format(c='text')} END")
    text_query("text_preview", lambda c: X.preview(c, 50), "CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END")
    text_query("punct_normalise", X.plain_punctuation, _SQUEEZE.format(c="regexp_replace(translate(text, '’‘“”—–', '''''\"\"--'), '!{2,}', '!', 'g')"))
    text_query("ascii_only", X.ascii_words, _SQUEEZE.format(c="regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"))
    text_query("html_escape", X.escape_html, "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")
    text_query("first_integer", lambda c: F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")), "nullif(regexp_extract(text, '([0-9]+)', 1), '')")
    issue_sql = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.ISSUES.items()) + "], lambda x: x IS NOT NULL), ',')"
    text_query("issue_detect", lambda c: F.array_join(X.issues(c), ","), issue_sql)
    strip_sql = "text"
    for pattern, to in X.STRIPS:
        strip_sql = f"regexp_replace({strip_sql}, '{pattern}', '{to}', 'g')"
    text_query("strip_pipeline", X.strip_leftovers, f"trim({strip_sql})")
    text_query("bracket_clean", X.clean_brackets, _SQUEEZE.format(c="regexp_replace(regexp_replace(" + _nested("text", X.DROPPED_TAGS) + ", '\\[[^\\]\\[]{0,19}\\]', '', 'g'), '\\[([^\\]\\[]{20,})\\]', '\\1', 'g')"))
    text_query("token_extract", lambda c: F.array_join(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"<(LBL:[A-Z0-9_]+)>"), F.lit(1)), ","), f"array_to_string({_TOKENS_SQL.format(c='text')}, ',')")
    text_query("keyword_words", lambda c: F.array_join(F.array_distinct(X.keyword_words(c)), " "), "(SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT list_filter(regexp_extract_all(lower(text), '([a-z'']+)', 1), lambda x: length(x) > 3) AS ws)) GROUP BY w))")

    @reg.add(
        "token_categories",
        with_sql("p", "t AS (SELECT post_id, unnest(list_distinct(" + _TOKENS_SQL.format(c="content") + ")) AS token FROM p)", "m(token, category) AS (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in TOKEN_CATEGORIES.items() for x in v) + ")")
        + "SELECT post_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM t JOIN m ON t.token = m.token GROUP BY post_id",
    )
    def token_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = _map(TOKEN_CATEGORIES)
        tokens = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"<(LBL:[A-Z0-9_]+)>"), F.lit(1))
        cats = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.coalesce(known[t], F.array().cast("array<string>"))))))
        return rows(spark, sf_dir, "p").select("post_id", F.array_join(cats, ",").alias("categories")).filter("categories <> ''")

    @reg.add(
        "token_replace",
        with_sql("p") + "SELECT post_id, replace(content, '<LBL:SUPPORTIVE>', list_extract(['" + "', '".join(_TEMPLATES) + "'], 1 + " + _hexmod("sha256('7:' || post_id || ':LBL:SUPPORTIVE:0')", "7", 64) + ")) AS content FROM p WHERE contains(content, '<LBL:SUPPORTIVE>')",
    )
    def token_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
        pick = H.sha_choice(F.concat(F.lit("7:"), F.col("post_id").cast("string"), F.lit(":LBL:SUPPORTIVE:0")), len(_TEMPLATES))
        phrase = F.get(F.array(*[F.lit(x) for x in _TEMPLATES]), pick.cast("int"))
        p = rows(spark, sf_dir, "p").filter(F.col("content").contains("<LBL:SUPPORTIVE>"))
        return p.select("post_id", F.replace("content", F.lit("<LBL:SUPPORTIVE>"), phrase).alias("content"))

    @reg.add("md5_choice", with_sql("u") + "SELECT user_id, " + _hexmod("md5(user_id || '-token')", "13", 32) + " AS choice FROM u")
    def md5_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "u").select("user_id", H.md5_choice(F.concat(F.col("user_id").cast("string"), F.lit("-token")), 13).alias("choice"))

    h = "md5(user_id || '-seed-identity')"
    @reg.add(
        "pseudonym",
        with_sql("u", f"t AS (SELECT user_id, {_hexmod(h, '10', 32)} AS a, {_hexmod(f'substr({h}, 1, 30)', '7', 30)} AS b, {_hexmod(f'substr({h}, 1, 28)', '100', 28)} AS n FROM u)")
        + f"SELECT user_id, list_extract({_FIRST}, a + 1) || '_' || list_extract({_LAST}, b + 1) || n AS pseudonym FROM t",
    )
    def pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-seed-identity")))
        pick = lambda names, drop: F.get(F.array(*[F.lit(x) for x in names]), H.hex_mod(d, len(names), 32 - drop).cast("int"))
        number = H.hex_mod(d, 100, 28).cast("string")
        return rows(spark, sf_dir, "u").select("user_id", F.concat(pick(_FIRST, 0), F.lit("_"), pick(_LAST, 2), number).alias("pseudonym"))

    @reg.add("hierarchical_uniform", with_sql("u") + "SELECT user_id, round(CAST('0x' || substr(sha256('314159:' || user_id || ':3'), 1, 8) AS BIGINT) / 4294967296.0, 9) AS u FROM u")
    def hierarchical_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "u").select("user_id", F.round(H.uniform(F.lit("314159"), F.col("user_id").cast("string"), F.lit("3")), 9).alias("u"))

    @reg.add("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'N/A') AS missing FROM events")
    def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").select(
            "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("N/A")).alias("missing")
        )

    @reg.add("json_encode", with_sql("p") + "SELECT post_id, '{\"post_id\":' || post_id || ',\"user_id\":' || user_id || '}' AS info FROM p")
    def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.to_json(F.struct("post_id", "user_id")).alias("info"))

    @reg.add("json_salvage")
    def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
        from plaza.operators.nested import json_text

        t = F.trim("payload")
        direct, fenced = F.try_parse_json(t), F.try_parse_json(json_text(F.col("payload")))
        how = F.when(direct.isNotNull(), "direct").when(fenced.isNotNull(), "salvaged").otherwise("lost")
        return table(spark, sf_dir, "spc_cache").select("cache_id", how.alias("how")).distinct()

    @reg.add(
        "ts_parse",
        with_sql("r", "z AS (SELECT post_id, \"timestamp\" AS t FROM r)")
        + """SELECT post_id, CASE WHEN regexp_matches(t, '^[0-9]{9,11}$') THEN to_timestamp(CAST(t AS BIGINT))
        WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN CAST(t AS TIMESTAMPTZ) ELSE CAST(t || 'Z' AS TIMESTAMPTZ) END AT TIME ZONE 'UTC' AS parsed FROM z""",
    )
    def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.col("timestamp")
        zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        iso = F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")
        parsed = F.when(t.rlike(r"^\d{9,11}$"), F.timestamp_seconds(t.try_cast("long"))).otherwise(iso)
        return rows(spark, sf_dir, "r").select("post_id", F.to_utc_timestamp(parsed, F.current_timezone()).cast("timestamp_ntz").alias("parsed"))

    @reg.add("iso_format", with_sql("p") + "SELECT post_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(created_at) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM p")
    def iso_format(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))

    @reg.add("clock_scale", "SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds(60 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))) AS scaled FROM events")
    def clock_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
        real = F.unix_micros(F.col("ts").cast("timestamp"))
        return table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(start + 60 * (real - start)).cast("timestamp_ntz").alias("scaled"))

    @reg.add("minute_bucket", "SELECT CAST((epoch_us(ts) // 60000000) * 60 AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1")
    def minute_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").groupBy(S.minute(F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("n"))

    @reg.add("hot_score", with_sql("p") + "SELECT post_id, round(sign(num_likes - num_dislikes) * log10(greatest(abs(num_likes - num_dislikes), 1)) + (epoch_us(created_at) / 1000000.0 - 1134028003) / 45000, 4) AS hot FROM p")
    def hot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.round(S.hot_score(F.col("num_likes"), F.col("num_dislikes"), F.col("created_at")), 4).alias("hot"))

    @reg.add("recency_score", with_sql("p", "m AS (SELECT max(epoch_us(created_at)) AS top FROM p)") + "SELECT post_id, CASE WHEN 271.8 - (top - epoch_us(created_at)) / 3600000000.0 > 0 THEN round(ln((271.8 - (top - epoch_us(created_at)) / 3600000000.0) / 100), 6) END AS recency FROM p, m")
    def recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
        hours = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 3.6e9
        top = table(spark, sf_dir, "post").agg(F.max("created_at").alias("top"))
        p = rows(spark, sf_dir, "p").join(F.broadcast(top))
        return p.select("post_id", F.round(S.recency_score(hours("top"), hours("created_at")), 6).alias("recency"))

    @reg.add("clipped", with_sql("p") + "SELECT post_id, least(10, greatest(1, num_likes)) AS clipped FROM p")
    def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "p").select("post_id", F.least(F.lit(10), F.greatest(F.lit(1), F.col("num_likes"))).alias("clipped"))

    @reg.add("list_parse", with_sql("k") + "SELECT persona_id, array_to_string(list_filter(list_transform(string_split(array_to_string(allowed_labels, ' ; ') || ';', ';'), lambda x: trim(x)), lambda x: x <> ''), ',') AS labels FROM k")
    def list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = F.concat(F.array_join("allowed_labels", " ; "), F.lit(";"))
        parts = F.filter(F.transform(F.split(joined, ";"), lambda x: F.trim(x)), lambda x: x != "")
        return rows(spark, sf_dir, "k").select("persona_id", F.array_join(parts, ",").alias("labels"))

    @reg.add("literal_list", with_sql("k") + "SELECT persona_id, len(allowed_labels) AS n FROM k WHERE allowed_labels IS NOT NULL")
    def literal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = rows(spark, sf_dir, "k").filter("allowed_labels IS NOT NULL")
        return k.select("persona_id", F.size(F.from_json(F.to_json("allowed_labels"), "array<string>")).cast("long").alias("n"))

    @reg.add("ordered_distinct", with_sql("r", "t AS (SELECT post_id, unnest(category_labels) AS x, generate_subscripts(category_labels, 1) AS i FROM r)", "d1 AS (SELECT post_id, x, min(i) AS i FROM t GROUP BY ALL)") + "SELECT post_id, string_agg(x, ',' ORDER BY i) AS labels FROM d1 GROUP BY post_id")
    def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = rows(spark, sf_dir, "r").filter("size(category_labels) > 0")
        return r.select("post_id", F.array_join(F.array_distinct("category_labels"), ",").alias("labels"))

    @reg.add("persona_prefix", with_sql("u") + "SELECT user_id, CASE " + " ".join(f"WHEN starts_with(lower(user_name), '{p}_') THEN '{'ed_risk' if p == 'edrisk' else p}'" for p in PREFIXES) + " END AS persona FROM u")
    def persona_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = X.persona_prefix(F.col("user_name"), PREFIXES)
        return rows(spark, sf_dir, "u").select("user_id", F.when(p == "edrisk", "ed_risk").otherwise(p).alias("persona"))

    @reg.add("keyword_rules", with_sql("p") + "SELECT post_id, CASE WHEN contains(lower(content), 'calorie') OR contains(lower(content), 'skin care') THEN 'eating_disorder_risk' WHEN contains(lower(content), 'recovery') OR contains(lower(content), 'mental health') THEN 'recovery_support' WHEN contains(lower(content), 'vaccine') OR contains(lower(content), 'fact checking') THEN 'misinformation' WHEN num_likes < 2 THEN 'benign' ELSE 'other' END AS label FROM p")
    def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = F.lower("content")
        rule = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))
        label = (
            F.when(rule("calorie", "skin care"), "eating_disorder_risk").when(rule("recovery", "mental health"), "recovery_support").when(rule("vaccine", "fact checking"), "misinformation").when(F.col("num_likes") < 2, "benign").otherwise("other")
        )
        return rows(spark, sf_dir, "p").select("post_id", label.alias("label"))

    @reg.add("sentence_spans")
    def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), X.squeeze), lambda s: F.size(F.split(s, " ")).between(6, 200))
        spans = F.when(F.size(parts) > 0, parts).otherwise(F.array(X.squeeze(F.col("text"))))
        return docs(spark, sf_dir).select("doc_id", F.posexplode(spans).alias("position", "span"))

    @reg.add("unicode_clean", with_sql("d") + "SELECT doc_id, regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b-\\x1f]', '', 'g') AS result FROM d")
    def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
        from plaza.functions.udfs import nfc

        return docs(spark, sf_dir).select("doc_id", nfc("text").alias("result"))

    @reg.add(
        "corpus_keywords",
        with_sql("c", "w AS (SELECT unnest(list_filter(regexp_extract_all(lower(content), '([a-z'']+)', 1), lambda x: length(x) > 3)) AS word FROM c)") + "SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25",
    )
    def corpus_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = rows(spark, sf_dir, "c").select(F.explode(X.keyword_words(F.col("content"))).alias("word"))
        return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)

    @reg.add("query_builder", with_sql("r") + "SELECT post_id, trim(coalesce(nullif(trim(text, ' ' || chr(9) || chr(10)), ''), '') || ' ' || lower(replace(array_to_string(coalesce(category_labels, []), ' '), '_', ' '))) AS query FROM r")
    def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n]+|[ \t\n]+$", "")
        labels = F.lower(F.replace(F.array_join(F.coalesce("category_labels", F.array().cast("array<string>")), " "), F.lit("_"), F.lit(" ")))
        return rows(spark, sf_dir, "r").select("post_id", F.trim(F.concat(body, F.lit(" "), labels)).alias("query"))

    @reg.add("sentinels", with_sql("p") + "SELECT post_id, regexp_replace(content, '<LBL:[A-Z0-9_]+>', '<extra_id_0>', 'g') AS source, array_to_string(" + _TOKENS_SQL.format(c="content") + ", ' ') AS target FROM p WHERE contains(content, '<LBL:')")
    def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = F.regexp_extract_all("content", F.lit(r"<(LBL:[A-Z0-9_]+)>"), F.lit(1))
        p = rows(spark, sf_dir, "p").filter(F.col("content").contains("<LBL:"))
        return p.select("post_id", F.regexp_replace("content", "<LBL:[A-Z0-9_]+>", "<extra_id_0>").alias("source"), F.array_join(tokens, " ").alias("target"))

    @reg.add("append_missing", with_sql("r") + "SELECT post_id, trim(trim(coalesce(text, '')) || ' ' || array_to_string(list_filter(['benign', 'kettle'], lambda t: NOT contains(coalesce(text, ''), t)), ' ')) AS result FROM r WHERE trim(text) <> ''")
    def append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir, "r").filter("trim(text) <> ''").select("post_id", F.trim(X.append_missing(F.col("text"), F.array(F.lit("benign"), F.lit("kettle")))).alias("result"))

    @reg.add("annotator_share", "SELECT record_table, record_id, round(count(*) FILTER (WHERE abusive = 1) * 1.0 / count(abusive), 6) AS share FROM abuse_labels WHERE abusive IS NOT NULL GROUP BY ALL")
    def annotator_share(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = table(spark, sf_dir, "abuse_labels").filter("abusive IS NOT NULL")
        return a.groupBy("record_table", "record_id").agg(F.round(F.count(F.when(F.col("abusive") == 1, 1)) / F.count("abusive"), 6).alias("share"))

    @reg.add("code_map", with_sql("u") + "SELECT user_id, CASE num_followers % 3 WHEN 0 THEN 'hate' WHEN 1 THEN 'offensive' ELSE 'unknown' END AS label FROM u")
    def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes = F.create_map(F.lit(0), F.lit("hate"), F.lit(1), F.lit("offensive"))
        return rows(spark, sf_dir, "u").select("user_id", F.coalesce(codes[F.col("num_followers") % 3], F.lit("unknown")).alias("label"))

    @reg.add("flag_tags", with_sql("p") + "SELECT post_id, CASE WHEN num_likes = 0 AND num_dislikes = 0 AND num_shares = 0 THEN 'benign' ELSE array_to_string(list_filter([CASE WHEN num_likes > 0 THEN 'liked' END, CASE WHEN num_dislikes > 0 THEN 'disliked' END, CASE WHEN num_shares > 0 THEN 'shared' END], lambda x: x IS NOT NULL), ',') END AS tags FROM p")
    def flag_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
        flags = F.array(*[F.when(F.col(c) > 0, F.lit(t)) for c, t in (("num_likes", "liked"), ("num_dislikes", "disliked"), ("num_shares", "shared"))])
        tags = F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",")
        return rows(spark, sf_dir, "p").select("post_id", F.when(tags == "", "benign").otherwise(tags).alias("tags"))

    @reg.add("nested_label", with_sql("p") + "SELECT post_id, CASE WHEN num_reports > 0 THEN 'reported' WHEN num_dislikes > 0 THEN 'disliked' WHEN num_likes > 0 THEN 'liked' ELSE 'silent' END AS label FROM p")
    def nested_label(spark: SparkSession, sf_dir: str) -> DataFrame:
        label = F.when(F.col("num_reports") > 0, "reported").when(F.col("num_dislikes") > 0, "disliked").when(F.col("num_likes") > 0, "liked").otherwise("silent")
        return rows(spark, sf_dir, "p").select("post_id", label.alias("label"))

    @reg.add("text_columns_with_token", "SELECT column_name FROM (SELECT 'content' AS column_name, bool_or(contains(content, 'LBL:')) AS hit FROM post UNION ALL SELECT 'quote_content', bool_or(contains(quote_content, 'LBL:')) FROM post) WHERE hit")
    def text_columns_with_token(spark: SparkSession, sf_dir: str) -> DataFrame:
        from plaza.sources.tables import text_columns_with

        return text_columns_with(table(spark, sf_dir, "post"), "LBL:")


def _nested(c: str, patterns: list[str]) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '', 'gi')"
    return c
