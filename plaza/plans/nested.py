"""Problem 7: persona records of spc_cache as flat tables linked by cache_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.operators.nested import blank, flatten_fields, flatten_objects, pair_value, parse_records, text_list
from plaza.registry import Registry
from plaza.sources.tables import table

#: Fields that may be lists, and fields of one value.
LISTS = {"groups": "S.groups"}
SCALARS = {"age_band": "S.demographics.age_band", "openness": "P.traits.openness", "formality": "P.communication_style.formality"}
#: The blocks of a record; values that come in several shapes stay JSON text.
BLOCKS = {
    "S": "groups string, demographics struct<age_band:string,gender_proxy:string,region_proxy:string>, role_in_community string",
    "P": "traits string, communication_style struct<formality:string,sarcasm_rate:string,aggression:string>",
}

_BLOCKS_SQL = r"""WITH a AS (SELECT DISTINCT cache_id, regexp_replace(payload, '^\s+|\s+$', '', 'g') AS t FROM spc_cache),
b AS (SELECT cache_id, CASE WHEN t LIKE '"%' THEN CASE WHEN json_valid(t) THEN json_extract_string(t, '$') END
  WHEN t LIKE '[%' THEN CASE WHEN json_valid(t) THEN CASE WHEN json_array_length(t) = 1 THEN CAST(json_extract(t, '$[0]') AS VARCHAR) END END ELSE t END AS t FROM a),
c AS (SELECT cache_id, nullif(regexp_extract(t, '\{.*\}', 0, 's'), '') AS t FROM b),
d AS (SELECT cache_id, CAST(t AS JSON) AS j FROM c WHERE json_valid(t)),
e AS (SELECT cache_id, j, CASE json_type(j, '$.S') WHEN 'VARCHAR' THEN j->>'$.S' ELSE CAST(j->'$.S' AS VARCHAR) END AS s,
  CASE json_type(j, '$.P') WHEN 'VARCHAR' THEN j->>'$.P' ELSE CAST(j->'$.P' AS VARCHAR) END AS p FROM d),
f AS (SELECT cache_id, j, CASE WHEN json_valid(s) THEN CAST(s AS JSON) END AS s, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS p FROM e)"""
_GROUPS_SQL = """,
g AS (SELECT cache_id, unnest(range(CAST(json_array_length(s, '$.groups') AS BIGINT))) AS i, s FROM f WHERE json_type(s, '$.groups') = 'ARRAY'
  UNION ALL SELECT cache_id, -1, s FROM f WHERE json_type(s, '$.groups') IN ('VARCHAR', 'OBJECT')),
h AS (SELECT cache_id, CAST(greatest(i, 0) AS INTEGER) AS i, CASE WHEN i < 0 THEN s->'$.groups' ELSE json_extract(s, '$.groups[' || i || ']') END AS x FROM g)"""
_SQL = _BLOCKS_SQL + _GROUPS_SQL + r""",
v AS (SELECT cache_id, 'S.groups' AS field_path, i AS ordinal, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.name' ELSE json_extract_string(x, '$') END AS value FROM h
  UNION ALL SELECT cache_id, 'S.demographics.age_band', 0, s->>'$.demographics.age_band' FROM f
  UNION ALL SELECT cache_id, 'P.traits.openness', 0, CASE WHEN json_type(p, '$.traits') = 'ARRAY' THEN list_filter(CAST(p->'$.traits' AS JSON[]), lambda x: x->>'$.name' = 'openness')[1]->>'$.value' ELSE p->>'$.traits.openness' END FROM f
  UNION ALL SELECT cache_id, 'P.communication_style.formality', 0, p->>'$.communication_style.formality' FROM f)
SELECT DISTINCT cache_id, {columns} FROM v WHERE regexp_matches(value, '\S')"""
_RECORDS_SQL = _BLOCKS_SQL + "\nSELECT DISTINCT cache_id, j->>'$.variant_id' AS variant_id, j->>'$.username' AS username, j->>'$.model' AS model, s->>'$.role_in_community' AS role_in_community FROM f"
_GROUP_ROWS_SQL = _BLOCKS_SQL + _GROUPS_SQL + r""",
v AS (SELECT cache_id, i AS ordinal, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.name' ELSE json_extract_string(x, '$') END AS name,
  CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.role' END AS role, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.since' END AS since FROM h)
SELECT DISTINCT * FROM v WHERE regexp_matches(name, '\S')"""
_TRAITS_SQL = _BLOCKS_SQL + r""",
g AS (SELECT cache_id, p, unnest(range(CAST(json_array_length(p, '$.traits') AS BIGINT))) AS i FROM f WHERE json_type(p, '$.traits') = 'ARRAY'),
k AS (SELECT cache_id, p, json_keys(p, '$.traits') AS ks FROM f WHERE json_type(p, '$.traits') = 'OBJECT'),
u AS (SELECT cache_id, p, ks, unnest(range(len(ks))) AS i FROM k),
v AS (SELECT cache_id, CAST(i AS INTEGER) AS ordinal, json_extract_string(p, '$.traits[' || i || '].name') AS name, json_extract_string(p, '$.traits[' || i || '].value') AS value FROM g
  UNION ALL SELECT cache_id, CAST(i AS INTEGER), ks[i + 1], json_extract_string(p, '$.traits."' || ks[i + 1] || '"') FROM u)
SELECT DISTINCT * FROM v WHERE regexp_matches(value, '\S')"""
_DEMOGRAPHICS_SQL = _BLOCKS_SQL + """
SELECT DISTINCT cache_id, s->>'$.demographics.age_band' AS age_band, s->>'$.demographics.gender_proxy' AS gender_proxy, s->>'$.demographics.region_proxy' AS region_proxy
FROM f WHERE json_type(s, '$.demographics') = 'OBJECT'"""
_STYLE_SQL = _BLOCKS_SQL + """
SELECT DISTINCT cache_id, p->>'$.communication_style.formality' AS formality, p->>'$.communication_style.sarcasm_rate' AS sarcasm_rate, p->>'$.communication_style.aggression' AS aggression
FROM f WHERE json_type(p, '$.communication_style') = 'OBJECT'"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_id, whether the payload holds one whole record, its texts and the blocks S and P."""
    return parse_records(table(spark, sf_dir, "spc_cache"), "payload", ["cache_id"], ["variant_id", "username", "model"], BLOCKS)


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cache_id, field, ordinal, value): every usable value of the four fields, once per row of the table."""
    rows = parsed(spark, sf_dir).select(
        "cache_id",
        text_list(F.col("S.groups")).alias("groups"),
        F.col("S.demographics.age_band").alias("age_band"),
        pair_value(F.col("P.traits"), "openness").alias("openness"),
        F.col("P.communication_style.formality").alias("formality"),
    )
    return flatten_fields(rows, ["cache_id"], LISTS, SCALARS).filter(~blank(F.col("value")))


def register(reg: Registry) -> None:
    """Add the queries of this module."""

    @reg.add("p7_found", _SQL.replace("{columns}", "field_path, ordinal"))
    def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return field_values(spark, sf_dir).select("cache_id", F.col("field").alias("field_path"), "ordinal").distinct()

    @reg.add("p7_values", _SQL.replace("{columns}", "field_path AS field, ordinal, value"))
    def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
        return field_values(spark, sf_dir).distinct()

    @reg.add("p7_records", _RECORDS_SQL)
    def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsed(spark, sf_dir).select("cache_id", "whole", "variant_id", "username", "model", F.col("S.role_in_community").alias("role_in_community"))
        return rows.distinct().filter("whole").drop("whole")

    @reg.add("p7_groups", _GROUP_ROWS_SQL)
    def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col("S.groups")
        item = "struct<name:string,role:string,since:string>"
        as_object = lambda x: F.when(x.startswith("{"), F.from_json(x, "name string, role string, since string")).when(
            x.isNotNull(), F.struct(x.alias("name"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("since"))
        )
        many = F.transform(F.from_json(c, "array<string>"), as_object)
        rows = parsed(spark, sf_dir).select("cache_id", F.when(c.startswith("["), many).when(c.isNotNull(), F.array(as_object(c))).cast(f"array<{item}>").alias("groups"))
        return flatten_objects(rows, ["cache_id"], "groups").filter(~blank(F.col("name"))).distinct()

    @reg.add("p7_traits", _TRAITS_SQL)
    def p7_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col("P.traits")
        pairs = F.from_json(c, "array<struct<name:string,value:string>>")
        entries = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
        rows = parsed(spark, sf_dir).select("cache_id", F.when(c.startswith("["), pairs).otherwise(entries).alias("traits"))
        return flatten_objects(rows, ["cache_id"], "traits").filter(~blank(F.col("value"))).distinct()

    @reg.add("p7_demographics", _DEMOGRAPHICS_SQL)
    def p7_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsed(spark, sf_dir).select("cache_id", F.col("S.demographics").alias("d")).distinct()
        return rows.filter("d IS NOT NULL").select("cache_id", "d.*")

    @reg.add("p7_style", _STYLE_SQL)
    def p7_style(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsed(spark, sf_dir).select("cache_id", F.col("P.communication_style").alias("d")).distinct()
        return rows.filter("d IS NOT NULL").select("cache_id", "d.*")
