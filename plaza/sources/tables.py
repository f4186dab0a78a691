"""Parquet tables of a data directory, and the readers of the other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; rows that break it become nulls."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_glob(spark: SparkSession, glob: str, schema: T.StructType | str, pattern: str) -> DataFrame:
    """CSV files of a glob; the first group of ``pattern`` on the file name becomes ``demographic``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return read_csv(spark, glob, schema).withColumns(
        {"source_file": name, "demographic": F.regexp_extract(name, pattern, 1)}
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """JSON lines; blank and broken lines are dropped, or kept in ``_corrupt_record``."""
    if not keep_bad:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(schema.fields)
    full = full.add("_corrupt_record", T.StringType())
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON array or object per file; each element of an array is a row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_keyed(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "key") -> DataFrame:
    """One JSON object per file whose fields are records: a row per record, its name in ``key``; a record that breaks the schema has nulls."""
    fields = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(parsed).alias(key, "_record")).select(key, F.from_json("_record", fields).alias("_r")).select(key, "_r.*")


def read_json_tree(spark: SparkSession, root: str, schema: T.StructType | str, pattern: str) -> DataFrame:
    """JSON files below ``root``; groups 1 and 2 of ``pattern`` on the path are event and label."""
    at = F.input_file_name()
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .json(root)
        .withColumns({"event": F.regexp_extract(at, pattern, 1), "label": F.regexp_extract(at, pattern, 2)})
    )


def text_columns_with(df: DataFrame, needle: str) -> DataFrame:
    """Names of the string columns in which ``needle`` occurs, found in one aggregate."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = df.agg(*[F.max(F.col(f"`{n}`").contains(needle)).alias(n) for n in names])
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("hit")) for n in names]
    return found.select(F.inline(F.array(*pairs))).filter("hit").select("column_name")


def first_present(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of ``names`` that ``df`` has, else a typed null: readers of evolving schemas."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return F.lit(None).cast(kind)
