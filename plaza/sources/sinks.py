"""Sinks: JSON lines, CSV, Parquet and fan-out by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet."""
    df.write.mode("overwrite").parquet(path)


def safe_name(c):
    """A label as a directory name: all but letters, digits, ``_`` and ``-`` become ``_``."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def write_by_label(df: DataFrame, labels: str, path: str) -> None:
    """A directory per label; a row with several labels is written under each."""
    rows = df.withColumn("label", F.explode(labels)).withColumn("label", safe_name(F.col("label")))
    rows.write.mode("overwrite").partitionBy("label").json(path)


def write_by_split(df: DataFrame, split: str, path: str, combined: str | None = None) -> None:
    """A directory per value of ``split``, and all rows with their split under ``combined`` where it is named."""
    df.write.mode("overwrite").partitionBy(split).json(path)
    if combined is not None:
        write_jsonl(df, combined)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table; columns are matched by name, missing ones become null, unknown ones are an error."""
    spark = df.sparkSession
    have = spark.read.parquet(path).schema
    extra = [c for c in df.columns if c not in have.names]
    if extra:
        raise ValueError(f"the table has no columns {extra}")
    cols = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.fields]
    df.select(*cols).write.mode("append").parquet(path)


def add_column(df: DataFrame, name: str, kind: str, value=None) -> DataFrame:
    """``df`` with a further column of one value, null by default; a column of that name stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast(kind))


def reset_column(df: DataFrame, name: str, value=None) -> DataFrame:
    """``df`` with every value of one column replaced."""
    return df.withColumn(name, F.lit(value).cast(df.schema[name].dataType))


def backup(df: DataFrame, path: str) -> int:
    """Write ``df`` beside what was there before and put it in its place once it is whole; the number of rows."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + "._new")
    jvm = spark._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path + "._new", path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path} could not be put in place")
    return spark.read.parquet(path).count()
