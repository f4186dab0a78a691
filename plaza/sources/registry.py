"""Data sets by name: a registry of formats and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.sources.tables import read_csv, read_jsonl


@dataclass(frozen=True)
class Source:
    """Where a data set lies and which of its columns are text and label."""

    path: str
    format: str
    text: str
    label: str | None = None
    columns: str = ""


def load(spark: SparkSession, sources: dict[str, Source], name: str) -> DataFrame:
    """(text, label) of a registered data set; an unknown name or format raises."""
    if name not in sources:
        raise KeyError(f"no data set {name}")
    s = sources[name]
    columns = s.columns or f"`{s.text}` string" + (f", `{s.label}` string" if s.label else "")
    if s.format == "csv":
        df = read_csv(spark, s.path, columns)
    elif s.format == "jsonl":
        df = read_jsonl(spark, s.path, columns)
    elif s.format == "parquet":
        df = spark.read.parquet(s.path)
    else:
        raise ValueError(f"format {s.format} of {name} is unknown")
    label = F.col(s.label).cast("string") if s.label else F.lit(None).cast("string")
    return df.select(F.col(s.text).alias("text"), label.alias("label"))


def load_pair(spark: SparkSession, sources: dict[str, Source], name: str, splits: tuple[str, str] = ("train", "test")) -> tuple[DataFrame, DataFrame]:
    """The two data sets ``<name>_train`` and ``<name>_test`` of a registry."""
    first, second = (load(spark, sources, f"{name}_{s}") for s in splits)
    return first, second
