"""Configuration in YAML: registries of data sets, banks of phrases, mappings of labels.

The YAML reader is optional: where it is not installed these functions raise
ImportError and nothing else of the package is touched.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plaza.sources.registry import Source


def read_yaml(path: str) -> Any:
    """The document of a YAML file on the driver; an empty file is an empty mapping."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_sources(path: str) -> dict[str, Source]:
    """A registry from ``datasets: {name: {source: {path, format, text_column, label_columns}}}``; entries without a path are left out."""
    out = {}
    for name, entry in (read_yaml(path).get("datasets") or {}).items():
        s = (entry or {}).get("source") or {}
        if s.get("path"):
            labels = s.get("label_columns") or ([s["label_column"]] if s.get("label_column") else [])
            out[name] = Source(s["path"], s.get("format", "csv"), s.get("text_column", "text"), labels[0] if labels else None)
    return out


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(token, at, phrase) of a bank of phrases: lists under the name of their token."""
    rows = [(str(t), i, str(x)) for t, phrases in read_yaml(path).items() for i, x in enumerate(phrases or [])]
    return spark.createDataFrame(rows, "token string, at int, phrase string")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(label, archetype, weight, tokens) of ``label_mappings: {label: {archetypes: [{archetype, weight, tokens}]}}``."""
    rows = [
        (str(name), a.get("archetype"), float(a.get("weight", 1.0)), [str(t) for t in a.get("tokens") or []])
        for name, entry in (read_yaml(path).get("label_mappings") or {}).items()
        for a in (entry or {}).get("archetypes") or []
    ]
    return spark.createDataFrame(rows, "label string, archetype string, weight double, tokens array<string>")
