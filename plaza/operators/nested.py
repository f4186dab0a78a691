"""Nested records as related flat tables.

The JVM parses the text once into nested columns; flattening works on whole
Arrow buffers: list offsets give each child's parent index and ordinal, and
the parents' keys are propagated by one vectorised take.  No row is visited in
Python.

Defined cases: null, empty and one-element lists; null children (kept by
``flatten_lists``, with their ordinal); columns of the parent not named as keys
are not read; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_children(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent index, ordinal, value) of every element of a list column, from its offsets."""
    values = column.flatten()
    parent = pc.list_parent_indices(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    ordinal = np.arange(len(values), dtype=np.int64) - first[parent.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)
    return parent, pa.array(ordinal.astype(np.int32)), values


def flatten_fields(df: DataFrame, keys: list[str], lists: dict[str, str], scalars: dict[str, str] | None = None) -> DataFrame:
    """(keys, field, ordinal, value): one row per element of each list column, and per non-null value of each scalar column.

    ``lists`` and ``scalars`` name columns of lists of texts and of texts, and
    the field each fills; the ordinal of a scalar is 0.
    """
    scalars = scalars or {}
    rows = df.select(*keys, *lists, *scalars)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("field", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate([*lists.values(), *scalars.values()], len(keys)):
                if i < len(keys) + len(lists):
                    parent, ordinal, values = list_children(b.column(i))
                else:
                    parent = pa.array(np.flatnonzero(b.column(i).is_valid().to_numpy(zero_copy_only=False)))
                    ordinal, values = pa.array(np.zeros(len(parent), np.int32)), b.column(i).take(parent)
                if len(values):
                    held = [b.column(k).take(parent) for k in range(len(keys))]
                    field = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(values), np.int32)), pa.array([name])).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([*held, field, ordinal, values.cast(pa.string())], names=[*schema.names])

    return rows.mapInArrow(run, schema)


def flatten_lists(df: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """(keys, field, ordinal, value): one row per element of each list column."""
    return flatten_fields(df, keys, lists)


def flatten_objects(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, ordinal, fields of the object): one row per object of a list-of-objects column."""
    rows = df.select(*keys, column)
    inner = rows.schema[column].dataType.elementType
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("ordinal", T.IntegerType()), *inner.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, ordinal, values = list_children(b.column(len(keys)))
            if len(values):
                held = [b.column(k).take(parent) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*held, ordinal, *values.flatten()], names=schema.names)

    return rows.mapInArrow(run, schema)


def json_text(c: Column) -> Column:
    """The JSON object inside a payload, or null.

    Takes off a surrounding JSON string, fences, a leading sentence and a list
    of one; text after the last brace is ignored.
    """
    return _braced(_unwrapped(_trimmed(c)))


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _unwrapped(t: Column) -> Column:
    quoted = F.from_json(F.concat(F.lit('{"x":'), t, F.lit("}")), "x string")["x"]
    items = F.from_json(t, "array<string>")
    return F.when(t.startswith('"'), quoted).when(t.startswith("["), F.when(F.size(items) == 1, F.get(items, F.lit(0)))).otherwise(t)


def _braced(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))


def parse_object(c: Column, fields: str) -> Column:
    """A struct of ``fields`` (all texts; a nested value keeps its JSON), null where ``c`` is not one whole object."""
    whole = F.from_json(c, fields + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(whole["_bad"].isNull(), whole)


def parse_records(df: DataFrame, payload: str, keys: list[str], texts: list[str], blocks: dict[str, str]) -> DataFrame:
    """(keys, texts, blocks): ``payload`` read once into its text fields ``texts`` and, by name, nested ``blocks``.

    ``blocks`` maps a field of the record to the DDL of its fields; a block may
    itself be JSON text.  Fields are null where the payload holds no whole
    record.  Every step is a projection of its own that the next one uses more
    than once, so no step is repeated for the columns that come of it; a filter
    on the result would be pushed below and repeat them.
    """
    text = df.select(*keys, _trimmed(F.col(payload)).alias("_t")).withColumn("_u", _unwrapped(F.col("_t"))).drop("_t").withColumn("_o", _braced(F.col("_u")))
    fields = ", ".join(f"`{x}` string" for x in [*texts, *blocks, "_bad"])
    top = text.withColumn("_r", F.from_json("_o", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("_r")["_bad"].isNull()
    part = {x: F.when(whole, F.col("_r")[x]) for x in texts}
    part |= {x: F.from_json(F.when(whole, F.col("_r")[x]), ddl) for x, ddl in blocks.items()}
    return top.select(*keys, (whole & F.col("_r").isNotNull()).alias("whole"), *[c.alias(n) for n, c in part.items()])


def text_list(c: Column, name: str = "name") -> Column:
    """A list of texts from a JSON value in any shape: an object counts by its ``name``, a single text is a list of one."""
    one = F.when(c.startswith("{"), F.get_json_object(c, f"$.{name}")).otherwise(c)
    many = F.transform(
        F.from_json(c, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{name}")).otherwise(x)
    )
    return F.when(c.startswith("["), many).when(c.isNotNull(), F.array(one))


def pair_value(c: Column, key: str) -> Column:
    """The text under ``key`` in an object, or in a list of ``{name, value}`` pairs."""
    pairs = F.from_json(c, "array<struct<name:string,value:string>>")
    named = F.filter(pairs, lambda p: p["name"] == key)
    return F.when(c.startswith("["), F.get(named, F.lit(0))["value"]).otherwise(F.from_json(c, f"`{key}` string")[key])


def blank(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")
