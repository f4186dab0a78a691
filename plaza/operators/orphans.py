"""References to records that do not exist, were removed, or came later.

A broadcast Bloom filter of all parent keys proves most missing references
without any join; only references that pass it are checked by an exact join
against the parents' creation and removal times.

Defined cases: a null reference is no orphan; a null time of the reference or
of the parent cannot make it early, a null time of the reference cannot make
it a reference to a removed record; repeated rows of one record give one row;
an empty parent table makes every non-null reference an orphan; of repeated
parents the earliest creation and the earliest removal count.  Columns beyond
those named are never read, so extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import counted, cut
from plaza.operators import bloom
from plaza.operators.skew import collect_hot, lookup_join

REFS = "table_name string, record_id long, kind int, ref long, at timestamp"


def parents(created: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per key: ``created`` (kind, ref, created_at) with the removal times of ``removed`` (kind, ref, removed_at).

    A key of ``removed`` without a row in ``created`` is no parent.
    """
    one = created.dropna(subset=["kind", "ref"]).groupBy("kind", "ref").agg(F.min("created_at").alias("created_at"))
    gone = removed.dropna(subset=["kind", "ref"]).groupBy("kind", "ref").agg(F.min("removed_at").alias("removed_at"))
    return one.join(gone, ["kind", "ref"], "left")


def _probed(known: DataFrame, parent: DataFrame, n: int, max_bits: int) -> DataFrame:
    """``known`` with ``maybe``: false proves that the key is no key of ``parent``, which has ``n`` rows.

    Keys beyond one filter are split by hash: each filter is built, broadcast
    and probed by the references of its hashes alone, in a pass of its own.
    """
    spark = known.sparkSession
    h1, h2 = bloom.hashes(F.col("kind"), F.col("ref"))
    shards = bloom.shards_for(n, max_bits)
    hashed = known.select("table_name", "record_id", "kind", "ref", "at", h1.alias("h1"), h2.alias("h2"))
    ddl = REFS.replace("at timestamp", "at " + known.schema["at"].dataType.simpleString()) + ", maybe boolean"
    out = None
    for i in range(shards):
        own = lambda df: df if shards == 1 else df.filter(bloom.shard(h1, shards) == i)  # noqa: B023, E731
        bits = spark.sparkContext.broadcast(bloom.build(own(parent.select("kind", "ref")), h1, h2, -(-n // shards)))

        def probe(batches: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = bloom.contains(bits.value, b.column(5).to_numpy(zero_copy_only=False), b.column(6).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ok)], [*b.schema.names[:5], "maybe"])

        part = cut(own(hashed).mapInArrow(probe, ddl), "probed")
        bits.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def find_orphans(refs: DataFrame, parent: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """Rows of ``refs`` (table_name, record_id, kind, ref, at) with ``reason``.

    ``reason`` is ``missing``, ``later``, ``removed`` or null for a sound reference.
    ``parent`` has one row per (kind, ref) with created_at and removed_at.
    References that the filter rules out are missing at once; only the others
    are shuffled to the join.
    """
    parent, _, n = counted(parent, "parents", rows=F.count(F.lit(1)))
    probed = _probed(refs.filter("ref IS NOT NULL"), parent, n["rows"], max_bits)
    missing = probed.filter("NOT maybe").select("table_name", "record_id", "at", F.lit("missing").alias("reason"))
    positive = probed.filter("maybe").drop("maybe")
    hot = collect_hot(positive, ["kind", "ref"])
    joined = lookup_join(positive, parent.withColumn("found", F.lit(True)), ["kind", "ref"], hot, ["record_id"])
    reason = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("created_at") > F.col("at"), "later")
        .when(F.col("removed_at") <= F.col("at"), "removed")
    )
    return joined.select("table_name", "record_id", "at", reason.alias("reason")).unionByName(missing)


def orphan_report(found: DataFrame) -> DataFrame:
    """Per table and month of the reference: references, and orphans by reason; a null month holds undated ones."""
    count = lambda c: F.count(F.when(c, 1))
    one = found.groupBy("table_name", "record_id").agg(F.min("at").alias("at"), F.max("reason").alias("reason"))
    return one.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_references"),
        count(F.col("reason").isNotNull()).alias("n_orphans"),
        count(F.col("reason") == "missing").alias("n_missing"),
        count(F.col("reason") == "later").alias("n_later"),
        count(F.col("reason") == "removed").alias("n_removed"),
    )
