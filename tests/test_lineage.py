"""Scratch tables lie where the cluster says."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plaza.lineage import counted, cut, drop_path, release, scratch_path, shared_dir, written


def test_shared_dir_is_the_cluster_setting():
    conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "hdfs://x/y/"}.get(key, default))
    assert shared_dir(SimpleNamespace(conf=conf)) == "hdfs://x/y"


def test_no_machine_local_folder_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://h:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context))


def test_written_table_and_drop(spark):
    df = spark.range(10).withColumn("b", F.col("id") % 2 == 0)
    table, path = written(df, "t")
    assert table.schema.names == ["id", "b"] and table.count() == 10
    at = Path(path.removeprefix("file://"))
    assert at.exists()
    drop_path(spark, path)
    assert not at.exists()


def test_cut_ends_the_plan_in_a_scan(spark):
    plan = cut(spark.range(5).groupBy("id").count())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Relation" in plan


def test_counted(spark):
    _, _, got = counted(spark.range(7), "n", rows=F.count(F.lit(1)), top=F.max("id"))
    assert got == {"rows": 7, "top": 6}
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_release_drops_all_scratch_tables(spark):
    path = written(spark.range(3), "r")[1]
    assert release(spark) >= 1 and not Path(path.removeprefix("file://")).exists()
    assert release(spark) == 0
