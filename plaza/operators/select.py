"""The least rows of each group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the unit interval; a task ranks only the rows of one bucket of one group.
BUCKETS = 1 << 16


def smallest_per_group(df: DataFrame, group: list[str], value: str, ties: str, quota: str) -> DataFrame:
    """Rows of ``df`` among the ``quota`` (a column) least of their group by ``value`` (in 0..1) and ``ties``."""
    rows = df.withColumn("_b", F.least(F.floor(F.col(value) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sizes = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("_before", upto - F.col("_n"))
    rows = rows.join(sizes, [*group, "_b"])
    inside = rows.filter(F.col("_before") + F.col("_n") <= F.col(quota))
    edge = rows.filter((F.col("_before") < F.col(quota)) & (F.col("_before") + F.col("_n") > F.col(quota)))
    nth = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(value, ties))
    edge = edge.withColumn("_r", nth).filter(F.col("_r") <= F.col(quota) - F.col("_before"))
    return inside.select(*df.columns).unionByName(edge.select(*df.columns))
