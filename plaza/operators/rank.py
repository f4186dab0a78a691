"""Ranks and running sums within groups of any size, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaza.lineage import cut


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the position (from 0) of each row within its group by ``order``, and running sums of columns.

    ``sums`` maps the names of running sums (up to and with the row) to the
    columns summed.  Rows are range-partitioned and sorted by group and order;
    a row's rank is its place in its task's part of the group plus the sizes of
    the earlier parts, of which there are at most as many as groups and tasks
    together.  ``order`` must be total for the ranks to be the same each time.
    """
    sums = sums or {}
    keys = [F.col(g).asc() for g in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    totals = {f"_t_{n}": F.sum(c) for n, c in sums.items()}
    parts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[t.alias(n) for n, t in totals.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
    before |= {f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n in sums}
    parts = parts.withColumns(before).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_first", *before)
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    if sums:  # running sums within one task's part of a group
        inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumns({f"_s_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = placed.join(parts, same).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long"))
    out = out.withColumns({n: F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_b_{n}") for n in sums}) if sums else out
    return out.select(*df.columns, name, *sums)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1.

    The limit on ``row_number`` is taken in every task before the shuffle, so a
    large group sends ``n`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)


def neighbours(df: DataFrame, group: list[str], order: list[Column], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with ``columns`` of the row before in its group: a self join on rank, so no group is sorted in one task."""
    ranked = cut(grouped_rank(df, group, order, "_rank"), "ranks")
    before = ranked.select(*[F.col(g).alias(f"_g_{g}") for g in group], (F.col("_rank") + 1).alias("_next"), *[F.col(c).alias(prefix + c) for c in columns])
    same = F.col("_rank") == F.col("_next")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ranked.join(before, same, "left").select(*df.columns, *[prefix + c for c in columns])
