"""Samples that match target shares of a category, under several margins.

Weights of the cells of category and a second margin come from iterative
proportional fitting towards the larger of share and minimum; rows are drawn by
weighted exponential keys (the least keys win); categories below their minimum
are then repaired from their next rows, at the cost of categories above theirs,
and what cannot be met is counted from the drawn rows.  Only targets and counts
per cell that occurs reach the driver; more than MAX_CELLS of them are refused
by an error, so none is dropped.

Defined cases: a record without category counts for none; labels are compared
trimmed, in lower case, with ``-`` and blanks as ``_``; repeated rows of an id
are one record (of differing rows the least counts); categories without
target are not drawn; categories without records are reported as short; ties
go by id; an empty table gives an empty sample and a full report; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.select import smallest_per_group

#: Targets, and cells of category and level, that one run may have.
MAX_CELLS = 1_000_000


def category(c: Column) -> Column:
    """A label in one spelling; null and blank give null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_"), F.lit(""))


def rake(n: np.ndarray, row: np.ndarray, col: np.ndarray, rows: np.ndarray, cols: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Counts ``n`` of the cells (``row``, ``col``) scaled so that their margins are ``rows`` and ``cols`` as nearly as absent cells allow."""
    x = n.astype(float)
    for _ in range(rounds):
        for at, want in ((row, rows), (col, cols)):
            have = np.bincount(at, x, len(want))
            x = x * np.divide(want, have, out=np.zeros(len(want)), where=have > 0)[at]
        if np.allclose(np.bincount(row, x, len(rows)), rows, rtol=1e-9, atol=1e-9):
            break
    return x


@dataclass
class Target:
    """Share in percent, least number, and size of the sample of one category."""

    pct: int
    least: int
    size: int

    @property
    def need(self) -> int:
        """Records the sample should hold at least."""
        return max(self.least, math.floor(self.pct * self.size / 100))


def repair(drawn: dict[str, int], available: dict[str, int], targets: dict[str, Target], size: int) -> dict[str, int]:
    """Numbers to take: drawn numbers raised to the needs where records allow, and lowered elsewhere to ``size`` in all."""
    floor = {c: min(t.need, available.get(c, 0)) for c, t in targets.items()}
    take = {c: max(drawn.get(c, 0), floor[c]) for c in targets}
    over = sum(take.values()) - size
    while over > 0:
        slack = {c: take[c] - floor[c] for c in take if take[c] > floor[c]}
        if not slack:
            break
        cut_by = max(1, over // len(slack))
        for c in sorted(slack, key=lambda c: (-slack[c], c)):
            d = min(slack[c], cut_by, over)
            take[c] -= d
            over -= d
            if not over:
                break
    return take


class Sample:
    """The sample of ``rows`` (scope, id, category, level) for ``targets`` (scope, category, target_pct, min_count, sample_size)."""

    def __init__(self, rows: DataFrame, targets: DataFrame, seed: str = "sample") -> None:
        spark = rows.sparkSession
        named = targets.select("scope", category(F.col("category")).alias("c"), F.col("category").alias("name"), "target_pct", "min_count", "sample_size")
        listed = _bounded(named.filter("scope IS NOT NULL AND c IS NOT NULL").distinct().orderBy("scope", "c", "name"), "targets")
        self.targets: dict[str, dict[str, Target]] = {}
        self.names: dict[tuple[str, str], str] = {}
        for r in listed:
            self.targets.setdefault(r.scope, {})[r.c] = Target(r.target_pct or 0, r.min_count or 0, r.sample_size or 0)
            self.names[r.scope, r.c] = r.name
        row = F.struct(category(F.col("category")).alias("category"), F.coalesce("level", F.lit("")).alias("level"))
        one = rows.filter("id IS NOT NULL").groupBy("scope", "id").agg(F.min(row).alias("r")).select("scope", "id", "r.*").filter("category IS NOT NULL")
        known = spark.createDataFrame([(s, c) for s, t in self.targets.items() for c in t], "scope string, category string")
        self.one = cut(one.join(F.broadcast(known), ["scope", "category"]), "sample")
        cells = _bounded(self.one.groupBy("scope", "category", "level").agg(F.count(F.lit(1)).alias("n")).orderBy("scope", "category", "level"), "cells")
        self.cells: dict[str, list] = {s: [] for s in self.targets}
        for r in cells:
            self.cells[r.scope].append((r.category, r.level, r.n))
        self.available: dict[str, Counter] = {s: Counter() for s in self.targets}
        for r in cells:
            self.available[r.scope][r.category] += r.n
        self.chosen = self._draw(spark, seed)

    def size(self, scope: str) -> int:
        """Rows the sample of a scope should have."""
        return max([t.size for t in self.targets[scope].values()], default=0)

    def weights(self, scope: str) -> list[tuple[str, str, float]]:
        """(category, level, weight) of each cell from which rows may be drawn."""
        cells, targets = self.cells[scope], self.targets[scope]
        order = sorted({c for c, _, _ in cells})
        levels = sorted({x for _, x, _ in cells})
        place, at = {c: i for i, c in enumerate(order)}, {x: i for i, x in enumerate(levels)}
        row, col = np.array([place[c] for c, _, _ in cells], int), np.array([at[x] for _, x, _ in cells], int)
        n = np.array([k for _, _, k in cells], float)
        size = self.size(scope)
        want = np.array([max(targets[c].pct * size / 100, targets[c].least) for c in order], float)
        if not want.sum():
            return []
        fitted = rake(n, row, col, size * want / want.sum(), size * np.bincount(col, n, len(levels)) / n.sum())
        return [(c, x, w) for (c, x, k), w in zip(cells, (fitted / n).tolist(), strict=True) if w > 0]

    def _draw(self, spark, seed: str) -> DataFrame:
        weights = [(s, *w) for s in self.targets for w in self.weights(s)]
        table = spark.createDataFrame(weights, "scope string, category string, level string, w double")
        rows = self.one.join(F.broadcast(table), ["scope", "category", "level"])
        u = (F.pmod(F.xxhash64(F.lit(seed), "scope", "id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        # The key -ln(u) / w, mapped onto the unit interval without changing its order.
        rows = cut(rows.withColumn("key", 1 - F.exp(F.log(u) / F.col("w"))).select("scope", "id", "category", "key"), "keys")
        sizes = spark.createDataFrame([(s, self.size(s)) for s in self.targets], "scope string, quota long")
        race = smallest_per_group(rows.join(F.broadcast(sizes), "scope"), ["scope"], "key", "id", "quota")
        drawn: dict[str, dict[str, int]] = {s: {} for s in self.targets}
        for r in race.groupBy("scope", "category").agg(F.count(F.lit(1)).alias("n")).collect():
            drawn[r.scope][r.category] = r.n
        self.taken = {s: repair(drawn[s], self.available[s], self.targets[s], self.size(s)) for s in self.targets}
        quotas = spark.createDataFrame([(s, c, n) for s, t in self.taken.items() for c, n in t.items()], "scope string, category string, quota long")
        return smallest_per_group(rows.join(F.broadcast(quotas), ["scope", "category"]), ["scope", "category"], "key", "id", "quota").select("scope", "id", "category")

    def report(self) -> DataFrame:
        """(scope, category, target_pct, need, available, drawn, share, shortfall) of every target.

        ``available`` is counted from the records and ``drawn`` from the rows of
        the sample; the repair draws every record of a category that has fewer
        than its need, so a shortfall is the want of records.
        """
        spark = self.one.sparkSession
        rows = [(s, self.names[s, c], c, t.pct, t.need, self.size(s)) for s, ts in self.targets.items() for c, t in ts.items()]
        want = spark.createDataFrame(rows, "scope string, category string, c string, target_pct int, need long, size long")
        there = self.one.select("scope", F.col("category").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("d"))
        taken = self.chosen.select("scope", F.col("category").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("d"))
        got = there.unionByName(taken).groupBy("scope", "c").agg(F.sum("a").alias("available"), F.sum("d").alias("drawn"))
        both = want.join(got, ["scope", "c"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("available", "drawn")})
        return both.select(
            "scope", "category", "target_pct", "need", "available", "drawn", F.round(F.try_divide("drawn", "size"), 6).alias("share"), F.greatest(F.lit(0), F.col("need") - F.col("drawn")).alias("shortfall")
        )


def _bounded(df: DataFrame, what: str) -> list:
    """The rows of ``df``, an error if there are more than MAX_CELLS."""
    rows = df.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} {what}")
    return rows
