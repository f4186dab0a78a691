"""Items of varying length into containers of several capacities with little unused space.

Items go to the tier of the smallest capacity that holds them; only an item
above the largest capacity is split.  The plan is made from the histogram of
lengths alone: longest lengths first, whole ranges of containers at a time,
each length into the tightest gap that takes it, so that gaps left in long
windows are filled from the shorter tiers before shorter containers are
opened.  Items then find their container by their rank among items of equal
length, which no task computes for a whole length.  Containers of a tier are
dealt to steps in order of fill, so steps carry equal loads.

The histogram has at most as many rows as the largest capacity, and the plan
at most ``len(tiers) + 3`` times that number of live container ranges.

Defined cases: null and empty items (length 0) are not packed; capacities that
are null, not positive or repeated are ignored; ties of length go by id; no
items or no capacities give no rows; repeated rows of an id are one item;
other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.rank import grouped_rank

#: Containers of one tier that make up a step.
STEP = 64


@dataclass
class Plan:
    """Placements (items of a length, from one rank on, into a range of containers at one offset) and runs of containers.

    A run is a range of containers of one tier and equal fill: its first
    container, their fill and their capacity.
    """

    length: np.ndarray
    rank: np.ndarray
    container: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    fill: np.ndarray
    tier: np.ndarray
    total: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container, offset) of the items of given length and rank."""
        key = self.length * (1 << 40) + self.rank
        at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
        return self.container[at] + rank - self.rank[at], self.offset[at]


def plan(lengths: dict[int, int], capacities: list[int]) -> Plan:
    """Best-fit decreasing over the histogram ``lengths``, tier by tier from the largest."""
    tiers = sorted(capacities)
    gaps: list[int] = []
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    placed: list[tuple[int, int, int, int]] = []
    total = 0

    def put(gap: int, piece: tuple[int, int, int]) -> None:
        if gap not in ranges:
            bisect.insort(gaps, gap)
            ranges[gap] = []
        ranges[gap].append(piece)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        tier = tiers[bisect.bisect_left(tiers, length)]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                start, count, used = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap]
                    gaps.pop(at)
                n = min(left, count)
                if n < count:
                    put(gap, (start + n, count - n, used))
            else:
                each = tier // length
                n = -(-left // each)
                start, count, used, gap = total, n, 0, tier
                total += n
                n = min(left, count)
            placed.append((length, rank, start, used))
            put(gap - length, (start, n, used + length))
            rank += n
            left -= n
    order = sorted(range(len(placed)), key=lambda i: placed[i][:2])
    cols = np.array([placed[i] for i in order], np.int64).reshape(-1, 4)
    runs = sorted((start, used, gap + used) for gap, pieces in ranges.items() for start, _, used in pieces)
    r = np.array(runs, np.int64).reshape(-1, 3)
    return Plan(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], r[:, 0], r[:, 1], r[:, 2], total)


def split_long(items: DataFrame, key: str, largest: int) -> DataFrame:
    """(key, piece, start, length): one row per item, or several of at most ``largest`` for a longer one."""
    n = F.ceil(F.col("length") / largest).cast("int")
    rows = items.filter("length > 0").select(key, "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return rows.select(key, "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("length") - start).alias("size"))


def pack(items: DataFrame, key: str, capacities: list[int], step: int = STEP) -> DataFrame:
    """(key, piece, start, size, capacity, container, offset, step) for ``items`` (key, length).

    ``container`` counts over all tiers; ``step`` counts within a tier.
    """
    caps = sorted({c for c in capacities if c and c > 0})
    kind = items.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, piece int, start long, size long, capacity long, container long, offset long, step long"
    if not caps:
        return items.sparkSession.createDataFrame([], ddl)
    one = items.groupBy(key).agg(F.max("length").alias("length"))
    pieces = cut(split_long(one, key, caps[-1]), "pieces")
    lengths = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(lengths, caps)
    ranked = grouped_rank(pieces, ["size"], [F.col(key).asc(), F.col("piece").asc()])
    base, n_steps = _steps(made, step)
    shared = items.sparkSession.sparkContext.broadcast((made, base, n_steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, base, n_steps = shared.value
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            container, offset = p.find(size, rank)
            r = np.searchsorted(p.first, container, side="right") - 1
            s = (base[r] + container - p.first[r]) % n_steps[r]
            cols = [*b.columns[:4], pa.array(p.tier[r]), pa.array(container), pa.array(offset), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "size", "capacity", "container", "offset", "step"])

    return ranked.mapInArrow(run, ddl)


def _steps(made: Plan, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run: its place in its tier's order of fill, and the tier's number of steps."""
    count = np.diff(np.append(made.first, made.total))
    base, n_steps = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    for t in np.unique(made.tier):
        mine = np.flatnonzero(made.tier == t)
        mine = mine[np.argsort(-made.fill[mine], kind="stable")]
        base[mine] = np.cumsum(count[mine]) - count[mine]
        n_steps[mine] = max(1, -(-int(count[mine].sum()) // step))
    return base, n_steps
