"""Mixtures of sources with target shares of the total size, by balanced sampling.

Every source gets a multiplicity: whole copies of all its items plus a
fraction, which is the inclusion probability of one more copy.  The cube
method moves these probabilities through the null space of the constraints
(number of items and number of tokens of the source) until they are 0 or 1.
Items are dealt to buckets of bounded size by a hash of their id, so the sample
does not depend on files or tasks.  Within a bucket all flights of a source
move at once, three items each, long items first; at most two items of a source
and bucket stay open, and these are gathered into 64 times fewer buckets until
one is left.  There the last two of a source land together with a few open
items of every length: they are rounded so that tokens and number miss least.

Only totals per source reach the driver; more than MAX_SOURCES are an error.

Defined cases: null and empty items are not used; sources are compared
trimmed, in lower case, with ``-`` and blanks as ``_``; items of no or no
targeted source are not used; a targeted source without items is reported and
the others keep their shares of each other; weights or caps that are null or
not positive give nothing; repeated rows of an id are one item; an empty table
gives an empty mixture; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut

MAX_SOURCES = 1_000_000
#: Items of a bucket, on average, and buckets gathered into one.
BUCKET_ROWS, GATHER = 50_000, 64
#: Items of a source, of all tiers of length in turn, that are left to the landing.
LANDING = 12
_EDGE = 1e-9


def source_name(c: Column) -> Column:
    """A source in one spelling; null and blank give null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_"), F.lit(""))


def fly(tokens: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1, and the sums of ``p`` and of ``p * tokens`` are as before.

    Items take part from the longest tier (power of two) to the shortest; in
    each round the open items move in threes, every three along the direction
    that keeps its number and tokens, until one of them is decided.
    """
    p = p.copy()
    draw = np.random.default_rng(seed)
    free = np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    tier = np.floor(np.log2(np.maximum(tokens[free], 1))).astype(int)
    open_ = np.zeros(0, int)
    for t in np.unique(tier)[::-1]:
        open_ = np.concatenate([open_, free[tier == t]])
        while len(open_) > 2:
            n = len(open_) // 3
            three, rest = open_[: 3 * n].reshape(n, 3), open_[3 * n :]
            x, w = p[three], tokens[three].astype(float)
            u = w[:, [2, 0, 1]] - w[:, [1, 2, 0]]
            u[(u == 0).all(1)] = (1, -1, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min(1)
                down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min(1)
            step = np.where(draw.random(n) * (up + down) < down, up, -down)
            x = x + step[:, None] * u
            done = (x <= _EDGE) | (x >= 1 - _EDGE)
            p[three] = np.where(done, np.round(x), x)
            open_ = np.concatenate([three[~done], rest])
    return p


def land(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last open items of a source, at most LANDING + 2, rounded so that their tokens and number miss least."""
    k = len(p)
    pick = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    miss = np.abs(pick @ tokens - p @ tokens) / max(tokens.max(initial=1), 1) + 0.1 * np.abs(pick.sum(1) - p.sum())
    return pick[np.argmin(miss)].astype(float)


def decide(tokens: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Flight and landing of one source: every probability becomes 0 or 1.

    Some open items of every tier of length stay out of the flight, so the
    landing has items of many lengths to make up for those left.
    """
    free = np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    tier = np.floor(np.log2(np.maximum(tokens[free], 1))).astype(int)
    order = np.argsort(tier, kind="stable")
    place = np.arange(len(free)) - np.searchsorted(tier[order], tier[order])
    kept = free[order[np.lexsort((tier[order], place))][:LANDING]]
    held = np.ones(len(p), bool)
    held[kept] = False
    p = p.copy()
    p[held] = fly(tokens[held], p[held], seed)
    open_ = np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    p[open_] = land(tokens[open_], p[open_])
    return p


def _fly(rows: DataFrame, last: bool) -> DataFrame:
    """``rows`` (id, source, tokens, p, random, bucket) after the flights of every bucket and source; ``last`` lands as well."""
    names = ["id", "source", "tokens", "p", "random", "bucket"]

    def flown(t: pa.Table) -> pa.Table:
        tokens, p, random = (t.column(n).to_numpy() for n in ("tokens", "p", "random"))
        p = (decide if last else fly)(tokens, p, int(random[0] * (1 << 52)))
        return t.set_column(3, "p", pa.array(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            bucket, source = t.column("bucket").to_numpy(), np.asarray(t.column("source").to_pylist(), object)
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (source[1:] != source[:-1])) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), t.num_rows], strict=True):
                if held and key != (bucket[i], source[i]):
                    yield from flown(pa.concat_tables(held)).to_batches()
                    held = []
                key = (bucket[i], source[i])
                held.append(t.slice(i, j - i))
        if held:
            yield from flown(pa.concat_tables(held)).to_batches()

    rows = rows.select(*names).repartition("bucket").sortWithinPartitions("bucket", "source", "random", "id")
    return rows.mapInArrow(run, rows.schema)


class Mixture:
    """The mixture of ``items`` (id, source, tokens) for ``targets`` (source, target_weight, max_repeats)."""

    def __init__(self, items: DataFrame, targets: DataFrame, total: int | None = None, seed: str = "mix") -> None:
        spark = items.sparkSession
        rows = items.select("id", source_name(F.col("source")).alias("source"), "tokens").filter("id IS NOT NULL AND source IS NOT NULL AND tokens > 0")
        rows = cut(rows.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("id", "r.*"), "mix")
        wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").alias("w"), F.col("max_repeats").alias("cap")).filter("source IS NOT NULL")
        listed = wanted.orderBy("source", "w", "cap").limit(MAX_SOURCES + 1).collect()
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.want = {r.source: (r.w, r.cap) for r in listed if r.w and r.w > 0 and r.cap and r.cap > 0}
        known = spark.createDataFrame([(s,) for s in self.want], "source string")
        rows = rows.join(F.broadcast(known), "source", "left_semi")
        per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()
        self.have = {r.source: (r.n, r.t) for r in per}
        weight = {s: w for s, (w, _) in self.want.items() if s in self.have}
        whole = sum(weight.values())
        self.share = {s: w / whole for s, w in weight.items()}
        self.total = float(total) if total is not None else min((self.want[s][1] * self.have[s][1] / x for s, x in self.share.items()), default=0.0)
        plan = []
        for s, x in self.share.items():
            m = min(float(self.want[s][1]), x * self.total / self.have[s][1])
            base = math.floor(m + _EDGE)
            plan.append((s, base, max(0.0, m - base)))
        shared = F.broadcast(spark.createDataFrame(plan, "source string, base int, p double"))
        u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)).cast("double") / float(1 << 52)
        self.plan = {x: b + q for x, b, q in plan}
        n = max(1, -(-sum(x for x, _ in self.have.values()) // BUCKET_ROWS))
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "id"), F.lit(n)).cast("int")
        left = rows.join(shared.select("source", "p"), "source").withColumns({"random": u, "bucket": bucket})
        edge = (F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)
        out = None
        while True:  # at most two open items per source and bucket: ever fewer buckets
            flown = cut(_fly(left, n == 1), "flight")
            done = flown if n == 1 else flown.filter(~edge)
            out = done if out is None else out.unionByName(done)
            if n == 1:
                break
            n = max(1, n // GATHER)
            left = flown.filter(edge).withColumn("bucket", F.pmod("bucket", F.lit(n)))
        copies = F.col("base") + F.round("p").cast("int")
        self.items = out.join(shared.select("source", "base"), "source").select("id", "source", "tokens", copies.alias("copies")).filter("copies > 0")

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, n_documents, most_copies, max_repeats, limited) of every targeted source.

        A source is limited where all its items are used as often as its cap
        allows, or where it has none: then the total cannot grow at these shares.
        """
        spark = self.items.sparkSession
        whole = sum(w for w, _ in self.want.values())
        full = {s: s not in self.plan or self.plan[s] >= c - _EDGE for s, (_, c) in self.want.items()}
        want = spark.createDataFrame([(s, w / whole, c, full[s]) for s, (w, c) in self.want.items()], "source string, target_share double, max_repeats int, limited boolean")
        used = self.items.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
        used = cut(used, "mixed")
        total = F.broadcast(used.agg(F.sum("tokens").alias("all_tokens")))
        both = want.join(used, "source", "left").join(total)
        return both.select(
            "source",
            F.round("target_share", 6).alias("target_share"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
            "limited",
        )
