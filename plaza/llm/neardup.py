"""Near-duplicate records: SuperMinHash signatures, banding, exact verification and groups.

A signature value of an element is its rank in a permutation of the slots plus
a random fraction, so the values of one element are correlated across slots
and the estimate varies less than that of independent hashes (Ertl 2017).
Ranks are drawn in blocks, and only as far as a record needs them: it is
finished as soon as no later rank can lower any of its slots.

Records with equal word sets are one class, so copies cost nothing until the
result lists them.  Band keys travel packed by shard, seven bytes each, and
only keys that several classes share come out; pairs within these are told
from chance meetings by sketches and verified by the exact Jaccard similarity.
Nothing is capped, but the search is one of signatures: a pair of similarity
0.7 shares no band with a chance of 0.0009, one of 0.8 with one in ten million,
and the sketches drop about one pair in a million.

Groups need no pairs of one band: members are linked to the least of their
band, and only members of different groups are compared after that.

Defined cases: null and blank texts have no words; records with fewer than
``min_words`` distinct words take no part; repeated rows of an id are one
record (of differing texts the greatest counts); equal texts of different ids
are pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.lineage import counted, cut
from plaza.operators.components import connected_components
from plaza.operators.skew import collect_hot, lookup_join, spread_join

#: Rows of a band and bands: two records of similarity 0.7 meet with a chance of 0.999.
BAND_ROWS, BANDS = 6, 56
#: Bits of the sketch (one of each of so many signature values) by which pairs of a band are told from chance meetings.
SKETCH = 128
#: Bytes of packed band keys that a task groups at once, and rows of signatures packed together.
SHARD_BYTES, PACK_ROWS = 16 << 20, 2048
#: Rounds in which the members of a band are linked to its least before all those still apart are compared.
STAR_ROUNDS = 2
#: Ids whose texts differ, up to which they are broadcast.
FEW_IDS = 100_000
#: Candidate pairs up to which the numbers of their classes are broadcast.
FEW_PAIRS = 1_000_000
#: Ranks taken at once, and element tables kept by a task.
_BLOCK, _WORDS, _SLICE = 64, 1 << 14, 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SuperMinHash:
    """Signatures of ``m`` values: rank in the upper 16 bits, fraction below."""

    def __init__(self, m: int) -> None:
        self.m = m
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.element = np.zeros(0, np.uint64)
        self.depth = np.zeros(0, np.int64)
        self.slot = np.zeros((0, self.m), np.int16)
        self.value = np.zeros((0, self.m), np.uint64)

    def _draw(self, row: np.ndarray, j: int, k: int) -> None:
        """The ranks ``j`` to ``k`` of the elements in table rows ``row``: one more part of a random permutation of the slots."""
        rank = np.arange(j, k, dtype=np.uint64)
        r = _mix(self.element[row][:, None] + (rank * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[None, :])
        with_ = rank.astype(np.int64)[None, :] + ((r >> np.uint64(40)) % (np.uint64(self.m) - rank)[None, :]).astype(np.int64)
        slot, every = self.slot[row], np.arange(len(row))
        for i in range(k - j):
            at = with_[:, i]
            a, b = slot[:, j + i].copy(), slot[every, at]
            slot[:, j + i], slot[every, at] = b, a
        self.slot[row] = slot
        self.value[row, j:k] = (rank << np.uint64(48))[None, :] | (_mix(r) >> np.uint64(16))
        self.depth[row] = k

    def _rows(self, element: np.ndarray) -> np.ndarray:
        """Rows of the elements in the tables, made where they are not there yet."""
        u, back = np.unique(element, return_inverse=True)
        if len(self.known) + len(u) > _WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
        new = u if not len(self.known) else u[self.known[at] != u]
        if len(new):
            n, used = len(new), len(self.known)
            if used + n > len(self.slot):  # room for twice as many
                room = max(1024, 2 * (used + n)) - len(self.slot)
                self.slot = np.concatenate([self.slot, np.empty((room, self.m), np.int16)])
                self.value = np.concatenate([self.value, np.empty((room, self.m), np.uint64)])
                self.element = np.concatenate([self.element, np.zeros(room, np.uint64)])
                self.depth = np.concatenate([self.depth, np.zeros(room, np.int64)])
            own = np.arange(used, used + n)
            self.slot[own], self.element[own], self.depth[own] = np.arange(self.m, dtype=np.int16), new, 0
            known, row = np.concatenate([self.known, new]), np.concatenate([self.row, own])
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
        return self.row[np.searchsorted(self.known, u)][back]

    def __call__(self, element: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Signatures of records, given their elements in a row and the number of each record's."""
        out = np.full((len(size), self.m), np.iinfo(np.uint64).max, np.uint64)
        end = np.cumsum(size)
        i = 0
        while i < len(size):
            first = end[i] - size[i]
            j = max(i + 1, int(np.searchsorted(end, first + _SLICE, side="right")))
            for a in range(first, end[j - 1], _SLICE):  # a record of very many elements comes in pieces
                b = min(a + _SLICE, end[j - 1])
                doc = np.searchsorted(end, np.arange(a, b), side="right")
                self._lower(out, doc, self._rows(element[a:b]))
            i = j
        return out

    def _lower(self, out: np.ndarray, doc: np.ndarray, row: np.ndarray) -> None:
        for j in range(0, self.m, _BLOCK):
            k = min(j + _BLOCK, self.m)
            fresh = np.unique(row[self.depth[row] < k])
            if len(fresh):
                self._draw(fresh, j, k)
            at = doc[:, None] * self.m + self.slot[row, j:k]
            np.minimum.at(out.reshape(-1), at.ravel(), self.value[row, j:k].ravel())
            docs = np.unique(doc)
            open_ = docs[(out[docs].max(1) >> np.uint64(48)) >= k]
            if not len(open_):
                return
            keep = np.isin(doc, open_)
            doc, row = doc[keep], row[keep]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per record and band."""
    part = signature.reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """The lowest bits of the first SKETCH values, as 64-bit integers: equal in (1 + similarity) / 2 of the places."""
    bits = (signature[:, :SKETCH] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def most_differing(similarity: float) -> int:
    """Sketch bits in which a pair of this similarity differs at most, but for a chance of about one in a million."""
    p = (1 - similarity) / 2
    return int(np.floor(SKETCH * p + 4.75 * np.sqrt(SKETCH * p * (1 - p))))


def word_set(text: Column, k: int = 1) -> Column:
    """Sorted 64-bit hashes of the distinct runs of ``k`` words (``a-z0-9``) of the lower-case text."""
    w = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    if k > 1:
        n = F.size(w) - (k - 1)
        w = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x))))


def pack(key: np.ndarray, num: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(shard, base, keys, offsets) of band keys and the numbers of their classes, which span less than 2**16.

    A power of two of ``shards`` takes the upper bits; a key keeps 40 bits within its shard.
    """
    u = key.view(np.uint64)
    shard = ((u >> np.uint64(40)) & np.uint64(shards - 1)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    base = int(num.min()) if len(num) else 0
    low, high, off = (u & np.uint64(0xFFFFFFFF)).astype("<u4")[order], ((u >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)[order], (num - base).astype("<u2")[order]
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)][: len(names)], strict=True):
        yield name, base, low[a:b].tobytes() + high[a:b].tobytes(), off[a:b].tobytes()


def unpack(shard: int, base: int, keys: bytes, offsets: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key, number) of a packed row; the key is the shard and the 40 bits kept."""
    n = len(offsets) // 2
    low, high = np.frombuffer(keys, "<u4", n).astype(np.int64), np.frombuffer(keys, np.uint8, n, 4 * n).astype(np.int64)
    return (shard << 40) | (high << 32) | low, np.frombuffer(offsets, "<u2", n).astype(np.int64) + base


def shared_keys(key: np.ndarray, num: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (key, number) rows whose key occurs more than once."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.append(same, False) | np.append(False, same) if len(k) else np.zeros(0, bool)
    return k[hit], num[order[hit]]


def _signed(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Packed band keys of classes (num, table hash, words), and in shards from ``shards`` on their sketches."""
    sign = SuperMinHash(BANDS * BAND_ROWS)
    for b in batches:
        num = b.column(0).to_numpy(zero_copy_only=False)
        i = 0
        while i < b.num_rows:
            far = np.flatnonzero(np.abs(num[i : i + PACK_ROWS] - num[i]) >= 1 << 15)  # the next file's numbers
            j = i + int(far[0]) if len(far) else min(i + PACK_ROWS, b.num_rows)
            part = b.slice(i, j - i)
            lists = part.column(2)
            signature = sign(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy()))
            keys = band_keys(signature) ^ part.column(1).to_numpy(zero_copy_only=False)[:, None]
            rows = list(pack(keys.ravel(), np.repeat(num[i:j], BANDS), shards))
            rows.append((shards + int(num[i] // PACK_ROWS % shards), 0, sketches(signature).tobytes(), num[i:j].astype("<i8").tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["shard", "base", "keys", "offsets"])
            i = j


def _met(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(key, num, s1, s2) from packed rows sorted by shard: shared band keys, and with a null key the sketches of classes."""

    def batch(key, num, s1, s2) -> Iterator[pa.RecordBatch]:
        t = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in (key, num, s1, s2)], ["key", "num", "s1", "s2"])
        for i in range(0, t.num_rows, 1 << 16):
            yield t.slice(i, 1 << 16)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    at = None
    for b in batches:
        for shard, base, keys, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard >= shards:
                s, num = np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(offsets, "<i8")
                yield from batch(pa.nulls(len(num), pa.int64()), num, s[:, 0], s[:, 1])
                continue
            if shard != at and held:
                key, num = shared_keys(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield from batch(key, num, pa.nulls(len(num), pa.int64()), pa.nulls(len(num), pa.int64()))
                held = []
            at = shard
            held.append(unpack(shard, base, keys, offsets))
    if held:
        key, num = shared_keys(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from batch(key, num, pa.nulls(len(num), pa.int64()), pa.nulls(len(num), pa.int64()))


class NearDuplicates:
    """Classes of equal word sets of ``rows`` (table_name, id, text) and the similar pairs of them."""

    def __init__(self, rows: DataFrame, threshold: tuple[int, int] = (7, 10), min_words: int = 18, k: int = 1) -> None:
        self.num, self.den = threshold
        self.key = ["table_name", "h1", "h2"]
        text = rows.filter("id IS NOT NULL AND text IS NOT NULL").select("table_name", "id", "text")
        words = text.withColumn("words", word_set(F.col("text"), k)).withColumn("enough", F.size("words") >= min_words)
        hashes = [F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(5), "words").alias("h2")]
        hashed = cut(words.select("table_name", "id", F.xxhash64("text").alias("t"), "enough", *hashes, F.when(F.col("enough"), F.col("words")).alias("words")), "sets")
        # Of differing texts of an id the greatest counts; only the few such ids take a second look at their texts.
        row = F.struct("enough", "h1", "h2")
        per = hashed.groupBy("table_name", "id").agg(F.min("t").alias("t1"), F.max("t").alias("t2"), F.max(row).alias("s"))
        one, _, n = counted(per.select("table_name", "id", (F.col("t1") != F.col("t2")).alias("differ"), "s.*"), "ids", differ=F.count_if("differ"))
        self.sets = one.filter("enough AND NOT differ").select("table_name", "id", "h1", "h2")
        if n["differ"]:
            ids = one.filter("differ").select("table_name", "id")
            again = words.join(F.broadcast(ids) if n["differ"] <= FEW_IDS else ids, ["table_name", "id"])
            best = again.groupBy("table_name", "id").agg(F.max(F.struct("text", "enough", *hashes)).alias("s")).filter("s.enough")
            self.sets = cut(self.sets.unionByName(best.select("table_name", "id", "s.h1", "s.h2")), "ids")
        # Word sets travel once, to their class; ids travel with hashes only.
        sizes = self.sets.groupBy(*self.key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        lists = hashed.filter("words IS NOT NULL").groupBy(*self.key).agg(F.first("words").alias("words"))
        self.classes, _, n = counted(sizes.join(lists, self.key).withColumn("num", F.monotonically_increasing_id()), "classes", rows=F.count(F.lit(1)))
        self.n_classes = n["rows"]
        self._bands: DataFrame | None = None

    def bands(self) -> DataFrame:
        """(key, num, s1, s2): the classes that share a band key with another, with their sketches."""
        if self._bands is None:
            want = self.n_classes * BANDS * 7 // SHARD_BYTES
            shards = 1 << max(6, want.bit_length())
            packed = self.classes.select("num", F.xxhash64("table_name").alias("t"), "words").mapInArrow(lambda bs: _signed(bs, shards), "shard int, base long, keys binary, offsets binary")
            met = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda bs: _met(bs, shards), "key long, num long, s1 long, s2 long")
            met = cut(met, "bands")
            shared = met.filter("key IS NOT NULL").select("key", "num")
            self._bands = cut(shared.join(met.filter("key IS NULL").select("num", "s1", "s2"), "num"), "shared")
        return self._bands

    def _pairs(self, left: DataFrame, right: DataFrame, more: Column) -> DataFrame:
        """(x, y), x < y: pairs of rows (key, num, s1, s2, ...) that share a key, hold ``more``, and whose sketches do not rule them out."""
        a = left.withColumnsRenamed({"num": "x", **{c: f"x_{c}" for c in left.columns if c not in ("key", "num")}})
        b = right.withColumnsRenamed({"num": "y", **{c: f"y_{c}" for c in right.columns if c not in ("key", "num")}})
        met = spread_join(a, b, ["key"], collect_hot(left, ["key"]), ["x"])
        differ = F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1"))) + F.bit_count(F.col("x_s2").bitwiseXOR(F.col("y_s2")))
        met = met.filter(more & (differ <= most_differing(self.num / self.den)))
        return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def candidates(self) -> DataFrame:
        """(x, y), x < y: numbers of classes that share a band key and may be similar."""
        return self._pairs(self.bands(), self.bands(), F.col("x") < F.col("y"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(x, y, table_name, a, b, similarity): pairs (x, y) of classes that are similar, with their representatives."""
        pairs, _, n = counted(pairs, "candidates", rows=F.count(F.lit(1)))

        def side(c: str) -> DataFrame:
            own = self.classes
            if n["rows"] <= FEW_PAIRS:  # the few classes asked for are picked without shuffling all word sets
                own = own.join(F.broadcast(pairs.select(F.col(c).alias("num")).distinct()), "num", "left_semi")
            return own.select(F.col("num").alias(c), F.col("words").alias(f"w{c}"), F.col("rep").alias(f"r{c}"), F.col("table_name").alias(f"t{c}"))

        both = spread_join(pairs, side("x"), ["x"], collect_hot(pairs, ["x"]), ["y"])
        both = spread_join(both, side("y"), ["y"], collect_hot(pairs, ["y"]), ["x"]).filter("tx = ty")
        both = both.withColumn("both", F.size(F.array_intersect("wx", "wy"))).withColumn("either", F.size("wx") + F.size("wy") - F.col("both"))
        same = both.filter(F.col("both") * self.den >= F.col("either") * self.num)
        return same.select("x", "y", F.col("tx").alias("table_name"), F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), (F.col("both") / F.col("either")).alias("similarity"))

    def links(self) -> DataFrame:
        """(table_name, a, b, similarity), a < b: similar classes by their representatives."""
        return self.verified(self.candidates()).select("table_name", "a", "b", "similarity")

    def members(self) -> DataFrame:
        """(table_name, id, rep, n, num): every record with the representative, size and number of its class."""
        right = self.classes.select(*self.key, "rep", "n", "num")
        hot = collect_hot(self.sets, self.key)
        return lookup_join(self.sets.select("id", *self.key), right, self.key, hot, ["id"]).select("table_name", "id", "rep", "n", "num")

    def pairs(self) -> DataFrame:
        """(table_name, id_a, id_b), id_a < id_b: all similar pairs of records."""
        links = cut(self.verified(self.candidates()), "links")
        linked = links.select(F.col("x").alias("num")).unionByName(links.select(F.col("y").alias("num"))).distinct()
        m = self.members().join(linked.withColumn("linked", F.lit(True)), "num", "left").filter("n > 1 OR linked")
        m = cut(m.select("table_name", "id", "num", "n"), "members")
        one, two = m.select(F.col("num").alias("x"), F.col("id").alias("i")), m.select(F.col("num").alias("y"), F.col("id").alias("j"))
        across = spread_join(links.select("table_name", "x", "y"), one, ["x"], collect_hot(m.select(F.col("num").alias("x")), ["x"]), ["y"])
        across = spread_join(across, two, ["y"], collect_hot(m.select(F.col("num").alias("y")), ["y"]), ["i"])
        copies = m.filter("n > 1")
        hot = collect_hot(copies, ["num"])
        within = spread_join(copies.select("table_name", "num", F.col("id").alias("i")), copies.select("num", F.col("id").alias("j")), ["num"], hot, ["i"]).filter("i < j")
        every = across.select("table_name", "i", "j").unionByName(within.select("table_name", "i", "j"))
        return every.select("table_name", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    def components(self) -> DataFrame:
        """(num, component): classes linked by chains of similar classes, by a number of links that grows with the classes.

        In every star round the least class of a band is compared with one
        class of each other component that meets there; after these rounds all
        members of a band that are still in different components are compared,
        so the components are those of all links.
        """
        bands = self.bands().withColumn("component", F.col("num"))
        found: DataFrame | None = None
        for i in range(STAR_ROUNDS + 1):
            if i < STAR_ROUNDS:
                one = bands.groupBy("key", "component").agg(F.min(F.struct("num", "s1", "s2")).alias("r")).select("key", "component", "r.*")
                least = one.groupBy("key").agg(F.min(F.struct("component", "num", "s1", "s2")).alias("r")).select("key", "r.*")
                pairs = self._pairs(one.select("key", "num", "s1", "s2", "component"), least, F.col("x_component") > F.col("y_component"))
            else:
                open_ = bands.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).filter("open").select("key")
                rest = cut(lookup_join(bands, open_.withColumn("open", F.lit(True)), ["key"], collect_hot(bands, ["key"]), ["num"]).filter("open").drop("open"), "open")
                pairs = self._pairs(rest, rest, F.col("x_component") > F.col("y_component"))
            links = cut(self.verified(pairs).select("x", "y"), "stars")
            found = links if found is None else found.unionByName(links)
            made = cut(connected_components(found, "x", "y"), "components")
            bands = self.bands().join(made.select(F.col("node").alias("num"), F.col("component").alias("c")), "num", "left").withColumn("component", F.coalesce("c", "num")).drop("c")
            bands = cut(bands, "labelled")
        return made.select(F.col("node").alias("num"), "component")

    def groups(self) -> DataFrame:
        """(table_name, id, group_id, n_records): records that resemble another, with the least id and the size of their group."""
        m = self.members()
        hot = collect_hot(m, ["num"])
        m = lookup_join(m, self.components(), ["num"], hot, ["id"]).filter("n > 1 OR component IS NOT NULL")
        m = cut(m.withColumn("component", F.coalesce("component", "num")), "grouped")
        sizes = m.groupBy("component").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_records"))
        return lookup_join(m, sizes, ["component"], collect_hot(m, ["component"]), ["id"]).select("table_name", "id", "group_id", "n_records")

    def link_counts(self) -> DataFrame:
        """(table_name, id, n_links): the number of records each record resembles, copies included, where there are any."""
        links = self.verified(self.candidates()).select("x", "y")
        ends = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        degree = ends.join(self.classes.select(F.col("num").alias("y"), "n"), "y").groupBy("x").agg(F.sum("n").alias("d")).withColumnRenamed("x", "num")
        m = self.members()
        m = lookup_join(m, degree, ["num"], collect_hot(m, ["num"]), ["id"])
        return m.withColumn("n_links", F.col("n") - 1 + F.coalesce("d", F.lit(0))).filter("n_links > 0").select("table_name", "id", "n_links")
