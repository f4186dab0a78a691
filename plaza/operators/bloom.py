"""A Bloom filter over keys, built in blocks on the cluster and broadcast within a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block; all bits of one key lie in one block.
BLOCK_BITS = 32768
#: Bits per key the filter aims at, and the bits a key sets.
BITS_PER_KEY, PROBES = 16, 7
#: No filter is larger: 32 MB.  More keys are split by hash over several filters, one pass of probes each.
MAX_BITS = 1 << 28


def hashes(*keys: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key."""
    return F.xxhash64(*keys), F.xxhash64(F.lit(97), *keys)


def shards_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Filters of at most ``max_bits`` that ``n`` keys need."""
    return max(1, -(-n * BITS_PER_KEY // max_bits))


def shard(h1: Column, shards: int) -> Column:
    """The filter a key belongs to, by bits of its hash that do not choose the block."""
    return F.pmod(F.shiftright(h1, 32), F.lit(shards)).cast("int")


def blocks_for(n: int) -> int:
    """Blocks of a filter over ``n`` keys: a power of two, within MAX_BITS."""
    want = max(1, min(MAX_BITS, n * BITS_PER_KEY) // BLOCK_BITS)
    return 1 << max(0, (want - 1).bit_length())


def _probes(h2: np.ndarray) -> np.ndarray:
    u = h2.view(np.uint64)
    first, step = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((first[None, :] + i * step[None, :]) % np.uint64(BLOCK_BITS)).astype(np.int64)


def build(keys: DataFrame, h1: Column, h2: Column, n: int) -> np.ndarray:
    """The filter's bits as one byte array of at most MAX_BITS / 8 bytes.

    ``keys`` are spread by block, so every block is made whole in one task and
    sent once; 16 bytes a key are shuffled.
    """
    n_blocks = blocks_for(n)
    rows = keys.select(F.pmod(h1, F.lit(n_blocks)).cast("int").alias("block"), h2.alias("h2"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            block, at = b.column(0).to_numpy(zero_copy_only=False), _probes(b.column(1).to_numpy(zero_copy_only=False))
            order = np.argsort(block, kind="stable")
            names, starts = np.unique(block[order], return_index=True)
            for name, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                mask = bits.setdefault(name, np.zeros(BLOCK_BITS, bool))
                mask[at[:, part].ravel()] = True
        for name, mask in bits.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int32()), "bits": pa.array([np.packbits(mask, bitorder="little").tobytes()])})

    made = rows.repartition("block").mapInArrow(fill, "block int, bits binary").collect()
    out = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for r in made:
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def contains(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each pair of hashes: False proves that no such key was put in."""
    block = np.mod(h1, bits.shape[0])
    at = _probes(h2)
    ok = np.ones(len(h1), bool)
    for i in range(PROBES):
        ok &= (bits[block, at[i] >> 3] >> (at[i] & 7).astype(np.uint8)) & 1 == 1
    return ok
