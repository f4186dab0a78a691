"""Deterministic choices from hashes, equal in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits taken at once: with a modulus below 2**31 no step leaves 64 bits.
DIGITS = 7


def hex_mod(digest: Column, n: int, size: int) -> Column:
    """The first ``size`` hex digits of a digest as one big number, modulo ``n`` (below 2**31)."""
    out = F.lit(0).cast("long")
    for at in range(1, size + 1, DIGITS):
        k = min(DIGITS, size - at + 1)
        out = F.pmod(out * (1 << 4 * k) + F.conv(F.substring(digest, at, k), 16, 10).cast("long"), F.lit(n))
    return out


def md5_choice(key: Column, n: int) -> Column:
    """``int(md5(key), 16) % n``."""
    return hex_mod(F.md5(key), n, 32)


def sha_choice(key: Column, n: int) -> Column:
    """``int(sha256(key), 16) % n``."""
    return hex_mod(F.sha2(key, 256), n, 64)


def seed32(*keys: Column) -> Column:
    """The first four bytes of the SHA-256 of the keys joined by colons, as an unsigned integer."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, 8), 16, 10).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys."""
    return seed32(*keys).cast("double") / float(1 << 32)


def hash_order(seed: str, key: Column) -> Column:
    """A random-looking but fixed order of keys."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def distinct_draw(n: Column, k: int, *keys: Column) -> Column:
    """``k`` distinct numbers of 0..n-1 (all of them if there are no more) as an array, drawn by hash of the keys: Floyd's sample."""
    none = F.array().cast("array<bigint>")

    def take(drawn: Column, j: Column) -> Column:
        x = F.pmod(F.xxhash64(*keys, j), j + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, x), j).otherwise(x)))

    n = n.cast("long")
    return F.when(n > 0, F.aggregate(F.sequence(F.greatest(n - k, F.lit(0)), n - 1), none, take)).otherwise(none)
