"""Words of whole batches of texts as hashes, by vectorised passes over their bytes.

A word is a run of ASCII letters and digits, ``'`` and bytes above 127.  Every
word gets a 64-bit hash from prefix sums of a polynomial, so no Python object
is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_WORD[39] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
_CHUNK = 1 << 21
_POW: list[np.ndarray] = []
#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows of a text column, at most ``most`` bytes or one row at a time."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    end = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + most, side="right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        _POW[:] = [np.cumprod(np.full(size, r, np.uint64)) for r in (_R, _RI)]
    return _POW[0][:n], _POW[1][:n]


@dataclass
class Words:
    """Words of a batch: hash, text index, byte start and end, sentence (counted over the batch), and the byte before."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    before: np.ndarray


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(texts: list[bytes], extra: bytes = b"") -> Words:
    """The words of UTF-8 ``texts``; bytes of ``extra`` count as letters too.

    Sentences end at ``.``, ``!``, ``?``, a line end or the end of a text.
    """
    if not texts:
        e = np.zeros(0, np.int64)
        return Words(e.astype(np.uint64), e, e, e, e, e.astype(np.uint8))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    word = _WORD
    if extra:
        word = _WORD.copy()
        word[list(extra)] = True
    low = _LOWER[raw]
    inside = word[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc_end = np.cumsum(size)
    doc = np.searchsorted(doc_end, start, side="right")
    stops = np.flatnonzero(_STOP[raw] & ~inside)
    return Words(_hash(low, start, end), doc, start, end, np.searchsorted(stops, start), raw[start - 1])


def _hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in pieces, so that the prefix sums stay small
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
        part = low[base : end[j - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = _mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def word_hash(word: str) -> int:
    """The hash that ``words`` gives one lower-case word."""
    return int(words([word.encode()], b"").hash[0])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two words in a row."""
    return _mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


class Table:
    """Words (or phrases) to small integers, looked up for whole arrays of hashes."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def get(self, h: np.ndarray, default: int = -1) -> np.ndarray:
        """The value of each hash, or ``default``."""
        out = np.full(len(h), default, self.values.dtype)
        near = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        if len(near):
            own = h[near]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            same = self.hashes[at] == own
            out[near[same]] = self.values[at[same]]
        return out
