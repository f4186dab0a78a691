"""Undoing disguised spelling: other alphabets' look-alikes, digits and signs for letters, spaced and stretched words.

A vectorised pass over the bytes of a batch finds the few texts that hold any
such thing; only these are rewritten.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF], None)
#: Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухкмтнвіјѕԁɡһӏαεορντικυχ", "aeopcyxkmthbijsdghlaeopvtikux")
_LEET = str.maketrans("013457$@!|", "oieastsaii")
_MIXED = re.compile(r"[a-zͰ-ԯɐ-ʯ]+")
_SPACED = re.compile(r"(?<![\w'@])([a-z0-9$@])([.\-_ ])[a-z0-9$@](?:\2[a-z0-9$@])+(?![\w])")
_SIGNED = re.compile(r"(?<![\w@])(?!@)[a-z0-9$@*!|]*[0-9$@*!|][a-z0-9$@*!|]*(?!\w)")
_STRETCHED = re.compile(r"[a-z]*([a-z])\1\1[a-z]*")
_RUN = re.compile(r"([a-z])\1{2,}")

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789$@*!|"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("$"), ord("*")]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in ".-_ "]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def disguised(texts: list[bytes]) -> np.ndarray:
    """Indices of the texts that may hold a disguised word."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 5
    raw = _LOWER[np.frombuffer(b"\n\n\n\n\n".join(texts) + b"\n\n\n\n\n", np.uint8)]
    if len(raw) < 8:
        return np.zeros(0, np.int64)
    letter = _LETTER[raw]
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    la, lb, lc = letter[:-2], letter[1:-1], letter[2:]
    odd = la & (a == b) & (b == c)
    odd |= la & _SIGN[b] & (lc | _SIGN[c] & letter_after(letter, 3))
    odd |= la & _SIGN[b] & _MARK[c]
    odd |= (_MARK[a] & (lb | _SIGN[b] & lc)) | (la & _MARK[b])
    odd |= (la & (b > 127)) | ((a > 127) & lb)
    gap = _GAP[raw]
    five = letter[:-4] & gap[1:-3] & letter[2:-2] & (raw[1:-3] == raw[3:-1]) & letter[4:]
    five[1:] &= ~letter[: len(five) - 1]
    at = np.union1d(np.flatnonzero(odd), np.flatnonzero(five))
    return np.unique(np.searchsorted(np.cumsum(size), at, side="right"))


def letter_after(letter: np.ndarray, n: int) -> np.ndarray:
    """For each position but the last two: is there a letter ``n`` further on."""
    out = np.zeros(len(letter) - 2, bool)
    k = len(letter) - n
    out[:k] = letter[n : n + k][: len(out)]
    return out


class Speller:
    """Rewrites texts; words of ``lexicon`` decide between readings."""

    def __init__(self, lexicon: set[str]) -> None:
        self.lexicon = lexicon
        self.by_size: dict[int, list[str]] = {}
        for w in sorted(lexicon):
            self.by_size.setdefault(len(w), []).append(w)

    def _alike(self, m: re.Match) -> str:
        w = m[0]
        return w if w.isascii() or not re.search("[a-z]", w) else w.translate(_ALIKE)

    def _spaced(self, m: re.Match) -> str:
        gap, letters = m[2], m[0][::2]
        if letters.isdigit():
            return m[0]
        plain = letters.translate(_LEET)
        for w in (plain, plain[:-1], plain[1:]):
            if w in self.lexicon:
                return f"{'' if w == plain or w != plain[1:] else plain[0] + ' '}{w}{' ' + plain[-1] if w == plain[:-1] and w != plain else ''}"
        return letters if gap != " " and len(letters) > 3 else m[0]

    def _signed(self, m: re.Match) -> str:
        w = m[0].rstrip("!|").lstrip("!|")
        if not re.search("[a-z]", w) or not (re.search(r"[a-z][0-9$@*!|]+[a-z$*]", w) or re.search(r"^[0-9$@]+[a-z]", w) or "*" in w or "$" in w):
            return m[0]
        if "*" in w:
            pattern = re.compile(re.escape(w).replace(r"\*", ".").translate(_LEET).replace("\\s", "s"))
            got = next((x for x in self.by_size.get(len(w), ()) if pattern.fullmatch(x)), None)
            return got or w.replace("*", "")
        plain = w.translate(_LEET)
        for x in (plain, w.translate(str.maketrans("1", "l")).translate(_LEET)):
            if x in self.lexicon:
                return x
        return plain

    def _short(self, m: re.Match) -> str:
        one, two = _RUN.sub(r"\1", m[0]), _RUN.sub(r"\1\1", m[0])
        return two if two in self.lexicon else one

    def __call__(self, text: str) -> str:
        """``text`` in lower case and plain spelling."""
        t = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).lower().replace("’", "'")
        if not t.isascii():
            t = _MIXED.sub(self._alike, t)
        t = _SPACED.sub(self._spaced, t)
        t = _SIGNED.sub(self._signed, t)
        return _STRETCHED.sub(self._short, t)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Texts as bytes, disguised ones rewritten."""
        raw = [b"" if not t else t.encode("utf-8", "replace") for t in texts]
        if raw:
            for i in disguised(raw).tolist():
                raw[i] = self(texts[i]).encode("utf-8", "replace")
        return raw
