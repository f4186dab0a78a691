"""Scores, times and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch and divisor of the hot score (fixed values).
HOT_EPOCH, HOT_SECONDS = 1134028003, 45000


def hot_score(likes: Column, dislikes: Column, at: Column) -> Column:
    """Sign and magnitude of the balance of likes plus the age in units of 12.5 hours, to 7 places."""
    s = likes - dislikes
    seconds = F.unix_micros(at.cast("timestamp")) / 1e6
    return F.round(F.signum(s) * F.log10(F.greatest(F.abs(s), F.lit(1)).cast("double")) + (seconds - HOT_EPOCH) / HOT_SECONDS, 7)


def recency_score(now: Column, then: Column) -> Column:
    """``ln((271.8 - age) / 100)``; null for ages of 271.8 and more."""
    left = (F.lit(271.8) - (now - then)) / 100
    return F.when(left > 0, F.log(left))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def minute(at: Column) -> Column:
    """The start of the minute, in epoch seconds."""
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 60).cast("long") * 60
