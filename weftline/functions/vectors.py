"""Vector functions, all built in, and order-aware extremes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column, least_norm: float = 1e-10) -> Column:
    """1 - cosine; 2 if the product of norms is below least_norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms < least_norm, F.lit(2.0)).otherwise(1 - dot(a, b) / norms)


def argmax_last(value: Column, index: Column) -> Column:
    """Aggregate: the index of the greatest value, the last of ties."""
    return F.max_by(index, F.struct(value, index))


def argmin_first(value: Column, index: Column) -> Column:
    """Aggregate: the index of the least value, the first of ties."""
    return F.min_by(index, F.struct(value, index))


def hamming(n: Column, size: int = 256) -> Column:
    return 0.54 - 0.46 * F.cos(F.lit(2 * pi) * n / size)


def pcm_to_float(sample: Column) -> Column:
    return sample / 32768.0


def frames(samples: Column, size: int = 256, hop: int = 128, most: int = 100) -> Column:
    """Array of frames: (len - size) / hop of them, at most `most`; the last full frame is not used."""
    count = F.least(F.floor((F.size(samples) - size) / hop), F.lit(most)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda f: F.slice(samples, f * hop + 1, F.lit(size)))
