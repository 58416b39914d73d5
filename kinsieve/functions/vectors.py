"""Distances between sequences of hashes, histograms, fingerprints and vectors, as array expressions.

Sequences of unequal length are compared over the shorter one. Null means that a
feature is absent and a gate abstains; a rejected hash score is null, too, and
its gate rejects null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import Options


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def zipped(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def hash_distances(a: Column, b: Column, bits: int = 64) -> Column:
    """Differing bits of each frame's hash words (arrays of long), scaled to 64; null where lengths differ."""
    words = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return zipped(a, b, lambda x, y: F.when(F.size(x) == F.size(y), words(x, y) * 64.0 / bits))


def hash_score(distances: Column, o: Options) -> Column:
    """Trimmed mean of the sorted distances over their spread; null if rejected (gap, cap, nothing left, a distance missing)."""
    d, n = F.array_sort(distances), F.size(distances)
    half = F.floor(n / 2).cast("int")
    low, high = F.slice(d, F.lit(1), half), F.slice(d, half + 1, n)
    trim = F.greatest(F.lit(1), F.floor(n * o.phash_trim_ratio).cast("int"))
    kept = F.slice(d, F.lit(1), F.greatest(F.lit(0), n - trim))
    m, sums = mean(kept), total(d)
    # by sums: a mean inside the lambda would be worked out again for every distance
    spread = F.greatest(F.lit(0.0), total(F.transform(d, lambda x: x * x)) - sums * sums / n)
    std = F.sqrt(spread / F.greatest(F.lit(1), n - 1))
    bad = F.exists(distances, lambda x: x.isNull()) | (n < 2) | ((n >= 6) & (mean(high) - mean(low) > o.phash_bimodal_gap_cap)) | (m > o.phash_trimmed_mean_cap)
    return F.when(~bad, F.when(n < 6, m).otherwise(m / (1 + std)))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Null if either histogram is absent, empty or of another length."""
    root = total(F.zip_with(a, b, lambda x, y: F.sqrt(F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0)))))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.sqrt(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))))


def fingerprint_distance(a: Column, b: Column, least: int = 40) -> Column:
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(zipped(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(n >= least, bits / (32.0 * n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 0.5 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def frame_distances(a: Column, b: Column) -> Column:
    return zipped(a, b, cosine_distance)


def percentile(xs: Column, q: float) -> Column:
    """Linear interpolation between the sorted values."""
    d, at = F.array_sort(xs), (F.size(xs) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.get(d, low), F.get(d, F.least(low + 1, F.size(xs) - 1))
    return F.when(F.size(xs) > 0, a + (b - a) * (at - low))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x * 0.0))


def pooled(patches: Column, side: int, grid: int) -> Column:
    """Mean of each of grid x grid square windows of a side x side array of numbers; side must be a multiple of grid."""
    k = side // grid
    cells = [[F.get(patches, F.lit((r * k + i) * side + c * k + j)) for i in range(k) for j in range(k)] for r in range(grid) for c in range(grid)]
    return F.array(*(sum(cell[1:], cell[0]) / len(cell) for cell in cells))
