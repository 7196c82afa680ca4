"""Depth classes, overlap shares, scaled depths and Poisson probabilities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_WIDTH = 16_384
SLOTS, SLOT_SHARE = 70, 2 / 3
DEPTH_LIMIT, PROJECTION_LIMIT = 50_000, 8.0
SIZE_CLASSES = ("small", "middle", "large")


def depth_class(depth: Column, least: int = 4, most: int = 0) -> Column:
    """Coverage class of a depth; ``most`` of 0 means no upper bound."""
    out = F.when(depth == 0, "NO_COVERAGE").when(depth < least, "LOW_COVERAGE")
    if most > 0:
        out = out.when(depth >= most, "EXCESSIVE_COVERAGE")
    return out.otherwise("CALLABLE")


def size_class(length: Column) -> Column:
    """Length class of a call."""
    small, middle, large = SIZE_CLASSES
    return F.when(length < 20_000, small).when(length < 100_000, middle).otherwise(large)


def clamped_copies(cn: Column) -> Column:
    """Copy numbers above two are one state."""
    return F.least(cn, F.lit(3))


def overlap_share(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over the shorter length, 0 without overlap."""
    shared = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    return F.coalesce(F.try_divide(shared, F.least(end_a - start_a, end_b - start_b)), F.lit(0.0))


def scaled_depth(size: Column, median: Column) -> Column:
    return F.least(F.coalesce(F.try_divide(size.cast("double"), median), F.lit(0.0)), F.lit(float(DEPTH_LIMIT)))


def slot_of(depth: Column) -> Column:
    """The histogram slot of a scaled depth."""
    raw = F.floor(F.least(depth, F.lit(10.0)) * (SLOTS * SLOT_SHARE) + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), raw)).cast("int")


def quantised_depth(depth: Column) -> Column:
    """A capped depth in 16 bits, as the projections use it."""
    return F.floor(F.least(depth, F.lit(PROJECTION_LIMIT)) * (65_535 / PROJECTION_LIMIT) + 0.5).cast("int")


def virtual_offset(file: Column, block: Column) -> Column:
    return F.shiftleft(file.cast("bigint"), 16).bitwiseOR(block.cast("bigint"))


def fold_change(depth: Column, centre: Column) -> Column:
    """Base-2 logarithm of depth over the two-copy centre; null where either is not positive."""
    return F.when((depth > 0) & (centre > 0), F.log2(depth / centre))


def is_aberrant(change: Column, low: float = -0.5, high: float = 0.3) -> Column:
    return ~((change > low) & (change < high))


_LOG_FACTORIAL = np.array([math.lgamma(k + 1) for k in range(4096)])


def log_factorial(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k)
    out = _LOG_FACTORIAL[np.minimum(k, len(_LOG_FACTORIAL) - 1)]
    big = k >= len(_LOG_FACTORIAL)
    if big.any():
        out = out.copy()
        out[big] = [math.lgamma(x + 1) for x in k[big]]
    return out


def poisson_pmf(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(K = k); a rate of zero has all its weight at zero."""
    k, rate = np.broadcast_arrays(np.asarray(k, dtype=np.int64), np.asarray(rate, dtype=float))
    safe = np.maximum(rate, 1e-300)
    return np.where(rate > 0, np.exp(k * np.log(safe) - rate - log_factorial(k)), (k == 0).astype(float))


def poisson_cdf(k: int, rate: float) -> float:
    return float(poisson_pmf(np.arange(k + 1), rate).sum())
