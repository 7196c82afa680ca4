"""Copy numbers by expectation-maximisation over samples' depths, mixtures, and runs of aberrant windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import poisson_pmf

STATES, ROUNDS, TOLERANCE = 9, 10, 0.01
#: Fold changes within these bounds are the ordinary state.
LOWER, UPPER = -0.80, 0.40


def _medians(depths: np.ndarray) -> np.ndarray:
    """Rows' middle values; of an even number, the mean of those at ``n / 2`` and the next (of two, both)."""
    s, n = np.sort(depths, axis=1), depths.shape[1]
    if n % 2:
        return s[:, n // 2]
    return s.mean(1) if n == 2 else s[:, n // 2 : n // 2 + 2].mean(1)


def _nearest(centres: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Index of the closer of the two centres around each depth of a row, the lower one on ties."""
    top = centres.shape[1] - 1
    right = np.clip((centres[:, None, :] < depths[:, :, None]).sum(2), 1, top)
    closer = np.abs(depths - np.take_along_axis(centres, right, 1)) < np.abs(depths - np.take_along_axis(centres, right - 1, 1))
    return np.where(depths <= centres[:, :1], 0, np.where(depths > centres[:, -1:], top, right - 1 + closer))


def em_centres(depths: np.ndarray) -> np.ndarray:
    """Depth centres of the copy numbers 0 to 8, for a row of samples' depths or for many rows at once; zeros if all depths are zero.

    Rows that have settled are left out of further rounds.
    """
    depths = np.asarray(depths, float)
    if depths.ndim == 1:
        return em_centres(depths[None])[0]
    k = np.arange(STATES)
    two = _medians(depths)
    centres = two[:, None] * (k / 2) ** 1.1
    centres[:, 0] = TOLERANCE * two
    live = np.arange(len(depths))
    for _ in range(ROUNDS):
        if not len(live):
            break
        d, before = depths[live], centres[live]
        state = _nearest(before, d)
        counts = np.stack([(state == s).sum(1) for s in k], 1)
        sums = np.stack([np.where(state == s, d, 0.0).sum(1) for s in k], 1)
        means = np.divide(sums, counts, out=np.zeros(sums.shape), where=counts > 0)
        # no sample at two copies: what the others say of it; the top state is left out
        inner = slice(1, STATES - 1)
        others = (means[:, inner] * (2 / k[inner]) * counts[:, inner] / d.shape[1]).sum(1)
        two = np.where(means[:, 2] == 0, others, means[:, 2])
        after = before.copy()
        after[:, 1:] = two[:, None] * k[1:] / 2
        spread = (after[:, 2] - after[:, 1]) / 1.5
        after[:, 1] -= spread
        after[:, 3] += spread
        change = np.abs(after - before)
        centres[live] = after
        live = live[(change.sum(1) > TOLERANCE) & (change.max(1) > 0.5)]
    return centres


def copy_numbers(depths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest state, unless two copies explain the depth about as well (Poisson probabilities); of one row or of many."""
    depths = np.asarray(depths, float)
    if depths.ndim == 1:
        return copy_numbers(depths[None], centres[None])[0]
    state = _nearest(centres, depths)
    whole, two = np.floor(depths + 0.5).astype(np.int64), centres[:, 2:3]
    two_better = poisson_pmf(whole, np.take_along_axis(centres, state, 1)) * 0.9 < poisson_pmf(whole, np.broadcast_to(two, depths.shape))
    above = depths > centres[:, -1:]  # past the last centre: that state without a test
    return np.where(two <= 0, 0, np.where((state != 2) & two_better & ~above, 2, state))


def fold_changes(depths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Base-2 logarithms of depths over the two-copy centre, of one row or of many; not a number where the centre is not positive."""
    depths, two = np.asarray(depths, float), centres[..., 2:3]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(two > 0, np.log2(depths / np.where(two > 0, two, 1.0)), np.nan)


def of_lengths(rows: pd.Series):
    """Rows of an Arrow batch that have one length, as places and a matrix."""
    size = np.array([0 if d is None else len(d) for d in rows])
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.stack([np.asarray(rows.iloc[i], float) for i in at])


EM = T.StructType([T.StructField("centres", T.ArrayType(T.DoubleType())), T.StructField("cn", T.ArrayType(T.IntegerType())), T.StructField("change", T.ArrayType(T.DoubleType()))])


def em(depths: Column) -> Column:
    """``struct(centres, cn, change)`` of an array of samples' depths; a change is null where it is not defined."""
    @F.pandas_udf(EM)
    def run(rows: pd.Series) -> pd.DataFrame:
        out = [([], [], [])] * len(rows)
        for at, d in of_lengths(rows):
            centres = em_centres(d)
            cn, change = copy_numbers(d, centres), fold_changes(d, centres).astype(object)
            change[np.isnan(change.astype(float))] = None
            for i, *row in zip(at.tolist(), centres.tolist(), cn.tolist(), change.tolist(), strict=True):
                out[i] = tuple(row)
        return pd.DataFrame(out, columns=["centres", "cn", "change"])

    return run(depths)


def state_changes(before: Column, after: Column) -> Column:
    """``struct(stayed, changed, share)``: samples aberrant in the same direction in both windows, samples that
    changed, and the share of samples in the same state; arrays hold sample indices from 0."""
    where = lambda cond: F.filter(F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda z, i: F.when(cond(z["a"], z["b"]), i)), lambda i: i.isNotNull())
    plain = lambda x: (x > LOWER) & (x < UPPER)
    same_way = lambda a, b: ((a >= UPPER) & (b >= UPPER)) | ((a <= LOWER) & (b <= LOWER))
    stayed = where(lambda a, b: same_way(a, b) & ~(plain(a) & plain(b)))
    changed = where(lambda a, b: ~same_way(a, b) & ~(plain(a) & plain(b)))
    return F.struct(stayed.alias("stayed"), changed.alias("changed"), ((F.size(before) - F.size(changed)) / F.size(before)).alias("share"))


def mixture(depths: np.ndarray, states: int = 8, eps: float = 0.001, prior: float = 11.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, two-copy rate and posteriors (states x samples) of a Poisson mixture over copy numbers 0 to 7, of one row of depths or of many."""
    depths = np.asarray(depths, float)
    if depths.ndim == 1:
        weights, rate, posterior = mixture(depths[None], states, eps, prior)
        return weights[0], float(rate[0]), posterior[0]
    n, k = depths.shape[1], np.arange(states)
    weights = np.full((len(depths), states), eps)
    weights[:, 2] = 1 - 5 * eps * (states - 1)
    whole = np.floor(depths + 0.5).astype(np.int64)[:, None, :]
    mean_depth = depths.mean(1)
    rate, found = np.full(len(depths), np.inf), mean_depth.copy()
    posterior = np.zeros((len(depths), states, n))
    live = np.arange(len(depths))
    for _ in range(10):
        live = live[np.abs(rate[live] - found[live]) > 0.01]
        if not len(live):
            break
        rate[live] = found[live]
        level, w = k / 2 * rate[live][:, None], weights[live][:, :, None]
        below = (w * poisson_pmf(whole[live], level[:, :, None])).sum(1, keepdims=True)
        level[:, 0] = eps / 2 * rate[live]
        top = w * poisson_pmf(whole[live], level[:, :, None])
        posterior[live] = np.divide(top, below, out=np.zeros_like(top), where=below > 0)
        mean = posterior[live].mean(2)
        weights[live] = (mean + np.where(k == 2, prior, 0.0) / n) / (1 + prior / n)
        load = (mean * np.where(k == 0, eps, k) / 2).sum(1)
        found[live] = np.where(load > 0, mean_depth[live] / np.where(load > 0, load, 1.0), rate[live])
    return weights, found, posterior


def information_gain(posterior: np.ndarray, eps: float = 0.001) -> np.ndarray:
    """Of posteriors (states x samples) of one row or of many."""
    states = posterior.shape[-2]
    k = np.where(np.arange(states) == 0, eps, np.arange(states))
    return (posterior.mean(-1) * np.abs(np.log(k / 2))).sum(-1)


def normalised_gain(posterior: np.ndarray, eps: float = 0.001) -> np.ndarray:
    """Each sample's posterior-weighted distance from two copies; the two-copy state itself adds nothing."""
    k = np.where(np.arange(len(posterior)) == 0, eps, np.arange(len(posterior)))
    return (posterior * np.abs(np.log(k / 2))[:, None]).sum(0)


MIXTURE = T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType()), T.StructField("gain", T.DoubleType())])


def mixture_of(depths: Column) -> Column:
    """``struct(weights, rate, gain)`` of an array of samples' depths."""
    @F.pandas_udf(MIXTURE)
    def run(rows: pd.Series) -> pd.DataFrame:
        out = [([], None, None)] * len(rows)
        for at, d in of_lengths(rows):
            weights, rate, posterior = mixture(d)
            for i, *row in zip(at.tolist(), weights.tolist(), rate.tolist(), information_gain(posterior).tolist(), strict=True):
                out[i] = tuple(row)
        return pd.DataFrame(out, columns=["weights", "rate", "gain"])

    return run(depths)


def aberrant_runs(windows: DataFrame, gap: int = 30_000) -> DataFrame:
    """Calls from ``chrom, start, end, sample, depth, cn, change``: runs of aberrant windows per sample.

    A window counts if it and the window before it (the first of a contig: it alone) are aberrant in one
    direction; a gap of ``gap`` bases ends a run; windows near the ordinary state are not reported.
    """
    order = Window.partitionBy("sample", "chrom").orderBy("start", "end")
    before = F.coalesce(F.lag("change").over(order), F.col("change"))
    both = ((F.col("change") >= UPPER) & (before >= UPPER)) | ((F.col("change") <= LOWER) & (before <= LOWER))
    seen = windows.withColumn("_in", both).where("_in")
    fresh = F.when(F.lag("end").over(order).isNull() | (F.col("start") - F.lag("end").over(order) >= gap), 1).otherwise(0)
    runs = seen.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(order)).where("NOT (change > -0.5 AND change < 0.3)")
    items = F.array_sort(F.collect_list(F.struct("start", "end", "depth", "cn", "change")))
    return runs.groupBy("sample", "chrom", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), items.alias("windows")).drop("run")
