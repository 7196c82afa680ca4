"""Depth matrices in long form (``chrom, start, end, sample, depth`` and a covariate): scaling and debiasing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import small, staged
from . import cohort
from .ranks import pick
from .sequences import blocked, following, walk

SITE = ("chrom", "start", "end")


def sample_levels(matrix: DataFrame, share: float = 0.65) -> DataFrame:
    """``sample, level``: the positive depth at rank ``int(share * n)``."""
    return pick(matrix.where("depth > 0"), ["sample"], "depth", level=lambda n: F.floor(n * share))


def over_levels(matrix: DataFrame, share: float = 0.65) -> DataFrame:
    """Depths over their sample's level; there is one row of levels per sample."""
    return matrix.join(sample_levels(matrix, share), "sample").withColumn("depth", F.coalesce(F.try_divide("depth", "level"), F.lit(0.0))).drop("level")


def z_scored(matrix: DataFrame, by: tuple[str, ...] = SITE) -> DataFrame:
    """Rows to mean 0 and sample sd 1, with what undoes it; constant rows become 0."""
    own = Window.partitionBy(*by)
    out = matrix.withColumn("mean", F.avg("depth").over(own)).withColumn("sd", F.coalesce(F.stddev_samp("depth").over(own), F.lit(0.0)))
    return out.withColumn("depth", F.coalesce(F.try_divide(F.col("depth") - F.col("mean"), F.col("sd")), F.lit(0.0)))


def z_restored(matrix: DataFrame) -> DataFrame:
    """Undoes ``z_scored``; depths are not negative."""
    return matrix.withColumn("depth", F.greatest(F.lit(0.0), F.col("depth") * F.col("sd") + F.col("mean"))).drop("mean", "sd")


def centred(matrix: DataFrame, by: tuple[str, ...], centre: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Depths minus the centre of their row (``by`` the site) or column (``by`` the sample)."""
    out = matrix.withColumn("centre", centre(F.col("depth")).over(Window.partitionBy(*by)))
    return out.withColumn("depth", F.col("depth") - F.col("centre"))


def uncentred(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("depth", F.col("depth") + F.col("centre")).drop("centre")


def log_centred(matrix: DataFrame) -> DataFrame:
    """log2(1 + depth) minus the sample's upper median (rank ``n // 2``)."""
    logs = matrix.withColumn("depth", F.log2(1 + F.col("depth")))
    return logs.join(pick(logs, ["sample"], "depth", centre=lambda n: F.floor(n / 2)), "sample").withColumn("depth", F.col("depth") - F.col("centre"))


def log_restored(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("depth", F.pow(F.lit(2.0), F.col("depth") + F.col("centre")) - 1).drop("centre")


def moving_median(matrix: DataFrame, covariate: str, window: int = 9, block: int = 50_000) -> DataFrame:
    """Depths over the median of a centred window of rows in covariate order, at least 1; per sample.

    The order is cut into blocks that hold ``window // 2`` rows of their neighbours, so a sample is many tasks.  Sorting by
    the covariate needs no undoing: every row keeps its site.
    """
    half = window // 2
    order = Window.partitionBy("sample", "_block").orderBy("_rank").rowsBetween(-half, half)
    rows = blocked(matrix, ["sample"], [covariate, *SITE], half, block)
    level = F.greatest(F.lit(1.0), F.percentile("depth", F.lit(0.5)).over(order))
    return rows.withColumn("_level", level).where("_own").withColumn("depth", F.col("depth") / F.col("_level")).select(matrix.columns)


def edge_median(depth: np.ndarray, window: int = 9, first: int = 0, total: int | None = None) -> np.ndarray:
    """The moving median as the command-line tool takes it: the first ``mid`` rows share the first ``mid`` values'
    median, the window then takes values ``mid`` further on (those between are not taken), and the last rows keep the last median.

    ``depth`` are the values from rank ``first`` on of ``total``; those within ``window + mid`` ranks of a part that goes on are not right.
    """
    mid, here, total = (window - 1) // 2 + 1, len(depth), first + len(depth) if total is None else total
    rank = first + np.arange(here)
    last = np.minimum(rank, total - mid - 1)  # the row whose push is the last one that counts
    level = np.full(here, 1.0)
    early = last < mid
    if early.any() and first == 0:
        level[early] = np.median(depth[:mid])
    # the values in order of being taken; the n-th is the row of rank n, or of rank n + mid from the mid-th on
    kept = np.flatnonzero((rank < mid) | (rank >= 2 * mid))
    taken = depth[kept]
    shift = 0 if not len(kept) else rank[kept[0]] - (mid if rank[kept[0]] >= mid else 0)
    stop = last + 1 - shift  # in ``taken``
    full = np.flatnonzero(~early & (stop >= window) & (stop <= len(taken)))
    if len(full):
        level[full] = np.median(np.lib.stride_tricks.sliding_window_view(taken, window)[stop[full] - window], axis=1)
    for i in np.flatnonzero(~early & (stop < window) & (stop > 0)):  # fewer than a window were taken: near the first row only
        level[i] = np.median(taken[: stop[i]])
    return depth / np.maximum(level, 1.0)


def moving_median_with_edges(matrix: DataFrame, covariate: str, window: int = 9, block: int = 50_000) -> DataFrame:
    """``edge_median`` of every sample, in blocks of the covariate's order."""
    rows, columns = blocked(matrix, ["sample"], [covariate, *SITE], window + (window - 1) // 2 + 1, block), matrix.columns

    def work(table):
        order = np.argsort(table.column("_rank").to_numpy())
        table = table.take(order)
        depth = edge_median(table.column("depth").to_numpy().astype(float), window, table.column("_rank")[0].as_py(), table.column("_total")[0].as_py())
        table = table.set_column(table.schema.get_field_index("depth"), "depth", [depth])
        return table.filter(table.column("_own")).select(columns)

    rows = rows.withColumn("depth", F.col("depth").cast("double"))
    return rows.groupBy("sample", "_block").applyInArrow(work, rows.select(*columns).schema)


def buckets(matrix: DataFrame, covariate: str, reach: float) -> DataFrame:
    """``sample, <covariate>, bucket`` of every value that occurs: a bucket ends where the value is more than ``reach`` past its first.

    Where a bucket begins depends on all before it: a walk along pointers from each value to the first one out of its reach.
    """
    keys = ["sample"]
    values = staged(matrix.select(*keys, F.col(covariate).alias("at")).distinct(), "values")
    # goals stand behind equal values, as reaching exactly so far is within
    asked = values.select(*keys, F.col("at").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(values.schema["at"].dataType).alias("of"))
    asked = asked.unionByName(values.select(*keys, (F.col("at") + reach).alias("place"), F.lit(1).alias("kind"), F.col("at").alias("of")))
    pointers = following(asked, keys, ["place", "kind", "of"], next=F.when(F.col("kind") == 0, F.col("place"))).where("kind = 1").select(*keys, F.col("of").alias("at"), "next")
    begins = walk(pointers, keys).withColumn("own", F.col("at"))
    found = following(values.join(begins, [*keys, "at"], "left"), keys, ["at"], True, before=F.col("own"))
    return found.select(*keys, F.col("at").alias(covariate), F.coalesce("own", "before").alias("bucket"))


def bucketed(matrix: DataFrame, covariate: str, reach: float) -> DataFrame:
    """Depths over the median (rank ``n // 2``) of the positive depths of their sample's bucket of the covariate."""
    rows = matrix.join(staged(buckets(matrix, covariate, reach), "buckets"), ["sample", covariate])
    centres = pick(rows.where("depth > 0"), ["sample", "bucket"], "depth", _centre=lambda n: F.floor(n / 2))
    return rows.join(centres, ["sample", "bucket"], "left").withColumn("depth", F.col("depth") / F.coalesce("_centre", F.lit(1.0))).select(matrix.columns)


def debiased(matrix: DataFrame, covariate: str = "gc", window: int = 9, bounds: tuple[float, float] | None = None, share: float = 0.65, block: int = 50_000) -> DataFrame:
    """``chrom, start, end, sample, depth``: windows within the covariate's ``bounds``, freed of its bias by the moving median in its
    order, over each sample's level (the rank ``share`` of its positive depths)."""
    kept = matrix if bounds is None else matrix.where(F.col(covariate).between(*bounds))
    return over_levels(moving_median_with_edges(kept, covariate, window, block), share).select(*SITE, "sample", "depth")


def without_components(matrix: DataFrame, most_percent: float = 15.0, most: int = 15) -> DataFrame:
    """The matrix less its leading singular components of more than ``most_percent`` of the variance, ``most`` at most.

    Right singular vectors are eigenvectors of the samples' products; each site's row is projected in Spark.  A sample that lacks
    a site counts as 0 there and stays absent.
    """
    own = staged(matrix.select(*SITE, "sample", "depth"), "matrix")
    samples = cohort.numbered(own)
    k = samples.count()
    if not k:
        return own
    tiles = cohort.product_tiles(own, samples, [*SITE])
    vectors, values, trace, width = cohort.leading(tiles, k, min(most, k), centre=False)
    drop = 0
    while drop < len(values) and 100 * values[drop] / max(trace, 1e-300) > most_percent:
        drop += 1
    if not drop:
        return own
    rows = own.join(small(staged(cohort.by_sample(vectors, samples, width), "loadings"), 100_000), "sample")
    shares = rows.groupBy(*SITE).agg(*(F.sum(F.col("depth") * F.col("v")[c]).alias(f"_s{c}") for c in range(drop)))
    part = sum((F.col("v")[c] * F.col(f"_s{c}") for c in range(drop)), F.lit(0.0))
    return rows.join(shares, [*SITE]).select(*SITE, "sample", (F.col("depth") - part).alias("depth"))
