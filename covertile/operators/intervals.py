"""Interval algebra: overlap joins through bins of several widths, sweeps, islands, subtraction, grids.

Positions are cut into shards, so no contig has to fit a task: sweeps and islands are worked out inside a shard, and only
the first and last island of each shard (two rows a shard) meet along the contig.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a shard.
SHARD = 65_536
#: Bins of a level are so many times (a power of two) as wide as those of the level before; intervals of up to as many widths stand in a level.
_SHIFT = 3


def binned(df: DataFrame, start: Column, end: Column, width: int, name: str = "_bin") -> DataFrame:
    """A row per bin that the half-open interval touches; empty intervals go."""
    return df.where(start < end).withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))


def level(start: Column, end: Column, width: int) -> Column:
    """The first level at which the interval is at most ``2 ** _SHIFT`` bins long."""
    return reduce(lambda x, k: x + F.when(end - start > width << _SHIFT * (k + 1), 1).otherwise(0), range((62 - width.bit_length()) // _SHIFT), F.lit(0))


def levels_of(df: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that occur, some twenty numbers at most."""
    return sorted(r[0] for r in df.where(F.col(start) < F.col(end)).select(level(F.col(start), F.col(end), width).alias("l")).distinct().collect())


def levels_to(length: int, width: int) -> list[int]:
    """All levels that intervals of up to ``length`` can have."""
    last = 0
    while length > width << _SHIFT * (last + 1):
        last += 1
    return list(range(last + 1))


def placed(df: DataFrame, start: str, end: str, width: int, others: list[int]) -> DataFrame:
    """Rows at the bins of their own level, ``_own``, and at the (at most two) bins of each higher level of ``others``."""
    s, e = F.col(start), F.col(end)
    own = level(s, e, width)
    at = F.concat(F.array(own), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own))
    rows = df.where(s < e).withColumn("_level", F.explode(at)).withColumn("_own", F.col("_level") == own)
    wide = F.call_function("shiftleft", F.lit(width).cast("bigint"), F.col("_level") * _SHIFT)
    return rows.withColumn("_wide", wide).withColumn("_bin", F.explode(F.sequence(F.floor(s / F.col("_wide")), F.floor((e - 1) / F.col("_wide")))))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int, a_span: tuple[str, str] = ("start", "end"), b_span: tuple[str, str] = ("start", "end"), suffix: str = "_b", levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """All overlapping pairs: an equi-join on keys, level and bin.

    An interval stands in bins near its own length, so one that spans a contig makes a few rows, not one for each ``width``; the
    shorter of a pair looks the longer up at the longer's level.  Each pair is kept in the later of the two first bins.
    ``b``'s columns other than ``on`` get the suffix.  Hot keys are split by adaptive execution, as both sides are plain exchanges.
    ``levels``: those that occur in ``a`` and ``b``, where known; both tables are read for them otherwise.
    """
    b = b.select(*on, *[F.col(c).alias(c + suffix) for c in b.columns if c not in on])
    (s1, e1), (s2, e2) = a_span, (b_span[0] + suffix, b_span[1] + suffix)
    of_a, of_b = levels or (levels_of(a, s1, e1, width), levels_of(b, s2, e2, width))
    overlaps = (F.col(e1) > F.col(s2)) & (F.col(s1) < F.col(e2))
    if {*of_a, *of_b} <= {0}:
        met = binned(a, F.col(s1), F.col(e1), width).join(binned(b, F.col(s2), F.col(e2), width), [*on, "_bin"])
        return met.where(overlaps & (F.col("_bin") == F.floor(F.greatest(s1, s2) / width))).drop("_bin")
    left = placed(a, s1, e1, width, of_b)
    right = placed(b, s2, e2, width, of_a).withColumnRenamed("_own", "_own_b").drop("_wide")
    met = left.join(right, [*on, "_level", "_bin"]).where(F.col("_own") | F.col("_own_b"))
    return met.where(overlaps & (F.col("_bin") == F.floor(F.greatest(s1, s2) / F.col("_wide")))).drop("_bin", "_level", "_wide", "_own", "_own_b")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width: int, key: list[str]) -> DataFrame:
    """Rows of ``a`` (unique by ``key``) that overlap any row of ``b``.

    ``b`` is merged first, so an interval meets few rows however deep ``b`` is.
    """
    return a.join(overlap_join(a.select(*dict.fromkeys([*on, *key, "start", "end"])), merge(b, on), on, width).select(*key).distinct(), key, "left_semi")


def sweep(sides: dict[str, DataFrame], on: list[str], shard: int = SHARD) -> DataFrame:
    """``on, _bin, start, end`` and a count a side: stretches of constant counts of the sides' intervals, cut at shards, counts of 0 included between edges.

    Intervals are clipped to shards, so each shard's running sums are independent of all others; edges are summed before they are shuffled.
    """
    edges = None
    for name, df in sides.items():
        cut = binned(df.select(*on, "start", "end"), F.col("start"), F.col("end"), shard)
        ends = F.array(F.struct(F.greatest("start", F.col("_bin") * shard).alias("pos"), F.lit(1).alias("step")), F.struct(F.least("end", (F.col("_bin") + 1) * shard).alias("pos"), F.lit(-1).alias("step")))
        part = cut.select(*on, "_bin", F.inline(ends)).select(*on, "_bin", "pos", *((F.col("step") if n == name else F.lit(0)).alias(n) for n in sides))
        edges = part if edges is None else edges.unionByName(part)
    steps = edges.groupBy(*on, "_bin", "pos").agg(*(F.sum(n).alias(n) for n in sides))
    order = Window.partitionBy(*on, "_bin").orderBy("pos")
    runs = steps.select(*on, "_bin", F.col("pos").cast("bigint").alias("start"), F.lead("pos").over(order).cast("bigint").alias("end"), *(F.sum(n).over(order).alias(n) for n in sides))
    return runs.where("end IS NOT NULL")


def islands(df: DataFrame, on: list[str], gap: int = 0, state: str | None = None, covered: bool = False, shard: int = SHARD) -> DataFrame:
    """Unions of intervals that overlap, touch, or lie within ``gap``; with ``state``, of intervals of one state.

    ``covered`` adds the summed length of the intervals (which must not overlap then, nor with ``state``).  Rows of a ``sweep`` are in
    shards already, others are cut.  Islands inside a shard are final; each shard's first and last one are joined with those of the shards beside it.
    """
    kept = [state] if state else []
    if "_bin" in df.columns:
        cut = df.select(*on, "_bin", *kept, "start", "end")
    else:
        cut = binned(df.select(*on, "start", "end", *kept), F.col("start"), F.col("end"), shard)
        cut = cut.select(*on, "_bin", *kept, F.greatest("start", F.col("_bin") * shard).cast("bigint").alias("start"), F.least("end", (F.col("_bin") + 1) * shard).cast("bigint").alias("end"))

    def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        joins = F.col("start") <= reach + gap
        if state:
            joins &= F.lag(state).over(order) == F.col(state)
        marked = rows.withColumn("_new", F.when(reach.isNotNull() & joins, 0).otherwise(1))
        return marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def united(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
        sums = [F.sum(length).alias("covered")] if covered else []
        return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.first(c).alias(c) for c in kept), *sums)

    own = united(numbered(cut, [*on, "_bin"]), [*on, "_bin"], F.col("end") - F.col("start"))
    own = own.withColumn("_edge", (F.col("_island") == 1) | (F.col("_island") == F.max("_island").over(Window.partitionBy(*on, "_bin"))))
    columns = [*on, "start", "end", *kept, *(["covered"] if covered else [])]
    inner = own.where("NOT _edge").select(*columns)
    outer = united(numbered(own.where("_edge").select(*columns), on), on, F.col("covered") if covered else F.lit(0)).select(*columns)
    return inner.unionByName(outer)


def merge(df: DataFrame, on: list[str], gap: int = 0, shard: int = SHARD) -> DataFrame:
    """Unions of intervals that overlap, touch, or lie within ``gap``."""
    return islands(df, on, gap, shard=shard)


def complement(df: DataFrame, extent: DataFrame, on: list[str], shard: int = SHARD) -> DataFrame:
    """What of each key's ``[0, length)`` no interval covers."""
    whole = extent.select(*on, F.lit(0).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end"))
    return islands(sweep({"_x": df, "_whole": whole}, on, shard).where("_whole > 0 AND _x = 0"), on, shard=shard)


def subtract(a: DataFrame, b: DataFrame, on: list[str], shard: int = SHARD) -> DataFrame:
    """The merged parts of ``a`` that ``b`` does not cover."""
    return islands(sweep({"_a": a, "_b": b}, on, shard).where("_a > 0 AND _b = 0"), on, shard=shard)


def intersect(a: DataFrame, b: DataFrame, on: list[str], shard: int = SHARD) -> DataFrame:
    """The merged parts that both cover."""
    return islands(sweep({"_a": a, "_b": b}, on, shard).where("_a > 0 AND _b > 0"), on, shard=shard)


def grid(extent: DataFrame, width: int, start: str = "from", end: str = "to") -> DataFrame:
    """Windows aligned to multiples of ``width`` and clipped to each row's ``[from, to)``."""
    full = extent.where(F.col(start) < F.col(end)).withColumn("_w", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    kept = [c for c in extent.columns if c not in (start, end)]
    return full.select(*kept, F.greatest(F.col("_w") * width, F.col(start)).cast("bigint").alias("start"), F.least((F.col("_w") + 1) * width, F.col(end)).cast("bigint").alias("end"))


def total_length(df: DataFrame) -> DataFrame:
    """One row: the summed length, overlaps counted each time."""
    return df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("total"))
