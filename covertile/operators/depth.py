"""Depth from alignments: pileups, windows, callable blocks, multi-sample blocks, window matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import depth_class
from ..staging import staged
from .intervals import SHARD, binned, grid, islands, levels_of, levels_to, overlap_join, sweep
from .sequences import following, walk


def usable(reads: DataFrame, mapq: int = 1) -> DataFrame:
    return reads.where(F.col("mapq") >= mapq)


def pileup_segments(reads: DataFrame, keys: tuple[str, ...] = ("sample", "chrom"), shard: int = SHARD) -> DataFrame:
    """Maximal runs of one positive depth per shard: ``keys, start, end, depth``.

    Reads are clipped to shards, so each shard's running sum is independent of all others and no
    contig has to fit a task; edges are summed before they are shuffled.
    """
    cut = binned(reads.select(*keys, "start", "end"), F.col("start"), F.col("end"), shard)
    cut = cut.withColumn("s", F.greatest("start", F.col("_bin") * shard)).withColumn("e", F.least("end", (F.col("_bin") + 1) * shard))
    edges = cut.select(*keys, "_bin", F.inline(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("step")))))
    steps = edges.groupBy(*keys, "_bin", "pos").agg(F.sum("step").alias("step")).where("step <> 0")
    order = Window.partitionBy(*keys, "_bin").orderBy("pos")
    run = steps.select(*keys, F.col("pos").cast("bigint").alias("start"), F.lead("pos").over(order).cast("bigint").alias("end"), F.sum("step").over(order).alias("depth"))
    return run.where("depth > 0 AND end IS NOT NULL")


def pileup(reads: DataFrame, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """A row per covered position; for exports and small regions."""
    return pileup_segments(reads, keys).withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).select(*keys, "pos", "depth")


def window_means(reads: DataFrame, regions: DataFrame, width: int = 250, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """Mean depth of every window of ``regions`` (``keys, from, to``), zero where nothing lies; missing positions count as 0.

    Every read adds its overlap to the windows that it touches; sums are made before the shuffle.
    """
    cut = binned(reads.select(*keys, "start", "end"), F.col("start"), F.col("end"), width, "_w")
    shared = F.least("end", (F.col("_w") + 1) * width) - F.greatest("start", F.col("_w") * width)
    sums = cut.groupBy(*keys, "_w").agg(F.sum(shared).alias("_sum"))
    windows = grid(regions, width).withColumn("_w", F.floor(F.col("start") / width))
    mean = F.coalesce(F.col("_sum"), F.lit(0)) / (F.col("end") - F.col("start"))
    return windows.join(sums, [*keys, "_w"], "left").select(*keys, "start", "end", mean.alias("mean"))


def class_blocks(reads: DataFrame, regions: DataFrame, least: int = 4, most: int = 0, keys: tuple[str, ...] = ("sample", "chrom"), shard: int = SHARD) -> DataFrame:
    """Runs of one coverage class that tile every region (``keys, from, to``) exactly."""
    inside = regions.select(*keys, F.col("from").alias("start"), F.col("to").alias("end"))
    runs = sweep({"_depth": reads, "_inside": inside}, [*keys], shard).where("_inside > 0")
    return islands(runs.withColumn("class", depth_class(F.col("_depth"), least, most)), [*keys], state="class", shard=shard)


def sufficient_runs(reads: DataFrame | None, samples: int, least: int = 7, share: float = 0.5, shard: int = SHARD, segments: DataFrame | None = None) -> DataFrame:
    """``chrom, _bin, start, end``: runs (cut at shards) of sites where strictly more than ``int(.5 + share * samples)`` samples reach the depth."""
    segments = pileup_segments(reads, shard=shard) if segments is None else segments  # a sample's do not overlap
    deep = segments.where(F.col("depth") >= least)
    return sweep({"_n": deep}, ["chrom"], shard).where(F.col("_n") > int(0.5 + share * samples)).drop("_n")


def sufficient_sites(reads: DataFrame, samples: int, least: int = 7, share: float = 0.5) -> DataFrame:
    """``chrom, pos`` of ``sufficient_runs``; a row a base, for exports and small regions."""
    return sufficient_runs(reads, samples, least, share).select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))


def site_blocks(runs: DataFrame, skip: int = 10, size: int = 15, longest: int = 10_000_000, shard: int = SHARD) -> DataFrame:
    """Islands of sites at most ``skip`` apart and of at least ``size`` sites, restarted after ``longest`` bases.

    ``runs``: ``chrom, start, end`` without overlaps, or single sites ``chrom, pos``.  Only islands that must be cut are looked at site by
    site: a part begins at the first site ``longest`` past the beginning of the part before it, found by a walk along such pointers.
    """
    if "pos" in runs.columns:
        runs = runs.select("chrom", F.col("pos").cast("bigint").alias("start"), (F.col("pos") + 1).cast("bigint").alias("end"))
    large = staged(islands(runs, ["chrom"], skip, covered=True, shard=shard).where(F.col("covered") >= size), "islands")
    fits, over = large.where(F.col("end") - F.col("start") <= longest), large.where(F.col("end") - F.col("start") > longest)
    if over.isEmpty():
        return fits.select("chrom", "start", "end")
    within = overlap_join(runs.select("chrom", "start", "end"), over.select("chrom", "start", "end"), ["chrom"], shard).select("chrom", F.col("start_b").alias("block"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    sites = staged(within, "sites")
    keys = ["chrom", "block"]
    asked = sites.select(*keys, F.col("at").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("of"))
    asked = asked.unionByName(sites.select(*keys, (F.col("at") + longest).alias("place"), F.lit(0).alias("kind"), F.col("at").alias("of")))
    pointers = following(asked, keys, ["place", "kind"], next=F.when(F.col("kind") == 1, F.col("place"))).where("kind = 0").select(*keys, F.col("of").alias("at"), "next")
    begins = walk(pointers, keys).withColumn("begins", F.lit(True))
    marked = sites.join(begins, [*keys, "at"], "left").withColumn("own", F.when(F.col("begins"), F.col("at")))
    owned = following(marked, keys, ["at"], True, before=F.col("own")).withColumn("start", F.coalesce("own", "before"))
    parts = owned.groupBy("chrom", "block", "start").agg((F.max("at") + 1).alias("end"))
    return fits.select("chrom", "start", "end").unionByName(parts.select("chrom", "start", "end"))


def block_means(reads: DataFrame | None, blocks: DataFrame, width: int = SHARD // 8, segments: DataFrame | None = None) -> DataFrame:
    """Mean depth of every sample in every block: depth summed over the block's whole span; ``segments``: of ``pileup_segments``, where known."""
    blocks = blocks.select("chrom", "start", "end")
    met = overlap_join(pileup_segments(reads) if segments is None else segments, blocks, ["chrom"], width, levels=(levels_to(SHARD, width), levels_of(blocks, "start", "end", width)))
    part = (F.least("end", "end_b") - F.greatest("start", "start_b")) * F.col("depth")
    return met.groupBy("chrom", F.col("start_b").alias("start"), F.col("end_b").alias("end"), "sample").agg((F.sum(part) / (F.first("end_b") - F.first("start_b"))).alias("mean"))


def widened(windows: DataFrame, factor: int, value: str = "mean") -> DataFrame:
    """Super-windows of ``factor`` windows per sample and contig: sums of means rounded half up."""
    order = Window.partitionBy("sample", "chrom").orderBy("start")
    group = windows.withColumn("_g", F.floor((F.row_number().over(order) - 1) / factor))
    return group.groupBy("sample", "chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.floor(F.col(value) + 0.5)).cast("bigint").alias("depth")).drop("_g")


def widened_to(windows: DataFrame, size: int, value: str = "mean") -> DataFrame:
    """Super-windows of windows of any widths: from its first window on, one takes windows until it spans ``size`` or the contig ends.

    Windows of a sample and contig do not overlap.  Where one begins depends on all before it: a walk along pointers to the first
    window after the one that fills it.
    """
    keys = ["sample", "chrom"]
    own = staged(windows.select(*keys, "start", "end", value), "windows")
    rows = own.select(*keys, F.col("end").alias("place"), F.lit(1).alias("kind"), F.col("start").alias("at"))
    goals = own.select(*keys, (F.col("start") + size).alias("place"), F.lit(0).alias("kind"), F.col("start").alias("at"))
    # the window that reaches the goal fills the super-window; the next one begins with the window after it
    row = F.when(F.col("kind") == 1, F.struct(F.col("at"), F.col("place")))
    met = staged(following(rows.unionByName(goals), keys, ["place", "kind", "at"], then=row), "met")
    full = met.where("kind = 0").select(*keys, "at", F.col("then.at").alias("fills"))
    after = met.where("kind = 1").select(*keys, F.col("at").alias("fills"), F.col("then.at").alias("next"))
    pointers = full.join(after, [*keys, "fills"], "left").select(*keys, "at", "next")
    begins = walk(pointers, keys).select(*keys, F.col("at").alias("start"), F.col("at").alias("own"))
    owned = following(own.join(begins, [*keys, "start"], "left"), keys, ["start"], True, before=F.col("own")).withColumn("own", F.coalesce("own", "before"))
    return owned.groupBy(*keys, "own").agg(F.max("end").alias("end"), F.sum(F.floor(F.col(value) + 0.5)).cast("bigint").alias("depth")).select(*keys, F.col("own").alias("start"), "end", "depth")


def to_matrix(long: DataFrame, samples: list[str], value: str, keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """One column per sample, 0 where a sample has no row."""
    return long.groupBy(*keys).pivot("sample", samples).agg(F.first(value)).na.fill(0, samples)


def misaligned(long: DataFrame, samples: int, keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Windows that not every sample has: an exact positional join must find none."""
    return long.groupBy(*keys).agg(F.count_distinct("sample").alias("samples")).where(F.col("samples") != samples)


def window_composition(windows: DataFrame, lines: DataFrame, lead: int = 0, width: int = 4_096, levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """``windows`` (``chrom, start, end`` and more) with the shares ``gc, cpg, masked`` of their sequence; null where there is none.

    ``lines``: ``chrom, start, sequence, after`` (pieces of the sequence, and the base that follows each).  A window takes its part of every line
    that it meets; counts are summed.  ``lead`` bases before the window count too, as reads that begin there reach into it.
    ``levels``: as for ``overlap_join``.
    """
    spans = windows.select("chrom", "start", "end").distinct().withColumn("from", F.greatest(F.lit(0), F.col("start") - lead))
    pieces = lines.withColumn("end", F.col("start") + F.length("sequence"))
    met = overlap_join(spans, pieces, ["chrom"], width, a_span=("from", "end"), levels=levels)
    begin, end = F.greatest("from", "start_b"), F.least("end", "end_b")
    part = F.substring(F.col("sequence_b"), begin - F.col("start_b") + 1, end - begin)
    # a pair may begin on the last base of a line and end on the first of the next
    pairs = F.when(F.col("end") > F.col("end_b"), F.concat("_part", "after_b")).otherwise(F.col("_part"))
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    counted = met.withColumn("_part", part).withColumn("_pairs", F.translate(pairs, "cg", "CG")).groupBy("chrom", "start", "end").agg(
        F.sum(F.length("_part")).alias("_n"), F.sum(count(F.col("_part"), "GCgc")).alias("_gc"), F.sum(F.length("_pairs") - F.length(F.replace("_pairs", F.lit("CG"), F.lit("")))).alias("_cpg"), F.sum(count(F.col("_part"), "abcdefghijklmnopqrstuvwxyz")).alias("_low"),
    )
    shares = counted.select("chrom", "start", "end", *((F.col(c) / F.col("_n")).alias(n) for c, n in (("_gc", "gc"), ("_cpg", "cpg"), ("_low", "masked"))))
    return windows.join(shares, ["chrom", "start", "end"], "left")
