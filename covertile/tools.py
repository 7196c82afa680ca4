"""Whole tools, from files or tables to results: each is a chain of the operators and readers.

Every function takes a session or tables and returns DataFrames; those with ``out`` also write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import EXCLUDE_CONTIGS
from .operators import copynumber, depth, evaluation, matrix, readstats, split, tiles
from .sources import bgzf, binary, sinks, text
from .staging import staged


def coverage_depth(reads: DataFrame, regions: DataFrame, window: int = 250, mapq: int = 1, least: int = 4, most: int = 0, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """``windows`` (mean depth of every window, with composition where ``lines`` of the sequence are given) and ``classes`` (coverage blocks) of ``regions``."""
    used = depth.usable(reads, mapq)
    windows = depth.window_means(used, regions, window)
    return {"windows": windows if lines is None else depth.window_composition(windows, lines), "classes": depth.class_blocks(used, regions, least, most)}


def sample_depths(reads: DataFrame, samples: int, mapq: int = 10, least: int = 7, share: float = 0.5, skip: int = 10, size: int = 15, longest: int = 10_000_000) -> DataFrame:
    """Mean depths of all samples in the blocks where enough of them are covered."""
    used = depth.usable(reads, mapq)
    segments = staged(depth.pileup_segments(used), "segments")
    return depth.block_means(used, depth.site_blocks(depth.sufficient_runs(used, samples, least, share, segments=segments), skip, size, longest), segments=segments)


def window_matrix(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    """A column a sample of the depth files' windows, gathered to super-windows of ``size``; an error where samples have different windows."""
    windows = staged(text.depth_windows(spark, paths).withColumnRenamed("depth", "mean"), "windows")
    names = sorted(r[0] for r in windows.select("sample").distinct().collect())  # columns, so needed before the plan
    wide = depth.widened_to(windows, size)
    if not depth.misaligned(wide, len(names)).isEmpty():
        raise ValueError("not all files have the same windows")
    return depth.to_matrix(wide, names, "depth")


def numbered_tiles(spark: SparkSession, paths: list[str], contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sample, chrom, tile, size`` of BAM and CRAM indexes, whose contigs are numbers, by the contigs' order; and ``sample, chrom, mapped, unmapped``."""
    named = contigs.select("chrom", F.col("ord").cast("bigint").alias("ref_id"))
    crai, bai = [p for p in paths if p.endswith(".crai")], [p for p in paths if p.endswith(".bai")]
    found, stats = None, None
    if bai:
        indexes = staged(binary.bam_indexes(spark, bai), "indexes")
        found = binary.index_tiles(indexes).select("sample", F.col("ref_id").cast("bigint").alias("ref_id"), F.col("tile").cast("bigint").alias("tile"), "size")
        stats = indexes.select("sample", F.col("ref_id").cast("bigint").alias("ref_id"), "mapped", "unmapped").join(named, "ref_id").drop("ref_id")
    if crai:
        more = binary.cram_tiles(text.cram_index(spark, crai)).select("sample", "ref_id", F.col("tile").cast("bigint").alias("tile"), "size")
        found = more if found is None else found.unionByName(more)
    if found is None:
        raise ValueError("no index among the paths")
    return found.join(named, "ref_id").select("sample", "chrom", "tile", "size"), stats


def index_coverage(own: DataFrame, contigs: DataFrame, sexes: tuple[str, ...] = ("X", "Y"), exclude: str | None = EXCLUDE_CONTIGS, stats: DataFrame | None = None, include_gl: bool = False, out: str | None = None) -> dict[str, DataFrame]:
    """From index tiles ``depths``, ``curve`` (shares of tiles at a depth), ``pedigree`` (sex, counters, slope, components) and ``charted`` (contigs fit for charts)."""
    depths = staged(tiles.scaled(own, exclude), "depths")
    curve = tiles.coverage_curve(depths)
    pedigree = tiles.with_components(tiles.pedigree(depths, contigs, sexes, stats, include_gl), tiles.projections(depths, sexes=sexes))
    found = {"depths": depths, "curve": curve, "pedigree": pedigree, "charted": tiles.charted(depths, include_gl)}
    if out is not None:
        names = sorted(r[0] for r in depths.select("sample").distinct().collect())  # columns of the tables
        order = contigs.select("chrom", "ord")
        ordered = lambda df: df.join(order, "chrom")
        bgzf.write_bgzf(sinks.formatted(ordered(tiles.bed_matrix(depths, names))), f"{out}/depths", ["ord", "start"], without=("ord",))
        sinks.write_tsv(ordered(sinks.curve_rows(curve, names)), f"{out}/curves", ["ord", "x"], without=("ord",))
        sinks.write_tsv(pedigree, f"{out}/pedigree", ["sample_id"])
    return found


def even_splits(own: DataFrame, contigs: DataFrame, n: int, hard: DataFrame | None = None) -> DataFrame:
    """Regions of even amounts of data, in the contigs' order."""
    return split.even_regions(own, contigs, n, hard).join(contigs.select("chrom", "ord"), "chrom").select("ord", "chrom", "start", "end", "sum", "splits")


def read_report(reads: DataFrame, mapped: DataFrame, genome: int, n: int = 1_000_000, skip: int = 100_000) -> DataFrame:
    """The report of read statistics: a row a sample with its coverage."""
    return readstats.coverage(readstats.statistics(reads, n, skip), mapped, genome)


def debiased_depths(spark: SparkSession, path: str, fasta: str, window: int = 9, bounds: tuple[float, float] | None = None, lead: int = 250, out: str | None = None) -> DataFrame:
    """A depth matrix file freed of its bias by GC: read, composition of each window and ``lead`` bases before it, moving median along GC,
    samples' levels; written as ``chrom, start, end`` and a column a sample, with two decimals."""
    rows = staged(text.depth_matrix(spark, path), "matrix")
    sites = depth.window_composition(rows.select("chrom", "start", "end").distinct(), text.fasta_lines(spark, fasta), lead).select("chrom", "start", "end", "gc")
    found = matrix.debiased(rows.join(sites.na.fill(0.0, ["gc"]), ["chrom", "start", "end"]), "gc", window, bounds)
    if out is not None:
        found = staged(found, "debiased")
        names = sorted(r[0] for r in found.select("sample").distinct().collect())
        wide = depth.to_matrix(found, names, "depth")
        sinks.write_tsv(wide.select("chrom", "start", "end", *(sinks.fixed(F.col(f"`{n}`")).alias(n) for n in names)), out, ["chrom", "start"])
    return found


def called_runs(rows: DataFrame, gap: int = 30_000) -> DataFrame:
    """Copy-number calls from window depths (``chrom, start, end, sample, depth``): the copy numbers of each window's samples together, then
    runs of windows that depart in one direction.  A window's samples are one array, as the cohort is what its centres come from."""
    own = F.array_sort(F.collect_list(F.struct("sample", F.col("depth").cast("double").alias("depth"))))
    sites = rows.groupBy("chrom", "start", "end").agg(own.alias("own")).withColumn("em", copynumber.em(F.col("own.depth")))
    each = sites.select("chrom", "start", "end", F.inline(F.arrays_zip(F.col("own.sample").alias("sample"), F.col("own.depth").alias("depth"), F.col("em.cn").alias("cn"), F.col("em.change").alias("change"))))
    return copynumber.aberrant_runs(each, gap)


def call_report(calls: DataFrame, truths: DataFrame, least: float = 0.4, width: int = 50) -> dict[str, DataFrame]:
    """Scores of calls: ``rows`` with precision and recall a sample and size class, and the ``cohort`` by size class."""
    scores = staged(evaluation.confusion(calls, truths, least, width), "scores")
    return {"rows": evaluation.rated(scores), "cohort": evaluation.tabulated(scores)}
