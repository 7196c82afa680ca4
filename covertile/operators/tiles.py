"""Coverage from index tiles: scaling, normalisation, histograms, counters, sex, slopes, pedigree rows, chart data.

Tiles are ``sample, chrom, tile, size``; contigs are ``chrom, length, ord``.  All contigs are ordered by
``ord``, never by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import SLOT_SHARE, SLOTS, TILE_WIDTH, quantised_depth, scaled_depth, slot_of
from ..functions.text import bare_contig, excluded, is_sex_contig
from ..staging import staged
from . import cohort
from .ranks import capped_weighted_median


#: Charts and slopes are of contigs of more tiles than this.
CHARTED_TILES = 2


def sizes_from_offsets(offsets: DataFrame) -> DataFrame:
    """Tile sizes as differences of successive virtual offsets (``sample, chrom, tile, voffset``); n offsets make n - 1 tiles."""
    order = Window.partitionBy("sample", "chrom").orderBy("tile")
    return offsets.withColumn("size", F.lead("voffset").over(order) - F.col("voffset")).where("size IS NOT NULL").select("sample", "chrom", "tile", "size")


def medians(tiles: DataFrame) -> DataFrame:
    """``sample, median``: the capped weighted median of each sample's positive tiles."""
    return capped_weighted_median(tiles.where("size > 0"), ["sample"], "size")


def scaled(tiles: DataFrame, exclude: str | None = None) -> DataFrame:
    """``sample, chrom, tile, depth``; there is one median per sample, which adaptive execution may broadcast."""
    kept = tiles if exclude is None else tiles.where(~excluded(F.col("chrom"), exclude))
    return kept.join(medians(tiles), "sample").select("sample", "chrom", "tile", scaled_depth(F.col("size"), F.col("median")).alias("depth"))


def bed_matrix(depths: DataFrame, samples: list[str]) -> DataFrame:
    """``chrom, start, end`` and a column per sample, 0 past a sample's last tile."""
    wide = depths.groupBy("chrom", "tile").pivot("sample", samples).agg(F.first("depth")).na.fill(0.0, samples)
    return wide.select("chrom", (F.col("tile") * TILE_WIDTH).alias("start"), ((F.col("tile") + 1) * TILE_WIDTH).alias("end"), *samples)


def slot_counts(depths: DataFrame) -> DataFrame:
    """``sample, chrom, slot, n`` with all slots."""
    counts = depths.groupBy("sample", "chrom", slot_of(F.col("depth")).alias("slot")).agg(F.count("*").alias("n"))
    slots = counts.select("sample", "chrom").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return slots.join(counts, ["sample", "chrom", "slot"], "left").na.fill(0, ["n"])


def coverage_curve(depths: DataFrame) -> DataFrame:
    """``sample, chrom, slot, x, share``: the share of tiles with at least the slot's depth."""
    at = Window.partitionBy("sample", "chrom").orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("sample", "chrom")
    return slot_counts(depths).select("sample", "chrom", "slot", (F.col("slot") / (SLOTS * SLOT_SHARE)).alias("x"), (F.sum("n").over(at) / F.sum("n").over(whole)).alias("share"))


def _cells(depths: DataFrame, sexes: tuple[str, ...], low: float = 0.15, near: tuple[float, float] = (0.85, 1.15)) -> DataFrame:
    """``sample, chrom, ordinary, last`` and counts of tiles: the one aggregate that counters and slopes are made of.

    ``n_fall`` counts the tiles whose slot lies between those of 0.85 and 1.15, which is what a coverage curve loses there.
    """
    lo, hi = (int(x * SLOTS * SLOT_SHARE + 0.5) for x in (0.85, 1.15))
    depth, slot = F.coalesce("depth", F.lit(0.0)), slot_of(F.col("depth"))
    outside = (depth < near[0]) | (depth > near[1])
    counts = depths.groupBy("sample", "chrom").agg(
        F.max("tile").alias("last"), F.count("*").alias("n"), F.count_if(outside).alias("n_out"), F.count_if(depth < low).alias("n_low"),
        F.count_if(depth > near[1]).alias("n_hi"), F.count_if(~outside).alias("n_in"), F.count_if((slot >= lo) & (slot < hi)).alias("n_fall"),
    )
    return counts.withColumn("ordinary", ~is_sex_contig(F.col("chrom"), sexes))


def _counters(cells: DataFrame, low: float = 0.15, near: tuple[float, float] = (0.85, 1.15)) -> list:
    """Aggregates of ``_cells`` per sample; tiles that a sample lacks have depth 0, and there are the cohort's tiles less its own."""
    own = lambda c: F.sum(F.when(F.col("ordinary"), F.col(c)))
    cohort = cells.where("ordinary").groupBy("chrom").agg((F.max("last") + 1).alias("tiles")).agg(F.sum("tiles")).scalar()
    missing = cohort - own("n")
    blank_out, blank_low = near[0] > 0 or near[1] < 0, low > 0
    add = lambda c, blank: own(c) + missing if blank else own(c)
    return [
        add("n_out", blank_out).alias("n_out"), add("n_low", blank_low).alias("n_low"), add("n_hi", near[1] < 0).alias("n_hi"), add("n_in", not blank_out).alias("n_in"),
    ]


def _slope(cells: DataFrame, contigs: DataFrame, least_tiles: int, include_gl: bool = False) -> tuple[DataFrame, object]:
    """The cells with what decides on their contig, and the aggregate of them that is a sample's slope."""
    longest = F.max("last").over(Window.partitionBy("chrom"))
    judged = cells.withColumn("longest", longest).join(contigs.select("chrom", "length"), "chrom", "left")
    used = F.col("ordinary") & (F.col("longest") + 1 > max(least_tiles, CHARTED_TILES)) & (F.lit(include_gl) | ~F.col("chrom").startswith("GL")) & F.col("length").isNotNull()
    fall = F.col("n_fall") / F.col("n") * F.col("length") / 1e6
    return judged, F.try_divide(F.sum(F.when(used, fall)), F.count_if(used)).alias("slope")


def bin_counters(depths: DataFrame, sexes: tuple[str, ...] = ("X", "Y"), low: float = 0.15, near: tuple[float, float] = (0.85, 1.15)) -> DataFrame:
    """``sample, n_out, n_low, n_hi, n_in`` over the tiles of ordinary contigs; missing tails are low and out."""
    cells = _cells(depths.where(~is_sex_contig(F.col("chrom"), sexes)), sexes, low, near)
    return cells.groupBy("sample").agg(*_counters(cells, low, near))


def sex_copies(depths: DataFrame, sexes: tuple[str, ...] = ("X", "Y")) -> DataFrame:
    """``sample, chrom, cn``: twice the depth at rank ``int(.4 n)`` of the positive tiles; null without any.

    Where more than 0.3 of a contig's tiles are positive but under 0.02, those are left out.  Equal depths are
    counted first; all that follows stays in the groups of that count.
    """
    key = ["sample", "chrom"]
    groups = Window.partitionBy(*key)
    counts = depths.where(is_sex_contig(F.col("chrom"), sexes)).groupBy(*key, "depth").agg(F.count("*").alias("c"))
    faint = (F.col("depth") > 0) & (F.col("depth") < 0.02)
    drop = F.sum(F.when(faint, F.col("c")).otherwise(0)).over(groups) / F.sum("c").over(groups) > 0.3
    taken = counts.withColumn("drop", drop).withColumn("c", F.when((F.col("depth") > 0) & ~(F.col("drop") & faint), F.col("c")).otherwise(0))
    ranked = taken.withColumn("upto", F.sum("c").over(groups.orderBy("depth"))).withColumn("at", F.floor(F.sum("c").over(groups) * 0.4))
    found = (F.col("c") > 0) & (F.col("upto") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("upto"))
    return ranked.groupBy(*key).agg((2 * F.max(F.when(found, F.col("depth")))).alias("cn"))


def slopes(depths: DataFrame, contigs: DataFrame, sexes: tuple[str, ...] = ("X", "Y"), least_tiles: int = 100) -> DataFrame:
    """``sample, slope``: how steeply the coverage curve falls around one, weighed by contig length."""
    judged, slope = _slope(_cells(depths.where(~is_sex_contig(F.col("chrom"), sexes)), sexes), contigs, least_tiles)
    return judged.groupBy("sample").agg(slope).where("slope IS NOT NULL")


def cohort_levels(depths: DataFrame, sizes: DataFrame) -> DataFrame:
    """``chrom, tile, level``: what the cohort's depths around each tile are divided by; null where they stay.

    A tile's level takes the depths of the tile before it as they have become, so the scan is sequential.  But what happens to a depth depends on its
    sample's last tile alone, and linearly so: the scan runs on sums over samples of one last tile (a class), not on samples.  A contig's
    classes and tiles (some ten thousand, a few classes) are one group.
    """
    sums = depths.join(sizes, ["sample", "chrom"]).groupBy("chrom", "size", "tile").agg(F.sum("depth").alias("d"))
    classes = sizes.groupBy("chrom", "size").agg(F.count("*").alias("n"))
    rows = sums.join(classes, ["chrom", "size"])

    def work(table: pa.Table) -> pa.Table:
        size, tile, d, n = (table.column(c).to_numpy() for c in ("size", "tile", "d", "n"))
        ends, which = np.unique(size, return_inverse=True)
        count = np.zeros(len(ends))
        count[which] = n
        total, length = count.sum(), int(ends.max())
        level = np.full(length, np.nan)
        sums = np.zeros((len(ends), length + 4))
        sums[which, tile] = d
        for j in range(length if total >= 5 else 0):
            live, right = ends > j, ends > j + 1
            members = count[live].sum() * (2 if j else 1) + count[right].sum()
            mean = (sums[live, j].sum() + (sums[live, j - 1].sum() if j else 0.0) + sums[right, j + 1].sum()) / members if members else 0.0
            if members < 3 * total - 4 or mean < 0.1:
                continue
            level[j] = mean
            sums[live, j] /= mean
            if j > 2:
                inner = ends - 3 > j
                sums[inner, j] = (sums[inner, j - 3 : j + 1].sum(1) + sums[inner, j + 1 : j + 4].sum(1) / mean) / 7
        known = np.flatnonzero(~np.isnan(level))
        return pa.table({"chrom": pa.array([table.column("chrom")[0].as_py()] * len(known), pa.string()), "tile": known, "level": level[known]})

    return rows.groupBy("chrom").applyInArrow(work, "chrom string, tile long, level double")


def normalised(depths: DataFrame, block: int = 64) -> DataFrame:
    """Depths over the cohort's depth around each tile, smoothed over seven tiles; needs five samples.

    Missing tiles before a sample's last one count as 0.  Given the levels, samples do not depend on each other: blocks of samples are tasks.
    """
    own = staged(depths.select("sample", "chrom", F.col("tile").cast("bigint").alias("tile"), F.col("depth").cast("double").alias("depth")), "depths")
    sizes = own.groupBy("sample", "chrom").agg((F.max("tile") + 1).alias("size"))
    levels = staged(cohort_levels(own, sizes), "levels").groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("tile", "level"))).alias("levels"))  # a row a tile of the contig
    blocks = F.pmod(F.xxhash64("sample"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("chrom")) / block)))
    dealt = own.join(sizes.withColumn("block", blocks), ["sample", "chrom"]).select("chrom", "block", "sample", "size", "tile", "depth")

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, which = np.unique(left.column("sample").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[which] = left.column("size").to_numpy()
        d = np.zeros((len(names), int(size.max(initial=0)) + 4))
        d[which, left.column("tile").to_numpy()] = left.column("depth").to_numpy()
        for x in right.column("levels")[0].as_py() if right.num_rows else []:
            j, mean = x["tile"], x["level"]
            live = size > j
            d[live, j] /= mean
            if j > 2:
                inner = size - 3 > j
                d[inner, j] = (d[inner, j - 3 : j + 1].sum(1) + d[inner, j + 1 : j + 4].sum(1) / mean) / 7
        s, t = np.nonzero(np.arange(d.shape[1]) < size[:, None])
        return pa.table({"sample": pa.array(names[s], pa.string()), "chrom": pa.array([key[0].as_py()] * len(s), pa.string()), "tile": t.astype(np.int64), "depth": d[s, t]})

    keyed = dealt.select("chrom", "block").distinct().join(levels, "chrom").select(F.col("chrom").alias("_chrom"), F.col("block").alias("_block"), "levels")
    return dealt.groupBy("chrom", "block").cogroup(keyed.groupBy("_chrom", "_block")).applyInArrow(work, "sample string, chrom string, tile long, depth double")


def projections(depths: DataFrame, components: int = 5, sexes: tuple[str, ...] = ("X", "Y")) -> DataFrame:
    """``sample, component, projection, share``: each sample's projections on the principal components, and the components' shares of the variance.

    Samples are rows and tiles columns; the eigenvectors of the centred product matrix give the
    components, the uncentred rows are projected on them, and each component's sign makes its largest
    projection positive.  Under three components there are none.
    """
    own = depths.where(~is_sex_contig(F.col("chrom"), sexes)).withColumn("q", quantised_depth(F.col("depth")))
    samples = cohort.numbered(own)
    k = samples.count()
    if k < 3:
        return own.sparkSession.createDataFrame([], "sample string, component int, projection double, share double")
    tiles = cohort.product_tiles(own, samples, ["chrom", "tile"], "q")
    vectors, values, trace, width = cohort.leading(tiles, k, components, centre=True)
    kept = int((values > values[0] * 1e-12).sum()) if values[0] > 0 else 0
    # the component of eigenvector u is (centred rows)' u / sqrt(value); rows times it is G C u / sqrt(value), and u is centred
    rows = cohort.by_sample(cohort.multiplied(tiles, vectors, width), samples, width)
    facts = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(np.sqrt(v) or 1.0)).alias("root"), F.lit(float(v / trace) if trace > 0 else 0.0).alias("share")) for c, v in enumerate(values[:kept])))
    if kept < 3:
        return own.sparkSession.createDataFrame([], "sample string, component int, projection double, share double")
    long = rows.select("sample", "v", F.explode(facts).alias("f")).select("sample", (F.col("f.c") + 1).alias("component"), (F.col("v")[F.col("f.c")] / F.col("f.root")).alias("projection"), "f.share")
    long = staged(long, "projections")
    largest = long.groupBy("component").agg(F.signum(F.max_by("projection", F.struct(F.abs("projection"), "sample"))).alias("_sign"))
    return long.join(largest, "component").select("sample", "component", (F.col("projection") * F.col("_sign")).alias("projection"), "share")


def with_components(pedigree: DataFrame, projected: DataFrame, components: int = 5) -> DataFrame:
    """The pedigree table with ``PC1`` and so on; null where there are none."""
    wide = projected.groupBy("sample").pivot("component", list(range(1, components + 1))).agg(F.first("projection"))
    named = wide.select(F.col("sample").alias("sample_id"), *(F.col(str(c)).alias(f"PC{c}") for c in range(1, components + 1)))
    return pedigree.join(named, "sample_id", "left").select(*pedigree.columns, *(f"PC{c}" for c in range(1, components + 1)))


def charted(depths: DataFrame, include_gl: bool = False) -> DataFrame:
    """``chrom``: contigs of more than two tiles, unplaced ones (``GL...``) only if asked for; slopes and charts are of these."""
    long = depths.groupBy("chrom").agg(F.max("tile").alias("last")).where(F.col("last") + 1 > CHARTED_TILES)
    return long.where(F.lit(include_gl) | ~F.col("chrom").startswith("GL")).select("chrom")


def pedigree(depths: DataFrame, contigs: DataFrame, sexes: tuple[str, ...] = ("X", "Y"), stats: DataFrame | None = None, include_gl: bool = False) -> DataFrame:
    """One row per sample: inferred sex, copies of the sex contigs, counters, slope, share outside, mapped reads."""
    depths = staged(depths, "depths")  # sex copies, counters and slopes each read them
    # the sex contigs found become columns, so their few names are needed before the plan is made
    copies = sorted(r["chrom"] for r in depths.where(is_sex_contig(F.col("chrom"), sexes)).select("chrom").distinct().collect())
    wide = sex_copies(depths, sexes).groupBy("sample").pivot("chrom", copies).agg(F.first("cn"))
    cells = _cells(depths, sexes)
    judged, slope = _slope(cells, contigs, 100, include_gl)
    out = judged.groupBy("sample").agg(*_counters(cells), slope).join(wide, "sample", "left")
    sex = F.coalesce(F.floor(F.col(copies[0]) + 0.5).cast("int"), F.lit(-9)) if copies else F.lit(-9)
    columns = [
        F.lit("unknown").alias("family_id"), F.col("sample").alias("sample_id"), F.lit("-9").alias("paternal_id"), F.lit("-9").alias("maternal_id"), sex.alias("sex"), F.lit("-9").alias("phenotype"),
        *[F.coalesce(c, F.lit(-0.1)).alias(f"cn_{c}") for c in copies],
        F.col("n_out").alias("bins_out"), F.col("n_low").alias("bins_lo"), F.col("n_hi").alias("bins_hi"), F.col("n_in").alias("bins_in"), "slope",
        F.try_divide(F.col("n_out"), F.col("n_in")).alias("p_out"),
    ]
    if stats is not None:
        totals = stats.groupBy("sample").agg(F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))
        return out.join(totals, "sample", "left").select(*columns, "mapped", "unmapped")
    return out.select(*columns)


def found_sexes(contigs: DataFrame, sexes: tuple[str, ...] = ("X", "Y")) -> list[str]:
    """Warnings about expected sex contigs that are missing; an error if a list of one's own matches none."""
    names = {r["b"] for r in contigs.where(is_sex_contig(F.col("chrom"), sexes)).select(bare_contig(F.col("chrom")).alias("b")).collect()}
    wanted = {s.removeprefix("chr") for s in sexes}
    if not names and wanted != {"X", "Y"}:
        raise ValueError(f"no contig among {sorted(wanted)}")
    return [f"contig {s} not found" for s in sorted(wanted - names)]


# ---- chart data -----------------------------------------------------------------------------
def depth_line(depths: DataFrame, top: float = 2.5, thin: bool = False) -> DataFrame:
    """Depth lines: from the first positive tile, clipped; thinned by 5 over 1000 points and by 10 over 2000."""
    whole = Window.partitionBy("sample", "chrom")
    first = F.min(F.when(F.col("depth") > 0, F.col("tile"))).over(whole)
    out = depths.withColumn("_first", first).where("tile >= _first")
    if thin:
        n, at = F.count("*").over(whole), F.row_number().over(whole.orderBy("tile")) - 1
        out = out.withColumn("_step", F.when(n > 2000, 10).when(n > 1000, 5).otherwise(1)).withColumn("_at", at).where("_at % _step = 0")
    return out.select("sample", "chrom", (F.col("tile") * TILE_WIDTH).alias("x"), F.least("depth", F.lit(top)).alias("y"))


def bins_scatter(counters: DataFrame) -> DataFrame:
    total = F.greatest(F.col("n_in") + F.col("n_out"), F.lit(1))
    return counters.select("sample", (F.col("n_low") / total).alias("x"), (F.col("n_out") / total).alias("y"))


def mapped_scatter(stats: DataFrame) -> DataFrame:
    sums = stats.groupBy("sample").agg(F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))
    return sums.select("sample", F.log1p("mapped").alias("x"), F.log1p("unmapped").alias("y"))


def sex_scatter(copies: DataFrame, first: str, second: str) -> DataFrame:
    wide = copies.groupBy("sample").pivot("chrom", [first, second]).agg(F.first("cn"))
    return wide.select("sample", F.col(first).alias("x"), F.col(second).alias("y"), F.floor(F.col(first) + 0.5).cast("int").alias("group"))


def background(depths: DataFrame, n: int) -> DataFrame:
    """Marks the samples after the first ``n`` (by name) as background."""
    names = depths.select("sample").distinct().withColumn("background", F.row_number().over(Window.orderBy("sample")) > n)
    return depths.join(names, "sample")
