"""Regions that hold even amounts of data, from a cohort's tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import TILE_WIDTH
from ..staging import staged
from .intervals import merge, overlap_join
from .sequences import following, running, walk


def cohort_sums(tiles: DataFrame) -> DataFrame:
    """``chrom, tile, size``: exact sums over all samples, in billions; absent tiles count 0."""
    return tiles.groupBy("chrom", "tile").agg((F.sum(F.col("size").cast("decimal(20,0)")).cast("double") / 1e9).alias("size"))


def chopped(sums: DataFrame) -> DataFrame:
    """Outliers above mean + 3 sd of their contig become 8 means."""
    own = Window.partitionBy("chrom")
    mean, sd = F.avg("size").over(own), F.coalesce(F.stddev_samp("size").over(own), F.lit(0.0))
    return sums.select("chrom", "tile", F.when(F.col("size") > mean + 3 * sd, 8 * mean).otherwise(F.col("size")).alias("size"))


def contig_shares(sums: DataFrame) -> DataFrame:
    """``chrom, total, share`` of the whole."""
    totals = sums.groupBy("chrom").agg(F.sum("size").alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(0)))  # over contigs, a row each
    return totals.select("chrom", "total", F.coalesce(F.try_divide("total", whole), F.lit(0.0)).alias("share"))


def even_regions(tiles: DataFrame, contigs: DataFrame, n: int, hard: DataFrame | None = None, width: int = TILE_WIDTH) -> DataFrame:
    """``chrom, start, end, sum, splits``: about ``n`` regions that tile all contigs exactly.

    A tile above its contig's target stands alone in up to eight parts, as does a hard tile of a twentieth of it; other
    tiles gather until the target, a fifth of it at a hard tile, or the contig's end.  Where a region begins depends on all before it: every tile
    points to the first tile of the region after the one that it would begin, and a walk along these pointers finds the regions.
    Amounts are whole numbers (billionths), so sums are exact in any order.
    """
    sums = chopped(cohort_sums(tiles))
    shares = contig_shares(sums).where("total > 0")
    spans = sums.join(contigs.select("chrom", "length"), "chrom").where(F.col("tile") * width < F.col("length"))
    spans = spans.select("chrom", F.col("tile").cast("bigint").alias("tile"), F.round(F.col("size") * 1e9).cast("decimal(38,0)").alias("amount"), F.col("length").cast("bigint").alias("length"), (F.col("tile") * width).alias("start"), ((F.col("tile") + 1) * width).alias("end"))
    if hard is None:
        marked = spans.withColumn("hard", F.lit(False))
    else:
        hit = overlap_join(spans.select("chrom", "tile", "start", "end"), merge(hard, ["chrom"]), ["chrom"], width).select("chrom", "tile").distinct().withColumn("hard", F.lit(True))
        marked = spans.join(hit, ["chrom", "tile"], "left").na.fill(False, ["hard"])
    want = F.greatest(F.lit(1), F.floor(F.col("share") * n)).cast("bigint")
    whole = spans.groupBy("chrom").agg(F.sum("amount").cast("decimal(38,0)").alias("whole"))
    # 20 x want x amount against multiples of the whole: a target is 20 of it, a fifth 4, a twentieth 1
    scaled = (F.col("amount") * F.col("want") * 20).cast("decimal(38,0)")
    ready = marked.join(shares.select("chrom", want.alias("want")), "chrom").join(whole, "chrom").withColumn("a", scaled)
    ready = ready.withColumn("heavy", (F.col("a") > F.col("whole") * 20) | (F.col("hard") & (F.col("a") >= F.col("whole"))))
    upto = staged(running(ready, ["chrom"], ["tile"], F.col("a"), "c").withColumn("c", F.col("c").cast("decimal(38,0)")), "tiles")
    place = lambda share: (F.col("c") - F.col("a") + F.col("whole") * share).cast("decimal(38,0)")
    events = upto.select("chrom", F.col("c").alias("place"), F.lit(2).alias("kind"), "tile", "hard", "heavy")
    for kind, share in ((0, 20), (1, 4)):
        events = events.unionByName(upto.select("chrom", place(share).alias("place"), F.lit(kind).alias("kind"), "tile", F.lit(False).alias("hard"), F.lit(False).alias("heavy")))
    own = F.when(F.col("kind") == 2, F.col("tile"))
    met = following(events, ["chrom"], ["place", "kind", "tile"], any=own, bad=F.when(F.col("hard"), own), big=F.when(F.col("heavy"), own))
    of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name)))
    next_ = met.groupBy("chrom", "tile").agg(of(2, "any").alias("after"), of(2, "big").alias("big"), F.least(of(0, "any"), of(1, "bad")).alias("stop"))
    known = staged(upto.join(next_, ["chrom", "tile"]).withColumn("flush", ~F.col("heavy") & F.col("big").isNotNull() & (F.col("stop").isNull() | (F.col("big") <= F.col("stop")))), "known")
    other = known.select("chrom", F.col("tile").alias("_ref"), F.col("after").alias("_after"), F.when(F.col("heavy"), F.col("c") - F.col("a")).otherwise(F.col("c")).alias("_c"))
    ref = F.when(F.col("heavy"), F.lit(None)).when(F.col("flush"), F.col("big")).otherwise(F.col("stop"))
    node = known.withColumn("_ref", ref).join(other, ["chrom", "_ref"], "left")
    stops = ~F.col("heavy") & ~F.col("flush") & F.col("stop").isNotNull()
    node = node.withColumn("next", F.when(F.col("heavy"), F.col("after")).when(F.col("flush"), F.col("big")).when(stops, F.col("_after")))
    node = node.withColumn("until", F.when(F.col("heavy"), F.col("tile") + 1).when(F.col("flush"), F.col("big")).when(stops, F.col("stop") + 1))
    reach = F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("whole") * F.col("want") * 20)
    node = staged(node.withColumn("held", (reach - F.col("c") + F.col("a")).cast("decimal(38,0)")), "nodes")
    seen = walk(node.select("chrom", F.col("tile").alias("at"), "next"), ["chrom"]).select("chrom", F.col("at").alias("tile"))
    regions = node.join(seen, ["chrom", "tile"])
    begin = regions.where("next IS NOT NULL").select("chrom", F.col("next").alias("tile"), F.col("until").alias("begin"))
    regions = regions.join(begin, ["chrom", "tile"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)).cast("bigint"))

    edge = lambda tile: F.least(F.col("length"), tile * width)
    real = lambda x: x.cast("double") / (F.col("want") * 20) / 1e9
    row = lambda start, end, total, splits: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), total.cast("double").alias("sum"), splits.cast("int").alias("splits"))
    one = F.lit(1)
    parts = F.least(F.lit(8), F.floor(0.5 + F.col("a").cast("double") / (F.col("whole") * 10).cast("double")))
    parts = F.when(parts >= 1, parts).when(F.col("hard"), 3).otherwise(1).cast("bigint")
    step = F.floor(width / F.col("_parts") + 1)
    at = F.col("tile") * width
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1), lambda k: row(F.least(F.col("length"), at + k * step), F.least(F.col("length"), F.least(at + (k + 1) * step, at + width)), real(F.col("a")) / F.col("_parts"), F.col("_parts")))
    alone = F.concat(F.array(row(edge(F.col("begin")), edge(F.col("tile")), F.lit(0.0), one)), cut)
    gathered = F.array(row(edge(F.col("begin")), F.coalesce(edge(F.col("until")), F.col("length")), real(F.col("held")), one))
    rest = F.when(F.col("next").isNull() & F.col("until").isNotNull(), F.array(row(edge(F.col("until")), F.col("length"), F.lit(0.0), one))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,sum:double,splits:int>>"))
    found = regions.withColumn("_parts", parts).select("chrom", F.inline(F.concat(F.when(F.col("heavy"), alone).otherwise(gathered), rest))).where("start < end")
    empty = contigs.join(ready.select("chrom").distinct(), "chrom", "left_anti")
    return found.unionByName(empty.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end"), F.lit(0.0).alias("sum"), F.lit(0).alias("splits")))
