"""Mixing sources to target weights by entropy balancing.

A source's target is its weighted share of the mix; targets stop at ``most`` times their source's size, and what that
leaves goes to the other sources by weight.  Among all rates of documents (how often a document is taken, 0 to
``most``) whose words meet the target, the balanced ones have the largest entropy relative to taking every document once:
``rate = min(most, exp(lambda * size))``.  ``lambda`` solves the source's convex dual problem by Newton's method, with a bracket
that bisects where a step leaves it.  A step is one aggregation over all sources: documents of one source and size share
a rate, so the iterations run over counts of sizes, and the table of multipliers stays in Spark.

Rates become copies along the sizes: a size's documents together get as many copies as the running sum of rates, rounded,
grows by, so a source misses its target by half of its largest document at most.  Up to ``REPAIRS`` documents more or less
then close what is left as well as one document can.  Which documents of a size get the extra copy follows the order of their ids'
MD5; ranks come from counts of ranges of that order, so a size that a third of all rows share is many small windows.

Only DataFrame functions; nothing but a few numbers passes the driver.

Defined results: null and empty texts have size 0, rate 1, and take nothing; a null source is a source of its own, the last one;
repeated rows are documents of their own; rows with equal (or null) ids and sizes are dealt copies in any order, which changes no
returned value; an empty table gives no row; a source without words has the target 0; further columns are kept, except those named
like one of the added columns (``size source_size target rate copies taken``), which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequences import ranked
from .common import release, small, staged

#: A word is a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["_null", "_source"]
ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]
STEPS, ROUNDS, REPAIRS = 4, 15, 3
#: Documents of one size and source that one window ranks, on average.
RANKED_ROWS = 500
#: Tables of a row a source, or a row a source and size, are broadcast up to so many rows.
SMALL_ROWS = 200_000


def beside(df: DataFrame, few: bool) -> DataFrame:
    """``df`` marked for broadcast where it was counted and is small."""
    return F.broadcast(df) if few else df


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def with_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``size``, the number of words of each whole text."""
    return df.withColumn("size", word_count(text))


def levels(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``_null, _source, total, docs, mean, least, spread, target`` of every source, from counts ``_null, _source, size, n``."""
    sums = sizes.groupBy(*SOURCE).agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"),
    )
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    names = staged(ranked(sums, SOURCE).withColumn("weight", weight).drop("rank"), "sources")
    row = names.agg(F.sum("total"), F.sum("weight")).first()
    total, held, free, capped = share * (row[0] or 0), 0.0, row[1] or 0.0, -1
    while True:  # a source that the level would fill beyond its bound is held there; the level of the others rises
        full = most * F.col("total") * F.lit(free) <= F.lit(total - held) * F.col("weight")
        row = names.agg(F.count_if(full), F.sum(F.when(full, most * F.col("total"))), F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == capped:
            break
        capped, held, free = row[0], row[1] or 0.0, row[2] or 0.0
    full = most * F.col("total") * F.lit(free) <= F.lit(total - held) * F.col("weight")
    target = F.when(full | F.lit(free == 0.0), most * F.col("total")).otherwise(F.lit(total - held) * F.col("weight") / F.lit(free or 1.0))
    return names.withColumn("target", target)


def tilted(x: Column, multiplier: Column, most: float) -> Column:
    """The rate of a document of size ``x`` (over its source's mean size)."""
    return F.least(F.lit(float(most)), F.exp(multiplier * x))


def newton(sizes: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """One step of all sources: the dual's slope and curvature, summed over the sizes, move each multiplier."""
    x = F.col("size") / F.col("mean")
    rate = tilted(x, F.col("multiplier"), most)
    sums = sizes.where("size > 0").join(state, SOURCE).groupBy(*SOURCE).agg(
        *(F.first(c).alias(c) for c in ("target", "mean", "multiplier", "low", "high")),
        F.sum(F.col("n") * x * rate).alias("_taken"), F.sum(F.when(rate < most, F.col("n") * x * x * rate).otherwise(0.0)).alias("_curve"),
    )
    goal = F.col("target") / F.col("mean")
    slope = F.col("_taken") - goal
    sums = sums.withColumn("low", F.when(slope <= 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(slope > 0, F.col("multiplier")).otherwise(F.col("high")))
    step = F.col("multiplier") - F.try_divide(slope, F.col("_curve"))
    moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
    done = F.abs(slope) <= 1e-13 * goal
    return sums.select(*SOURCE, "target", "mean", F.when(done, F.col("multiplier")).otherwise(moved).alias("multiplier"), "low", "high", done.alias("done"))


def multipliers(sizes: DataFrame, sources: DataFrame, most: float, few: bool) -> DataFrame:
    """``_null, _source, mean, multiplier`` of the sources that have words; ``STEPS`` steps are planned at a time."""
    ratio, mean = F.col("target") / F.col("total"), F.col("total") / F.col("docs")
    start = sources.where("total > 0").withColumn("mean", mean).withColumn("_least", F.col("least") / mean)
    shrinks = ratio < 1
    low = F.when(shrinks, F.ln(ratio) / F.col("_least")).otherwise(0.0)
    high = F.when(shrinks, 0.0).otherwise(F.ln(F.lit(float(most))) / F.col("_least"))
    # by Jensen the tilt at the mean size of a word's document takes at least the target
    first = F.when(shrinks, F.ln(ratio) * F.col("total") * mean / F.col("squares")).otherwise(0.0)
    first = F.when(F.col("target") >= most * F.col("total"), high).otherwise(first)
    state = staged(start.select(*SOURCE, "target", "mean", first.alias("multiplier"), low.alias("low"), high.alias("high")), "multipliers")
    for _ in range(ROUNDS):
        moved = state
        for _ in range(STEPS):
            moved = newton(sizes, beside(moved, few), most)
        before, state = state, staged(moved, "multipliers")
        release(before)
        if state.where("NOT done").isEmpty():
            break
    return state


def cell_copies(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``_null, _source, size, n, source_size, target, rate, c``: a source and size with the copies ``c`` of its ``n`` documents together."""
    few = sources.count() <= SMALL_ROWS
    state = multipliers(sizes, sources, most, few).select(*SOURCE, "mean", "multiplier")
    known = sizes.join(beside(sources.select(*SOURCE, F.col("total").alias("source_size"), "target"), few), SOURCE).join(beside(state, few), SOURCE, "left")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(tilted(F.col("size") / F.col("mean"), F.col("multiplier"), most))
    along = Window.partitionBy(*SOURCE).orderBy(F.col("size").desc())  # sizes of a source, a row each
    upto = known.withColumn("rate", rate).withColumn("_upto", F.floor(F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    grown = F.col("_upto") - F.coalesce(F.lag("_upto").over(along), F.lit(0))
    cells = staged(upto.withColumn("c", F.least(grown, F.col("n") * int(most))).drop("_upto", "mean", "multiplier"), "cells")
    for _ in range(REPAIRS):  # one document more or less, the one that leaves least
        missing = cells.groupBy(*SOURCE).agg((F.first("target") - F.sum(F.col("c") * F.col("size"))).alias("_missing"))
        open_ = cells.where("size > 0").join(beside(missing, few), SOURCE)
        way = F.when((F.col("_missing") > 0) & (F.col("c") < F.col("n") * int(most)), 1).when((F.col("_missing") < 0) & (F.col("c") > 0), -1)
        left = F.abs(F.col("_missing") - F.col("_way") * F.col("size"))
        best = open_.withColumn("_way", way).where("_way IS NOT NULL").withColumn("_left", left).where(F.col("_left") < F.abs("_missing"))
        best = best.groupBy(*SOURCE).agg(F.min(F.struct("_left", "size", "_way")).alias("_best")).select(*SOURCE, F.col("_best.size").alias("size"), F.col("_best._way").alias("_way"))
        before, cells = cells, staged(cells.join(beside(best, few), [*SOURCE, "size"], "left").withColumn("c", F.col("c") + F.coalesce("_way", F.lit(0))).drop("_way"), "cells")
        release(before)
    return cells


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``df`` (which has ``size``) with ``source_size, target, rate, copies, taken`` of every row.

    Sources in order of code points, null last, have the ``weights`` in turn; the mix holds ``share`` times all words, and no
    document more than ``most`` times.
    """
    kept = [c for c in df.columns if c not in ADDED]
    named = df.select(F.struct(*kept).alias("_row"), F.col("size").cast("bigint").alias("size"), F.col(key).cast("string").alias("_key"), F.col(source).isNull().alias("_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"))
    sizes = staged(named.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), "sizes")
    cells = cell_copies(sizes, levels(sizes, weights, share, most), most)
    rows = named.join(small(cells, SMALL_ROWS), [*SOURCE, "size"]).withColumn("_md5", F.md5(F.coalesce("_key", F.lit(""))))
    # ranges of the order of MD5, as many as the size needs
    part = F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("bigint") * F.ceil(F.col("n") / RANKED_ROWS) / F.lit(1 << 32))
    rows = rows.withColumn("_part", part)
    cell = [*SOURCE, "size"]
    ahead = Window.partitionBy(*cell).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where(F.col("n") > RANKED_ROWS).groupBy(*cell, "_part").agg(F.count("*").alias("_rows")).withColumn("_ahead", F.sum("_rows").over(ahead)).drop("_rows")
    rank = F.row_number().over(Window.partitionBy(*cell, "_part").orderBy("_md5", "_key")) + F.coalesce("_ahead", F.lit(0))
    extra = F.when(F.col("_rank") <= F.col("c") % F.col("n"), 1).otherwise(0)
    dealt = rows.join(parts, [*cell, "_part"], "left").withColumn("_rank", rank).withColumn("copies", F.floor(F.col("c") / F.col("n")) + extra)
    return dealt.select("_row.*", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its copies say, with ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
