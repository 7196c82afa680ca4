"""Statistics of sampled reads: lengths, inserts, templates, proportions, coverage; read groups.

``reads``: sample, ord (position in the file, from 0), flag, pos, mate_pos, end, tlen, read_len, n_cigar,
cigar_first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .ranks import counted, pick

#: Bits of a read's flag.
PROPER, UNMAPPED, FAILED, DUPLICATE = 2, 4, 512, 1024
KEY = ["sample"]
#: Reads of a block, in file order.
BLOCK = 1_000_000


def sampled(reads: DataFrame, n: int, skip: int = 100_000) -> DataFrame:
    """The reads that a sample's statistics are made of, in file order.

    After ``skip`` reads, all up to the one that gives the ``n``-th insert; a sample without any insert stops
    after ``2 n`` lengths.  Adds what each read counts as.
    """
    has = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    bad = has(DUPLICATE) | has(FAILED)
    insert = ~has(UNMAPPED) & ~bad & has(PROPER) & (F.col("pos") < F.col("mate_pos")) & (F.col("n_cigar") == 1) & (F.col("cigar_first") == "M")
    rows = reads.where(F.col("ord") >= skip).withColumn("unmapped", has(UNMAPPED)).withColumn("bad", ~has(UNMAPPED) & bad).withColumn("duplicate", ~has(UNMAPPED) & has(DUPLICATE))
    rows = rows.withColumn("proper", ~has(UNMAPPED) & ~bad & has(PROPER)).withColumn("good", ~has(UNMAPPED) & ~bad).withColumn("insert", insert)
    rows = rows.withColumn("_part", F.expr(f"ord div {BLOCK}"))
    # counts of blocks before each block, then a window inside the blocks in which a rule can stop; other blocks count as a whole
    blocks = rows.groupBy(*KEY, "_part").agg(F.count_if("insert").alias("_i"), F.count_if("good").alias("_g"))
    along = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # blocks, a row each
    sums = blocks.select(*KEY, "_part", "_i", "_g", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}0") for c in ("_i", "_g")))
    # a block after which the inserts, or without any insert the lengths, are complete has nothing to give
    sums = sums.where((F.col("_i0") < n) & ((F.col("_g0") <= 2 * n) | (F.col("_i0") > 0)))
    stops = (F.col("_i0") + F.col("_i") >= n) | ((F.col("_g0") < 2 * n) & (F.col("_g0") + F.col("_g") >= 2 * n)) | ((F.col("_i0") == 0) & (F.col("_g0") + F.col("_g") > 2 * n))
    sums = sums.select(*KEY, "_part", "_i0", "_g0", stops.alias("_stops"))
    met = rows.join(sums, [*KEY, "_part"])
    whole = met.where("NOT _stops").withColumn("sized", F.col("good") & (F.col("_g0") < 2 * n))
    before = Window.partitionBy(*KEY, "_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c, first: F.coalesce(F.sum(F.col(c).cast("bigint")).over(before), F.lit(0)) + F.col(first)
    last = met.where("_stops").withColumn("_inserts", seen("insert", "_i0")).withColumn("_good", seen("good", "_g0"))
    # the read at which a single-end sample stops still counts
    last = last.where((F.col("_inserts") < n) & ((F.col("_good") <= 2 * n) | (F.col("_inserts") > 0))).withColumn("sized", F.col("good") & (F.col("_good") < 2 * n))
    return whole.drop("_part", "_i0", "_g0", "_stops").unionByName(last.drop("_part", "_i0", "_g0", "_stops", "_inserts", "_good"))


def upper_bound(values: DataFrame, value: str, deviations: int = 10) -> DataFrame:
    """``sample, upper``: median plus so many median upper deviations; null under three values."""
    ranks = counted(values, KEY, value)
    median = pick(values, KEY, value, median=lambda n: F.floor(n / 2))
    # upper deviations are the ranks above the median's, so their median is a rank of the same values
    spread = ranks.join(median, KEY)
    at = F.floor(F.col("_n") / 2) + 1 + F.floor((F.col("_n") - F.floor(F.col("_n") / 2) - 1) / 2)
    found = spread.groupBy(*KEY).agg(F.first("median").alias("median"), F.first("_n").alias("n"), F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col(value))).alias("high"))
    return found.select(*KEY, F.when(F.col("n") >= 3, F.col("median") + deviations * (F.col("high") - F.col("median"))).alias("upper"))


def trimmed(values: DataFrame, value: str, deviations: int = 10) -> DataFrame:
    """Values up to the upper bound."""
    return values.join(upper_bound(values, value, deviations), KEY).where(F.col("upper").isNull() | (F.col(value) <= F.col("upper"))).drop("upper")


def statistics(reads: DataFrame, n: int, skip: int = 100_000) -> DataFrame:
    """One row per sample; the reads that count are written once and read by each part."""
    rows = staged(sampled(reads, n, skip).select(*KEY, "bad", "duplicate", "proper", "unmapped", "sized", "insert", "read_len", "tlen", (F.col("mate_pos") - F.col("end")).alias("gap")), "sampled")
    every = F.count("*")
    shares = rows.groupBy(*KEY).agg(
        (F.count_if("bad") / every).alias("bad"), (F.count_if("duplicate") / every).alias("duplicate"), (F.count_if("proper") / every).alias("proper"), (F.count_if("unmapped") / every).alias("unmapped"),
        F.avg(F.when(F.col("sized"), F.col("read_len"))).alias("read_mean"), F.max(F.when(F.col("sized"), F.col("read_len"))).alias("read_max"),
    )
    lengths = pick(rows.where("sized"), KEY, "read_len", read_median=lambda k: F.floor((k - 1) / 2))
    inserts = rows.where("insert").select(*KEY, F.col("gap").alias("v"))
    templates = rows.where("insert").select(*KEY, F.col("tlen").alias("v"))
    ends = pick(inserts, KEY, "v", insert_5=lambda k: F.floor((k - 1) * 0.05 + 0.5), insert_95=lambda k: F.floor((k - 1) * 0.95 + 0.5))
    moments = lambda df, name: trimmed(df, "v").groupBy(*KEY).agg(F.avg("v").alias(f"{name}_mean"), F.stddev_pop("v").alias(f"{name}_sd"))
    out = shares
    for part in (lengths, ends, moments(inserts, "insert"), moments(templates, "template")):
        out = out.join(part, KEY, "left")
    return out


def template_histogram(reads: DataFrame, n: int, skip: int = 100_000) -> DataFrame:
    """``sample, length, share`` of template lengths between the longest read and mean + 4 sd."""
    rows = staged(sampled(reads, n, skip).select(*KEY, "sized", "insert", "read_len", "tlen"), "sampled")
    templates = trimmed(rows.where("insert").select(*KEY, F.col("tlen").alias("v")), "v")
    moments = templates.groupBy(*KEY).agg((F.avg("v") + 4 * F.stddev_pop("v")).alias("stop"))
    starts = rows.where("sized").groupBy(*KEY).agg(F.max("read_len").alias("start"))
    inside = templates.join(moments, KEY).join(starts, KEY).where("v >= start AND v <= stop")
    counts = inside.groupBy(*KEY, F.col("v").alias("length")).agg(F.count("*").alias("c"))
    return counts.select(*KEY, "length", (F.col("c") / F.sum("c").over(Window.partitionBy(*KEY))).alias("share"))


def coverage(stats: DataFrame, mapped: DataFrame, genome: int) -> DataFrame:
    """Adds ``coverage``: (1 - bad) x mapped reads x mean read length over the genome; null without index statistics."""
    return stats.join(mapped, KEY, "left").withColumn("coverage", (1 - F.col("bad")) * F.col("mapped") * F.col("read_mean") / genome)


def unknown_contigs(seen: DataFrame, regions: DataFrame, least: int = 10_000) -> DataFrame:
    """Contigs without regions that are long and not random: worth a warning."""
    return seen.join(regions.select("chrom").distinct(), "chrom", "left_anti").where(~F.col("chrom").contains("random") & (F.col("length") > least))


def sample_names(groups: DataFrame, key: str = "file") -> DataFrame:
    """``file, samples, n``: the distinct sample names of read groups, sorted."""
    named = F.array_sort(F.collect_set("sm"))
    return groups.groupBy(key).agg(named.alias("samples"), F.size(named).cast("bigint").alias("n"))


def only_sample_name(groups: DataFrame, key: str = "file") -> DataFrame:
    """``file, sample``; a file with another number of sample names than one fails the query."""
    names = sample_names(groups, key)
    wrong = F.raise_error(F.concat(F.lit("expected one sample name in "), F.col(key), F.lit(", found "), F.col("n").cast("string")))
    return names.select(key, F.when(F.col("n") == 1, F.col("samples")[0]).otherwise(wrong.cast("string")).alias("sample"))
