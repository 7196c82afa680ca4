"""Scores of copy-number calls against a truth set.

``calls``: chrom, start, end, sample, cn.  ``truths``: chrom, start, end, samples (array), cn.  A call
matches a truth of its sample where they share ``least`` of the shorter length and the copy numbers
agree, those above two being one state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import SIZE_CLASSES, clamped_copies, overlap_share, size_class
from ..staging import staged
from .intervals import overlap_join


def by_sample(truths: DataFrame) -> DataFrame:
    """A row per truth and sample that carries it."""
    return truths.select("chrom", "start", "end", "cn", F.explode(F.array_distinct("samples")).alias("sample"))


def without_sample(truths: DataFrame, samples: DataFrame) -> DataFrame:
    """A row per truth and sample that does not carry it.

    The cohort's sample names travel as one array, so each truth expands in place.
    """
    names = samples.select("sample").distinct().agg(F.collect_set("sample").alias("s")).first()["s"]
    others = F.array_except(F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>"), F.col("samples"))
    return truths.select("chrom", "start", "end", "cn", F.explode(others).alias("sample"))


def all_samples(calls: DataFrame, truths: DataFrame) -> DataFrame:
    return calls.select("sample").union(by_sample(truths).select("sample")).distinct()


def restricted(truths: DataFrame, samples: DataFrame) -> DataFrame:
    """Truths of the given samples; those that no sample is left of go."""
    own = by_sample(truths).join(samples.select("sample").distinct(), "sample", "left_semi")
    return own.groupBy("chrom", "start", "end", "cn").agg(F.array_sort(F.collect_set("sample")).alias("samples"))


def matches(calls: DataFrame, truths: DataFrame, least: float = 0.4, width: int = 50) -> DataFrame:
    """Pairs of a call and a truth of one sample that match; both keep their columns, the truth's end in ``_b``."""
    met = overlap_join(calls, truths, ["sample", "chrom"], width)
    return met.where((overlap_share(F.col("start"), F.col("end"), F.col("start_b"), F.col("end_b")) >= least) & (clamped_copies(F.col("cn")) == clamped_copies(F.col("cn_b"))))


def confusion(calls: DataFrame, truths: DataFrame, least: float = 0.4, width: int = 50, task_rows: int = 1_000_000) -> DataFrame:
    """``sample, size_class, tp, fn, fp, tn``.

    A truth with a matching call is found (counted once), one without is missed.  A call that matches no
    truth of its sample is false.  A truth that no row gives to the sample and that no call of the
    sample matches is a true negative.  Truths meet the calls of all samples in one join; missed and
    negative truths are counts less the pairs found, so truths are never multiplied by samples.  The pairs
    are counted by call and by truth in tasks of some ``task_rows``, however many there are.
    """
    site = ["chrom", "start", "end", "cn"]
    sized = size_class(F.col("end") - F.col("start")).alias("size_class")
    number = F.monotonically_increasing_id()  # lasts, as the tables are written
    calls = staged(calls.select("sample", *site).distinct().select("*", number.alias("_call"), sized, clamped_copies(F.col("cn")).alias("_state")), "calls")
    truths = truths.groupBy(*site).agg(F.array_distinct(F.flatten(F.collect_list("samples"))).alias("samples"))
    truths = staged(truths.select("*", number.alias("_truth"), sized, clamped_copies(F.col("cn")).alias("_state")), "truths")
    met = overlap_join(calls.drop("cn"), truths.drop("cn"), ["chrom", "_state"], width)
    met = met.where(overlap_share(F.col("start"), F.col("end"), F.col("start_b"), F.col("end_b")) >= least).withColumn("own", F.array_contains("samples_b", F.col("sample")))
    met = staged(met.select("sample", "own", "_call", "size_class", F.col("_truth_b").alias("_truth"), "size_class_b"), "met")
    # a split of the written pairs, which compress well, can hold tens of millions of keys: they are dealt before they are hashed
    tasks = met.count() // task_rows + 1
    count = F.count("*").alias("n")
    n_calls = calls.groupBy("sample", "size_class").agg(count)
    n_own = truths.select(F.explode("samples").alias("sample"), "size_class").groupBy("sample", "size_class").agg(count)
    good = met.where("own").select("_call", "sample", "size_class").repartition(tasks, "_call").groupBy("_call").agg(F.first("sample").alias("sample"), F.first("size_class").alias("size_class")).groupBy("sample", "size_class").agg(count)
    hits = met.select("sample", "own", "_truth", "size_class_b").repartition(tasks, "_truth").groupBy("sample", "own", "_truth").agg(F.first("size_class_b").alias("size_class")).groupBy("sample", "own", "size_class").agg(count)
    names = n_calls.select("sample").union(n_own.select("sample")).where("sample IS NOT NULL").distinct()
    classes = names.withColumn("size_class", F.explode(F.array(*map(F.lit, SIZE_CLASSES))))
    cells = classes.join(truths.groupBy("size_class").agg(count), "size_class")

    def part(df: DataFrame, **share: str) -> DataFrame:
        return df.select("sample", "size_class", *(F.expr(share.get(c, "0")).cast("bigint").alias(c) for c in ("tp", "fn", "fp", "tn")))

    rows = part(n_calls, fp="n").unionByName(part(good, fp="-n")).unionByName(part(n_own, fn="n", tn="IF(sample IS NULL, 0, -n)"))
    rows = rows.unionByName(part(hits, tp="IF(own, n, 0)", fn="IF(own, -n, 0)", tn="IF(own OR own IS NULL, 0, -n)")).unionByName(part(cells, tn="n"))
    sums = rows.groupBy("sample", "size_class").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")))
    return sums.where("tp > 0 OR fn > 0 OR fp > 0 OR tn > 0")


def rated(scores: DataFrame) -> DataFrame:
    """Every row of scores with its precision and recall (null without a base)."""
    return scores.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def tabulated(scores: DataFrame) -> DataFrame:
    """Sums per size class and, as ``all``, over all classes, with precision and recall (null without a base)."""
    sums = scores.rollup("size_class").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")))
    return sums.select(
        F.coalesce("size_class", F.lit("all")).alias("size_class"), "tp", "fn", "fp", "tn",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )
