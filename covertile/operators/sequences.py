"""Rows in a total order over many tasks: ranges of the order stand in tasks of their own, and what crosses a
range's edge travels as a few rows a range.

The order of a table is cut by Spark's range partitioning, and the cut table is written (``staged``), so ranges stay
what they are when a task is run again.  No key is a task of its own, however many rows it has.  Restarts that depend on the
data (a block begins where the one before it has grown too large) are walks along pointers, found by doubling them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import release, staged


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of its range in ``order``; rows equal in all of ``order`` share one, so end it with a unique column."""
    cut = df.repartitionByRange(*([ranges] if ranges else []), *order)
    return staged(cut.withColumn("_range", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list[str], name: str = "rank", keys: tuple[str, ...] = (), ranges: int | None = None, total: str | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in ``order``, within ``keys`` (which then lead the order), and the rows of the key as ``total``."""
    cut = in_ranges(df, [*keys, *order], ranges)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # over ranges, a row each
    first = cut.groupBy("_range", *keys).agg(F.count("*").alias("_rows"))
    first = first.withColumn("_before", F.sum("_rows").over(whole.orderBy("_range")) - F.col("_rows")).withColumn("_total", F.sum("_rows").over(whole)).drop("_rows")
    own = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    joined = cut.withColumn("_own", own).join(first, ["_range", *keys]).withColumn(name, (F.col("_own") + F.col("_before") - 1).cast("bigint"))
    joined = joined.drop("_own", "_before", "_range")
    return joined.withColumnRenamed("_total", total) if total else joined.drop("_total")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row: sums of ranges, then a window inside a range."""
    cut = in_ranges(df.withColumn("_value", value), [*keys, *order], ranges)
    first = cut.groupBy("_range", *keys).agg(F.sum("_value").alias("_sum"))
    first = first.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.sum("_value").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(first, ["_range", *keys]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_value", "_range")


def following(df: DataFrame, keys: list[str], order: list[str], backwards: bool = False, ranges: int | None = None, **values: Column) -> DataFrame:
    """``df`` with, for each name, the first value (not null) of the rows after each row; ``backwards``: the last value of the rows before it."""
    marked = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    cut = in_ranges(marked, [*keys, *order], ranges)
    along = [F.col(c).asc() if backwards else F.col(c).desc() for c in order]
    by = F.col("_range").asc() if backwards else F.col("_range").desc()
    end = F.max_by if backwards else F.min_by
    place = F.struct(*order)
    edge = cut.groupBy("_range", *keys).agg(*(end(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values))
    beyond = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("_range", *keys, *(F.last(f"_e_{n}", ignorenulls=True).over(beyond).alias(f"_b_{n}") for n in values))
    own = Window.partitionBy("_range", *keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumns({f"_o_{n}": F.last(f"_v_{n}", ignorenulls=True).over(own) for n in values}).join(edge, ["_range", *keys])
    return joined.withColumns({n: F.coalesce(f"_o_{n}", f"_b_{n}") for n in values}).drop("_range", *(f"_{p}_{n}" for p in "vobe" for n in values))


def walk(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at`` of the rows that a walk from each key's least ``at`` along ``at -> next`` meets (``pointers``: a row an ``at``; null ends).

    Pointers are doubled, so the rounds grow with the logarithm of the longest walk; a round is two joins on the pointers.
    """
    jump = staged(pointers.where("next IS NOT NULL").select(*keys, "at", "next"), "pointers")
    seen = staged(pointers.groupBy(*keys).agg(F.min("at").alias("at")), "walk")
    while True:
        new = staged(seen.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at")), "walk")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)  # a staged table a round
        on = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("_then"))
        last, jump = jump, staged(jump.join(on, [*keys, "next"]).select(*keys, "at", F.col("_then").alias("next")), "pointers")
        release(last)


def blocked(df: DataFrame, keys: list[str], order: list[str], halo: int, size: int = 50_000) -> DataFrame:
    """Rows in blocks of ``size`` along ``order`` within ``keys``, each block with ``halo`` rows of its neighbours.

    Adds ``_rank``, ``_total`` (the key's rows), ``_block`` and ``_own`` (not of the halo); a block's rows are for one task.
    """
    if halo > size:
        raise ValueError("a halo is at most a block")
    placed = ranked(df, order, "_rank", tuple(keys), total="_total")
    home, inside, last = F.expr(f"_rank div {size}"), F.col("_rank") % size, F.expr(f"(_total - 1) div {size}")
    to = F.array(home, F.when((inside < halo) & (home > 0), home - 1), F.when((inside >= size - halo) & (home < last), home + 1))
    return placed.withColumn("_block", F.explode(F.array_compact(to))).withColumn("_own", F.col("_block") == home)
