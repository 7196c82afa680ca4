"""Vectors in blocks: exact integer scores of asking rows against all rows, in cells of bounded size, and the merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, of either side.
BLOCK = 32_768
NOTHING = np.iinfo(np.int64).min


def quantised(df: DataFrame, key: str, vector: str, scale: int, *further: str) -> DataFrame:
    """``key, v array<bigint>`` and further columns of the vectors that take part."""
    whole = f"{key} IS NOT NULL AND {vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('infinity'))"
    return df.where(whole).selectExpr(key, *further, f"transform({vector}, x -> floor({scale} * double(x))) AS v")


def inner_products(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer products of long matrices: in doubles where every sum stays below 2**53, else with whole numbers of any size."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(q) * most(block) * max(1, q.shape[1]) < 2**53:
        return q.astype(np.float64) @ block.astype(np.float64)
    return np.clip(q.astype(object) @ block.astype(object), NOTHING + 1, np.iinfo(np.int64).max).astype(np.int64)


def vectors_by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow table by the length of their vectors, in order of id, and the vectors as a matrix."""
    lists = table.column("v").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    out = {}
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        own = own[np.argsort(ids[own], kind="stable")]
        out[dim] = own, lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
    return out


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """A cell's asking rows and its rows."""
    asks = table.column("asks")
    return table.filter(asks), table.filter(pc.invert(asks))


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def dealt(asking: DataFrame, rows: DataFrame, *carried: str):
    """Both sides in cells by ``g, i, j``: a group's asking rows in ``p`` blocks, its rows in ``q`` (columns of both), each block of one side with all of
    the other.  ``carried`` are further columns of the asking rows; null on the other side where it lacks them."""

    def side(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        met = df.withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        i, j = ("_own", "_other") if asks else ("_other", "_own")
        further = [F.col(c) if c in df.columns else F.lit(None).cast(asking.schema[c].dataType).alias(c) for c in carried]
        return met.select("g", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(asks).alias("asks"), "id", "v", *further)

    return side(asking, "p", "q", True).unionByName(side(rows, "q", "p", False)).groupBy("g", "i", "j")


def whole(total: int, asked: int, block: int, cores: int) -> dict:
    """One group of all rows: a cell for each core at least (of a thousand rows or more), and a block on either side at most."""
    q = max(1, -(-total // block), min(cores, total // 1024))
    return {"g": F.lit(0), "p": F.lit(max(1, -(-asked // block))).cast("long"), "q": F.lit(q).cast("long")}


def top(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The best ``k`` rows of each key with ``rank`` from 1; lists are cut before they are shuffled, and by branches of cells before they meet."""
    others = [c for c in df.columns if c not in (*keys, score, ident)]
    best = F.slice(F.sort_array(F.collect_list(F.struct(score, (-F.col(ident)).alias("_minus"), *others)), asc=False), 1, k)
    level = df.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(64)).alias("_branch")).agg(best.alias("_top")).select(*keys, F.inline("_top")).withColumn(ident, -F.col("_minus")).drop("_minus")
    final = level.groupBy(*keys).agg(best.alias("_top")).select(*keys, F.posexplode("_top").alias("_at", "_x"))
    return final.select(*keys, (F.col("_at") + 1).cast("int").alias("rank"), (-F.col("_x._minus")).alias(ident), f"_x.{score}", *(f"_x.{c}" for c in others))
