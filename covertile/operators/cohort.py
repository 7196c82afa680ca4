"""Products and leading components of a cohort's samples, for cohorts of any size.

The samples' products over all cells are tiles of ``BLOCK`` x ``BLOCK`` samples, a row each; every task sums numpy products of its own
cells.  The leading components come from block power iteration on these tiles: a step multiplies tiles with a panel of a few columns,
whose blocks are rows too.  Only matrices of the panel's width (some 20 x 20 numbers) pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import release, small, staged
from .sequences import ranked

BLOCK = 256
#: Values of a chunk of cells, and bytes of tiles that a task holds before it hands them on.
CHUNK, HELD = 4_000_000, 64_000_000
#: Blocks of a panel up to which it is broadcast.
PANEL_ROWS = 4_096


def numbered(df: DataFrame) -> DataFrame:
    """``sample, sid``: the samples' places in order of their names."""
    return staged(ranked(df.select("sample").distinct(), ["sample"], "sid"), "samples")


def product_tiles(matrix: DataFrame, samples: DataFrame, cell: list[str], value: str = "depth") -> DataFrame:
    """``i, j, tile``: products of the samples of blocks i and j over all cells; absent values are 0."""
    k = samples.count()
    blocks = -(-k // BLOCK)
    rows = matrix.join(small(samples, 1_000_000), "sample").select(*cell, "sid", F.col(value).cast("double").alias("v"))
    chunks = max(1, -(-rows.count() // CHUNK))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*cell), F.lit(chunks)))
    place = F.dense_rank().over(Window.partitionBy("chunk").orderBy(*cell)) - 1  # cells of a chunk
    rows = rows.select("chunk", place.cast("bigint").alias("cell"), "sid", "v")

    def work(batches: Iterable[pa.RecordBatch]):
        held: dict[tuple[int, int], np.ndarray] = {}
        parts: list[list[np.ndarray]] = []

        def add() -> None:
            at, sid, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            x = np.zeros((int(at.max()) + 1, blocks * BLOCK))
            x[at, sid] = v
            for i in range(blocks):
                for j in range(blocks):
                    tile = x[:, i * BLOCK : (i + 1) * BLOCK].T @ x[:, j * BLOCK : (j + 1) * BLOCK]
                    held[i, j] = held[i, j] + tile if (i, j) in held else tile

        def handed():
            for (i, j), tile in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([j], pa.int64()), pa.array([tile.tobytes()], pa.binary())], ["i", "j", "tile"])
            held.clear()

        now = None
        for batch in batches:
            chunk, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now is not None and chunk[a] != now and parts:
                    add()
                    if len(held) * BLOCK * BLOCK * 8 > HELD:
                        yield from handed()
                now = chunk[a]
                parts.append([x[a:b] for x in rest])
        if parts:
            add()
        yield from handed()

    tiles = rows.mapInArrow(work, "i long, j long, tile binary")
    branch = F.pmod(F.spark_partition_id(), F.lit(32))
    return staged(summed(summed(tiles.withColumn("branch", branch), ["i", "j", "branch"], "tile"), ["i", "j"], "tile"), "tiles")


def summed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element by element sums of binary arrays of doubles."""

    def work(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column(value):
            one = np.frombuffer(x.as_py())
            total = one.copy() if total is None else total + one
        return pa.table({**{k: table.column(k)[:1] for k in keys}, value: pa.array([total.tobytes()], pa.binary())})

    return df.select(*keys, value).groupBy(*keys).applyInArrow(work, ", ".join(f"{k} {'int' if k == 'branch' else 'long'}" for k in keys) + f", {value} binary")


def panel(blocks: DataFrame, change: Callable[[int, np.ndarray], np.ndarray], width: int, name: str = "v") -> DataFrame:
    """``i, v`` with every block (``BLOCK`` x ``width``) changed by a function of its number and numbers."""

    def work(batches):
        for batch in batches:
            rows = [change(i, np.frombuffer(v).reshape(BLOCK, width)) for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([r.tobytes() for r in rows], pa.binary())], ["i", name])

    return blocks.select("i", "v").mapInArrow(work, f"i long, {name} binary")


def small_sum(blocks: DataFrame, each: Callable[[int, np.ndarray], np.ndarray], width: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all blocks of a small matrix that each block gives."""
    size = int(np.prod(shape))
    parts = panel(blocks, lambda i, v: np.ascontiguousarray(each(i, v), float), width, "p")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("x")[k])

    def work(batches):
        total = np.zeros(size)
        for batch in batches:
            for p in batch.column(1).to_pylist():
                total += np.frombuffer(p)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    rows = parts.mapInArrow(work, "x array<double>").select(F.posexplode(numbers).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["x"]
    return out.reshape(shape)


def multiplied(tiles: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Tiles times a panel."""
    met = tiles.join(small(blocks.withColumnRenamed("i", "j"), PANEL_ROWS), "j").select("i", "tile", "v")

    def work(batches):
        for batch in batches:
            rows = [(np.frombuffer(t).reshape(BLOCK, BLOCK) @ np.frombuffer(v).reshape(BLOCK, width)).tobytes() for t, v in zip(batch.column("tile").to_pylist(), batch.column("v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(rows, pa.binary())], ["i", "v"])

    return summed(met.mapInArrow(work, "i long, v binary"), ["i"], "v")


def leading(tiles: DataFrame, k: int, components: int, centre: bool, rounds: int = 200, tolerance: float = 1e-13) -> tuple[DataFrame, np.ndarray, float, int]:
    """The leading eigenvectors of the product matrix as a panel ``i, v`` of so many columns, their values, the sum of all values, and the columns.

    ``centre``: of the products of values less their mean over the samples.  Subspace iteration with a few columns more than asked
    for; it ends when the values asked for have settled.
    """
    spark, width = tiles.sparkSession, min(k, components + 8)
    inside = lambda i: (np.arange(i * BLOCK, (i + 1) * BLOCK) < k)[:, None]

    def begun(i: int, _: np.ndarray) -> np.ndarray:
        return np.random.default_rng(1000 + i).standard_normal((BLOCK, width)) * inside(i)

    def turned(blocks: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """An orthonormal basis of a panel's columns (less their means), by one pass over it, and the singular values of the panel."""
        sums = small_sum(blocks, lambda i, v: np.vstack([v.T @ v, v.sum(0)]), width, (width + 1, width))
        mean = sums[-1] / k if centre else np.zeros(width)
        inner = sums[:-1] - k * np.outer(mean, mean)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        turn = vectors / np.sqrt(np.maximum(values, max(values.max(), 0) * 1e-24 + 1e-300))
        turn[:, values <= values.max() * 1e-22] = 0  # directions that the products do not have
        return panel(blocks, lambda i, v: ((v - mean) * inside(i)) @ turn, width), np.sqrt(np.maximum(values[::-1], 0))

    first = spark.range(-(-k // BLOCK)).select(F.col("id").alias("i"), F.lit(bytes(BLOCK * width * 8)).alias("v"))
    moved = staged(panel(first, begun, width), "panel")
    last = None
    for _ in range(rounds):
        basis, values = turned(moved)
        # squares, as that is what the values come from: their rounding is that of the largest one's square
        if last is not None and np.abs(values[:components] ** 2 - last[:components] ** 2).max() <= tolerance * max(values[0] ** 2, 1e-300):
            break
        before, last, moved = moved, values, staged(multiplied(tiles, basis, width), "panel")
        release(before)
    # once more, as one pass leaves rounding
    basis = staged(turned(staged(turned(moved)[0], "panel"))[0], "panel")
    moved = staged(multiplied(tiles, basis, width), "panel")
    both = basis.join(small(moved.withColumnRenamed("v", "w"), PANEL_ROWS), "i").select("i", F.concat("v", "w").alias("v"))
    inner = small_sum(both, lambda i, x: x.reshape(2, BLOCK, width)[0].T @ x.reshape(2, BLOCK, width)[1], 2 * width, (width, width))
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    by = np.argsort(values)[::-1][: min(components, width)]
    out = staged(panel(basis, lambda i, v: v @ vectors[:, by], width), "components")
    trace = tile_sum(tiles.where("i = j"), np.trace) - (tile_sum(tiles, np.sum) / k if centre else 0.0)
    return out, np.maximum(values[by], 0), trace, len(by)


def tile_sum(tiles: DataFrame, each: Callable[[np.ndarray], float]) -> float:
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(each(np.frombuffer(t).reshape(BLOCK, BLOCK))) for t in batch.column(0).to_pylist()], pa.float64())], ["x"])

    return tiles.select("tile").mapInArrow(work, "x double").agg(F.sum("x")).first()[0] or 0.0


def by_sample(blocks: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """``sample, v array<double>``: the panel's rows."""

    def work(batches):
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * BLOCK, (i + 1) * BLOCK)), pa.array(np.frombuffer(v).reshape(BLOCK, width).tolist(), pa.list_(pa.float64()))], ["sid", "v"])

    return blocks.mapInArrow(work, "sid long, v array<double>").join(samples, "sid").select("sample", "v")
