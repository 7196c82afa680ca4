"""Shared plumbing of the operators: reading tables, staging, Arrow buffers, hashing kernels."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

from ..staging import noted, release, shared_dir, small, staged  # noqa: F401


def read(spark, sf_dir: str, table: str):
    """The table as a DataFrame; the path is opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Arrow batches to Python hold so many bytes at most (a longer row stands alone), unless the session sets less.
BATCH_BYTES = 4_000_000


def in_arrow(df, work, schema):
    """``df.mapInArrow`` in batches of bounded bytes; a task's worker gives freed memory back when the task is over."""
    size, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)

    def trimmed(batches):
        yield from work(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def tidy(work):
    """A function of one group's table for ``applyInArrow``, after which freed memory is given back."""

    def tidied(table):
        out = work(table)
        give_back()
        return out

    return tidied


def give_back() -> None:
    """Hand memory that was freed but is still held by the allocators to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offsets: np.ndarray, limit: int):
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply) on uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Longer ranges are hashed one by one.
_CHUNKED = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of one buffer: eight bytes are mixed in at a time, for all ranges together; ranges of over
    ``_CHUNKED`` bytes go through BLAKE2b.  No algebraic structure of the bytes survives, so unequal ranges collide by chance only."""
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place
    live = np.flatnonzero(size <= _CHUNKED)
    for k in range(0, _CHUNKED, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = mix64((out[live] ^ (eight[start[live] + k] & _KEEP[np.minimum(size[live] - k, 8)])) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1))
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > _CHUNKED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(whole[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them; kept per process."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """64-bit hashes of any short byte ranges of one buffer, by prefix sums of a polynomial modulo 2**64.

    Every byte goes through a random 64-bit table first, and the result is finalised with the
    range's length, so equal ranges have equal hashes wherever they start.  Only for ranges of some hundred bytes at most
    that overlap (n-grams, contexts): long ranges of a certain structure collide; ``byte_hashes`` has no such weakness.
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        table = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run without ASCII white space, never across rows) and the words before each row."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def segment_arange(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after the other."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    out -= np.repeat(np.cumsum(counts) - counts, counts)
    return out
