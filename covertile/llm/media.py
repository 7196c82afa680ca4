"""Media columns: PNG files in binary columns, with checksum tests, numpy unfiltering and cosine-transform hashes.

``encode_png`` and ``decode_png`` are a lossless round trip through the PNG chunk format (8-bit
samples, zlib data, CRC of every chunk).  ``perceptual_hash`` is the sign pattern of the low
frequencies of a two-dimensional cosine transform of the image averaged down to 32 x 32.

Defined results: null and empty texts become one row of spaces; equal texts give equal files and
features; a damaged or empty file gives a null payload and an ``error`` text instead of a failure; ``read_media``
adds columns ``payload``, ``feature`` and ``error``, which its input must not hold.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat_bytes, in_arrow, row_chunks

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW_BYTES = 192
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values of the format: samples per pixel by colour type


class MediaError(ValueError):
    """A file that is not a readable PNG."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray, pixel: int) -> np.ndarray:
    """Rows with their filter byte in front: none, left or up, whichever has the least sum of absolute differences."""
    left = rows.copy()
    left[:, pixel:] -= rows[:, :-pixel]
    up = rows.copy()
    up[1:] -= rows[:-1]
    options = np.stack([rows, left, up])
    cost = np.minimum(options, -options).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    return np.concatenate([best.astype(np.uint8)[:, None], options[best, np.arange(len(rows))]], axis=1)


def encode_png(samples: np.ndarray, colour: int = 2, level: int = 6) -> bytes:
    """A PNG of ``(height, bytes per row)`` 8-bit samples."""
    pixel = CHANNELS[colour]
    height, width = samples.shape[0], samples.shape[1] // pixel
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(samples, pixel).tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter_wave(rows: np.ndarray, above: np.ndarray, kinds: np.ndarray, pixel: int) -> np.ndarray:
    """Rows of the two kinds that need left, upper and corner samples: all pixels of a diagonal at once."""
    high, wide = len(rows), rows.shape[1] // pixel
    work = np.zeros((high + 1, wide + 1, pixel), np.int32)
    work[0, 1:], work[1:, 1:] = above.reshape(wide, pixel), rows.reshape(high, wide, pixel)
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        left, up, corner = work[y + 1, x], work[y, x + 1], work[y, x]
        by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.where(kinds[y, None] == 3, (left + up) >> 1, nearest)
        work[y + 1, x + 1] = (work[y + 1, x + 1] + guess) & 255
    return work[1:, 1:].reshape(high, -1).astype(np.uint8)


def unfilter(rows: np.ndarray, kinds: np.ndarray, pixel: int) -> np.ndarray:
    """Samples of filtered rows.  Runs of rows without filter are copied, runs of "up" rows are a running
    sum down the columns, "left" rows a running sum along the row; the two kinds that depend on both
    neighbours go diagonal by diagonal."""
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter")
    out = rows.copy()
    kind_of = np.minimum(kinds, 3)
    bounds = np.flatnonzero(np.r_[True, kind_of[1:] != kind_of[:-1]]).tolist() + [len(kinds)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        kind = kinds[a]
        if kind == 1:
            shaped = out[a:b].reshape(b - a, -1, pixel)
            np.cumsum(shaped, axis=1, out=shaped, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, out=out[a:b], dtype=np.uint8)
        elif kind > 2:
            out[a:b] = _unfilter_wave(rows[a:b], out[a - 1] if a else np.zeros_like(rows[0]), kinds[a:b], pixel)
    return out


def decode_png(data: bytes, most_bytes: int = 1 << 31) -> tuple[np.ndarray, int]:
    """Samples ``(height, bytes per row)`` and colour type; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no signature")
    at, head, body = 8, None, []
    while True:
        if at + 12 > len(data):
            raise MediaError("truncated")
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise MediaError("truncated")
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise MediaError("checksum")
        at += 12 + size
        if kind == b"IHDR":
            if size != 13:
                raise MediaError("header")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise MediaError("unsupported form")
    width, height, colour = head[0], head[1], head[3]
    if not width or not height:
        raise MediaError("no samples")
    row = width * CHANNELS[colour]
    if (row + 1) * height > most_bytes:
        raise MediaError("too large")
    reader = zlib.decompressobj()
    try:
        raw = reader.decompress(b"".join(body), (row + 1) * height + 1)
    except zlib.error as e:
        raise MediaError("zlib") from e
    if len(raw) != (row + 1) * height or not reader.eof:
        raise MediaError("size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    return unfilter(rows[:, 1:], rows[:, 0], CHANNELS[colour]), colour


def _cosines(n: int, kept: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(kept)[:, None])


SIDE, LOW = 32, 8
_BASIS = _cosines(SIDE, LOW)


def shrink(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Area means on a ``side`` x ``side`` grid; a short axis repeats its samples."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(side + 1) * n // side
        first, last = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        sums = np.cumsum(image, axis=axis)
        sums = np.concatenate([np.zeros_like(sums.take([0], axis)), sums], axis)
        size = (last - first).reshape((-1, 1) if axis == 0 else (1, -1))
        image = (sums.take(last, axis) - sums.take(first, axis)) / size
    return image


def perceptual_hash(samples: np.ndarray, pixel: int) -> str:
    """64 bits as hex: which of the lowest 8 x 8 cosine coefficients are above their median (the mean left out)."""
    grey = samples.reshape(len(samples), -1, pixel).mean(axis=2, dtype=np.float64)
    low = (_BASIS @ shrink(grey) @ _BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes, row: int = ROW_BYTES) -> bytes:
    """The bytes padded with spaces to a positive multiple of the row."""
    return text + b" " * (max(row, -(-len(text) // row) * row) - len(text))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", level: int = 6, chunk_bytes: int = 4_000_000) -> DataFrame:
    """``key, n_bytes long, media binary``: each whole text as a PNG of 64 RGB pixels per row."""

    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(1))
            for a, b in row_chunks(offsets, chunk_bytes):
                files = [encode_png(np.frombuffer(payload(data[offsets[k] : offsets[k + 1]].tobytes()), np.uint8).reshape(-1, ROW_BYTES), 2, level) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(offsets[a : b + 1])), pa.array(files, pa.binary())], [key, "n_bytes", "media"])

    return in_arrow(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_media(df: DataFrame, media: str = "media", chunk_bytes: int = 4_000_000) -> DataFrame:
    """Adds ``payload binary`` (the stored samples, read back), ``feature string`` and ``error string``."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])
    place = df.columns.index(media)

    def work(batches):
        for batch in batches:
            _, offsets = flat_bytes(batch.column(place))
            for a, b in row_chunks(offsets, chunk_bytes):
                part, rows = batch.slice(a, b - a), []
                for blob in part.column(place).to_pylist():
                    try:
                        samples, colour = decode_png(blob or b"")
                        rows.append((samples.tobytes(), perceptual_hash(samples, CHANNELS[colour]), None))
                    except MediaError as e:
                        rows.append((None, None, str(e)))
                kinds = (pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*part.schema.names, "payload", "feature", "error"])

    return in_arrow(df, work, schema)
