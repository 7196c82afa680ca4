"""Blocked gzip: files of compressed blocks of at most 64 KB that can be read from any block on; tables written so, ``format("bgzf")``."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.sequences import ranked

#: Bytes of a block before compression, and the last block of a file.
BLOCK = 65_280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URL, and the path in it; local paths lie on a folder that all machines share."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def block(raw: bytes) -> bytes:
    """One compressed block; its bytes depend on ``raw`` alone, its time is zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def blocks_from(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Place, next place and contents of the blocks in ``data``; a block that is cut off at the end is left out."""
    at = 0
    while at + 18 <= len(data):
        after = at + struct.unpack_from("<H", data, at + 16)[0] + 1
        if after > len(data):
            return
        yield at, after, zlib.decompress(data[at + 18 : after - 8], -15)
        at = after


def packed(lines: list[str]) -> bytes:
    """Lines in as many blocks as they need."""
    raw = "".join(f"{x}\n" for x in lines).encode()
    return b"".join(block(raw[k : k + BLOCK]) for k in range(0, len(raw), BLOCK))


@dataclass
class Part(WriterCommitMessage):
    path: str
    number: int
    rows: int


class BgzfWriter(DataSourceArrowWriter):
    """Lines and the numbers of their groups (``value, at``) as part files whose names follow the partitions.  A group's lines are
    compressed alone, so the bytes do not depend on where partitions begin; the header stands before the first line, the end block in the
    last part, so the parts in order of their names are one file."""

    def __init__(self, path: str, header: str):
        self.path, self.header = path, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        system, root = opened(self.path)
        system.create_dir(root)
        temporary, held, now, rows = f"{root}/.{uuid.uuid4().hex}", [], None, 0
        with system.open_output_stream(temporary) as f:
            for batch in iterator:
                for line, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if at != now:
                        f.write(packed(held))
                        held, now = [self.header] if at == 0 else [], at
                    held.append(line)
                rows += batch.num_rows
            f.write(packed(held))
        name = f"{root}/part-{number:05}.gz"
        system.move(temporary, name)  # the same rows make the same bytes, whichever attempt of a task comes last
        return Part(name, number, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        if parts:
            system, path = opened(max(parts, key=lambda m: m.number).path)
            with system.open_append_stream(path, compression=None) as f:
                f.write((b"" if any(m.rows for m in parts) else packed([self.header])) + END)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None:
                system, path = opened(m.path)
                system.delete_file(path)


class BgzfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string, at long"

    def writer(self, schema, overwrite: bool) -> BgzfWriter:
        return BgzfWriter(self.options["path"], self.options.get("header", ""))


def write_bgzf(df: DataFrame, path: str, order: list[str], without: tuple[str, ...] = (), lines: int = 1_000) -> None:
    """A table as tab-separated lines in blocked gzip, in ``order`` (which no two rows share); columns ``without`` only order."""
    df.sparkSession.dataSource.register(BgzfSource)
    kept = [c for c in df.columns if c not in without]
    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in kept))
    rows = ranked(df, order, "_rank").select(line.alias("value"), F.expr(f"_rank div {lines}").alias("at"), "_rank")
    placed = rows.repartitionByRange("at").sortWithinPartitions("_rank").select("value", "at")
    placed.write.format("bgzf").option("header", "#" + "\t".join(kept)).mode("append").save(path)
