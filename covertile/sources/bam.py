"""BAM files as a Spark data source, ``format("bam")``: reads in parallel between the index's virtual offsets, writes part files with their indexes.

Files are opened through Arrow's file systems, so a path may be local (on a folder that all machines share) or a URL that Arrow knows.
A BAM file is a chain of compressed blocks of at most 64 KB; a virtual offset is a block's place in the file and a place in the block.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bgzf import BLOCK, END, block, blocks_from, opened
from .binary import STATS_BIN, parse_bam_header, parse_bam_index

SCHEMA = "file string, ref_id int, pos long, end long, mapq int, flag int, mate_ref int, mate_pos long, tlen long, read_len int, n_cigar int, cigar_first string, name string"
#: Bits of a window of the index, operations of alignments, those that move along the reference, and those that take bases.
WINDOW = 14
OPERATIONS, ALONG, TAKING = "MIDNSHP=X", (0, 2, 3, 7, 8), (0, 1, 4, 7, 8)
CORE = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])


def decoded(raw: bytes, stop: int) -> tuple[dict[str, np.ndarray], int]:
    """Columns of the whole records that begin before ``stop``, and where the first record behind them begins."""
    starts, at = [], 0
    while at < stop and at + 4 <= len(raw):
        size = struct.unpack_from("<i", raw, at)[0]
        if at + 4 + size > len(raw):
            break
        starts.append(at)
        at += 4 + size
    data, start = np.frombuffer(raw, np.uint8), np.array(starts, np.int64)
    core = data[start[:, None] + np.arange(CORE.itemsize)].copy().view(CORE)[:, 0] if len(start) else np.zeros(0, CORE)
    begin, count = start + CORE.itemsize + core["l_name"], core["n_cigar"].astype(np.int64)
    row = np.repeat(np.arange(len(start)), count)
    place = np.repeat(begin, count) + 4 * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    cigar = data[place[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(row) else np.zeros(0, np.uint32)
    span = np.bincount(row, np.where(np.isin(cigar & 15, ALONG), cigar >> 4, 0), len(start)).astype(np.int64)
    bases = np.bincount(row, np.where(np.isin(cigar & 15, TAKING), cigar >> 4, 0), len(start)).astype(np.int64)
    first = np.array([""] * len(start), object)
    has = np.flatnonzero(count)
    if len(has):
        letters = np.array(list(OPERATIONS), object)
        first[has] = letters[cigar[(np.cumsum(count) - count)[has]] & 15]
    names = [raw[a : a + n - 1].decode() for a, n in zip((start + CORE.itemsize).tolist(), core["l_name"].tolist(), strict=True)]
    pos = core["pos"].astype(np.int64)
    return {
        "ref_id": core["ref"], "pos": pos, "end": pos + span, "mapq": core["mapq"].astype(np.int32), "flag": core["flag"].astype(np.int32), "mate_ref": core["mate_ref"], "mate_pos": core["mate_pos"].astype(np.int64),
        "tlen": core["tlen"].astype(np.int64), "read_len": np.where(core["l_seq"] > 0, core["l_seq"], bases).astype(np.int32), "n_cigar": count.astype(np.int32), "cigar_first": first, "name": np.array(names, object),
    }, at


@dataclass
class Chunk(InputPartition):
    file: str
    first: int  # virtual offsets; -1 ends with the file
    last: int


class BamReader(DataSourceReader):
    def __init__(self, path: str, chunk_bytes: int):
        self.path, self.chunk_bytes = path, chunk_bytes

    def partitions(self) -> list[Chunk]:
        """Chunks of about ``chunk_bytes`` between offsets that the indexes name; a file without an index is one."""
        system, root = opened(self.path)
        found = system.get_file_info(root)
        infos = system.get_file_info(fs.FileSelector(root)) if found.type == fs.FileType.Directory else [found]
        out = []
        for info in sorted((i for i in infos if i.path.endswith(".bam")), key=lambda i: i.path):
            with system.open_input_stream(info.path) as f:  # a header fits the first bytes, or all are taken
                head = f.read(1 << 20)
                try:
                    first = first_record(head)
                except (ValueError, struct.error, StopIteration):
                    first = first_record(head + f.read())
            offsets = []
            if system.get_file_info(f"{info.path}.bai").type == fs.FileType.File:
                with system.open_input_stream(f"{info.path}.bai") as f:
                    offsets = sorted({v for _, linear, *_ in parse_bam_index(f.read()) for v in linear if v > first})
            cuts, last = [first], first >> 16
            for v in offsets:
                if (v >> 16) - last >= self.chunk_bytes:
                    cuts.append(v)
                    last = v >> 16
            out += [Chunk(info.path, a, b) for a, b in zip(cuts, [*cuts[1:], -1], strict=True)]
        return out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        """The records that begin in the chunk; the last of them may end behind it."""
        last_block, last_place = (partition.last >> 16, partition.last & 0xFFFF) if partition.last >= 0 else (1 << 62, 0)
        with opened(self.path)[0].open_input_file(partition.file) as f:
            at, skip = partition.first >> 16, partition.first & 0xFFFF
            f.seek(at)
            tail, held, stop = b"", b"", None  # ``stop``: where in ``held`` the next chunk begins
            while True:
                data = f.read(1 << 20)
                tail += data
                used, parts, size = 0, [held], len(held)
                for place, used, raw in blocks_from(memoryview(tail)):  # noqa: B007
                    if stop is None and at + place >= last_block:
                        stop = size - skip + (last_place if at + place == last_block else 0)
                    parts.append(raw[skip:])
                    size, skip = size + len(raw) - skip, 0
                at, tail, held = at + used, tail[used:], b"".join(parts)
                columns, upto = decoded(held, len(held) if stop is None else stop)
                if len(columns["pos"]):
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(columns["pos"]), pa.string()), *(pa.array(c) for c in columns.values())], ["file", *columns])
                held, stop = held[upto:], None if stop is None else stop - upto
                if not data or (stop is not None and stop <= 0):
                    return


def first_record(head: bytes) -> int:
    """The virtual offset behind the header."""
    text, contigs = parse_bam_header(head)
    length = 12 + len(text.encode()) + sum(9 + len(n.encode()) for n, _ in contigs)
    # the header's text may be padded with zero bytes
    raw = b""
    for place, after, part in blocks_from(memoryview(head)):
        raw += part
        if len(raw) >= 8:
            pad = struct.unpack_from("<i", raw, 4)[0] - len(text.encode())
            if len(raw) > length + pad:
                return place << 16 | (length + pad - (len(raw) - len(part)))
            if len(raw) == length + pad:
                return after << 16
    raise ValueError("the header goes on")


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class BamWriter(DataSourceArrowWriter):
    """Writes rows (in order of ``ref_id, pos``) of ``ref_id, pos, end, mapq, flag, mate_ref, mate_pos, tlen, name``, each aligned as a whole."""

    def __init__(self, path: str, contigs: list[tuple[str, int]]):
        self.path, self.contigs = path, contigs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = opened(self.path)
        system.create_dir(root)
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.contigs)
        header = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.contigs)
        linear: dict[int, dict[int, int]] = {}
        counts: dict[int, int] = {}
        rows, held, place = 0, b"", 0
        temporary = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:

            def put(raw: bytes) -> int:
                nonlocal place
                out = block(raw)
                f.write(out)
                place += len(out)
                return place

            for k in range(0, len(header), BLOCK):
                put(header[k : k + BLOCK])
            pending: list[tuple[int, int, int, int]] = []  # offset in ``held``, contig, first and last window

            def flush(final: bool) -> None:
                nonlocal held, pending
                while len(held) >= BLOCK or (final and held):
                    begin, raw = place, held[:BLOCK]
                    for offset, ref, a, b in (x for x in pending if x[0] < len(raw)):
                        own = linear.setdefault(ref, {})
                        for w in range(a, b + 1):
                            own.setdefault(w, begin << 16 | offset)
                    pending = [(o - len(raw), *x) for o, *x in pending if o >= len(raw)]
                    put(raw)
                    held = held[len(raw) :]

            for batch in iterator:
                col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("ref_id", "pos", "end", "mapq", "flag", "mate_ref", "mate_pos", "tlen", "name")}
                names = [str(n).encode() + b"\0" for n in col["name"]]
                core = np.zeros(batch.num_rows, CORE)
                for ours, theirs in (("ref", "ref_id"), ("pos", "pos"), ("mapq", "mapq"), ("flag", "flag"), ("mate_ref", "mate_ref"), ("mate_pos", "mate_pos"), ("tlen", "tlen")):
                    core[ours] = col[theirs]
                core["l_name"] = [len(n) for n in names]
                core["n_cigar"], core["size"] = 1, CORE.itemsize - 4 + core["l_name"] + 4
                cigar = ((col["end"] - col["pos"]).astype(np.uint32) << 4).astype("<u4")
                size = core["size"].astype(np.int64) + 4
                offset = len(held) + np.cumsum(size) - size
                window = col["pos"] >> WINDOW, (col["end"] - 1) >> WINDOW
                pending += list(zip(offset.tolist(), col["ref_id"].tolist(), window[0].tolist(), window[1].tolist(), strict=True))
                held += b"".join(c + n + g for c, n, g in zip((x.tobytes() for x in core), names, (x.tobytes() for x in cigar), strict=True))
                for ref, n in zip(*np.unique(col["ref_id"], return_counts=True), strict=True):
                    counts[int(ref)] = counts.get(int(ref), 0) + int(n)
                rows += batch.num_rows
                flush(False)
            flush(True)
            f.write(END)
        name = f"{root}/part-{part:05}.bam"
        index = b"BAI\x01" + struct.pack("<i", len(self.contigs))
        for ref in range(len(self.contigs)):
            own, last = linear.get(ref, {}), 0
            offsets = []
            for w in range(max(own, default=-1) + 1):
                last = own.get(w, last)
                offsets.append(last)
            index += struct.pack("<iIiQQQQi", 1, STATS_BIN, 2, 0, 0, counts.get(ref, 0), 0, len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets)
        with system.open_output_stream(f"{temporary}.bai") as f:
            f.write(index)
        # the same rows make the same bytes, so whichever attempt of a task is the last to come here leaves a whole file
        system.move(f"{temporary}.bai", f"{name}.bai")
        system.move(temporary, name)
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        with system.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list[Part | None]) -> None:
        system = opened(self.path)[0]
        for m in messages:
            if m is not None:
                for end in ("", ".bai"):
                    system.delete_file(m.path + end)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("chunk_bytes", 32_000_000)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        names = self.options["contigs"].split(",")
        return BamWriter(self.options["path"], [(n, int(k)) for n, _, k in (x.rpartition(":") for x in names)])


def read_bam(spark: SparkSession, path: str, chunk_bytes: int = 32_000_000) -> DataFrame:
    """Records of a BAM file, or of all BAM files of a folder, in tasks of about ``chunk_bytes`` of the compressed file."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("chunk_bytes", chunk_bytes).load(path)


def write_bam(df: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    """Alignments as part files, sorted along the contigs (``ref_id`` counts them), each with its index."""
    df.sparkSession.dataSource.register(BamSource)
    rows = df.select(*(F.col(c).cast(t).alias(c) for c, t in (("ref_id", "int"), ("pos", "long"), ("end", "long"), ("mapq", "int"), ("flag", "int"), ("mate_ref", "int"), ("mate_pos", "long"), ("tlen", "long"), ("name", "string"))))
    rows.repartitionByRange("ref_id", "pos", "name").sortWithinPartitions("ref_id", "pos", "name").write.format("bam").option("contigs", ",".join(f"{n}:{k}" for n, k in contigs)).mode("append").save(path)
