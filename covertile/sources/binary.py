"""BAM indexes and headers, decoded from Spark's binary file source; CRAM slices to tiles."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import TILE_WIDTH
from ..functions.text import short_name

STATS_BIN = 37_450  # fixed value: the pseudo-bin that holds a contig's read counts


def parse_bam_index(data: bytes) -> list[tuple[int, list[int], int, int]]:
    """Per contig: id, linear-index offsets, mapped and unmapped reads."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for ref in range(struct.unpack_from("<i", data, 4)[0]):
        bins, mapped, unmapped = struct.unpack_from("<i", data, at)[0], 0, 0
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if number == STATS_BIN and chunks == 2:
                mapped, unmapped = struct.unpack_from("<QQ", data, at + 16)
            at += 16 * chunks
        n = struct.unpack_from("<i", data, at)[0]
        out.append((ref, list(struct.unpack_from(f"<{n}Q", data, at + 4)), mapped, unmapped))
        at += 4 + 8 * n
    return out


def bam_indexes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, sample, ref_id, voffsets, mapped, unmapped``; one row per contig of every index."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse_bam_index(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "ref_id", "voffsets", "mapped", "unmapped"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInPandas(work, "path string, ref_id int, voffsets array<bigint>, mapped bigint, unmapped bigint")
    return rows.withColumn("sample", short_name(F.regexp_replace("path", r"\.bai$", "")))


def index_tiles(indexes: DataFrame) -> DataFrame:
    """``sample, ref_id, tile, size``; a negative size is an error."""
    size = lambda v, i: F.when(F.col("voffsets")[i + 1] >= F.col("voffsets")[i], F.col("voffsets")[i + 1] - F.col("voffsets")[i]).otherwise(F.raise_error(F.lit("offsets fall")).cast("bigint"))
    sizes = F.transform(F.slice("voffsets", 1, F.greatest(F.size("voffsets") - 1, F.lit(0))), size)
    return indexes.select("sample", "ref_id", F.posexplode(sizes).alias("tile", "size"))


def parse_bam_header(data: bytes) -> tuple[str, list[tuple[str, int]]]:
    """Header text and contigs of a BAM file's first compressed blocks."""
    raw, at = b"", 0

    def need(n: int) -> None:
        nonlocal raw, at
        while len(raw) < n:
            if data[at : at + 4] != b"\x1f\x8b\x08\x04":
                raise ValueError("not a BAM file")
            extra = struct.unpack_from("<H", data, at + 10)[0]
            size = next(struct.unpack_from("<H", data, p + 4)[0] + 1 for p in range(at + 12, at + 12 + extra) if data[p : p + 4] == b"BC\x02\x00")
            raw += zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
            at += size

    need(8)
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = struct.unpack_from("<i", raw, 4)[0]
    need(12 + text)
    place, contigs = 12 + text, []
    for _ in range(struct.unpack_from("<i", raw, 8 + text)[0]):
        need(place + 4)
        n = struct.unpack_from("<i", raw, place)[0]
        need(place + 8 + n)
        contigs.append((raw[place + 4 : place + 3 + n].decode(), struct.unpack_from("<i", raw, place + 4 + n)[0]))
        place += 8 + n
    return raw[8 : 8 + text].rstrip(b"\0").decode(), contigs


def bam_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, text, contigs array<struct<chrom, length>>``."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                text, contigs = parse_bam_header(bytes(c))
                rows.append((p, text, [{"chrom": n, "length": k} for n, k in contigs]))
            yield pd.DataFrame(rows, columns=["path", "text", "contigs"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(work, "path string, text string, contigs array<struct<chrom:string,length:bigint>>")


def header_contigs(headers: DataFrame, chrom: str | None = None) -> DataFrame:
    """``path, chrom, length, ord``; with ``chrom``, only that contig."""
    out = headers.select("path", F.posexplode("contigs").alias("ord", "c")).select("path", "c.chrom", "c.length", "ord")
    return out if chrom is None else out.where(F.col("chrom") == chrom)


def read_groups(headers: DataFrame) -> DataFrame:
    """``file, rg_id, sm`` from the header's read-group lines."""
    lines = headers.select(F.col("path").alias("file"), F.explode(F.split("text", "\n")).alias("line")).where("line LIKE '@RG%'")
    return lines.select("file", F.regexp_extract("line", r"\tID:([^\t]*)", 1).alias("rg_id"), F.nullif(F.regexp_extract("line", r"\tSM:([^\t]*)", 1), F.lit("")).alias("sm"))


def slice_tiles(slices: list[tuple[int, int, int]], width: int = TILE_WIDTH) -> list[int]:
    """Tile sizes of one contig from ``(start, span, bytes)`` of CRAM slices in file order.

    A slice gives each whole tile of its span its bytes per base (in 1/100000); the tile before a gap gets
    the last slice's value, further gap tiles 0; what a slice reaches past a tile moves to the next.
    """
    out: list[int] = []
    edge = value = 0
    for start, span, size in slices:
        blank = max(0, -(-(start - width - edge) // width))
        if blank:
            out += [value] + [0] * (blank - 1)
            edge, value = edge + blank * width, 0
        late = max(0, -(-(edge - width - start) // width))
        start, span = start + late * width, span - late * width
        if span <= 0:
            continue
        value = int(100_000 * size / span)
        tiles = span // width
        out += [value] * tiles
        edge += tiles * width
    return out


def cram_tiles(slices: DataFrame) -> DataFrame:
    """``sample, ref_id, tile, size`` of the rows of ``cram_index``; a contig's slices of one sample are a group."""

    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        sizes = slice_tiles(list(zip(pdf["start"].tolist(), pdf["span"].tolist(), pdf["bytes"].tolist(), strict=True)))
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "ref_id": pdf["ref_id"].iloc[0], "tile": range(len(sizes)), "size": sizes})

    return slices.select("sample", "ref_id", "ord", "start", "span", "bytes").groupBy("sample", "ref_id").applyInPandas(work, "sample string, ref_id bigint, tile int, size bigint")


def index_path(path: str, exists) -> str:
    """The index of an alignment file: itself if it is one, else the first of the usual neighbours that ``exists`` accepts."""
    if path.endswith((".crai", ".bai")):
        return path
    stem = path.rsplit(".", 1)[0]
    options = {"bam": [f"{path}.bai", f"{stem}.bai"], "cram": [f"{path}.crai", f"{stem}.crai"]}.get(path.rsplit(".", 1)[-1], [])
    for option in options:
        if exists(option):
            return option
    raise FileNotFoundError(f"no index for {path}")
