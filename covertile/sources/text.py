"""Tab-separated formats, read by Spark's text and CSV readers."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged
from ..functions.text import depth_file_name, region, short_name


def fasta_index(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """``chrom, length, ord`` in file-offset order; an error if no contig is left."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, length bigint, offset bigint, line_bases int, line_width int")
    if chrom is not None:
        rows = rows.where(F.col("chrom") == chrom)
    out = rows.select("chrom", "length", (F.row_number().over(Window.orderBy("offset")) - 1).alias("ord"))  # an index has some thousand lines
    if out.isEmpty():
        raise ValueError(f"no contigs in {path}")
    return out


def bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``chrom, start, end`` of one or several files; comments, headers and empty intervals go."""
    lines = spark.read.text(paths).where("NOT (value LIKE '#%' OR value LIKE 'track%' OR value LIKE 'browser%')")
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("chrom"), parts[1].try_cast("bigint").alias("start"), parts[2].try_cast("bigint").alias("end"))
    return rows.where("start < end")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions as text, ``chrom:start-end`` or tab-separated."""
    return spark.read.text(path).select(region(F.col("value")).alias("r")).where("r IS NOT NULL").select("r.*")


def cram_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``sample, ref_id, ord, start, span, container, slice, bytes`` of gzip-compressed CRAM indexes.

    Lines without exactly six integers are an error; unmapped slices are skipped; a negative span ends
    its file.  Order is the line's place in its file; an index has some thousand lines per contig.
    """
    names = ["ref_id", "start", "span", "container", "slice", "bytes"]
    numbers = F.transform(F.split("value", "\t"), lambda x: x.try_cast("bigint"))

    def work(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                kept = [x for x in (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode().split("\n") if x]
                yield pd.DataFrame({"path": path, "ord": range(len(kept)), "value": kept})

    # the files' names do not end in .gz, so Spark's text reader would not unpack them
    files = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(work, "path string, ord bigint, value string")
    lines = files.select("path", "ord", numbers.alias("v"))
    wrong = F.raise_error(F.concat(F.lit("expected six integers in "), F.col("path"))).cast("array<bigint>")
    lines = lines.withColumn("v", F.when((F.size("v") == len(names)) & ~F.exists("v", lambda x: x.isNull()), F.col("v")).otherwise(wrong))
    rows = lines.select("path", "ord", *(F.col("v")[i].alias(n) for i, n in enumerate(names)))
    ended = F.max(F.when(F.col("span") < 0, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("ord"))
    return rows.withColumn("_ended", ended).where("_ended = 0 AND ref_id <> -1").select(short_name(F.col("path")).alias("sample"), "ref_id", "ord", *names[1:])


def depth_windows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``sample, chrom, start, end, depth`` of window files; means are rounded half up, the sample comes from the file's name."""
    parts = F.split("value", "\t")
    rows = spark.read.text(paths).where("NOT value LIKE '#%'").select(F.input_file_name().alias("path"), parts.alias("p"))
    cols = [F.col("p")[0].alias("chrom"), F.col("p")[1].cast("bigint").alias("start"), F.col("p")[2].cast("bigint").alias("end"), F.floor(F.col("p")[3].cast("double") + 0.5).cast("bigint").alias("depth")]
    return rows.select(depth_file_name(F.col("path")).alias("sample"), *cols)


def depth_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end, sample, depth`` of a multi-sample file whose first line names the samples."""
    head = spark.read.text(path).first()["value"]
    if not head.startswith(("#", "chrom")):
        raise ValueError("the first line names no samples")
    samples = head.split("\t")[3:]
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value") != head)
    pairs = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.transform(F.slice(parts, 4, len(samples)), lambda x: x.cast("double")).alias("depth"))
    return rows.select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"), F.inline(pairs)).toDF("chrom", "start", "end", "sample", "depth")


def copy_number_calls(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """``chrom, start, end, cn, samples``; with ``samples``, only rows that hold one of them."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT value LIKE '#%' AND value <> ''")
    out = rows.select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"), parts[3].cast("int").alias("cn"), F.split(parts[4], ",").alias("samples"))
    return out if samples is None else out.where(F.arrays_overlap("samples", F.array(*map(F.lit, samples))))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, sequence``: records split at ``>``; a contig is one row."""
    records = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    lines = F.split("value", "\n")
    return records.select(F.split(lines[0], r"\s")[0].alias("chrom"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("sequence"))


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, sequence, after``: the sequence line by line with its position, and the first base of the next line of its contig.

    Lines stay in Spark's splits of the file.  A line's contig and position come from the headers and lengths before it: sums
    inside a split, and one row a split for what the splits before it hold, so no contig is ever one row.
    """
    line = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("at"))
    rows = staged(line.where("value <> ''").select("_range", "at", "value", F.col("value").startswith(">").alias("head")), "fasta")
    name, length = F.when(F.col("head"), F.split(F.expr("substring(value, 2)"), r"\s")[0]), F.when(F.col("head"), 0).otherwise(F.length("value")).cast("bigint")
    first = F.when(~F.col("head"), F.substring("value", 1, 1)).otherwise("")
    inside = Window.partitionBy("_range").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_name", F.last(name, ignorenulls=True).over(upto)).withColumn("_sum", F.sum(length).over(upto)).withColumn("_base", F.last(F.when(F.col("head"), F.col("_sum")), ignorenulls=True).over(upto))
    own = own.withColumn("after", F.lead(first).over(inside))
    # a row a split: its last header, the bases behind that header, and its first line
    summary = rows.withColumn("_sum", F.sum(length).over(upto)).groupBy("_range").agg(
        F.max_by(F.struct(name.alias("n"), F.col("_sum").alias("s")), F.when(F.col("head"), F.col("at"))).alias("h"), F.sum(length).alias("_all"), F.min_by(first, "at").alias("_first"),
    )
    along = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_all").over(before), F.lit(0))
    summary = summary.withColumn("_total", total).withColumn("_last", F.last(F.struct(F.col("h.n").alias("n"), (F.col("h.s") + F.col("_total")).alias("s")), ignorenulls=True).over(before))
    heads = summary.withColumn("_e", F.when(F.col("h.n").isNotNull(), F.struct(F.col("h.n").alias("n"), (F.col("h.s") + F.col("_total")).alias("s"))))
    heads = heads.select("_range", "_total", F.last("_e", ignorenulls=True).over(before).alias("_before"), F.lead("_first").over(along).alias("_next"))
    met = own.join(F.broadcast(heads), "_range")  # a row a split of the file
    place = F.when(F.col("_base").isNotNull(), F.col("_sum") - F.col("_base")).otherwise(F.col("_sum") + F.col("_total") - F.col("_before.s"))
    found = met.where("NOT head").select(F.coalesce("_name", "_before.n").alias("chrom"), (place - F.length("value")).alias("start"), F.col("value").alias("sequence"), F.coalesce("after", "_next", F.lit("")).alias("after"))
    return found
