"""Where a cohort's contigs come from, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import same_contig
from .binary import bam_headers, header_contigs
from .text import fasta_index


def contigs_of(spark: SparkSession, paths: list[str], fasta_index_path: str | None = None, chrom: str | None = None) -> DataFrame:
    """``chrom, length, ord``: of the first BAM file's header, else of the FASTA index; an error without either."""
    for path in paths:
        if path.endswith(".bam"):
            found = header_contigs(bam_headers(spark, path), chrom).drop("path")
            if found.isEmpty():
                raise ValueError(f"no contigs in {path}")
            return found
    if fasta_index_path is None:
        raise ValueError("neither a BAM file nor a FASTA index names the contigs")
    return fasta_index(spark, fasta_index_path, chrom)


def find_contig(contigs: DataFrame, name: str) -> DataFrame:
    """The contig of that name, with or without ``chr`` in front."""
    return contigs.where(same_contig(F.col("chrom"), F.lit(name)))


def contig_length(contigs: DataFrame, name: str) -> int:
    """The length of exactly that contig; an error if there is none."""
    row = contigs.where(F.col("chrom") == name).select("length").first()
    if row is None:
        raise ValueError(f"no contig {name}")
    return int(row["length"])
