"""Names, regions, contigs and sequence composition as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: contigs that are left out by default.
EXCLUDE_CONTIGS = r"^chrEBV$|^NC|_random$|Un_|^HLA\-|_alt$|hap\d$"
#: Fixed value: a region as text, 1-based with "-" or 0-based tab-separated; the contig may hold colons.
REGION = r"^(.+?)[:\t](\d+)([\-\t])(\d+)"


def excluded(chrom: Column, pattern: str = EXCLUDE_CONTIGS) -> Column:
    return chrom.rlike(pattern)


def bare_contig(chrom: Column) -> Column:
    """The contig's name without a leading ``chr``."""
    return F.regexp_replace(chrom, "^chr", "")


def same_contig(a: Column, b: Column) -> Column:
    return bare_contig(a) == bare_contig(b)


def is_sex_contig(chrom: Column, sexes: tuple[str, ...] = ("X", "Y")) -> Column:
    return bare_contig(chrom).isin([s.removeprefix("chr") for s in sexes])


def region(text: Column) -> Column:
    """``struct(chrom, start, end)``, 0-based and half-open; null where the text is no region."""
    start = F.regexp_extract(text, REGION, 2).try_cast("bigint")
    shift = F.when(F.regexp_extract(text, REGION, 3) == "-", 1).otherwise(0)
    found = F.struct(F.regexp_extract(text, REGION, 1).alias("chrom"), F.greatest(start - shift, F.lit(0)).alias("start"), F.regexp_extract(text, REGION, 4).try_cast("bigint").alias("end"))
    return F.when(text.rlike(REGION), found)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_name(path: Column) -> Column:
    """A sample's name from its file: the stem, or all dotted parts but the last joined by ``-``."""
    parts = F.split(base_name(path), r"\.")
    return F.when(F.size(parts) <= 2, parts[0]).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-"))


def depth_file_name(path: Column) -> Column:
    """A depth file's sample: its base name without ``.gz``, ``.bed`` and ``.depth``, in this order, once each."""
    out = base_name(path)
    for end in ("gz", "bed", "depth"):
        out = F.regexp_replace(out, rf"\.{end}$", "")
    return out


def composition(sequence: Column) -> Column:
    """``struct(gc, cpg, masked)``: shares of G or C, of CpG pairs (twice per base), of lower case; null if empty."""
    n = F.length(sequence)
    upper = F.upper(sequence)
    count = lambda text, chars: n - F.length(F.translate(text, chars, ""))
    pairs = (n - F.length(F.replace(upper, F.lit("CG"), F.lit("")))) / 2
    return F.when(
        n > 0,
        F.struct(
            (count(upper, "GC") / n).alias("gc"),
            (2 * pairs / n).alias("cpg"),
            (count(sequence, "abcdefghijklmnopqrstuvwxyz") / n).alias("masked"),
        ),
    )


def significant(number: Column, digits: int) -> Column:
    """A number as text with so many significant digits and no trailing zeros, in the style of C's ``%g``."""
    magnitude = F.floor(F.log10(F.abs(number)))
    rounded = F.format_string(f"%.{digits - 1}e", number)
    exponent = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(rounded, r"^(-?[\d.]+)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for e in range(-4, digits):
        plain = F.when(exponent == e, F.format_string(f"%.{max(0, digits - 1 - e)}f", number)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(number.isNull() | F.isnan(number), "NaN").when(number == 0, "0").when(magnitude.isNull(), None).when((exponent < -4) | (exponent >= digits), scientific).otherwise(plain)


def tick_label(position: Column) -> Column:
    """Axis labels in millions or thousands of bases."""
    return F.when(position >= 1_000_000, F.concat(significant(position / 1e6, 4), F.lit("MB"))).when(position >= 1_000, F.concat(significant(position / 1e3, 4), F.lit("KB"))).otherwise(position.cast("string"))
