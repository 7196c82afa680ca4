"""Text sinks: tables with formatted numbers as tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import significant


def formatted(df: DataFrame, digits: int = 3, keep: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Doubles as text with so many significant digits."""
    numbers = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[significant(F.col(c), digits).alias(c) if c in numbers and c not in keep else F.col(c) for c in df.columns])


def fixed(number: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", number)


def write_tsv(df: DataFrame, path: str, order: list[str], header: bool = True, compress: bool = False, without: tuple[str, ...] = ()) -> None:
    """Rows in range-partitioned order: the part files' names follow it, so no task sorts all rows.  Columns ``without`` only order."""
    df.orderBy(*order).drop(*without).write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip" if compress else "none")


def curve_rows(curve: DataFrame, samples: list[str]) -> DataFrame:
    """The coverage curves as a table: ``chrom, x`` and a column per sample."""
    return curve.groupBy("chrom", "slot", "x").pivot("sample", samples).agg(F.first("share")).drop("slot")
