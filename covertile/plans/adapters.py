"""Domain views of the standard star-schema tables, in Spark; ``VIEWS`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "DATE'1992-01-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads: ship day to ship day + quantity."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.expr(EPOCH)).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"),
        start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_linenumber").alias("mapq"), F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("part"),
    )


def read_regions(reads: DataFrame) -> DataFrame:
    """``sample, chrom, from, to``: every sample with every contig, to the contig's last base in any sample."""
    ends = reads.groupBy("chrom").agg(F.max("end").alias("to"))
    pairs = reads.select("sample", "chrom").distinct()
    return pairs.join(ends, "chrom").select("sample", "chrom", F.lit(0).cast("bigint").alias("from"), "to")


def index_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as index tiles: segment, priority, and sums per 16 days."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.expr(EPOCH)).cast("bigint")
    # prices have two decimals, so sums of whole cents are exact in any order
    joined = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.floor(day / 16).alias("tile")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return joined.groupBy(F.col("c_mktsegment").alias("sample"), F.col("o_orderpriority").alias("chrom"), "tile").agg(cents.alias("size"))


def tile_contigs(tiles: DataFrame) -> DataFrame:
    ends = tiles.groupBy("chrom").agg(((F.max("tile") + 1) * 16_384).alias("length"))
    return ends.withColumn("ord", F.row_number().over(Window.orderBy("chrom")) - 1)


def calls_and_truths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items of odd orders as calls; of even orders as truths that the orders' flags carry."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.expr(EPOCH)).cast("bigint") * 1000
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint") * 4000).alias("end"),
        F.col("l_returnflag").alias("sample"), F.least(F.col("l_linenumber") - 1, F.lit(4)).alias("cn"), (F.col("l_orderkey") % 2).alias("odd"),
    )
    calls = rows.where("odd = 1").drop("odd")
    truths = rows.where("odd = 0").groupBy("chrom", "start", "end", "cn").agg(F.array_sort(F.collect_set("sample")).alias("samples"))
    return calls, truths


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All line items as intervals of their supplier, a contig each: of odd orders, and of even orders."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.expr(EPOCH)).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("part"),
    )
    return rows.where("read_id % 2 = 1"), rows.where("read_id % 2 = 0")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value")


#: DuckDB versions of the views above; queries put ``WITH`` before the ones that they name.
VIEWS = {
    "aln": """aln AS (SELECT l_returnflag AS sample, 'c' || (l_suppkey % 5) AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s,
        date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT AS e, l_linenumber AS mapq, l_orderkey AS read_id FROM lineitem)""",
    "regions": "regions AS (SELECT p.sample, p.chrom, m.t FROM (SELECT DISTINCT sample, chrom FROM aln) p JOIN (SELECT chrom, max(e) AS t FROM aln GROUP BY chrom) m USING (chrom))",
    "tiles": """tiles AS (SELECT c_mktsegment AS sample, o_orderpriority AS chrom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) // 16 AS tile,
        sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "contigs": "contigs AS (SELECT chrom, (max(tile) + 1) * 16384 AS length FROM tiles GROUP BY chrom)",
    "medians": """med_r AS (SELECT sample, size, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY sample) AS n FROM tiles WHERE size > 0 WINDOW w AS (PARTITION BY sample ORDER BY size)),
        med_c AS (SELECT sample, max(size) FILTER (r = floor(n * 0.98)::BIGINT) AS cap FROM med_r GROUP BY sample),
        med_s AS (SELECT sample, size, r, sum(least(size, cap)) OVER (PARTITION BY sample ORDER BY r) AS run, sum(least(size, cap)) OVER (PARTITION BY sample) AS whole FROM med_r JOIN med_c USING (sample)),
        medians AS (SELECT sample, min_by(size, r) AS median FROM med_s WHERE run > floor(whole / 2) GROUP BY sample)""",
    "depths": "depths AS (SELECT sample, chrom, tile, least(size::DOUBLE / median, 50000.0) AS depth FROM tiles JOIN medians USING (sample))",
    "curve": """slot_n AS (SELECT sample, chrom, greatest(0, least(69, floor(least(depth, 10.0) * (70 * (2 / 3)) + 0.5)))::INT AS slot, count(*) AS n FROM depths GROUP BY ALL),
        slots AS (SELECT sample, chrom, slot::INT AS slot, coalesce(n, 0) AS n FROM (SELECT sample, chrom, unnest(range(0, 70)) AS slot FROM (SELECT DISTINCT sample, chrom FROM slot_n)) LEFT JOIN slot_n USING (sample, chrom, slot)),
        curve AS (SELECT sample, chrom, slot, n, slot / (70 * (2 / 3)) AS x, sum(n) OVER (PARTITION BY sample, chrom ORDER BY slot DESC) / sum(n) OVER (PARTITION BY sample, chrom) AS share FROM slots)""",
    "calls": """rows AS (SELECT l_suppkey::VARCHAR AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000 AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000 + l_quantity::BIGINT * 4000 AS e,
        l_returnflag AS sample, least(l_linenumber - 1, 4) AS cn, l_orderkey % 2 AS odd FROM lineitem),
        calls AS (SELECT DISTINCT chrom, s, e, sample, cn FROM rows WHERE odd = 1),
        own AS (SELECT DISTINCT chrom, s, e, sample, cn FROM rows WHERE odd = 0),
        names AS (SELECT DISTINCT sample FROM rows),
        absent AS (SELECT t.*, names.sample FROM (SELECT DISTINCT chrom, s, e, cn FROM own) t, names EXCEPT SELECT chrom, s, e, cn, sample FROM own)""",
}


def sql(views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(VIEWS[v] for v in views.split()) + "\n" + body
