"""Queries of the operators on the standard tables, and the same results in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import math as fm
from ..functions import text as ft
from ..operators.sequences import ranked
from ..operators import copynumber, depth, evaluation, intervals, matrix, ranks, readstats, split, tiles
from .. import tools
from ..sources import bam
from ..staging import shared_dir, staged
from .adapters import alignments, calls_and_truths, index_tiles, order_sides, read_regions, signal, sql, table, tile_contigs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return put


SEXES = ("1-URGENT", "5-LOW")  # the priorities that stand for sex contigs
_SEX = "('1-URGENT', '5-LOW')"


# ---- depth ----------------------------------------------------------------------------------
_WINDOWS = """w AS (SELECT sample, chrom, k * 50 AS s, least((k + 1) * 50, t) AS e FROM (SELECT sample, chrom, t, unnest(range(0, (t + 49) // 50)) AS k FROM regions)),
p AS (SELECT sample, chrom, unnest(range(s, e)) AS pos FROM aln WHERE mapq >= 1),
means AS (SELECT w.sample, w.chrom, w.s, w.e, count(p.pos) / (w.e - w.s) AS mean FROM w LEFT JOIN p ON p.sample = w.sample AND p.chrom = w.chrom AND p.pos // 50 = w.s // 50 GROUP BY w.sample, w.chrom, w.s, w.e)"""


def _windows(spark, d) -> DataFrame:
    reads = alignments(spark, d)
    return depth.window_means(depth.usable(reads), read_regions(reads), 50)


@query("depth_windows", sql("aln regions", ", " + _WINDOWS + ' SELECT sample, chrom, s AS start, e AS "end", round(mean, 6) AS mean FROM means').replace("\n, w AS", ", w AS"))
def depth_windows(spark, d):
    return _windows(spark, d).withColumn("mean", F.round("mean", 6))


@query("pileup", sql("aln", "SELECT sample, chrom, pos, count(*) AS depth FROM (SELECT sample, chrom, unnest(range(s, e)) AS pos FROM aln WHERE mapq >= 2) GROUP BY ALL"))
def pileup(spark, d):
    return depth.pileup(depth.usable(alignments(spark, d), 2))


_CLASSES = """, p AS (SELECT sample, chrom, unnest(range(0, t)) AS pos FROM regions), q AS (SELECT sample, chrom, unnest(range(s, e)) AS pos FROM aln),
c AS (SELECT p.sample, p.chrom, p.pos, count(q.pos) AS n FROM p LEFT JOIN q USING (sample, chrom, pos) GROUP BY ALL),
k AS (SELECT *, CASE WHEN n = 0 THEN 'NO_COVERAGE' WHEN n < 40 THEN 'LOW_COVERAGE' WHEN n >= 90 THEN 'EXCESSIVE_COVERAGE' ELSE 'CALLABLE' END AS class FROM c),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY sample, chrom, class ORDER BY pos) AS run FROM k)
SELECT sample, chrom, min(pos) AS start, max(pos) + 1 AS "end", class FROM r GROUP BY sample, chrom, class, run"""


@query("callable_blocks", sql("aln regions", _CLASSES))
def callable_blocks(spark, d):
    reads = alignments(spark, d)
    return depth.class_blocks(reads, read_regions(reads), least=40, most=90)


_SITES = """, q AS (SELECT sample, chrom, unnest(range(s, e)) AS pos FROM aln), c AS (SELECT sample, chrom, pos, count(*) AS n FROM q GROUP BY ALL),
t AS (SELECT chrom, pos FROM c WHERE n >= 45 GROUP BY ALL HAVING count(*) > 2),
g AS (SELECT chrom, pos, CASE WHEN pos - (lag(pos) OVER w + 1) <= 10 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
i AS (SELECT chrom, pos, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM g),
b AS (SELECT chrom, min(pos) AS s, max(pos) + 1 AS e FROM i GROUP BY chrom, island HAVING count(*) >= 15)"""


def _blocks(spark, d) -> tuple[DataFrame, DataFrame]:
    segments = staged(depth.pileup_segments(alignments(spark, d)), "segments")
    return segments, depth.site_blocks(depth.sufficient_runs(None, 3, least=45, share=0.5, segments=segments))


@query("sample_blocks", sql("aln", _SITES + ' SELECT chrom, s AS start, e AS "end" FROM b'))
def sample_blocks(spark, d):
    return _blocks(spark, d)[1]


@query("block_means", sql("aln", _SITES + ' SELECT b.chrom, b.s AS start, b.e AS "end", c.sample, round(sum(c.n) / (b.e - b.s), 6) AS mean FROM b JOIN c ON c.chrom = b.chrom AND c.pos >= b.s AND c.pos < b.e GROUP BY b.chrom, b.s, b.e, c.sample'))
def block_means(spark, d):
    segments, blocks = _blocks(spark, d)
    return depth.block_means(None, blocks, 1024, segments).withColumn("mean", F.round("mean", 6))


_WIDE = f""", {_WINDOWS}, g AS (SELECT *, (row_number() OVER (PARTITION BY sample, chrom ORDER BY s) - 1) // 4 AS k FROM means),
z AS (SELECT sample, chrom, min(s) AS s, max(e) AS e, sum(floor(mean + 0.5))::BIGINT AS depth FROM g GROUP BY sample, chrom, k)"""


@query("window_matrix", sql("aln regions", _WIDE + """ SELECT chrom, s AS start, e AS "end", coalesce(max(depth) FILTER (sample = 'A'), 0) AS "A", coalesce(max(depth) FILTER (sample = 'N'), 0) AS "N",
coalesce(max(depth) FILTER (sample = 'R'), 0) AS "R" FROM z GROUP BY chrom, s, e"""))  # fmt: skip
def window_matrix(spark, d):
    return depth.to_matrix(depth.widened(_windows(spark, d), 4), ["A", "N", "R"], "depth")


@query("misaligned_windows", sql("aln regions", _WIDE + ' SELECT chrom, s AS start, e AS "end", count(DISTINCT sample) AS samples FROM z GROUP BY ALL HAVING count(DISTINCT sample) <> 3'))
def misaligned_windows(spark, d):
    return depth.misaligned(depth.widened(_windows(spark, d), 4), 3)


_UNEVEN = """, pts AS (SELECT sample, chrom, unnest(range(s, e)) AS pos FROM aln), cnt AS (SELECT sample, chrom, pos, count(*) AS n FROM pts GROUP BY ALL),
seg AS (SELECT sample, chrom, n, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample, chrom, n ORDER BY pos) AS run FROM cnt) GROUP BY sample, chrom, n, run),
w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY s) AS k FROM seg),
b AS (SELECT sample, chrom, 1::BIGINT AS k FROM w WHERE k = 1
    UNION ALL SELECT b.sample, b.chrom, min(w.k) + 1 FROM b JOIN w o ON o.sample = b.sample AND o.chrom = b.chrom AND o.k = b.k JOIN w ON w.sample = b.sample AND w.chrom = b.chrom AND w.e >= o.s + 100 GROUP BY b.sample, b.chrom, b.k),
z AS (SELECT w.*, max(b.k) AS own FROM w JOIN b ON b.sample = w.sample AND b.chrom = w.chrom AND b.k <= w.k GROUP BY ALL)
SELECT sample, chrom, min(s) AS start, max(e) AS "end", sum(n)::BIGINT AS depth FROM z GROUP BY sample, chrom, own"""


@query("uneven_windows", sql("aln", _UNEVEN))
def uneven_windows(spark, d):
    """Stretches of one depth, of any length, as windows that gather until they span 100 positions."""
    return depth.widened_to(depth.pileup_segments(alignments(spark, d)), 100, "depth")


# ---- interval algebra: line items of odd orders against those of even orders, a contig a supplier ----
_SIDES = "sides AS (SELECT l_suppkey::VARCHAR AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e, l_orderkey AS read_id, l_linenumber AS part FROM lineitem), a AS (SELECT * FROM sides WHERE read_id % 2 = 1), b AS (SELECT * FROM sides WHERE read_id % 2 = 0)"
_POINTS = "WITH " + _SIDES + ", pa AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS pos FROM a), pb AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS pos FROM b), x AS ({points}), r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM x) SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\" FROM r GROUP BY chrom, run"
_PAIRS = "WITH " + _SIDES + ' SELECT a.chrom, a.read_id, a.part, a.s AS start, a.e AS "end", b.read_id AS other_read_id, b.part AS other_part, b.s AS other_start, b.e AS other_end FROM a JOIN b ON a.chrom = b.chrom AND a.e > b.s AND a.s < b.e'
_EXISTS = "WITH " + _SIDES + ' SELECT chrom, read_id, part, s AS start, e AS "end" FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.e > b.s AND a.s < b.e)'
_UNION = _POINTS.format(points="SELECT * FROM pa UNION SELECT * FROM pb")
_MINUS = _POINTS.format(points="SELECT * FROM pa EXCEPT SELECT * FROM pb")
_BOTH = _POINTS.format(points="SELECT * FROM pa INTERSECT SELECT * FROM pb")
_NEITHER = _POINTS.format(points="SELECT chrom, unnest(range(0, t)) AS pos FROM (SELECT chrom, max(e) AS t FROM sides GROUP BY chrom) EXCEPT (SELECT * FROM pa UNION SELECT * FROM pb)")


# every query has its older name, ``all_...``, too
@query("overlap_pairs", _PAIRS)
@query("all_overlap_pairs", _PAIRS)
def overlap_pairs(spark, d):
    met = intervals.overlap_join(*order_sides(spark, d), ["chrom"], 32)
    return met.select("chrom", "read_id", "part", "start", "end", *(F.col(f"{c}_b").alias(f"other_{c}") for c in ("read_id", "part", "start", "end")))


@query("overlap_exists", _EXISTS)
@query("all_overlap_exists", _EXISTS)
def overlap_exists(spark, d):
    return intervals.overlapping(*order_sides(spark, d), ["chrom"], 32, ["chrom", "read_id", "part", "start", "end"])


@query("interval_merge", _UNION)
@query("all_interval_merge", _UNION)
def interval_merge(spark, d):
    a, b = order_sides(spark, d)
    return intervals.merge(a.unionByName(b), ["chrom"])


@query("interval_subtract", _MINUS)
@query("all_interval_subtract", _MINUS)
def interval_subtract(spark, d):
    return intervals.subtract(*order_sides(spark, d), ["chrom"])


@query("interval_intersect", _BOTH)
@query("all_interval_intersect", _BOTH)
def interval_intersect(spark, d):
    return intervals.intersect(*order_sides(spark, d), ["chrom"])


@query("interval_complement", _NEITHER)
@query("all_interval_complement", _NEITHER)
def interval_complement(spark, d):
    a, b = order_sides(spark, d)
    both = a.unionByName(b)
    return intervals.complement(both, both.groupBy("chrom").agg(F.max("end").alias("length")), ["chrom"])


@query("interval_total", sql("aln", "SELECT sum(e - s)::BIGINT AS total FROM aln"))
def interval_total(spark, d):
    return intervals.total_length(alignments(spark, d))


# ---- index tiles ----------------------------------------------------------------------------
def _depths(spark, d) -> DataFrame:
    return tiles.scaled(index_tiles(spark, d))


@query("tile_medians", sql("tiles medians", "SELECT * FROM medians"))
def tile_medians(spark, d):
    return tiles.medians(index_tiles(spark, d))


@query("tile_depths", sql("tiles medians depths", "SELECT sample, chrom, tile, round(depth, 6) AS depth FROM depths"))
def tile_depths(spark, d):
    return _depths(spark, d).withColumn("depth", F.round("depth", 6))


_BED = ", ".join(f"round(coalesce(max(depth) FILTER (sample = '{s}'), 0), 6) AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))


@query("tile_matrix", sql("tiles medians depths", f'SELECT chrom, tile * 16384 AS start, (tile + 1) * 16384 AS "end", {_BED} FROM depths GROUP BY chrom, tile'))
def tile_matrix(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = tiles.bed_matrix(_depths(spark, d), names)
    return wide.select("chrom", "start", "end", *(F.round(n, 6).alias(n) for n in names))


@query("slot_histogram", sql("tiles medians depths curve", "SELECT sample, chrom, slot, n FROM curve"))
def slot_histogram(spark, d):
    return tiles.slot_counts(_depths(spark, d))


@query("coverage_curve", sql("tiles medians depths curve", "SELECT sample, chrom, slot, round(x, 6) AS x, round(share, 6) AS share FROM curve"))
def coverage_curve(spark, d):
    return tiles.coverage_curve(_depths(spark, d)).withColumns({"x": F.round("x", 6), "share": F.round("share", 6)})


_COUNTERS = f""", full_grid AS (SELECT s.sample, c.chrom, c.tile FROM (SELECT DISTINCT sample FROM depths) s, (SELECT chrom, unnest(range(0, max(tile) + 1)) AS tile FROM depths WHERE chrom NOT IN {_SEX} GROUP BY chrom) c),
filled AS (SELECT g.sample, coalesce(depth, 0) AS depth FROM full_grid g LEFT JOIN depths USING (sample, chrom, tile)),
counters AS (SELECT sample, count(*) FILTER (depth < 0.85 OR depth > 1.15) AS n_out, count(*) FILTER (depth < 0.15) AS n_low, count(*) FILTER (depth > 1.15) AS n_hi, count(*) FILTER (depth BETWEEN 0.85 AND 1.15) AS n_in FROM filled GROUP BY sample)"""


@query("bin_counters", sql("tiles medians depths", _COUNTERS + " SELECT * FROM counters"))
def bin_counters(spark, d):
    return tiles.bin_counters(_depths(spark, d), SEXES)


_CN = f""", faint AS (SELECT sample, chrom, count(*) FILTER (depth > 0 AND depth < 0.02) / count(*) > 0.3 AS dropped FROM depths WHERE chrom IN {_SEX} GROUP BY sample, chrom),
cn_r AS (SELECT sample, chrom, depth, row_number() OVER (PARTITION BY sample, chrom ORDER BY depth) - 1 AS r, count(*) OVER (PARTITION BY sample, chrom) AS n FROM depths JOIN faint USING (sample, chrom) WHERE depth > 0 AND NOT (dropped AND depth < 0.02)),
cn AS (SELECT sample, chrom, 2 * max(depth) FILTER (r = floor(n * 0.4)) AS cn FROM cn_r GROUP BY sample, chrom)"""


@query("sex_copies", sql("tiles medians depths", _CN + " SELECT sample, chrom, round(cn, 6) AS cn FROM cn"))
def sex_copies(spark, d):
    return tiles.sex_copies(_depths(spark, d), SEXES).withColumn("cn", F.round("cn", 6))


_SLOPES = f""", steps AS (SELECT sample, chrom, max(share) FILTER (slot = 40) - max(share) FILTER (slot = 54) AS fall FROM curve
 WHERE chrom IN (SELECT chrom FROM depths GROUP BY chrom HAVING max(tile) + 1 > 100) AND chrom NOT IN {_SEX} GROUP BY sample, chrom),
slopes AS (SELECT sample, sum(fall * length / 1e6) / count(*) AS slope FROM steps JOIN contigs USING (chrom) GROUP BY sample)"""


@query("curve_slopes", sql("tiles medians depths curve contigs", _SLOPES + " SELECT sample, round(slope, 6) AS slope FROM slopes"))
def curve_slopes(spark, d):
    own = index_tiles(spark, d)
    return tiles.slopes(tiles.scaled(own), tile_contigs(own), SEXES).withColumn("slope", F.round("slope", 6))


@query("pedigree", sql("tiles medians depths curve contigs", _COUNTERS + _CN + _SLOPES + """ SELECT 'unknown' AS family_id, c.sample AS sample_id, '-9' AS paternal_id, '-9' AS maternal_id,
coalesce(floor(max(cn) FILTER (chrom = '1-URGENT') + 0.5)::INT, -9) AS sex, '-9' AS phenotype, round(coalesce(max(cn) FILTER (chrom = '1-URGENT'), -0.1), 6) AS cn_a, round(coalesce(max(cn) FILTER (chrom = '5-LOW'), -0.1), 6) AS cn_b,
n_out AS bins_out, n_low AS bins_lo, n_hi AS bins_hi, n_in AS bins_in, round(slope, 6) AS slope, round(n_out / n_in, 6) AS p_out
FROM counters c JOIN slopes USING (sample) LEFT JOIN cn ON cn.sample = c.sample GROUP BY c.sample, n_out, n_low, n_hi, n_in, slope"""))  # fmt: skip
def pedigree(spark, d):
    own = staged(index_tiles(spark, d), "tiles")
    out = tiles.pedigree(tiles.scaled(own), tile_contigs(own), SEXES)
    out = out.withColumnRenamed("cn_1-URGENT", "cn_a").withColumnRenamed("cn_5-LOW", "cn_b")
    return out.withColumns({c: F.round(c, 6) for c in ("cn_a", "cn_b", "slope", "p_out")})


@query("depth_line", sql("tiles medians depths", "SELECT sample, chrom, tile * 16384 AS x, round(least(depth, 2.5), 6) AS y FROM depths"))
def depth_line(spark, d):
    return tiles.depth_line(_depths(spark, d)).withColumn("y", F.round("y", 6))


@query("bins_scatter", sql("tiles medians depths", _COUNTERS + " SELECT sample, round(n_low / greatest(n_in + n_out, 1), 6) AS x, round(n_out / greatest(n_in + n_out, 1), 6) AS y FROM counters"))
def bins_scatter(spark, d):
    return tiles.bins_scatter(tiles.bin_counters(_depths(spark, d), SEXES)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("sex_scatter", sql("tiles medians depths", _CN + """ SELECT sample, round(max(cn) FILTER (chrom = '1-URGENT'), 6) AS x, round(max(cn) FILTER (chrom = '5-LOW'), 6) AS y, floor(max(cn) FILTER (chrom = '1-URGENT') + 0.5)::INT AS "group" FROM cn GROUP BY sample"""))
def sex_scatter(spark, d):
    return tiles.sex_scatter(tiles.sex_copies(_depths(spark, d), SEXES), *SEXES).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("mapped_scatter", "SELECT c_mktsegment AS sample, round(ln(1 + count(*) FILTER (o_orderstatus = 'F')), 6) AS x, round(ln(1 + count(*) FILTER (o_orderstatus <> 'F')), 6) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def mapped_scatter(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    stats = joined.groupBy(F.col("c_mktsegment").alias("sample"), F.col("o_orderpriority").alias("chrom")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("mapped"), F.count_if(F.col("o_orderstatus") != "F").alias("unmapped"))
    return tiles.mapped_scatter(stats).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("offset_sizes", "SELECT o_orderpriority AS sample, 'c' || (o_custkey % 7) AS chrom, row_number() OVER w - 1 AS tile, lead(o_orderkey) OVER w - o_orderkey AS size FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_custkey % 7 ORDER BY o_orderkey) QUALIFY size IS NOT NULL")
def offset_sizes(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sample"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("chrom"), F.col("o_orderkey").alias("voffset"))
    at = Window.partitionBy("sample", "chrom").orderBy("voffset")
    return tiles.sizes_from_offsets(orders.withColumn("tile", (F.row_number().over(at) - 1).cast("bigint")))


_NORMALISED = """, who AS (SELECT chrom, sample, max(tile) + 1 AS size, row_number() OVER (PARTITION BY chrom ORDER BY sample) AS i FROM depths GROUP BY chrom, sample),
sz AS (SELECT chrom, list(size ORDER BY i) AS size, list(sample ORDER BY i) AS names, count(*) AS n, max(size) AS last FROM who GROUP BY chrom),
rt AS MATERIALIZED (SELECT w.chrom, g.tile, list(coalesce(d.depth, 0.0) ORDER BY w.i) AS r FROM who w JOIN sz USING (chrom), unnest(range(0, last + 4)) AS g(tile) LEFT JOIN depths d ON d.chrom = w.chrom AND d.sample = w.sample AND d.tile = g.tile GROUP BY w.chrom, g.tile),
go AS (SELECT chrom, 0::BIGINT AS j, list_transform(size, lambda x: 0.0::DOUBLE) AS u1, list_transform(size, lambda x: 0.0::DOUBLE) AS u2, list_transform(size, lambda x: 0.0::DOUBLE) AS u3 FROM sz
    UNION ALL SELECT chrom, j + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN size[i] <= j OR count < 3 * n - 4 OR mean < 0.1 THEN r0[i] WHEN j > 2 AND size[i] - 3 > j THEN (u3[i] + u2[i] + u1[i] + r0[i] / mean + (r1[i] + r2[i] + r3[i]) / mean) / 7 ELSE r0[i] / mean END), u1, u2
    FROM (SELECT *, total / nullif(count, 0) AS mean FROM (SELECT go.*, n, size, a.r AS r0, b.r AS r1, c.r AS r2, d.r AS r3,
        list_sum(list_transform(range(1, n + 1), lambda i: (size[i] > j)::INT * (CASE WHEN j > 0 THEN 2 ELSE 1 END) + (size[i] > j + 1)::INT)) AS count,
        list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN size[i] > j THEN a.r[i] + (CASE WHEN j > 0 THEN u1[i] ELSE 0 END) ELSE 0 END + CASE WHEN size[i] > j + 1 THEN b.r[i] ELSE 0 END)) AS total
        FROM go JOIN sz USING (chrom) JOIN rt a ON a.chrom = go.chrom AND a.tile = j JOIN rt b ON b.chrom = go.chrom AND b.tile = j + 1 JOIN rt c ON c.chrom = go.chrom AND c.tile = j + 2 JOIN rt d ON d.chrom = go.chrom AND d.tile = j + 3 WHERE j < last))),
got AS (SELECT chrom, j - 1 AS tile, u1, unnest(range(1, n + 1)) AS i FROM go JOIN sz USING (chrom) WHERE j > 0)
SELECT names[i] AS sample, chrom, tile, round(u1[i], 6) AS depth FROM got JOIN sz USING (chrom) WHERE tile < size[i]"""


@query("normalised_tiles", sql("tiles medians depths", _NORMALISED))
def normalised_tiles(spark, d):
    return tiles.normalised(_depths(spark, d)).withColumn("depth", F.round("depth", 6))


def _leading(matrix_: str, name: str) -> str:
    """The first eigenvector of a symmetric matrix ``(i, j, v)``, by squaring the matrix thirty times, and the matrix less that component."""
    return f""", {name}_p AS (SELECT 0 AS n, i, j, v FROM {matrix_}
    UNION ALL SELECT n, i, j, v / sum(v) FILTER (i = j) OVER () FROM (SELECT a.n + 1 AS n, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_p a JOIN {name}_p b ON a.j = b.i WHERE a.n < 30 GROUP BY a.n, a.i, b.j)),
{name}_c AS (SELECT i, v, sum(v * v) OVER () AS q FROM {name}_p WHERE n = 30 AND j = (SELECT arg_max(i, v) FROM {name}_p WHERE n = 30 AND i = j)),
{name} AS (SELECT i, v / sqrt(q) AS u FROM {name}_c), {name}_l AS (SELECT sum(g.v * a.u * b.u) AS l FROM {matrix_} g JOIN {name} a ON a.i = g.i JOIN {name} b ON b.i = g.j),
{name}_rest AS (SELECT g.i, g.j, g.v - l * a.u * b.u AS v FROM {name}_l, {matrix_} g JOIN {name} a ON a.i = g.i JOIN {name} b ON b.i = g.j)"""


_PROJECTED = f""", qd AS (SELECT sample AS i, chrom, tile, floor(least(depth, 8.0) * (65535 / 8) + 0.5) AS q FROM depths WHERE chrom NOT IN {_SEX}),
who AS (SELECT DISTINCT i FROM qd), raw AS (SELECT a.i, b.i AS j, sum(a.q * b.q) AS v FROM qd a JOIN qd b USING (chrom, tile) GROUP BY a.i, b.i),
gm AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER () AS v FROM raw), tr AS (SELECT sum(v) AS t FROM gm WHERE i = j)""" + _leading("gm", "e1") + _leading("e1_rest", "e2") + _leading("e2_rest", "e3") + _leading("e3_rest", "e4") + """,
every AS (SELECT 1 AS component, i, u, l FROM e1, e1_l UNION ALL SELECT 2, i, u, l FROM e2, e2_l UNION ALL SELECT 3, i, u, l FROM e3, e3_l UNION ALL SELECT 4, i, u, l FROM e4, e4_l),
pr AS (SELECT component, raw.i, sum(raw.v * u) / sqrt(l) AS p, l / t AS share FROM every JOIN raw ON raw.j = every.i, tr GROUP BY component, raw.i, l, t)
SELECT i AS sample, component, round(p * sign(first_value(p) OVER (PARTITION BY component ORDER BY abs(p) DESC)), 2) AS projection, round(share, 6) AS share FROM pr"""


@query("sample_projections", sql("tiles medians depths", _PROJECTED))
def sample_projections(spark, d):
    return tiles.projections(_depths(spark, d), sexes=SEXES).withColumns({"projection": F.round("projection", 2), "share": F.round("share", 6)})


_PC = ", ".join(f"round(max(q) FILTER (component = {c}), 2) AS \"PC{c}\"" for c in range(1, 6))


@query("pedigree_components", sql("tiles medians depths curve contigs", _COUNTERS + _CN + _SLOPES + _PROJECTED.rsplit("\nSELECT", 1)[0] + f""",
pc AS (SELECT i, {_PC} FROM (SELECT i, component, p * sign(first_value(p) OVER (PARTITION BY component ORDER BY abs(p) DESC)) AS q FROM pr) GROUP BY i),
pd AS (SELECT 'unknown' AS family_id, c.sample AS sample_id, '-9' AS paternal_id, '-9' AS maternal_id,
coalesce(floor(max(cn) FILTER (chrom = '1-URGENT') + 0.5)::INT, -9) AS sex, '-9' AS phenotype, round(coalesce(max(cn) FILTER (chrom = '1-URGENT'), -0.1), 6) AS cn_a, round(coalesce(max(cn) FILTER (chrom = '5-LOW'), -0.1), 6) AS cn_b,
n_out AS bins_out, n_low AS bins_lo, n_hi AS bins_hi, n_in AS bins_in, round(slope, 6) AS slope, round(n_out / n_in, 6) AS p_out
FROM counters c JOIN slopes USING (sample) LEFT JOIN cn ON cn.sample = c.sample GROUP BY c.sample, n_out, n_low, n_hi, n_in, slope)
SELECT pd.*, pc."PC1", pc."PC2", pc."PC3", pc."PC4", pc."PC5" FROM pd LEFT JOIN pc ON pc.i = sample_id"""))  # fmt: skip
def pedigree_components(spark, d):
    own = staged(index_tiles(spark, d), "tiles")
    out = tools.index_coverage(own, tile_contigs(own), SEXES, None)["pedigree"]
    out = out.withColumnRenamed("cn_1-URGENT", "cn_a").withColumnRenamed("cn_5-LOW", "cn_b")
    return out.withColumns({**{c: F.round(c, 6) for c in ("cn_a", "cn_b", "slope", "p_out")}, **{f"PC{c}": F.round(f"PC{c}", 2) for c in range(1, 6)}})


# ---- even regions ---------------------------------------------------------------------------
_CHOP = """, sums AS (SELECT chrom, tile, sum(size)::DOUBLE / 1e9 AS size FROM tiles GROUP BY ALL), st AS (SELECT chrom, avg(size) AS m, coalesce(stddev_samp(size), 0) AS sd FROM sums GROUP BY chrom),
chop AS (SELECT chrom, tile, CASE WHEN size > m + 3 * sd THEN 8 * m ELSE size END AS size FROM sums JOIN st USING (chrom))"""


@query("chopped_tiles", sql("tiles", _CHOP + " SELECT chrom, tile, round(size, 6) AS size FROM chop"))
def chopped_tiles(spark, d):
    return split.chopped(split.cohort_sums(index_tiles(spark, d))).withColumn("size", F.round("size", 6))


@query("contig_shares", sql("tiles", _CHOP + " SELECT chrom, round(sum(size), 6) AS total, round(sum(size) / sum(sum(size)) OVER (), 6) AS share FROM chop GROUP BY chrom"))
def contig_shares(spark, d):
    return split.contig_shares(split.chopped(split.cohort_sums(index_tiles(spark, d)))).withColumns({"total": F.round("total", 6), "share": F.round("share", 6)})


_EVEN = _CHOP + """, tot AS (SELECT chrom, sum(size) AS total FROM chop GROUP BY chrom), ct AS (SELECT chrom, (max(tile) + 1) * 16384 AS length, max(tile) AS last FROM tiles GROUP BY chrom),
wn AS (SELECT chrom, greatest(1, floor(total / (SELECT sum(total) FROM tot) * 100))::HUGEINT AS want FROM tot),
ft AS (SELECT ct.chrom, g.tile, coalesce(round(chop.size * 1e9), 0)::HUGEINT AS amount, chop.size IS NOT NULL AND g.tile IN (30, 31) AS hard FROM ct, unnest(range(0, last + 1)) AS g(tile) LEFT JOIN chop ON chop.chrom = ct.chrom AND chop.tile = g.tile),
f AS MATERIALIZED (SELECT ft.*, want, length, last, sum(amount) OVER (PARTITION BY chrom)::HUGEINT AS whole FROM ft JOIN ct USING (chrom) JOIN wn USING (chrom)),
f2 AS MATERIALIZED (SELECT *, 20 * amount * want > 20 * whole OR (hard AND 20 * amount * want >= whole) AS heavy FROM f),
go AS (SELECT chrom, 0::BIGINT AS tile, 0::BIGINT AS begin, 0::HUGEINT AS held FROM ct
    UNION ALL SELECT go.chrom, go.tile + 1, CASE WHEN heavy OR (held + amount) * want >= whole OR (hard AND 5 * (held + amount) * want >= whole) THEN go.tile + 1 ELSE begin END,
        CASE WHEN heavy OR (held + amount) * want >= whole OR (hard AND 5 * (held + amount) * want >= whole) THEN 0 ELSE held + amount END FROM go JOIN f2 USING (chrom, tile)),
pt AS (SELECT *, CASE WHEN least(8, floor(0.5 + 2 * amount::DOUBLE * want / whole::DOUBLE)) >= 1 THEN least(8, floor(0.5 + 2 * amount::DOUBLE * want / whole::DOUBLE)) WHEN hard THEN 3 ELSE 1 END::BIGINT AS parts FROM f2),
out AS (SELECT go.chrom, begin * 16384 AS s, go.tile * 16384 AS e, held::DOUBLE / 1e9 AS total, 1 AS splits FROM go JOIN f2 USING (chrom, tile) WHERE heavy AND go.tile > begin
    UNION ALL SELECT chrom, tile * 16384 + k * floor(16384 / parts + 1)::BIGINT, least(tile * 16384 + (k + 1) * floor(16384 / parts + 1)::BIGINT, (tile + 1) * 16384), amount::DOUBLE / parts / 1e9, parts FROM (SELECT *, unnest(range(0, parts)) AS k FROM pt WHERE heavy)
    UNION ALL SELECT go.chrom, begin * 16384, (go.tile + 1) * 16384, (held + amount)::DOUBLE / 1e9, 1 FROM go JOIN f2 USING (chrom, tile) WHERE NOT heavy AND ((held + amount) * want >= whole OR (hard AND 5 * (held + amount) * want >= whole))
    UNION ALL SELECT go.chrom, begin * 16384, length, held::DOUBLE / 1e9, 1 FROM go JOIN ct ON ct.chrom = go.chrom AND go.tile = last + 1 WHERE begin * 16384 < length)
SELECT chrom, s AS start, e AS "end", round(total, 6) AS sum, splits::INTEGER AS splits FROM out WHERE s < e"""


@query("even_regions", sql("tiles", _EVEN))
def even_regions(spark, d):
    own = index_tiles(spark, d)
    hard = tile_contigs(own).select("chrom", F.lit(500_000).cast("bigint").alias("start"), F.lit(520_000).cast("bigint").alias("end"))
    return split.even_regions(own, tile_contigs(own), 100, hard).withColumn("sum", F.round("sum", 6))


# ---- evaluation of calls --------------------------------------------------------------------
_SIZE = "CASE WHEN e - s < 20000 THEN 'small' WHEN e - s < 100000 THEN 'middle' ELSE 'large' END"
_MATCH = "c.sample = t.sample AND c.chrom = t.chrom AND c.e > t.s AND c.s < t.e AND (least(c.e, t.e) - greatest(c.s, t.s)) / least(c.e - c.s, t.e - t.s) >= 0.4 AND least(c.cn, 3) = least(t.cn, 3)"
_EVAL = f""", scores AS (SELECT sample, {_SIZE} AS size_class, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn FROM (
SELECT sample, s, e, hit::INT AS tp, (NOT hit)::INT AS fn, 0 AS fp, 0 AS tn FROM (SELECT *, EXISTS (SELECT 1 FROM calls c WHERE {_MATCH}) AS hit FROM own t)
UNION ALL SELECT sample, s, e, 0, 0, 1, 0 FROM calls c WHERE NOT EXISTS (SELECT 1 FROM own t WHERE {_MATCH})
UNION ALL SELECT sample, s, e, 0, 0, 0, 1 FROM absent t WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE {_MATCH})) GROUP BY 1, 2)"""


@query("call_confusion", sql("calls", _EVAL + " SELECT * FROM scores"))
def call_confusion(spark, d):
    calls, truths = calls_and_truths(spark, d)
    return evaluation.confusion(calls, truths, 0.4, 100_000)


@query("call_accuracy", sql("calls", _EVAL + """ SELECT coalesce(size_class, 'all') AS size_class, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn,
round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) END, 6) AS recall FROM scores GROUP BY ROLLUP (size_class)"""))  # fmt: skip
def call_accuracy(spark, d):
    return evaluation.tabulated(call_confusion(spark, d)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("call_rates", sql("calls", _EVAL + " SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM scores"))
def call_rates(spark, d):
    return tools.call_report(*calls_and_truths(spark, d), 0.4, 100_000)["rows"].withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("truths_by_sample", sql("calls", 'SELECT chrom, s AS start, e AS "end", cn, sample FROM own'))
def truths_by_sample(spark, d):
    return evaluation.by_sample(calls_and_truths(spark, d)[1])


@query("truths_without_sample", sql("calls", 'SELECT chrom, s AS start, e AS "end", cn, sample FROM absent'))
def truths_without_sample(spark, d):
    calls, truths = calls_and_truths(spark, d)
    return evaluation.without_sample(truths, evaluation.all_samples(calls, truths))


# ---- reads and names ------------------------------------------------------------------------
def _reads(spark, d) -> DataFrame:
    """Line items as sequenced reads; lengths, flags and mates come from their numbers.

    Statistics of them take the usual million inserts; 100 reads are skipped, as small tables have no 100,000 to spare.
    """
    items = table(spark, d, "lineitem")
    pos = F.datediff(F.col("l_shipdate").cast("date"), F.expr("DATE'1992-01-01'")).cast("bigint")
    length = 50 + F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_linenumber") == 7, 4).when((F.col("l_orderkey") % 11) == 0, 1024).when((F.col("l_orderkey") % 13) == 0, 512).otherwise(F.when(F.col("l_partkey") % 4 != 0, 2).otherwise(0))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    items = ranked(items.select("l_returnflag", *order), order, "ord", ("l_returnflag",))
    return items.select(
        F.col("l_returnflag").alias("sample"), "ord", flag.alias("flag"), pos.alias("pos"), (pos + F.col("l_suppkey") % 300 - 20).alias("mate_pos"), (pos + length).alias("end"),
        (F.col("l_suppkey") % 300 + length).alias("tlen"), length.alias("read_len"), F.when(F.col("l_partkey") % 9 == 0, 2).otherwise(1).alias("n_cigar"), F.lit("M").alias("cigar_first"),
    )


_READS = """WITH reads AS (SELECT l_returnflag AS sample, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS ord,
CASE WHEN l_linenumber = 7 THEN 4 WHEN l_orderkey % 11 = 0 THEN 1024 WHEN l_orderkey % 13 = 0 THEN 512 WHEN l_partkey % 4 <> 0 THEN 2 ELSE 0 END AS flag,
date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos, pos + l_suppkey % 300 - 20 AS mate, pos + 50 + l_quantity::INT AS e, l_suppkey % 300 + 50 + l_quantity::INT AS tlen, 50 + l_quantity::INT AS len, l_partkey % 9 <> 0 AS plain FROM lineitem),
r AS (SELECT *, flag IN (0, 2) AS good, flag = 2 AND pos < mate AND plain AS ins FROM reads WHERE ord >= 100),
o AS (SELECT *, coalesce(sum(ins::INT) OVER w, 0) AS ni, coalesce(sum(good::INT) OVER w, 0) AS ng FROM r WINDOW w AS (PARTITION BY sample ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, good AND ng < 2000000 AS sized FROM o WHERE ni < 1000000 AND (ng <= 2000000 OR ni > 0)),
i AS (SELECT sample, mate - e AS v, row_number() OVER (PARTITION BY sample ORDER BY mate - e) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM u WHERE ins),
t AS (SELECT sample, tlen AS v, row_number() OVER (PARTITION BY sample ORDER BY tlen) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM u WHERE ins),
ib AS (SELECT sample, max(v) FILTER (k = n // 2) AS m, max(v) FILTER (k = n // 2 + 1 + (n - n // 2 - 1) // 2) AS h FROM i GROUP BY sample),
tb AS (SELECT sample, max(v) FILTER (k = n // 2) AS m, max(v) FILTER (k = n // 2 + 1 + (n - n // 2 - 1) // 2) AS h FROM t GROUP BY sample),
im AS (SELECT sample, avg(v) AS insert_mean, stddev_pop(v) AS insert_sd FROM i JOIN ib USING (sample) WHERE v <= m + 10 * (h - m) GROUP BY sample),
tm AS (SELECT sample, avg(v) AS template_mean, stddev_pop(v) AS template_sd FROM t JOIN tb USING (sample) WHERE v <= m + 10 * (h - m) GROUP BY sample),
ip AS (SELECT sample, max(v) FILTER (k = floor((n - 1) * 0.05 + 0.5)) AS insert_5, max(v) FILTER (k = floor((n - 1) * 0.95 + 0.5)) AS insert_95 FROM i GROUP BY sample),
l AS (SELECT sample, len, row_number() OVER (PARTITION BY sample ORDER BY len) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM u WHERE sized),
lm AS (SELECT sample, max(len) FILTER (k = (n - 1) // 2) AS read_median, avg(len) AS read_mean, max(len) AS read_max FROM l GROUP BY sample),
sh AS (SELECT sample, count(*) FILTER (flag IN (512, 1024)) / count(*) AS bad, count(*) FILTER (flag = 1024) / count(*) AS duplicate, count(*) FILTER (flag = 2) / count(*) AS proper, count(*) FILTER (flag = 4) / count(*) AS unmapped FROM u GROUP BY sample)
"""
_STATS = ["bad", "duplicate", "proper", "unmapped", "read_mean", "insert_mean", "insert_sd", "template_mean", "template_sd"]


@query("read_statistics", _READS + "SELECT sample, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS) + ", read_median, read_max, insert_5, insert_95 FROM sh LEFT JOIN lm USING (sample) LEFT JOIN ip USING (sample) LEFT JOIN im USING (sample) LEFT JOIN tm USING (sample)")
def read_statistics(spark, d):
    return readstats.statistics(_reads(spark, d), 1_000_000, 100).withColumns({c: F.round(c, 6) for c in _STATS})


@query("template_histogram", _READS + """, z AS (SELECT sample, v FROM t JOIN tb USING (sample) JOIN tm USING (sample) JOIN lm USING (sample) WHERE v <= m + 10 * (h - m) AND v >= read_max AND v <= template_mean + 4 * template_sd)
SELECT sample, v AS length, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share FROM z GROUP BY sample, v""")  # fmt: skip
def template_histogram(spark, d):
    return readstats.template_histogram(_reads(spark, d), 1_000_000, 100).withColumn("share", F.round("share", 6))


@query("stored_reads", """SELECT (l_suppkey % 5)::INTEGER AS ref_id, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000 AS pos, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000 + l_quantity::BIGINT * 10 AS "end",
l_linenumber::INTEGER AS mapq, (CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 2 END)::INTEGER AS flag, l_partkey AS tlen, (l_quantity * 10)::INTEGER AS read_len, l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR AS name FROM lineitem""")
def stored_reads(spark, d):
    """Line items written as alignment files with their indexes, and read back in chunks between indexed offsets."""
    pos = F.datediff(F.col("l_shipdate").cast("date"), F.expr("DATE'1992-01-01'")).cast("bigint") * 1000
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("ref_id"), pos.alias("pos"), (pos + F.col("l_quantity").cast("bigint") * 10).alias("end"), F.col("l_linenumber").alias("mapq"), F.when(F.col("l_partkey") % 4 == 0, 0).otherwise(2).alias("flag"),
        F.lit(-1).alias("mate_ref"), F.lit(-1).alias("mate_pos"), F.col("l_partkey").alias("tlen"), F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("name"),
    )
    path = f"{shared_dir(spark)}/covertile/reads-{uuid.uuid4().hex}"
    bam.write_bam(rows, path, [(f"c{k}", 1 << 28) for k in range(5)])
    return bam.read_bam(spark, path, 20_000).select("ref_id", "pos", "end", "mapq", "flag", "tlen", "read_len", "name")


@query("sample_names", "SELECT n_name AS file, list_sort(list(DISTINCT substr(s_name, 1, 14))) AS samples, count(DISTINCT substr(s_name, 1, 14)) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def sample_names(spark, d):
    groups = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("file"), F.substring("s_name", 1, 14).alias("sm"))
    return readstats.sample_names(groups)


_BASE = "string_split(url, '/')[-1]"


@query("path_names", f"""SELECT page_id, {_BASE} AS base, CASE WHEN len(string_split({_BASE}, '.')) <= 2 THEN string_split({_BASE}, '.')[1] ELSE array_to_string(string_split({_BASE}, '.')[:-2], '-') END AS name,
regexp_replace(regexp_replace(regexp_replace({_BASE}, '\\.gz$', ''), '\\.bed$', ''), '\\.depth$', '') AS depth_name FROM pages""")  # fmt: skip
def path_names(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", ft.base_name(F.col("url")).alias("base"), ft.short_name(F.col("url")).alias("name"), ft.depth_file_name(F.col("url")).alias("depth_name"))


@query("region_parse", sql("aln", "SELECT read_id, mapq AS part, chrom AS r_chrom, greatest(s - 1, 0) AS r_start, e AS r_end FROM aln"))
def region_parse(spark, d):
    reads = alignments(spark, d).select("read_id", "part", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("t"))
    return reads.select("read_id", "part", ft.region(F.col("t")).alias("r")).select("read_id", "part", F.col("r.chrom").alias("r_chrom"), F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"))


@query("contig_filter", "SELECT p_partkey, p_type, p_brand FROM part WHERE NOT regexp_matches(p_type, '^SMALL|_random$|TIN$')")
def contig_filter(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return parts.where(~ft.excluded(F.col("p_type"), "^SMALL|_random$|TIN$"))


@query("composition", """SELECT doc_id, round((length(text) - length(translate(upper(text), 'GC', ''))) / length(text), 6) AS gc, round((length(text) - length(replace(upper(text), 'CG', ''))) / length(text), 6) AS cpg,
round((length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', ''))) / length(text), 6) AS masked FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM documents)""")  # fmt: skip
def composition(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    return docs.select("doc_id", ft.composition(F.col("text")).alias("c")).select("doc_id", *(F.round(f"c.{x}", 6).alias(x) for x in ("gc", "cpg", "masked")))


_PIECES = """WITH t AS (SELECT doc_id::VARCHAR AS chrom, text, length(text) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT chrom, k * 250 AS s, least(n, k * 250 + 250) AS e, substr(text, k * 250 + 1, 250) AS x FROM (SELECT *, unnest(range(0, (n + 249) // 250)) AS k FROM t)),
y AS (SELECT *, replace(replace(x, 'c', 'C'), 'g', 'G') AS u FROM w)"""


@query("window_composition", _PIECES + """ SELECT chrom, s AS start, e AS "end", round((length(u) - length(translate(u, 'GC', ''))) / length(x), 6) AS gc, round((length(u) - length(replace(u, 'CG', ''))) / length(x), 6) AS cpg,
round((length(x) - length(translate(x, 'abcdefghijklmnopqrstuvwxyz', ''))) / length(x), 6) AS masked FROM y""")  # fmt: skip
def window_composition(spark, d):
    """Documents as contigs, wrapped into lines of 60 characters, and windows of 250."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("chrom"), "text", F.length("text").cast("bigint").alias("to"))
    # cut in one pass: a substring a line would walk each text, and carry it, once for every line
    cut = docs.select("chrom", F.regexp_extract_all("text", F.lit("(?s).{1,60}"), F.lit(0)).alias("cut"))
    lines = cut.select("chrom", F.expr("inline(transform(cut, (x, k) -> struct(k * 60L AS start, x AS sequence, coalesce(substring(get(cut, k + 1), 1, 1), '') AS after)))"))
    windows = intervals.grid(docs.select("chrom", F.lit(0).cast("bigint").alias("from"), "to"), 250)
    return depth.window_composition(windows, lines, width=60, levels=([0], [0])).withColumns({c: F.round(c, 6) for c in ("gc", "cpg", "masked")})


# ---- matrices -------------------------------------------------------------------------------
def _matrix(spark, d) -> DataFrame:
    """Window means with a covariate: the window's place on a circle, in whole steps."""
    means = _windows(spark, d).withColumnRenamed("mean", "depth")
    return means.withColumn("gc", (F.col("start") * 7) % 101)


_MATRIX = f", {_WINDOWS}, mx AS (SELECT sample, chrom, s AS start, e AS \"end\", mean AS depth, (s * 7) % 101 AS gc FROM means)"


@query("over_levels", sql("aln regions", _MATRIX + """, lr AS (SELECT sample, depth, row_number() OVER (PARTITION BY sample ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM mx WHERE depth > 0),
lv AS (SELECT sample, max(depth) FILTER (k = floor(n * 0.65)) AS level FROM lr GROUP BY sample) SELECT sample, chrom, start, "end", gc, round(depth / level, 6) AS depth FROM mx JOIN lv USING (sample)"""))  # fmt: skip
def over_levels(spark, d):
    return matrix.over_levels(_matrix(spark, d)).withColumn("depth", F.round("depth", 6))


@query("z_scores", sql("aln regions", _MATRIX + """ SELECT sample, chrom, start, "end", round(CASE WHEN sd > 1e-12 THEN (depth - m) / sd ELSE 0 END, 5) AS depth FROM (SELECT *, avg(depth) OVER w AS m, coalesce(stddev_samp(depth) OVER w, 0) AS sd FROM mx WINDOW w AS (PARTITION BY chrom, start, "end"))"""))
def z_scores(spark, d):
    return matrix.z_scored(_matrix(spark, d)).select("sample", "chrom", "start", "end", F.round("depth", 5).alias("depth"))


@query("row_centred", sql("aln regions", _MATRIX + ' SELECT sample, chrom, start, "end", round(depth - avg(depth) OVER (PARTITION BY chrom, start, "end"), 6) + 0.0 AS depth FROM mx'))
def row_centred(spark, d):
    return matrix.centred(_matrix(spark, d), matrix.SITE).select("sample", "chrom", "start", "end", (F.round("depth", 6) + F.lit(0.0)).alias("depth"))


@query("log_centred", sql("aln regions", _MATRIX + """, lg AS (SELECT *, log2(1 + depth) AS l FROM mx), lr AS (SELECT sample, l, row_number() OVER (PARTITION BY sample ORDER BY l) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM lg),
c AS (SELECT sample, max(l) FILTER (k = n // 2) AS m FROM lr GROUP BY sample) SELECT sample, chrom, start, "end", round(l - m, 6) + 0.0 AS depth FROM lg JOIN c USING (sample)"""))  # fmt: skip
def log_centred(spark, d):
    return matrix.log_centred(_matrix(spark, d)).select("sample", "chrom", "start", "end", (F.round("depth", 6) + F.lit(0.0)).alias("depth"))


@query("moving_median", sql("aln regions", _MATRIX + ' SELECT sample, chrom, start, "end", round(depth / greatest(1, quantile_cont(depth, 0.5) OVER (PARTITION BY sample ORDER BY gc, chrom, start, "end" ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), 6) AS depth FROM mx'))
def moving_median(spark, d):
    return matrix.moving_median(_matrix(spark, d), "gc").select("sample", "chrom", "start", "end", F.round("depth", 6).alias("depth"))


@query("edge_median", sql("aln regions", _MATRIX + """, l AS (SELECT sample, list(depth ORDER BY gc, chrom, start, "end") AS own, count(*) AS n FROM mx GROUP BY sample),
taken AS (SELECT sample, n, list_median(own[1:5]) AS early, list_concat(own[1:5], own[11:]) AS v FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY gc, chrom, start, "end") - 1 AS i FROM mx),
lv AS (SELECT sample, i, CASE WHEN i < 5 OR n < 11 THEN early ELSE list_median(v[greatest(1, least(i, n - 6) - 7):least(i, n - 6) + 1]) END AS level FROM r JOIN taken USING (sample))
SELECT sample, chrom, start, "end", gc, round(depth / greatest(1, level), 6) AS depth FROM r JOIN lv USING (sample, i)"""))  # fmt: skip
def edge_median(spark, d):
    return matrix.moving_median_with_edges(_matrix(spark, d), "gc").withColumn("depth", F.round("depth", 6))


@query("bucket_median", sql("aln regions", _MATRIX + """, g AS (SELECT DISTINCT sample, gc FROM mx),
begins AS (SELECT sample, min(gc) AS b FROM g GROUP BY sample UNION ALL SELECT begins.sample, min(g.gc) FROM begins JOIN g ON g.sample = begins.sample AND g.gc > begins.b + 5 GROUP BY begins.sample),
m AS (SELECT mx.sample, chrom, start, "end", gc, depth, max(b) AS b FROM mx JOIN begins ON begins.sample = mx.sample AND b <= gc GROUP BY ALL),
k AS (SELECT sample, b, depth, row_number() OVER (PARTITION BY sample, b ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY sample, b) AS n FROM m WHERE depth > 0),
c AS (SELECT sample, b, max(depth) FILTER (k = n // 2) AS centre FROM k GROUP BY sample, b)
SELECT m.sample, chrom, start, "end", gc, round(depth / coalesce(centre, 1), 6) AS depth FROM m LEFT JOIN c ON c.sample = m.sample AND c.b = m.b"""))  # fmt: skip
def bucket_median(spark, d):
    return matrix.bucketed(_matrix(spark, d), "gc", 5).withColumn("depth", F.round("depth", 6))


_DEBIASED = _MATRIX + """, mb AS (SELECT * FROM mx WHERE gc BETWEEN 5 AND 95), l AS (SELECT sample, list(depth ORDER BY gc, chrom, start, "end") AS own, count(*) AS n FROM mb GROUP BY sample),
taken AS (SELECT sample, n, list_median(own[1:5]) AS early, list_concat(own[1:5], own[11:]) AS v FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY gc, chrom, start, "end") - 1 AS i FROM mb),
lv AS (SELECT sample, i, CASE WHEN i < 5 OR n < 11 THEN early ELSE list_median(v[greatest(1, least(i, n - 6) - 7):least(i, n - 6) + 1]) END AS level FROM r JOIN taken USING (sample)),
free AS (SELECT sample, chrom, start, "end", depth / greatest(1, level) AS depth FROM r JOIN lv USING (sample, i)),
lr AS (SELECT sample, depth, row_number() OVER (PARTITION BY sample ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM free WHERE depth > 0), top AS (SELECT sample, max(depth) FILTER (k = floor(n * 0.65)) AS level FROM lr GROUP BY sample)
SELECT chrom, start, "end", sample, round(depth / level, 6) AS depth FROM free JOIN top USING (sample)"""


@query("debiased_depths", sql("aln regions", _DEBIASED))
def debiased_depths(spark, d):
    """Windows within the covariate's bounds, debiased in its order and divided by their sample's level."""
    return matrix.debiased(_matrix(spark, d), "gc", 9, (5, 95)).withColumn("depth", F.round("depth", 6))


@query("without_components", sql("aln regions", _MATRIX + """, gm AS (SELECT a.sample AS i, b.sample AS j, sum(a.depth * b.depth) AS v FROM mx a JOIN mx b USING (chrom, start, "end") GROUP BY a.sample, b.sample), tr AS (SELECT sum(v) AS t FROM gm WHERE i = j)""" + _leading("gm", "e1") + _leading("e1_rest", "e2") + """,
d1 AS (SELECT mx.chrom, mx.start, mx."end", sample, depth, e1.u AS u1, e2.u AS u2 FROM mx JOIN e1 ON e1.i = sample JOIN e2 ON e2.i = sample)
SELECT chrom, start, "end", sample, round(depth - CASE WHEN 100 * e1_l.l / t > 15 THEN u1 * sum(depth * u1) OVER w ELSE 0 END - CASE WHEN 100 * e1_l.l / t > 15 AND 100 * e2_l.l / t > 15 THEN u2 * sum(depth * u2) OVER w ELSE 0 END, 4) + 0.0 AS depth
FROM d1, e1_l, e2_l, tr WINDOW w AS (PARTITION BY chrom, start, "end")"""))  # fmt: skip
def without_components(spark, d):
    return matrix.without_components(_matrix(spark, d)).withColumn("depth", F.round("depth", 4) + F.lit(0.0))


# ---- copy numbers ---------------------------------------------------------------------------
def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> abs(double(x)) * 200)").alias("depths"))


_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) * 200) AS d FROM embeddings WHERE len(embedding) > 0), vp AS MATERIALIZED (SELECT vec_id, unnest(d)::DOUBLE AS x FROM v), vs AS (SELECT vec_id, list_sort(d) AS s, len(d) AS n FROM v)"
_CENTRES = ", ".join(f"two * {k} / 2" for k in range(4, 9))
_EM = "WITH RECURSIVE " + _VECTORS + """, med AS (SELECT vec_id, (CASE WHEN n % 2 = 1 THEN s[n // 2 + 1] WHEN n = 2 THEN (s[1] + s[2]) / 2 ELSE (s[n // 2 + 1] + s[n // 2 + 2]) / 2 END)::DOUBLE AS two FROM vs),
em AS (SELECT vec_id, 0 AS k, list_transform(range(0, 9), lambda i: CASE WHEN i = 0 THEN 0.01 * two ELSE two * pow(i / 2, 1.1) END) AS c, 100::DOUBLE AS total, 100::DOUBLE AS largest FROM med
    UNION ALL SELECT vec_id, k + 1, e, list_sum(list_transform(range(1, 10), lambda i: abs(e[i] - c[i]))), list_max(list_transform(range(1, 10), lambda i: abs(e[i] - c[i]))) FROM
        (SELECT vec_id, k, c, [c[1], two / 2 - two / 2 / 1.5, two, two * 3 / 2 + two / 2 / 1.5, """ + _CENTRES + """] AS e FROM
        (SELECT vec_id, k, c, CASE WHEN m[3] <> 0 THEN m[3] ELSE list_sum(list_transform(range(2, 9), lambda i: m[i] * (2 / (i - 1)) * q[i] / n)) END AS two FROM
        (SELECT vec_id, k, c, count(*) AS n, [coalesce(avg(x) FILTER (st = 0), 0), coalesce(avg(x) FILTER (st = 1), 0), coalesce(avg(x) FILTER (st = 2), 0), coalesce(avg(x) FILTER (st = 3), 0), coalesce(avg(x) FILTER (st = 4), 0), coalesce(avg(x) FILTER (st = 5), 0), coalesce(avg(x) FILTER (st = 6), 0), coalesce(avg(x) FILTER (st = 7), 0), coalesce(avg(x) FILTER (st = 8), 0)] AS m, [count(*) FILTER (st = 0), count(*) FILTER (st = 1), count(*) FILTER (st = 2), count(*) FILTER (st = 3), count(*) FILTER (st = 4), count(*) FILTER (st = 5), count(*) FILTER (st = 6), count(*) FILTER (st = 7), count(*) FILTER (st = 8)] AS q FROM
        (SELECT vec_id, k, c, x, CASE WHEN x <= c[1] THEN 0 WHEN x > c[9] THEN 8 ELSE r - 1 + (abs(x - c[r + 1]) < abs(x - c[r]))::INT END AS st FROM (SELECT em.vec_id, k, c, x, greatest(1, least(8, len(list_filter(c, lambda y: y < x)))) AS r FROM em JOIN vp USING (vec_id) WHERE k < 10 AND total > 0.01 AND largest > 0.5)) GROUP BY vec_id, k, c)))),
fin AS (SELECT vec_id, arg_max(c, k) AS c FROM em GROUP BY vec_id),
call AS (SELECT vec_id, c, i, x, CASE WHEN x <= c[1] THEN 0 WHEN x > c[9] THEN 8 ELSE r - 1 + (abs(x - c[r + 1]) < abs(x - c[r]))::INT END AS st FROM (SELECT fin.vec_id, c, i, d[i]::DOUBLE AS x, greatest(1, least(8, len(list_filter(c, lambda y: y < d[i])))) AS r FROM (SELECT vec_id, d, unnest(range(1, len(d) + 1)) AS i FROM v) JOIN fin USING (vec_id)))
SELECT vec_id, list_transform(first(c), lambda y: round(y, 6)) AS centres, list((CASE WHEN c[3] <= 0 THEN 0 WHEN st <> 2 AND x <= c[9] AND floor(x + 0.5) * ln(c[st + 1]) - c[st + 1] + ln(0.9) < floor(x + 0.5) * ln(c[3]) - c[3] THEN 2 ELSE st END)::INTEGER ORDER BY i) AS cn FROM call GROUP BY vec_id"""
_MEANS = ", ".join(f"avg(t[{k}] / b)" for k in range(1, 9))
_MIXTURE = "WITH RECURSIVE " + _VECTORS + """, mx AS (SELECT vec_id, 0 AS k, [0.001, 0.001, 0.965, 0.001, 0.001, 0.001, 0.001, 0.001]::DOUBLE[] AS w, 'infinity'::DOUBLE AS rate, avg(x) AS found, []::DOUBLE[] AS m, avg(x) AS mean, count(*) AS n FROM vp GROUP BY vec_id
    UNION ALL SELECT vec_id, k + 1, list_transform(range(1, 9), lambda i: (a[i] + CASE WHEN i = 3 THEN 11.0 / n ELSE 0 END) / (1 + 11.0 / n)), found, CASE WHEN load > 0 THEN mean / load ELSE found END, a, mean, n FROM
        (SELECT *, list_sum(list_transform(range(1, 9), lambda i: a[i] * CASE WHEN i = 1 THEN 0.001 ELSE i - 1 END / 2)) AS load FROM
        (SELECT vec_id, k, found, mean, n, [""" + _MEANS + """] AS a FROM
        (SELECT *, list_transform(range(1, 9), lambda i: w[i] * exp(o * ln(l[i]) - l[i] - lgamma(o + 1))) AS t, list_sum(list_transform(range(2, 9), lambda i: w[i] * exp(o * ln(l[i]) - l[i] - lgamma(o + 1)))) + CASE WHEN o = 0 THEN w[1] ELSE 0 END AS b FROM
        (SELECT mx.vec_id, k, w, found, mean, n, floor(x + 0.5) AS o, list_transform(range(1, 9), lambda i: CASE WHEN i = 1 THEN 0.0005 * found ELSE (i - 1) / 2 * found END) AS l FROM mx JOIN vp USING (vec_id) WHERE k < 10 AND abs(rate - found) > 0.01)) GROUP BY vec_id, k, found, mean, n)))
SELECT vec_id, round(arg_max(found, k), 6) AS rate, round(list_sum(list_transform(range(1, 9), lambda i: arg_max(m, k)[i] * abs(ln(CASE WHEN i = 1 THEN 0.0005 ELSE (i - 1) / 2 END)))), 6) AS gain FROM mx GROUP BY vec_id"""


@query("em_copies", _EM)
def em_copies(spark, d):
    return _vectors(spark, d).select("vec_id", copynumber.em(F.col("depths")).alias("em")).select("vec_id", F.expr("transform(em.centres, x -> round(x, 6))").alias("centres"), "em.cn")


@query("mixture_copies", _MIXTURE)
def mixture_copies(spark, d):
    return _vectors(spark, d).select("vec_id", copynumber.mixture_of(F.col("depths")).alias("m")).select("vec_id", F.round("m.rate", 6).alias("rate"), F.round("m.gain", 6).alias("gain"))


_RUNS = ", " + _WINDOWS + """, v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY chrom, s) AS vec_id, chrom, s, e, list(mean ORDER BY sample) AS d, list(sample ORDER BY sample) AS names FROM means GROUP BY chrom, s, e),
vp AS MATERIALIZED (SELECT vec_id, unnest(d)::DOUBLE AS x FROM v), vs AS (SELECT vec_id, list_sort(d) AS s, len(d) AS n FROM v)""" + _EM.removeprefix("WITH RECURSIVE " + _VECTORS).rsplit("\nSELECT", 1)[0] + """,
st AS (SELECT names[call.i] AS sample, chrom, s, e, CASE WHEN c[3] > 0 THEN CASE WHEN x = 0 THEN '-infinity'::DOUBLE ELSE log2(x / c[3]) END END AS change FROM call JOIN v USING (vec_id)),
b AS (SELECT *, coalesce(lag(change) OVER (PARTITION BY sample, chrom ORDER BY s, e), change) AS was FROM st),
ab AS (SELECT * FROM b WHERE (change >= 0.4 AND was >= 0.4) OR (change <= -0.8 AND was <= -0.8)),
f AS (SELECT *, CASE WHEN s - lag(e) OVER w < 200 THEN 0 ELSE 1 END AS fresh FROM ab WINDOW w AS (PARTITION BY sample, chrom ORDER BY s, e)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, chrom ORDER BY s, e) AS run FROM f)
SELECT sample, chrom, min(s) AS start, max(e) AS "end", count(*) AS n FROM r WHERE NOT (change > -0.5 AND change < 0.3) GROUP BY sample, chrom, run"""


@query("called_runs", sql("aln regions", _RUNS))
def called_runs(spark, d):
    """From reads to calls: window depths, copy numbers of each window's samples, runs."""
    return tools.called_runs(_windows(spark, d).withColumnRenamed("mean", "depth"), 200).drop("windows")


@query("fold_changes", "SELECT o_orderkey, round(log2(o_totalprice / 150000), 6) AS change, NOT (log2(o_totalprice / 150000) > -0.5 AND log2(o_totalprice / 150000) < 0.3) AS aberrant FROM orders WHERE o_totalprice > 0")
def fold_changes(spark, d):
    change = fm.fold_change(F.col("o_totalprice"), F.lit(150_000.0))
    return table(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", F.round(change, 6).alias("change"), fm.is_aberrant(change).alias("aberrant"))


def _states(spark, d) -> DataFrame:
    """Window depths as fold changes of their sample's mean."""
    means = _windows(spark, d).where("mean > 0")
    centre = F.avg("mean").over(Window.partitionBy("sample"))
    return means.withColumn("change", F.round(F.log2(F.col("mean") / centre), 6)).select("sample", "chrom", "start", "end", F.col("mean").alias("depth"), F.lit(2).alias("cn"), "change")


_STATES = f", {_WINDOWS}, st AS (SELECT sample, chrom, s, e, round(log2(mean / avg(mean) OVER (PARTITION BY sample)), 6) AS change FROM means WHERE mean > 0)"


@query("aberrant_runs", sql("aln regions", _STATES + """, b AS (SELECT *, coalesce(lag(change) OVER (PARTITION BY sample, chrom ORDER BY s, e), change) AS was FROM st),
i AS (SELECT * FROM b WHERE (change >= 0.4 AND was >= 0.4) OR (change <= -0.8 AND was <= -0.8)),
f AS (SELECT *, CASE WHEN s - lag(e) OVER w < 200 THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY sample, chrom ORDER BY s, e)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, chrom ORDER BY s, e) AS run FROM f)
SELECT sample, chrom, min(s) AS start, max(e) AS "end", count(*) AS n FROM r WHERE NOT (change > -0.5 AND change < 0.3) GROUP BY sample, chrom, run"""))  # fmt: skip
def aberrant_runs(spark, d):
    return copynumber.aberrant_runs(_states(spark, d), gap=200).drop("windows")


@query("gap_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS run FROM f) SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM r GROUP BY user_id, run""")  # fmt: skip
def gap_sessions(spark, d):
    order = Window.partitionBy("user_id").orderBy("us")
    marked = signal(spark, d).withColumn("fresh", F.when(F.col("us") - F.lag("us").over(order) < 1_800_000_000, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    return marked.groupBy("user_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n")).drop("run")


@query("rank_picks", "SELECT event_type, max(value) FILTER (k = floor(n * 0.65)) AS high, max(value) FILTER (k = (n - 1) // 2) AS low FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def rank_picks(spark, d):
    return ranks.pick(table(spark, d, "events"), ["event_type"], "value", high=lambda n: F.floor(n * 0.65), low=lambda n: F.floor((n - 1) / 2))
