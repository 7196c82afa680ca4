import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from covertile.functions import math as fm
from covertile.functions import text as ft
from covertile.operators import copynumber, depth, evaluation, intervals, matrix, ranks, readstats, split, tiles

EM_1 = [1, 8, 33, 34, 35, 37, 31, 22, 66]
EM_2 = [30, 28, 33, 34, 35, 37, 31, 22, 38]
EM_3 = [296.6, 16.7, 17.0, 3019.2, 14.4, 16.5, 14.2, 26, 7]


@pytest.mark.parametrize(("depths", "cn"), [(EM_1, [0, 1, 2, 2, 2, 2, 2, 2, 4]), (EM_2, [2] * 9), (EM_3, [8, 2, 2, 8, 2, 2, 2, 3, 1])])
def test_em_copy_numbers(depths, cn):
    assert copynumber.copy_numbers(np.array(depths), copynumber.em_centres(np.array(depths))).tolist() == cn


def test_em_of_zeros_and_nothing(spark):
    zero = copynumber.em_centres(np.zeros(5))
    assert copynumber.copy_numbers(np.zeros(5), zero).tolist() == [0] * 5
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, []), (3, None)], "id int, d array<double>").select("id", copynumber.em(F.col("d")).alias("e"))
    rows = {r["id"]: r["e"] for r in df.collect()}
    assert rows[1]["cn"] == [0, 0, 0] and rows[1]["change"] == [None] * 3 and rows[2]["cn"] == [] and rows[3]["cn"] == []


def test_state_changes(spark):
    first = [296.6, 16.7, 17.0, 3019.2, 14.4, 16.5, 14.2, 26, 7]
    change = copynumber.fold_changes(np.array(first), copynumber.em_centres(np.array(first))).tolist()
    after = [change[0], 0.0, 0.0, change[3], 0.0, 0.0, 0.0, 0.0, 0.1]
    row = spark.createDataFrame([(change, after)], "a array<double>, b array<double>").select(copynumber.state_changes(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert row["stayed"] == [0, 3] and row["changed"] == [7, 8] and row["share"] == pytest.approx(7 / 9)


def test_mixture_finds_two_copies():
    weights, rate, posterior = copynumber.mixture(np.array([30.0, 31, 29, 30, 33, 15, 28, 30]))
    assert abs(weights.sum() - 1) < 0.2 and 25 < rate < 35 and posterior.shape == (8, 8)
    assert posterior[:, 5].argmax() == 1 and posterior[:, 0].argmax() == 2
    assert copynumber.information_gain(posterior) >= 0 and copynumber.normalised_gain(posterior).shape == (8,)


def test_poisson():
    assert fm.poisson_pmf(np.array([3]), np.array([2.5]))[0] == pytest.approx(2.5**3 * math.exp(-2.5) / 6)
    assert fm.poisson_pmf(np.array([0, 1]), np.array([0.0, 0.0])).tolist() == [1.0, 0.0]
    assert fm.poisson_pmf(np.array([5000]), np.array([5000.0]))[0] == pytest.approx(1 / math.sqrt(2 * math.pi * 5000), rel=1e-3)
    assert fm.poisson_cdf(50, 10.0) == pytest.approx(1.0)


def names(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_names(spark):
    assert names(spark, ft.short_name, "asdf.cram", "/path/to/v1/asdf.123.cram", "x", "a/b.c.d.bam") == ["asdf", "asdf-123", "x", "b-c-d"]
    assert names(spark, ft.depth_file_name, "/d/s1.depth.bed.gz", "s2.bed", "s3.depth") == ["s1", "s2", "s3"]
    assert names(spark, ft.bare_contig, "chr1", "X", "chrchr2") == ["1", "X", "chr2"]


def test_regions(spark):
    got = names(spark, ft.region, "chr1:1-100", "HLA-A*01:01:01:5-9", "chr2\t0\t50", "nothing", "c:0-4")
    assert [tuple(g) if g else None for g in got] == [("chr1", 0, 100), ("HLA-A*01:01:01", 4, 9), ("chr2", 0, 50), None, ("c", 0, 4)]


def test_excluded(spark):
    assert names(spark, ft.excluded, "chr1", "chrEBV", "NC_7", "chr1_random", "chrUn_2", "HLA-A", "chr6_alt", "x_hap3") == [False] + [True] * 7


def test_number_format(spark):
    values = [12.5, 12.0, 0.0, 1234567.0, 0.00001234, 0.1, 99999.0, -2.25, 1e10, 0.99996]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(ft.significant(F.col("v"), 4)).collect()] == [f"{v:.4g}" for v in values]


def test_composition(spark):
    got = names(spark, ft.composition, "ACGTacgt", "", "CGCG", None)
    assert (got[0]["gc"], got[0]["cpg"], got[0]["masked"]) == (0.5, 0.5, 0.5) and got[1] is None and got[2]["cpg"] == 1.0 and got[3] is None


def test_rank_rule_is_not_percentile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)], "k string, v double")
    assert ranks.pick(df, ["k"], "v", at=lambda n: F.floor(n * 0.4)).first()["at"] == 4.0


def test_capped_weighted_median(spark):
    rng = np.random.default_rng(0)
    sizes = (rng.pareto(1.5, 500) * 100).astype(int) + 1
    s = np.sort(sizes)
    cap = s[int(0.98 * len(s))]
    run = np.cumsum(np.minimum(s, cap))
    want = s[np.flatnonzero(run > run[-1] // 2)[0]]
    df = spark.createDataFrame([("x", int(v)) for v in sizes], "k string, size long")
    assert ranks.capped_weighted_median(df, ["k"], "size").first()["median"] == want


@pytest.mark.parametrize("width", [3, 7, 55, 250])
def test_windows_tile_regions_and_keep_depth(spark, width):
    reads = spark.createDataFrame([("s", "c", 0, 10), ("s", "c", 5, 30), ("s", "c", 5, 30), ("s", "d", 2, 3)], "sample string, chrom string, start long, end long")
    regions = spark.createDataFrame([("s", "c", 0, 40), ("s", "d", 1, 9)], "sample string, chrom string, from long, to long")
    rows = depth.window_means(reads, regions, width).collect()
    for chrom, lo, hi, total in (("c", 0, 40, 60), ("d", 1, 9, 1)):
        own = sorted((r["start"], r["end"], r["mean"]) for r in rows if r["chrom"] == chrom)
        assert own[0][0] == lo and own[-1][1] == hi and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert sum((e - s) * m for s, e, m in own) == pytest.approx(total)


@pytest.mark.parametrize("shard", [4, 1000])
def test_pileup_does_not_depend_on_shards(spark, shard):
    reads = spark.createDataFrame([("s", "c", 0, 10), ("s", "c", 5, 30), ("s", "c", 29, 31)], "sample string, chrom string, start long, end long")
    covered = {}
    for r in depth.pileup_segments(reads, shard=shard).collect():
        for p in range(r["start"], r["end"]):
            assert p not in covered
            covered[p] = r["depth"]
    assert covered == {p: (p < 10) + (5 <= p < 30) + (29 <= p < 31) for p in range(31)}


def test_blocks_restart_after_longest(spark):
    sites = spark.createDataFrame([("c", p) for p in [*range(0, 40), *range(100, 103), *range(200, 230)]], "chrom string, pos long")
    got = sorted((r["start"], r["end"]) for r in depth.site_blocks(sites, skip=10, size=15, longest=25).collect())
    assert got == [(0, 25), (25, 40), (200, 225), (225, 230)]


def test_interval_algebra_against_points(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [("c" if rng.random() < 0.5 else "d", int(s), int(s + rng.integers(1, 12))) for s in rng.integers(0, 150, n)]
    a, b = make(25), make(20)
    points = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e)}
    da, db = (spark.createDataFrame(x, "chrom string, start long, end long") for x in (a, b))
    got = lambda df: points([(r["chrom"], r["start"], r["end"]) for r in df.collect()])
    assert got(intervals.merge(da, ["chrom"])) == points(a)
    assert got(intervals.subtract(da, db, ["chrom"])) == points(a) - points(b)
    assert got(intervals.intersect(da, db, ["chrom"], 16)) == points(a) & points(b)
    pairs = intervals.overlap_join(da, db, ["chrom"], 5).count()
    assert pairs == sum(x[0] == y[0] and x[2] > y[1] and x[1] < y[2] for x in a for y in b)


@pytest.mark.parametrize("shard", [3, 16, 1000])
def test_shards_do_not_show(spark, shard):
    rng = np.random.default_rng(shard)
    make = lambda n: [("c" if rng.random() < 0.5 else "d", int(s), int(s + rng.integers(1, 12))) for s in rng.integers(0, 150, n)]
    a, b = [*make(12), ("e", 0, 90), ("e", 200, 201)], [*make(9), ("e", 40, 50)]
    da, db = (spark.createDataFrame(x, "chrom string, start long, end long") for x in (a, b))
    points = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e)}

    def runs(found, gap=0):
        out = []
        for c, p in sorted(found):
            if out and out[-1][0] == c and p - out[-1][2] <= gap:
                out[-1][2] = p + 1
            else:
                out.append([c, p, p + 1])
        return [tuple(x) for x in out]

    got = lambda df: sorted((r["chrom"], r["start"], r["end"]) for r in df.collect())
    assert got(intervals.merge(da, ["chrom"], shard=shard)) == runs(points(a))
    assert got(intervals.merge(da, ["chrom"], 5, shard)) == runs(points(a), 5)
    assert got(intervals.subtract(da, db, ["chrom"], shard)) == runs(points(a) - points(b))
    assert got(intervals.intersect(da, db, ["chrom"], shard)) == runs(points(a) & points(b))
    extent = spark.createDataFrame([("c", 170), ("d", 100), ("f", 7)], "chrom string, length long")
    whole = {(c, p) for c, n in (("c", 170), ("d", 100), ("f", 7)) for p in range(n)}
    assert got(intervals.complement(da, extent, ["chrom"], shard)) == runs(whole - points(a))
    regions = spark.createDataFrame([("s", "c", 5, 170), ("s", "d", 0, 100), ("s", "f", 2, 7)], "sample string, chrom string, from long, to long")
    blocks = depth.class_blocks(da.selectExpr("'s' AS sample", "*"), regions, least=2, most=3, shard=shard).collect()
    depth_at = {}
    for c, s, e in a:
        for p in range(s, e):
            depth_at[c, p] = depth_at.get((c, p), 0) + 1
    kind = lambda n: "NO_COVERAGE" if n == 0 else "LOW_COVERAGE" if n < 2 else "EXCESSIVE_COVERAGE" if n >= 3 else "CALLABLE"
    want = []
    for c, lo, hi in (("c", 5, 170), ("d", 0, 100), ("f", 2, 7)):
        for p in range(lo, hi):
            k = kind(depth_at.get((c, p), 0))
            if want and want[-1][0] == c and want[-1][2] == p and want[-1][3] == k:
                want[-1][2] = p + 1
            else:
                want.append([c, p, p + 1, k])
    assert sorted((r["chrom"], r["start"], r["end"], r["class"]) for r in blocks) == sorted(map(tuple, want))
    sites = depth.site_blocks(da.where("false").unionByName(intervals.merge(da, ["chrom"], shard=shard)), skip=2, size=4, longest=20, shard=shard)
    plain = []
    for c in "cde":
        own, at = sorted(p for x, p in points(a) if x == c), 0
        while at < len(own):
            stop = at
            while stop + 1 < len(own) and own[stop + 1] - own[stop] - 1 <= 2:
                stop += 1
            if stop - at + 1 >= 4:
                island, first = own[at : stop + 1], own[at]
                if island[-1] + 1 - first <= 20:
                    plain.append((c, first, island[-1] + 1))
                else:
                    last = first
                    for p in island:
                        if p - first >= 20:
                            plain.append((c, first, last + 1))
                            first = p
                        last = p
                    plain.append((c, first, last + 1))
            at = stop + 1
    assert got(sites) == sorted(plain)


def test_only_edges_meet_along_a_contig(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 2 = 0, 'c', 'd') AS chrom", "id * 10 AS start", "id * 10 + 5 AS end")
    plan = intervals.merge(rows, ["chrom"], shard=10_000)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    along = [k for k, line in enumerate(plan) if "Window [" in line and "_bin#" not in line]
    # windows along a contig stand above the filter that leaves two islands a shard
    assert along and all(any("Filter" in x and "_island" in x for x in plan[k:]) for k in along)
    assert intervals.merge(rows, ["chrom"], shard=10_000).count() == 40_000


def test_a_contig_long_interval_makes_few_rows(spark):
    long = spark.createDataFrame([("c", 0, 250_000_000, 1), ("c", 7, 9, 2), ("c", 1000, 70_000, 3)], "chrom string, start long, end long, i int")
    small = spark.range(3000).selectExpr("'c' AS chrom", "id * 80000 AS start", "id * 80000 + 20 AS end", "id AS j")
    levels = intervals.levels_of(small, "start", "end", 32)
    assert intervals.placed(long, "start", "end", 32, levels).count() <= 3 * 10 and levels == [0]
    of_long = intervals.levels_of(long, "start", "end", 32)
    assert len(of_long) == 3 and intervals.placed(small, "start", "end", 32, of_long).count() <= 3000 * 6
    want = sum(s < e2 and e > s2 for s, e in ((0, 250_000_000), (7, 9), (1000, 70_000)) for s2, e2 in ((k * 80000, k * 80000 + 20) for k in range(3000)))
    assert intervals.overlap_join(long, small, ["chrom"], 32).count() == intervals.overlap_join(small, long, ["chrom"], 32).count() == want


def test_uneven_windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key in (("s", "c"), ("s", "d"), ("t", "c")):
        at = 0
        for _ in range(60):
            at += int(rng.integers(0, 4))
            end = at + int(rng.integers(1, 30))
            rows.append((*key, at, end, float(rng.integers(0, 90)) / 10))
            at = end
    got = sorted(tuple(r) for r in depth.widened_to(spark.createDataFrame(rows, "sample string, chrom string, start long, end long, mean double"), 50).collect())
    want = []
    for key in sorted({r[:2] for r in rows}):
        block = None
        for _, _, s, e, m in sorted(r for r in rows if r[:2] == key):
            block = (s, e, int(m + 0.5)) if block is None else (block[0], e, block[2] + int(m + 0.5))
            if e - block[0] >= 50:
                want.append((*key, *block))
                block = None
        if block:
            want.append((*key, *block))
    assert got == want


def test_even_regions_tile_contigs(spark):
    rng = np.random.default_rng(3)
    cells = [(f"s{s}", "c1", t, int(rng.integers(0, 10**9))) for s in range(3) for t in range(80)] + [("s0", "c1", 40, 10**12)]
    t = spark.createDataFrame(cells, "sample string, chrom string, tile long, size long")
    contigs = spark.createDataFrame([("c1", 80 * 16384 - 5, 0), ("c2", 100, 1)], "chrom string, length long, ord int")
    hard = spark.createDataFrame([("c1", 16384 * 7 + 1, 16384 * 7 + 9)], "chrom string, start long, end long")
    rows = split.even_regions(t, contigs, 20, hard).collect()
    own = sorted((r["start"], r["end"]) for r in rows if r["chrom"] == "c1")
    assert own[0][0] == 0 and own[-1][1] == 80 * 16384 - 5 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    assert [(r["start"], r["end"], r["sum"], r["splits"]) for r in rows if r["chrom"] == "c2"] == [(0, 100, 0.0, 0)]
    assert max(r["splits"] for r in rows) > 1


def plain_regions(size, hard, length, want, width):
    """The scan along one contig, as the command-line tool makes it, in whole numbers."""
    whole, out, begin, held = sum(size), [], 0, 0
    edge = lambda tile: min(length, tile * width)
    for tile, (amount, bad) in enumerate(zip(size, hard, strict=True)):
        if amount * want > whole or (bad and 20 * amount * want >= whole):
            out.append((edge(begin), edge(tile), held, 1))
            parts = min(8, int(0.5 + 2 * amount * want / whole))
            parts = parts if parts >= 1 else 3 if bad else 1
            step = int(width / parts + 1)
            for k in range(parts):
                out.append((min(length, tile * width + k * step), min(length, tile * width + (k + 1) * step, (tile + 1) * width), amount / parts, parts))
            begin, held = tile + 1, 0
        else:
            held += amount
            if held * want >= whole or (bad and 5 * held * want >= whole):
                out.append((edge(begin), edge(tile + 1), held, 1))
                begin, held = tile + 1, 0
    out.append((edge(begin), length, held, 1))
    return [r for r in out if r[0] < r[1]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_even_regions_equal_the_scan(spark, seed):
    rng = np.random.default_rng(seed)
    contigs, cells, bad, want = [], [], [], {}
    for c, last in (("a", 60), ("b", 25), ("c", 3)):
        size = [int(x) for x in rng.integers(0, 30, last) * 10**9]
        size[0] = 0 if c == "b" else size[0]
        there = [t for t in range(last) if size[t]]
        hard = [t in there and rng.random() < 0.2 for t in range(last)]
        contigs.append((c, last * 10 - (4 if c == "a" else -25 if c == "b" else 0)))
        cells += [("s", c, t, size[t]) for t in there]
        bad += [(c, t * 10 + 1, t * 10 + 2) for t in range(last) if hard[t]]
        want[c] = (size, hard)
    t = spark.createDataFrame(cells, "sample string, chrom string, tile long, size long")
    rows = split.even_regions(t, spark.createDataFrame(contigs, "chrom string, length long"), 20, spark.createDataFrame(bad, "chrom string, start long, end long"), 10).collect()
    chopped = {(r["chrom"], r["tile"]): int(round(r["size"] * 1e9)) for r in split.chopped(split.cohort_sums(t)).collect()}
    every = sum(chopped.values())
    for c, length in contigs:
        size = [chopped.get((c, k), 0) for k in range(len(want[c][0]))]
        plain = plain_regions(size, want[c][1], length, max(1, int(sum(size) / every * 20)), 10)
        assert sorted((r["start"], r["end"], round(r["sum"], 6), r["splits"]) for r in rows if r["chrom"] == c) == sorted((s, e, round(x / 1e9, 6), k) for s, e, x, k in plain)


def test_projections_equal_singular_vectors(spark):
    rng = np.random.default_rng(1)
    d = rng.random((6, 50)).round(3)
    df = spark.createDataFrame([(f"s{i}", "c", j, float(d[i, j])) for i in range(6) for j in range(50)], "sample string, chrom string, tile long, depth double")
    got, share = projected(tiles.projections(df), 5)
    q = np.floor(np.minimum(d, 8) * (65535 / 8) + 0.5)
    _, s, vt = np.linalg.svd(q - q.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(q @ vt[:5].T), rtol=1e-4) and np.allclose(share, (s**2 / (s**2).sum())[:5], rtol=1e-6)
    assert (got[np.abs(got).argmax(0), np.arange(5)] > 0).all()
    assert tiles.projections(df.where("sample < 's2'")).count() == 0


def projected(df, components):
    rows = df.collect()
    names = sorted({r["sample"] for r in rows})
    got, share = np.zeros((len(names), components)), np.zeros(components)
    for r in rows:
        got[names.index(r["sample"]), r["component"] - 1], share[r["component"] - 1] = r["projection"], r["share"]
    return got, share


def test_a_cohort_of_500_samples(spark, monkeypatch):
    from covertile.operators import cohort

    monkeypatch.setattr(cohort, "CHUNK", 20_000)  # several chunks of cells
    rng = np.random.default_rng(6)
    d = (np.outer(rng.random(500), rng.random(90)) * 3 + np.outer(rng.random(500) > 0.7, rng.random(90) > 0.5) + rng.random((500, 90)) / 20).round(3)
    df = spark.createDataFrame([(f"s{i:03}", "c", j, float(d[i, j])) for i in range(500) for j in range(90)], "sample string, chrom string, tile long, depth double").repartition(6)
    got, share = projected(tiles.projections(df, components=3), 3)
    q = np.floor(np.minimum(d, 8) * (65535 / 8) + 0.5)
    _, s, vt = np.linalg.svd(q - q.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got[:, :2]), np.abs(q @ vt[:2].T), rtol=1e-3) and np.allclose(share, (s**2 / (s**2).sum())[:3], rtol=1e-6)


def test_curve_starts_at_one_and_falls(spark, sf):
    from covertile.plans.catalog import QUERIES

    rows = QUERIES["coverage_curve"](spark, sf).collect()
    assert all(r["share"] == 1.0 for r in rows if r["slot"] == 0)
    by = {(r["sample"], r["chrom"], r["slot"]): r["share"] for r in rows}
    assert all(by[s, c, k] <= by[s, c, k - 1] + 1e-9 for s, c, k in by if k)


def test_normalised_needs_five_samples(spark):
    few = spark.createDataFrame([(f"s{i}", "c", j, float(i + j % 3 + 1)) for i in range(4) for j in range(12)], "sample string, chrom string, tile long, depth double")
    assert sorted(tuple(r) for r in tiles.normalised(few).collect()) == sorted(tuple(r) for r in few.collect())
    many = spark.createDataFrame([(f"s{i}", "c", j, 2.0) for i in range(6) for j in range(12)], "sample string, chrom string, tile long, depth double")
    got = tiles.normalised(many).collect()
    # the first and last tile have a neighbour too few and stay as they are
    assert all((r["depth"] == 2.0) if r["tile"] in (0, 11) else 0.5 <= r["depth"] <= 1.5 for r in got)


def test_many_rows_at_once_are_as_each_alone():
    rng = np.random.default_rng(12)
    rows = np.vstack([rng.integers(0, 90, (40, 9)) * 1.5, np.zeros((2, 9)), np.full((2, 9), 30.0)])
    centres = copynumber.em_centres(rows)
    weights, rate, posterior = copynumber.mixture(rows + 1)
    gain = copynumber.information_gain(posterior)
    for i, row in enumerate(rows):
        own = copynumber.em_centres(row)
        assert np.allclose(own, centres[i]) and (copynumber.copy_numbers(row, own) == copynumber.copy_numbers(rows, centres)[i]).all()
        w, r, p = copynumber.mixture(row + 1)
        assert np.allclose(w, weights[i]) and r == pytest.approx(rate[i]) and np.allclose(p, posterior[i]) and copynumber.information_gain(p) == pytest.approx(gain[i])


def test_scalers_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [("c", j * 10, j * 10 + 10, f"s{i}", float(rng.random() * 9)) for i in range(4) for j in range(15)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, sample string, depth double")
    want = {(r[1], r[3]): r[4] for r in rows}
    for there, back in ((matrix.z_scored, matrix.z_restored), (lambda x: matrix.centred(x, matrix.SITE), matrix.uncentred), (matrix.log_centred, matrix.log_restored)):
        got = {(r["start"], r["sample"]): r["depth"] for r in back(there(df)).collect()}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def plain_edges(depth, window):
    mid = (window - 1) // 2 + 1
    out, held = list(depth), list(depth[:mid])
    level = max(1.0, float(np.median(held)))
    for i, d in enumerate(depth):
        if mid <= i < len(depth) - mid:
            held = [*held, depth[i + mid]][-window:]
            level = max(1.0, float(np.median(held)))
        out[i] = d / level
    return out


@pytest.mark.parametrize("n", [1, 9, 12, 70])
def test_debiasing_in_blocks(spark, n):
    rng = np.random.default_rng(n)
    rows = [("c", j * 10, j * 10 + 10, s, float(rng.integers(0, 40)) / 4, float(rng.integers(0, 5))) for s in "ab" for j in range(n)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, sample string, depth double, gc double").repartition(3)
    edges = {(r["sample"], r["start"]): r["depth"] for r in matrix.moving_median_with_edges(df, "gc", 5, 10).collect()}
    centred = {(r["sample"], r["start"]): r["depth"] for r in matrix.moving_median(df, "gc", 5, 10).collect()}
    done = {(r["sample"], r["start"]): r["depth"] for r in matrix.debiased(df, "gc", 5, (1.0, 3.0), block=10).collect()}
    for s in "ab":
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[5], r[1]))
        depth = [r[4] for r in own]
        assert np.allclose([edges[s, r[1]] for r in own], plain_edges(depth, 5))
        assert np.allclose([centred[s, r[1]] for r in own], [d / max(1.0, float(np.median(depth[max(0, i - 2) : i + 3]))) for i, d in enumerate(depth)])
        kept = [r for r in own if 1 <= r[5] <= 3]
        free = plain_edges([r[4] for r in kept], 5) if kept else []
        positive = sorted(x for x in free if x > 0)
        for r, x in zip(kept, free, strict=True):
            assert done[s, r[1]] == pytest.approx(x / positive[int(0.65 * len(positive))])


def test_buckets_restart_where_the_value_is_out_of_reach(spark):
    rng = np.random.default_rng(3)
    rows = [("c", j, j + 1, s, float(rng.integers(0, 9)), float(rng.integers(0, 60)) / 2) for s in "ab" for j in range(80)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, sample string, depth double, gc double")
    got = {(r["sample"], r["start"]): r["depth"] for r in matrix.bucketed(df, "gc", 2.5).collect()}
    for s in "ab":
        own, begin = sorted((r for r in rows if r[3] == s), key=lambda r: r[5]), 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][5] - own[begin][5] > 2.5:
                positive = sorted(r[4] for r in own[begin:i] if r[4] > 0)
                for r in own[begin:i]:
                    assert got[s, r[1]] == pytest.approx(r[4] / (positive[len(positive) // 2] if positive else 1))
                begin = i


def test_debias_kernels():
    depths = np.arange(1.0, 31.0)
    out = matrix.edge_median(depths, 9)
    assert np.allclose(out[:5], depths[:5] / 3) and out[6] == pytest.approx(7 / np.median([*depths[:5], *depths[10:12]]))


def test_leading_components_go(spark):
    rng = np.random.default_rng(4)
    base = np.outer(rng.random(40) + 1, [1.0, 2, 3, 4]) + rng.normal(0, 0.01, (40, 4))
    df = spark.createDataFrame([("c", j, j + 1, f"s{i}", float(base[j, i])) for j in range(40) for i in range(4)], "chrom string, start long, end long, sample string, depth double")
    assert max(abs(r["depth"]) for r in matrix.without_components(df).collect()) < 0.1


def test_confusion_by_hand(spark):
    truths = spark.createDataFrame([("1", 0, 1000, ["a", "b"], 1), ("1", 5000, 30000, ["a"], 3)], "chrom string, start long, end long, samples array<string>, cn int")
    calls = spark.createDataFrame([("1", 100, 900, "a", 1), ("1", 6000, 29000, "a", 7), ("1", 90000, 99000, "b", 1)], "chrom string, start long, end long, sample string, cn int")
    got = {(r["sample"], r["size_class"]): (r["tp"], r["fn"], r["fp"], r["tn"]) for r in evaluation.confusion(calls, truths).collect()}
    assert got == {("a", "small"): (1, 0, 0, 0), ("a", "middle"): (1, 0, 0, 0), ("b", "small"): (0, 1, 1, 0), ("b", "middle"): (0, 0, 0, 1)}
    assert {r["sample"] for r in evaluation.by_sample(evaluation.restricted(truths, calls.where("sample = 'b'"))).collect()} == {"b"}


def test_trimming_keeps_small_groups_and_drops_outliers(spark):
    df = spark.createDataFrame([("a", v) for v in [*range(100), 5000]] + [("b", 1), ("b", 900)], "sample string, v long")
    got = readstats.trimmed(df, "v")
    assert got.where("sample = 'a'").agg(F.max("v")).first()[0] == 99 and got.where("sample = 'b'").count() == 2


def test_one_sample_name(spark):
    groups = spark.createDataFrame([("f", "1", "x"), ("f", "2", "x"), ("g", "1", "y"), ("g", "2", "z")], "file string, rg_id string, sm string")
    assert readstats.only_sample_name(groups.where("file = 'f'")).first()["sample"] == "x"
    with pytest.raises(Exception, match="expected one sample name"):
        readstats.only_sample_name(groups).collect()


def test_runs_end_at_gaps(spark):
    rows = [("s", "c", k * 1000, k * 1000 + 1000, 1.0, 1, c) for k, c in enumerate([0.0, -1.0, -1.0, -1.0, 0.0])] + [("s", "c", 90_000, 91_000, 1.0, 1, -1.0), ("s", "c", 91_000, 92_000, 1.0, 1, -1.0)]
    df = spark.createDataFrame(rows, "sample string, chrom string, start long, end long, depth double, cn int, change double")
    got = sorted((r["start"], r["end"], r["n"]) for r in copynumber.aberrant_runs(df).collect())
    assert got == [(2000, 4000, 2), (91_000, 92_000, 1)]
