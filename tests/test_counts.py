"""Counts that are made without the cells or pairs they stand for, against those cells and pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covertile.functions import math as fm
from covertile.operators import evaluation, readstats, tiles


@pytest.fixture
def depths(spark):
    rng = np.random.default_rng(11)
    reach = {"c1": (150, 120, 150), "c2": (110, 0, 40), "GL1": (130, 130, 130), "X": (60, 60, 60), "Y": (30, 0, 30)}
    rows = [(f"s{i}", c, j, float(rng.choice([0.0, 0.01, 0.5, 0.9, 1.0, 1.1, 1.14, 1.3]) + rng.choice([0, 0.001]))) for c, ends in reach.items() for i, end in enumerate(ends) for j in range(end)]
    return rows, spark.createDataFrame(rows, "sample string, chrom string, tile long, depth double")


def test_counters_of_missing_tiles(depths):
    rows, df = depths
    by = {r[:3]: r[3] for r in rows}
    ends = {c: max(t for _, k, t, _ in rows if k == c) for c in ("c1", "c2", "GL1")}
    for r in tiles.bin_counters(df).collect():
        every = [by.get((r["sample"], c, t), 0.0) for c, end in ends.items() for t in range(end + 1)]
        out = [d for d in every if not 0.85 <= d <= 1.15]
        assert (r["n_out"], r["n_low"], r["n_hi"], r["n_in"]) == (len(out), sum(d < 0.15 for d in every), sum(d > 1.15 for d in every), len(every) - len(out))


def test_slopes_are_falls_of_the_curve(spark, depths):
    _, df = depths
    contigs = spark.createDataFrame([("c1", 5_000_000), ("c2", 3_000_000), ("GL1", 9_000_000), ("X", 1_000_000)], "chrom string, length long")
    share = {(r["sample"], r["chrom"], r["slot"]): r["share"] for r in tiles.coverage_curve(df).collect()}
    for r in tiles.slopes(df, contigs).collect():
        parts = [(share[r["sample"], c, 40] - share[r["sample"], c, 54]) * n for c, n in (("c1", 5.0), ("c2", 3.0)) if (r["sample"], c, 40) in share]
        assert r["slope"] == pytest.approx(sum(parts) / len(parts))


def test_sex_copies_by_hand(depths):
    rows, df = depths
    for r in tiles.sex_copies(df).collect():
        own = [x[3] for x in rows if x[:2] == (r["sample"], r["chrom"])]
        drop = sum(0 < d < 0.02 for d in own) / len(own) > 0.3
        kept = sorted(d for d in own if d > 0 and not (drop and d < 0.02))
        assert r["cn"] == pytest.approx(2 * kept[int(0.4 * len(kept))])


def test_pedigree_keeps_samples_and_mapped_reads(spark, depths):
    _, df = depths
    contigs = spark.createDataFrame([("c1", 5_000_000), ("X", 1_000_000)], "chrom string, length long")
    stats = spark.createDataFrame([("s0", 7, 1), ("s0", 3, 1), ("s1", 5, 0)], "sample string, mapped long, unmapped long")
    got = {r["sample_id"]: r for r in tiles.pedigree(df, contigs, stats=stats).collect()}
    assert set(got) == {"s0", "s1", "s2"} and got["s0"]["mapped"] == 10 and got["s2"]["mapped"] is None
    assert got["s1"]["cn_Y"] == -0.1 and got["s1"]["cn_X"] > 0 and got["s0"]["bins_out"] + got["s0"]["bins_in"] == 150 + 110 + 130
    none = tiles.pedigree(df.where("chrom = 'c1'"), contigs).collect()
    assert {r["sex"] for r in none} == {-9}


def test_confusion_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    names = ["a", "b", "c"]
    site = lambda: (str(rng.integers(2)), int(s := rng.integers(0, 40) * 1000), int(s + rng.choice([0, 5_000, 30_000, 120_000])), int(rng.integers(0, 5)))
    truths = [(*site(), [str(x) for x in rng.choice(names, rng.integers(0, 3), replace=False)]) for _ in range(60)]
    truths += [(*truths[0][:4], ["c"]), truths[1]]
    calls = [(*site(), str(rng.choice(names))) for _ in range(50)]
    calls += calls[:3]
    carried = {}
    for *t, samples in truths:
        carried.setdefault(tuple(t), set()).update(samples)
    everyone = {c[4] for c in calls} | set().union(*carried.values())

    def meets(c, t):
        shared = min(c[2], t[2]) - max(c[1], t[1])
        return c[0] == t[0] and shared > 0 and min(c[3], 3) == min(t[3], 3) and shared / min(c[2] - c[1], t[2] - t[1]) >= 0.4

    size = lambda x: "small" if x[2] - x[1] < 20_000 else "middle" if x[2] - x[1] < 100_000 else "large"
    want = {}
    for t, samples in carried.items():
        for s in everyone:
            hit = any(c[4] == s and meets(c, t) for c in calls)
            at = want.setdefault((s, size(t)), [0, 0, 0, 0])
            at[0 if hit else 1] += s in samples
            at[3] += s not in samples and not hit
    for c in set(calls):
        want.setdefault((c[4], size(c)), [0, 0, 0, 0])[2] += not any(c[4] in samples and meets(c, t) for t, samples in carried.items())
    got = evaluation.confusion(
        spark.createDataFrame(calls, "chrom string, start long, end long, cn int, sample string"), spark.createDataFrame(truths, "chrom string, start long, end long, cn int, samples array<string>"), width=10_000
    )
    assert {(r["sample"], r["size_class"]): [r["tp"], r["fn"], r["fp"], r["tn"]] for r in got.collect()} == {k: v for k, v in want.items() if any(v)}


def test_confusion_of_empty_tables(spark):
    calls = spark.createDataFrame([("1", 0, 1000, 1, "a")], "chrom string, start long, end long, cn int, sample string")
    truths = spark.createDataFrame([("1", 0, 1000, 1, ["a"])], "chrom string, start long, end long, cn int, samples array<string>")
    rows = lambda c, t: [tuple(r) for r in evaluation.confusion(c, t).collect()]
    assert rows(calls.limit(0), truths.limit(0)) == []
    assert rows(calls, truths.limit(0)) == [("a", "small", 0, 0, 1, 0)]
    assert rows(calls.limit(0), truths) == [("a", "small", 0, 1, 0, 0)]


def test_warnings_and_coverage(spark):
    contigs = spark.createDataFrame([("chrX", 10), ("1", 5)], "chrom string, length long")
    assert tiles.found_sexes(contigs) == ["contig Y not found"]
    with pytest.raises(ValueError, match="no contig"):
        tiles.found_sexes(contigs, ("W",))
    seen = spark.createDataFrame([("1", 20_000), ("2", 20_000), ("3_random", 20_000), ("4", 5)], "chrom string, length long")
    regions = spark.createDataFrame([("1", 0, 5)], "chrom string, start long, end long")
    assert [r["chrom"] for r in readstats.unknown_contigs(seen, regions).collect()] == ["2"]
    stats = spark.createDataFrame([("a", 0.2, 100.0), ("b", 0.0, 90.0)], "sample string, bad double, read_mean double")
    mapped = spark.createDataFrame([("a", 1000)], "sample string, mapped long")
    assert {r["sample"]: r["coverage"] for r in readstats.coverage(stats, mapped, 4000).collect()} == {"a": pytest.approx(20.0), "b": None}


def test_chart_rows(spark):
    rows = [("s", "c", j, 0.0 if j < 3 else 3.0) for j in range(1503)] + [("t", "c", 0, 1.0), ("u", "c", 0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, chrom string, tile long, depth double")
    thin = sorted((r["x"], r["y"]) for r in tiles.depth_line(df.where("sample = 's'"), thin=True).collect())
    assert len(thin) == 300 and thin[0] == (3 * 16384, 2.5) and thin[1][0] == 8 * 16384
    assert {r["sample"]: r["background"] for r in tiles.background(df, 2).select("sample", "background").distinct().collect()} == {"s": False, "t": False, "u": True}
    assert spark.range(1).select(fm.virtual_offset(F.lit(5), F.lit(9))).first()[0] == 5 * 65536 + 9


def test_pairs_are_dealt_before_they_are_counted(spark):
    """Pairs go to tasks of ``task_rows`` by call and by truth (before: every split of the written pairs was hashed as a whole)."""
    calls = spark.createDataFrame([("1", 100 * k, 100 * k + 90, f"s{k % 3}", k % 5) for k in range(120)], "chrom string, start long, end long, sample string, cn int")
    truths = spark.createDataFrame([("1", 100 * k + 9 * (k % 4), 100 * k + 95, ["s0", f"s{k % 2}"], k % 5) for k in range(120)], "chrom string, start long, end long, samples array<string>, cn int")
    dealt = evaluation.confusion(calls, truths, task_rows=20)
    plan = dealt._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(_truth" in plan and "hashpartitioning(_call" in plan
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, evaluation.confusion(calls, truths).collect()))
