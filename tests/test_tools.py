"""Tools from files to results."""

import struct

import numpy as np
import pytest

from covertile import tools
from covertile.operators import evaluation


def bam_index(contigs):
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for offsets, mapped in contigs:
        out += struct.pack("<i", 1) + struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, mapped, 3) + struct.pack("<i", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets)
    return out


def test_index_coverage_from_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    paths, sizes = [], {}
    for k in range(4):
        contigs = []
        for c, n in (("chr1", 130), ("chrX", 40), ("GL1", 120)):
            own = rng.integers(900, 1100, n) // (2 if c == "chrX" and k % 2 else 1)
            sizes[f"s{k}", c] = own.tolist()
            contigs.append(([int(x) for x in np.r_[0, np.cumsum(own)] + 7], 1000 + k))
        path = tmp_path / f"s{k}.bam.bai"
        path.write_bytes(bam_index(contigs))
        paths.append(str(path))
    contigs = spark.createDataFrame([("chr1", 130 * 16384, 0), ("chrX", 40 * 16384, 1), ("GL1", 120 * 16384, 2), ("chr3", 5, 3)], "chrom string, length long, ord int")
    own, stats = tools.numbered_tiles(spark, paths, contigs)
    got = {}
    for r in own.collect():
        got.setdefault((r["sample"], r["chrom"]), {})[r["tile"]] = r["size"]
    assert {k: [v[t] for t in range(len(v))] for k, v in got.items()} == sizes
    found = tools.index_coverage(own, contigs, stats=stats, out=str(tmp_path / "out"))
    rows = {r["sample_id"]: r for r in found["pedigree"].collect()}
    assert [rows[f"s{k}"]["sex"] for k in range(4)] == [2, 1, 2, 1] and rows["s0"]["mapped"] == 3000
    assert all(r["PC1"] is not None and r["PC3"] is not None and r["PC4"] is None for r in rows.values())
    assert {r["chrom"] for r in found["charted"].collect()} == {"chr1", "chrX"}
    both = tools.index_coverage(own, contigs, include_gl=True)
    assert {r["chrom"] for r in both["charted"].collect()} == {"chr1", "chrX", "GL1"}
    assert {r["slope"] for r in both["pedigree"].collect()} != {r["slope"] for r in rows.values()}
    header = sorted((tmp_path / "out" / "pedigree").glob("part*"))[0].read_text().split("\n")[0]
    assert header.split("\t")[:2] == ["family_id", "sample_id"] and header.endswith("PC5")


def test_window_matrix_from_files(spark, tmp_path):
    for name, depth in (("a", 3.4), ("b", 8.6)):
        (tmp_path / f"{name}.depth.bed").write_text("".join(f"c\t{k * 10}\t{k * 10 + 10}\t{depth}\n" for k in range(7)) + f"d\t0\t4\t{depth}\n")
    got = sorted(tuple(r) for r in tools.window_matrix(spark, [str(tmp_path / "a.depth.bed"), str(tmp_path / "b.depth.bed")], 30).collect())
    assert got == [("c", 0, 30, 9, 27), ("c", 30, 60, 9, 27), ("c", 60, 70, 3, 9), ("d", 0, 4, 3, 9)]
    (tmp_path / "c.depth.bed").write_text("c\t0\t10\t1\n")
    with pytest.raises(ValueError, match="same windows"):
        tools.window_matrix(spark, [str(tmp_path / f"{x}.depth.bed") for x in "ac"], 30)


def test_debiased_depths_from_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    bases = "".join(rng.choice(list("ACGT"), 900))
    (tmp_path / "x.fa").write_text(">c\n" + "".join(bases[i : i + 60] + "\n" for i in range(0, 900, 60)))
    depths = rng.integers(5, 60, (30, 2))
    (tmp_path / "m.bed").write_text("#chrom\tstart\tend\ts\tt\n" + "".join(f"c\t{k * 30}\t{k * 30 + 30}\t{a}\t{b}\n" for k, (a, b) in enumerate(depths)))
    got = {(r["start"], r["sample"]): r["depth"] for r in tools.debiased_depths(spark, str(tmp_path / "m.bed"), str(tmp_path / "x.fa"), bounds=(0.3, 0.6), lead=20, out=str(tmp_path / "out")).collect()}
    gc = [sum(b in "GC" for b in bases[max(0, k * 30 - 20) : k * 30 + 30]) / (min(k * 30, 20) + 30) for k in range(30)]
    kept = sorted((k for k in range(30) if 0.3 <= gc[k] <= 0.6), key=lambda k: (gc[k], k * 30))
    for i, s in enumerate("st"):
        own = [float(depths[k, i]) for k in kept]
        out, held = [], own[:5]
        level = max(1.0, float(np.median(held)))
        for j, d in enumerate(own):
            if 5 <= j < len(own) - 5:
                held = [*held, own[j + 5]][-9:]
                level = max(1.0, float(np.median(held)))
            out.append(d / level)
        top = sorted(out)[int(0.65 * len(out))]
        assert {k * 30: pytest.approx(x / top) for k, x in zip(kept, out, strict=True)} == {a: d for (a, who), d in got.items() if who == s}
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*"))).split("\n")
    assert lines[0] == "chrom\tstart\tend\ts\tt" and len([x for x in lines if x.startswith("c\t")]) == len(kept) and len(lines[1].split("\t")[3].split(".")[1]) == 2


def test_calls_from_depths_and_their_report(spark):
    rows = [("c", k * 1000, k * 1000 + 1000, f"s{i}", 30.0 + i % 3 + (30 if i == 2 and 10 <= k < 20 else 0)) for i in range(7) for k in range(30)]
    calls = tools.called_runs(spark.createDataFrame(rows, "chrom string, start long, end long, sample string, depth double"))
    assert [(r["sample"], r["chrom"], r["start"], r["end"], r["n"]) for r in calls.collect()] == [("s2", "c", 11000, 20000, 9)]
    truths = spark.createDataFrame([("c", 10000, 20000, 4, ["s2"])], "chrom string, start long, end long, cn int, samples array<string>")
    report = tools.call_report(calls.selectExpr("sample", "chrom", "start", "end", "4 AS cn"), truths)
    assert [(r["sample"], r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in report["rows"].collect()] == [("s2", 1, 0, 0, 1.0, 1.0)]
    assert {r["size_class"]: r["recall"] for r in report["cohort"].collect()} == {"small": 1.0, "all": 1.0}
    assert evaluation.rated(spark.createDataFrame([("a", "small", 0, 0, 0, 5)], "sample string, size_class string, tp long, fn long, fp long, tn long")).first()["precision"] is None


def test_depths_of_samples_and_reads(spark):
    reads = spark.createDataFrame([(s, "c", a, a + 40, 60) for s in "ab" for a in range(0, 100, 2)], "sample string, chrom string, start long, end long, mapq int")
    regions = spark.createDataFrame([(s, "c", 0, 140) for s in "ab"], "sample string, chrom string, from long, to long")
    found = tools.coverage_depth(reads, regions, 50, least=4)
    assert found["windows"].count() == 6 and {r["class"] for r in found["classes"].collect()} == {"LOW_COVERAGE", "CALLABLE", "NO_COVERAGE"}
    blocks = tools.sample_depths(reads, 2, share=0.5).collect()
    assert {(r["sample"], r["start"], r["end"]) for r in blocks} == {("a", 12, 126), ("b", 12, 126)}
    contigs = spark.createDataFrame([("c", 3 * 16384, 0)], "chrom string, length long, ord int")
    split = tools.even_splits(spark.createDataFrame([("a", "c", t, 10**9) for t in range(3)], "sample string, chrom string, tile long, size long"), contigs, 3)
    assert sorted((r["ord"], r["start"], r["end"]) for r in split.collect()) == [(0, k * 16384, (k + 1) * 16384) for k in range(3)]
