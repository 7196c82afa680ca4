import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from covertile.sources import binary, sinks, text


def bgzf(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def test_fasta_index_keeps_file_order(spark, tmp_path):
    (tmp_path / "x.fai").write_text("chr2\t50\t100\t60\t61\nchr10\t70\t5\t60\t61\n")
    got = [tuple(r) for r in text.fasta_index(spark, str(tmp_path / "x.fai")).orderBy("ord").collect()]
    assert got == [("chr10", 70, 0), ("chr2", 50, 1)]
    with pytest.raises(ValueError, match="no contigs"):
        text.fasta_index(spark, str(tmp_path / "x.fai"), "chr3")


def test_bed_and_regions(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\nchr1\t5\t9\textra\nchr1\t9\t9\nchr2\t0\t4")
    assert sorted(tuple(r) for r in text.bed(spark, str(tmp_path / "a.bed")).collect()) == [("chr1", 5, 9), ("chr2", 0, 4)]
    (tmp_path / "r.txt").write_text("chr1:1-5\nbad\n")
    assert [tuple(r) for r in text.regions(spark, str(tmp_path / "r.txt")).collect()] == [("chr1", 0, 5)]


def test_cram_index(spark, tmp_path):
    with gzip.open(tmp_path / "s.crai", "wt") as f:
        f.write("0\t1\t40000\t10\t20\t4000\n0\t40001\t20000\t10\t20\t900\n-1\t0\t0\t1\t1\t1\n1\t5\t-3\t1\t1\t1\n1\t1\t100\t1\t1\t1\n")
    slices = text.cram_index(spark, str(tmp_path / "s.crai"))
    assert slices.select("ref_id").distinct().count() == 1 and slices.count() == 2
    sizes = [r["size"] for r in binary.cram_tiles(slices).orderBy("tile").collect()]
    assert sizes == binary.slice_tiles([(1, 40000, 4000), (40001, 20000, 900)])
    with gzip.open(tmp_path / "bad.crai", "wt") as f:
        f.write("0\t1\t2\n")
    with pytest.raises(Exception, match="six integers"):
        text.cram_index(spark, str(tmp_path / "bad.crai")).collect()


def test_slice_tiles_fill_gaps():
    assert binary.slice_tiles([]) == []
    assert binary.slice_tiles([(0, 32768, 32768)]) == [100_000, 100_000]
    assert binary.slice_tiles([(0, 16384, 16384), (16384 * 4, 16384, 16384)]) == [100_000, 100_000, 0, 100_000]


def test_bam_index(spark, tmp_path):
    ref = struct.pack("<i", 1) + struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, 7, 2) + struct.pack("<i", 3) + struct.pack("<QQQ", 100, 150, 400)
    (tmp_path / "x.bam.bai").write_bytes(b"BAI\x01" + struct.pack("<i", 2) + ref + struct.pack("<ii", 0, 0))
    rows = binary.bam_indexes(spark, str(tmp_path / "x.bam.bai"))
    assert sorted((r["sample"], r["ref_id"], r["mapped"], r["unmapped"]) for r in rows.collect()) == [("x", 0, 7, 2), ("x", 1, 0, 0)]
    assert [(r["tile"], r["size"]) for r in binary.index_tiles(rows).orderBy("tile").collect()] == [(0, 50), (1, 250)]


def test_bam_header(spark, tmp_path):
    head = b"@HD\tVN:1.6\n@RG\tID:a\tSM:one\n@RG\tID:b\n"
    raw = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    (tmp_path / "x.bam").write_bytes(bgzf(raw[:20]) + bgzf(raw[20:]))
    heads = binary.bam_headers(spark, str(tmp_path / "x.bam"))
    assert [(r["chrom"], r["length"], r["ord"]) for r in binary.header_contigs(heads).collect()] == [("chr1", 1000, 0)]
    assert sorted((r["rg_id"], r["sm"]) for r in binary.read_groups(heads).collect()) == [("a", "one"), ("b", None)]


def test_index_path():
    there = {"a.bam.bai", "b.bai", "c.cram.crai"}
    assert [binary.index_path(p, there.__contains__) for p in ("a.bam", "b.bam", "c.cram", "d.crai")] == ["a.bam.bai", "b.bai", "c.cram.crai", "d.crai"]
    with pytest.raises(FileNotFoundError):
        binary.index_path("z.bam", there.__contains__)


def test_matrices_and_calls(spark, tmp_path):
    (tmp_path / "m.bed").write_text("#chrom\tstart\tend\tA\tB\nc\t0\t5\t1.5\t2\nc\t5\t9\t0\t4\n")
    got = sorted(tuple(r) for r in text.depth_matrix(spark, str(tmp_path / "m.bed")).collect())
    assert got == [("c", 0, 5, "A", 1.5), ("c", 0, 5, "B", 2.0), ("c", 5, 9, "A", 0.0), ("c", 5, 9, "B", 4.0)]
    (tmp_path / "t.bed").write_text("#x\nc\t0\t5\t1\ta,b\nc\t0\t5\t1\td\n")
    assert text.copy_number_calls(spark, str(tmp_path / "t.bed"), ["b"]).first()["samples"] == ["a", "b"]
    (tmp_path / "s9.depth.bed").write_text("c\t0\t5\t1.5\n")
    assert tuple(text.depth_windows(spark, str(tmp_path / "s9.depth.bed")).first()) == ("s9", "c", 0, 5, 2)


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 note\nACGT\nacgt\n>c2\nTT\n")
    assert sorted(tuple(r) for r in text.fasta(spark, str(tmp_path / "g.fa")).collect()) == [("c1", "ACGTacgt"), ("c2", "TT")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", 5, 9, 1.23456), ("c", 0, 5, 2.0)], "chrom string, start long, end long, v double")
    sinks.write_tsv(sinks.formatted(df), str(tmp_path / "out"), ["chrom", "start"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).replace("chrom\tstart\tend\tv\n", "")
    assert lines == "c\t0\t5\t2\nc\t5\t9\t1.23\n"
    assert df.select(sinks.fixed(F.col("v"))).first()[0] == "1.23"


def test_references(spark, tmp_path):
    from covertile.sources import references

    (tmp_path / "x.fai").write_text("chr2\t50\t100\t60\t61\nX\t70\t5\t60\t61\n")
    contigs = references.contigs_of(spark, ["a.cram"], str(tmp_path / "x.fai"))
    assert references.contig_length(contigs, "X") == 70
    assert [r["chrom"] for r in references.find_contig(contigs, "chrX").collect()] == ["X"]
    with pytest.raises(ValueError, match="no contig 2"):
        references.contig_length(contigs, "2")
    raw = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c9\0" + struct.pack("<i", 12)
    (tmp_path / "y.bam").write_bytes(bgzf(raw))
    assert references.contig_length(references.contigs_of(spark, [str(tmp_path / "y.bam")]), "c9") == 12
    with pytest.raises(ValueError, match="neither"):
        references.contigs_of(spark, ["a.cram"])


@pytest.mark.parametrize("split", [64, 200, 1 << 20])
def test_fasta_lines_and_window_composition(spark, tmp_path, split):
    import random

    from covertile.operators import depth

    rnd = random.Random(split)
    contigs = {f"c{k}": "".join(rnd.choice("ACGTacgtNn") for _ in range(n)) for k, n in enumerate((1, 130, 611, 59, 60))}
    (tmp_path / "x.fa").write_text("".join(f">{c} text\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)) for c, seq in contigs.items()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = text.fasta_lines(spark, str(tmp_path / "x.fa"))
        rows = lines.collect()
        assert len({r["chrom"] for r in rows}) == 5
        for r in rows:
            seq = contigs[r["chrom"]]
            assert seq[r["start"] : r["start"] + len(r["sequence"])] == r["sequence"] and seq[r["start"] + len(r["sequence"]) :][:1] == r["after"]
        windows = [(c, a, min(len(seq), a + 47)) for c, seq in contigs.items() for a in range(0, len(seq), 47)]
        got = depth.window_composition(spark.createDataFrame(windows, "chrom string, start long, end long"), lines, lead=20, width=64).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(windows)
    for r in got:
        x = contigs[r["chrom"]][max(0, r["start"] - 20) : r["end"]]
        up = x.upper()
        assert r["gc"] == pytest.approx(sum(b in "GC" for b in up) / len(x)) and r["masked"] == pytest.approx(sum(b.islower() for b in x) / len(x))
        assert r["cpg"] == pytest.approx(2 * up.count("CG") / len(x))


def test_bam_records_in_chunks(spark, tmp_path):
    import random

    from covertile.sources import bam

    rnd = random.Random(3)
    want = [(c, p, p + rnd.randrange(1, 400), rnd.randrange(61), 2, -1, -1, rnd.randrange(-500, 500), f"read{k}" + "x" * rnd.randrange(100)) for k, (c, p) in enumerate((rnd.randrange(3), rnd.randrange(3_000_000)) for _ in range(6000))]
    df = spark.createDataFrame(want, "ref_id int, pos long, end long, mapq int, flag int, mate_ref int, mate_pos long, tlen long, name string")
    bam.write_bam(df, str(tmp_path / "a"), [("c1", 1 << 28), ("c2", 5000), ("c3", 1 << 28)])
    bam.write_bam(df.repartition(7), str(tmp_path / "b"), [("c1", 1 << 28), ("c2", 5000), ("c3", 1 << 28)])
    for chunk in (1, 1 << 30):
        got = bam.read_bam(spark, str(tmp_path / "a"), chunk)
        assert sorted(tuple(r) for r in got.select(df.columns).collect()) == sorted(want)
        assert (got.rdd.getNumPartitions() > 8) == (chunk == 1)
    row = got.where("name LIKE 'read17x%' OR name = 'read17'").first()
    assert row["n_cigar"] == 1 and row["cigar_first"] == "M" and row["read_len"] == row["end"] - row["pos"]
    assert sum(r["mapped"] for r in binary.bam_indexes(spark, str(tmp_path / "a" / "*.bai")).collect()) == 6000
    assert {r["chrom"] for r in binary.header_contigs(binary.bam_headers(spark, str(tmp_path / "a" / "*.bam"))).collect()} == {"c1", "c2", "c3"}
    same = sorted(f.name for f in (tmp_path / "a").glob("part*"))
    assert same and b"".join((tmp_path / "a" / n).read_bytes() for n in same) == b"".join((tmp_path / "b" / n).read_bytes() for n in same if (tmp_path / "b" / n).exists())


def test_cigars_of_several_operations():
    from covertile.sources import bam

    ops = [(5, 4), (20, 0), (3, 1), (7, 2), (100, 3), (9, 0), (2, 5)]
    body = struct.pack("<iiBBHHHiiii", 0, 99, 2, 60, 0, len(ops), 16, 0, -1, -1, 0) + b"r\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    raw = struct.pack("<i", len(body)) + body
    columns, upto = bam.decoded(raw + raw[:10], len(raw) + 10)
    assert upto == len(raw) and columns["end"].tolist() == [99 + 20 + 7 + 100 + 9] and columns["read_len"].tolist() == [5 + 20 + 3 + 9] and columns["cigar_first"].tolist() == ["S"]


def test_blocked_gzip_table(spark, tmp_path):
    from covertile.sources import bgzf

    df = spark.range(20_000).selectExpr("id % 3 AS ord", "concat('c', id % 3) AS chrom", "id AS start", "CAST(id AS double) / 4 AS x")
    whole = []
    for name in "ab":
        bgzf.write_bgzf(df.repartition(5), str(tmp_path / name), ["ord", "start"], without=("ord",))
        whole.append(b"".join(f.read_bytes() for f in sorted((tmp_path / name).glob("part*"))))
    assert whole[0] == whole[1] and whole[0].endswith(bgzf.END) and whole[0].count(bgzf.END) == 1
    parts = list(bgzf.blocks_from(memoryview(whole[0])))
    assert parts[-1][1] == len(whole[0]) and all(len(raw) <= bgzf.BLOCK for *_, raw in parts)
    lines = gzip.decompress(whole[0]).decode().split("\n")
    assert lines[0] == "#chrom\tstart\tx" and lines[1] == "c0\t0\t0.0" and len(lines) == 20_002
    assert [int(x.split("\t")[1]) for x in lines[1:-1]] == sorted(range(20_000), key=lambda i: (i % 3, i))
