"""Orders over many ranges against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covertile.operators import sequences


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(8)
    data = [("hot" if i % 3 else f"k{i % 7}", int(v), i, int(v) if v % 4 == 0 else None) for i, v in enumerate(rnd.integers(0, 200, 400))]
    return data, spark.createDataFrame(data, "k string, v long, id long, mark long").repartition(5)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_ranks_and_sums(spark, rows):
    data, df = rows
    got = {r["id"]: (r["rank"], r["n"]) for r in sequences.ranked(df, ["v", "id"], keys=("k",), ranges=9, total="n").collect()}
    assert got == {r[2]: (i, len(g)) for g in by_key(data).values() for i, r in enumerate(g)}
    assert sorted(r["rank"] for r in sequences.ranked(df, ["v", "id"], ranges=9).collect()) == list(range(400))
    sums = {r["id"]: r["s"] for r in sequences.running(df, ["k"], ["v", "id"], F.col("v"), "s", ranges=9).collect()}
    assert sums == {r[2]: sum(x[1] for x in g[: i + 1]) for g in by_key(data).values() for i, r in enumerate(g)}


@pytest.mark.parametrize("backwards", [False, True])
def test_following(spark, rows, backwards):
    data, df = rows
    got = {r["id"]: (r["a"], r["b"]) for r in sequences.following(df, ["k"], ["v", "id"], backwards, 9, a=F.col("mark"), b=F.col("id")).collect()}
    want = {}
    for g in by_key(data).values():
        for i, r in enumerate(g):
            rest = g[:i][::-1] if backwards else g[i + 1 :]
            want[r[2]] = next((x[3] for x in rest if x[3] is not None), None), next((x[2] for x in rest), None)
    assert got == want


def test_walks(spark):
    rows = [(k, i, i + step if i + step < n else None) for k, n, step in (("a", 100, 3), ("b", 1, 1), ("c", 64, 1), ("d", 5, 9)) for i in range(n)]
    got = sorted(tuple(r) for r in sequences.walk(spark.createDataFrame(rows, "k string, at long, next long"), ["k"]).collect())
    assert got == sorted([("a", i) for i in range(0, 100, 3)] + [("b", 0)] + [("c", i) for i in range(64)] + [("d", 0)])


def test_blocks_have_their_halo(spark, rows):
    data, df = rows
    got = sequences.blocked(df, ["k"], ["v", "id"], 3, 10).collect()
    for k, g in by_key(data).items():
        for b in range((len(g) + 9) // 10):
            own = sorted((r["_rank"], r["id"], r["_own"]) for r in got if r["k"] == k and r["_block"] == b)
            assert own == [(i, g[i][2], i // 10 == b) for i in range(max(0, b * 10 - 3), min(len(g), b * 10 + 13))]
