"""Every query of the catalogue against its SQL on the smallest tables; those without SQL run and have invariants elsewhere."""

import time
from collections import defaultdict

import pytest
from compare import same, views

import __spark_entry__ as entry
from pyspark.sql import functions as F

from covertile.operators import readstats
from covertile.plans import catalog
from covertile.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), views(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_read_statistics_stop_early(spark, sf):
    """The same query and SQL with limits that small tables reach."""
    done = readstats.statistics(catalog._reads(spark, sf), 100, 100).withColumns({c: F.round(c, 6) for c in catalog._STATS})
    same(done, views(sf), ORACLE_SQL["read_statistics"].replace("2000000", "200").replace("1000000", "100"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_interval_queries_take_every_row(spark, sf):
    rows = views(sf).execute("SELECT l_suppkey::VARCHAR, date_diff('day', DATE '1992-01-01', l_shipdate::DATE), l_quantity::INT, l_orderkey, l_linenumber FROM lineitem").fetchall()
    sides = [defaultdict(list), defaultdict(list)]
    for chrom, s, n, read, part in rows:
        sides[1 - read % 2][chrom].append((read, part, s, s + n))
    got = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())
    pairs = [(c, *x, *y) for c in sides[0] for x in sides[0][c] for y in sides[1][c] if x[3] > y[2] and x[2] < y[3]]
    assert got("all_overlap_pairs") == sorted(pairs)
    assert got("all_overlap_exists") == sorted({p[:5] for p in pairs})
    assert QUERIES["overlap_pairs"] is QUERIES["all_overlap_pairs"]
    points = [{(c, p) for c in side for x in side[c] for p in range(x[2], x[3])} for side in sides]
    ends = defaultdict(int)
    for c, p in points[0] | points[1]:
        ends[c] = max(ends[c], p + 1)
    every = {(c, p) for c in ends for p in range(ends[c])}
    for name, want in {"merge": points[0] | points[1], "subtract": points[0] - points[1], "intersect": points[0] & points[1], "complement": every - points[0] - points[1]}.items():
        found = QUERIES[f"all_interval_{name}"](spark, sf).collect()
        assert sorted((r["chrom"], p) for r in found for p in range(r["start"], r["end"])) == sorted(want)


def test_window_composition_of_long_texts(spark, tmp_path):
    """Lines are cut in one pass: a text of 1.5 million characters was walked 50,000 times before."""
    texts = [(1, "ACgtN\n" * 250_000), (2, "é\U0001f9eccg" * 75), (3, ""), (4, None), (5, "cG" * 30), (6, ("g" * 59 + "C") * 2 + "G")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "sf" / "documents.parquet")
    begun = time.monotonic()
    same(QUERIES["window_composition"](spark, f"{tmp_path}/sf"), views(f"{tmp_path}/sf"), ORACLE_SQL["window_composition"])
    assert time.monotonic() - begun < 60
