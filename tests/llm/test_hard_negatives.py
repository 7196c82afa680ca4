import math
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same, views

from covertile.llm.hard_negatives import mine
from covertile.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>, rank int, id string"


def brute(rows, k=5, m=10, low=30, high=90):
    use = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        use[i] = min(use.get(i, own), own)
    out = []
    for a, (label, v) in use.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, (other, w) in use.items() if b != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            near = [(n, b) for n, b, other in scores if other != label and low * -s <= 100 * -n <= high * -s][:m]
            out += [(a, p, r + 1, b, -s, -n) for r, (n, b) in enumerate(near)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in mine(df, "vec_id % 100 = 0", **more).collect())


def test_query_equals_sql(spark, sf):
    same(QUERIES["op12_hard_negatives"](spark, sf), views(sf), ORACLE_SQL["op12_hard_negatives"])


def vectors(n, seed, labels=4):
    rnd = np.random.default_rng(seed)
    # coarse components, so that scores tie
    return [(int(i) * 20, int(min(labels - 1, rnd.geometric(0.6) - 1)), (rnd.integers(-1, 4, 5) / 4).tolist()) for i in rnd.permutation(n)]


def test_blocks_and_ties_equal_brute_force(spark):
    rows = vectors(160, 3)
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, rows, block=16) == want


def test_a_vector_that_a_third_of_the_rows_share(spark):
    rows = [*vectors(90, 5), *((i * 20 + 7, 0, [0.5] * 5) for i in range(60))]
    assert found(spark, rows, block=32) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(40, 9), (None, 1, [1.0] * 5), (5, None, [1.0] * 5), (6, 1, None), (7, 1, []), (8, 1, [nan] * 5), (9, 1, [inf] * 5), (10, 1, [None] * 5), (11, 1, [1.0] * 4), (1300, 1, [1.0] * 4), (1400, 9, [1.0] * 5), (0, 3, [0.25] * 5), (1500, 1, [-1.0] * 5)]
    rows += [rows[0], rows[0]]
    assert found(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(i * 50, i % 2, [float(i) * 1e6, 1.0]) for i in range(12)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(100, None, None)]) == []


def test_other_limits(spark):
    rows = vectors(120, 11)
    assert found(spark, rows, low=-50, high=150, positives=3, negatives=4) == brute(rows, 3, 4, -50, 150)
