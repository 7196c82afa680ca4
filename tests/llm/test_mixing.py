import math
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same, views

from covertile.llm import mixing
from covertile.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, source string, n int, target string, _row int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def mixed(df):
    return mixing.mix(mixing.with_sizes(df)).collect()


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["source"]].append(r)
    return out


def solved(sizes, target, most=2.0):
    """The multiplier by plain bisection."""
    low, high = -60.0, 60.0
    total = lambda k: sum(s * min(most, math.exp(min(50, k * s))) for s in sizes)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < target else (low, mid)
    return low


def test_query_equals_sql(spark, sf):
    same(QUERIES["op11_mixing"](spark, sf), views(sf), ORACLE_SQL["op11_mixing"])


def test_rates_are_balanced_and_targets_met(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * i) % 37)), ["b", "a", "hot", "hot", "hot", None][i % 6]) for i in range(900)]
    rows += [(1000 + i, "same text of five words", "hot") for i in range(1300)]
    out = mixed(table(spark, rows).repartition(7))
    assert len(out) == len(rows)
    found = by_source(out)
    sizes = {s: [r["size"] for r in g] for s, g in found.items()}
    share = 1.5 * sum(map(sum, sizes.values()))
    # a 3, b 1, hot 2, null 3
    weight, target, held = {"a": 3, "b": 1, "hot": 2, None: 3}, {}, set()
    while True:
        left, free = share - sum(2 * sum(sizes[s]) for s in held), sum(w for s, w in weight.items() if s not in held)
        target = {s: 2 * sum(sizes[s]) if s in held else left * w / free for s, w in weight.items()}
        more = {s for s in weight if s not in held and target[s] > 2 * sum(sizes[s])}
        if not more:
            break
        held |= more
    assert held
    for s, group in found.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sum(sizes[s]) for r in group)
        multiplier = solved(sizes[s], target[s])
        for r in group:
            assert r["rate"] == pytest.approx(min(2, math.exp(min(50, multiplier * r["size"]))), abs=1e-6)
            assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] and abs(r["copies"] - r["rate"]) <= 1.1
        assert abs(sum(r["taken"] for r in group) - target[s]) <= 0.5
    assert sum(r["copies"] for r in out) == mixing.repeated(mixing.mix(mixing.with_sizes(table(spark, rows)))).count()


def test_reruns_agree(spark):
    rows = [(i, "a b c " * (i % 9), f"s{i % 3}") for i in range(300)]
    one, two = (sorted((r["doc_id"], r["copies"]) for r in mixed(table(spark, rows).repartition(n))) for n in (2, 9))
    assert one == two


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", "z"), (1, " \t ", "z"), (1, "one", "y"), (1, "one", "y"), (None, "one two", "y"), (None, "one two", "y"), (4, "x " * 200_000, "long"), (5, "é ü", "ü"), (6, "no", "")]
    out = mixed(table(spark, rows))
    assert len(out) == len(rows) and {"n", "_row"} <= set(out[0].asDict())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(r[1]) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["text"] is not None or r["size"] == 0 for r in out)
    assert [r["target"] for r in out if r["source"] in (None, "z")] == [0.0] * 3


def test_empty_tables_and_empty_texts(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)) == []
    assert [(r["taken"], r["target"]) for r in mixed(table(spark, [(1, "", "a"), (2, None, "a")]))] == [(0, 0.0), (0, 0.0)]


def test_a_source_of_one_document(spark):
    out = mixed(table(spark, [(1, "a b c d", "a"), (2, "a b", "b")]))
    # 9 words: 6.75 for a, 2.25 for b
    assert {r["source"]: (r["target"], r["taken"]) for r in out} == {"a": (6.75, 8), "b": (2.25, 2)}


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op11_mixing"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan
