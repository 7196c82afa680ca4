import re
import sys
from collections import defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same, views

from covertile.llm import filter_audit
from covertile.llm.queries import ORACLE_SQL, QUERIES

DOCS, LABELS = "doc_id long, text string, lang string, mask int, part string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out, shapley = [], defaultdict(int)
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                prior = set(order[:k])
                gone = [x for x in own if f in x[1] and not x[1] & prior]
                shapley[part, f] += len(gone)
                out.append([part, order, k + 1, sum(not x[1] & {*prior, f} for x in own), len(gone), sum(f in x[1] and bool(x[1] & prior) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def found(spark, docs, labels, parts=3):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(parts)
    return sorted(tuple(r) for r in filter_audit.audit(df, spark.createDataFrame(labels, LABELS)).collect())


def rows(seed=1, n=250):
    rnd = np.random.default_rng(seed)
    words = ["alpha", "Beta", "GAMMA", "d#e", "é", "x|y", "z", *map(str, range(150))]
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 160))) for _ in range(n // 2)]
    picked = [texts[min(int(rnd.integers(0, n)), n // 2 - 1)] for _ in range(n)]  # the last text is half of the rows
    docs = [(int(i), t, ["en", "de", None, ""][int(rnd.integers(0, 4))]) for i, t in zip(rnd.permutation(n), picked, strict=True)]
    return docs, [(int(i), int(rnd.integers(0, 2)), int(rnd.integers(0, 2))) for i in rnd.permutation(n)[: n // 3]]


def test_query_equals_sql(spark, sf):
    same(QUERIES["op13_filter_audit"](spark, sf), views(sf), ORACLE_SQL["op13_filter_audit"])


def test_equals_brute_force(spark):
    docs, labels = rows()
    assert found(spark, docs, labels) == brute(docs, labels)


def test_chains_that_are_sent_early(spark, monkeypatch):
    docs, labels = rows(2)
    want = brute(docs, labels)
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", 500)
    spark_rows = [(7, d[0], d[2] or "", (d[1] or "").encode()) for d in docs]  # every fingerprint collides
    sent = [r for k in range(0, len(docs), 60) for r in filter_audit.own_chains(filter_audit.failures, 16)(spark_rows[k : k + 60])]
    masks = list(filter_audit.judged(16)(sorted(sent, key=lambda r: r[0])))
    least = {}
    for i, t, _ in docs:
        least[t] = min(i, least.get(t, i))
    assert len(masks) == len(docs)
    assert {i for i, _, m in masks if m & 16} == {i for i, t, _ in docs if i > least[t]}
    assert sum(r[4] for r in want if r[1] == "EABCD" and r[2] == 1) == sum(m & 16 > 0 for *_, m in masks)


def test_odd_rows(spark):
    docs = [(None, "a", "en"), (None, "a", "en"), (3, "a", "en"), (3, "a", "en"), (2, "a", None), (9, None, ""), (8, "", None), (1, "W " * 300_000, "long"), (0, " \t\n", "en"), (5, "É É" * 50, "fr"), (6, "A1\x0bB2\x1cC3 D", "fr")]
    labels = [(None, 1, 1), (3, 1, None), (3, 0, 1), (9, None, None), (77, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "a", "en")], []) == brute([(1, "a", "en")], [])
