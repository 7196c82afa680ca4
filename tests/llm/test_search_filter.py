import math

import numpy as np

from covertile.llm import topk_search, url_filter


def brute(rows, k):
    ok = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 3 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def search(df, **how):
    return {tuple(r) for r in topk_search.search(df, df.where("vec_id % 3 = 0"), **how).collect()}


def test_search_equals_brute_force(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rnd.integers(-2, 3, 4) / 4]) for i in range(150)]
    rows += [(150, None), (151, [None, 1.0, 1.0, 1.0]), (153, [float("nan"), 1.0, 1.0, 1.0]), (156, [float("inf"), 1.0, 1.0, 1.0]), (159, []), (162, rows[0][1]), (165, rows[0][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score long").repartition(5)
    want = brute(rows, 5)
    assert search(df) == want == search(df, tile=7, tile_queries=3) == search(df, block=20)


def test_search_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert search(df) == {(0, 1, 3, 131072), (3, 1, 0, 131072)}
    assert search(df.where("vec_id < 0")) == set() and search(df.where("vec_id = 3")) == set()


def test_vectors_of_several_lengths_and_large_components(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.integers(-9, 9, 2 + i % 3)]) for i in range(40)]
    rows += [(60 + i, [float(np.float32(x)) for x in rnd.normal(0, 1e6, 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in ok if i % 3 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    assert search(df) == want
    far = spark.createDataFrame([(0, [1e30, 1e30]), (3, [1e30, -1.0]), (6, [-1e30, 1.0])], df.schema)
    assert sorted(search(far))[:2] == [(0, 1, 3, 2**63 - 1), (0, 2, 6, 1 - 2**63)]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://Www.Example.COM/en/x?y#z", "http://a.example.com/en/1", "http://example.com/EN/", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/fr", "http://net/fr/?q",
    "ftp://a.b?c://d/", "http://example.com?x=/en/", "http://www.example.com./en/", "http://u@example.com:80/en/", "a://b\nc.com/x", "http://é.com/en/", "http://.com/", "http://a..com/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    rows = [(i, u, u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for limit in (1000, 2):  # broadcast rules, and both sides shuffled
        out = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules, broadcast_rules=limit).collect()}
        assert out == {i: judged(u) for i, u, _ in rows}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), default="allow").collect()} == {"allow"}


def test_block_wins_between_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "/", "block"), ("a.b", "/", "allow")], "host string, path string, verdict string")
    assert url_filter.judge(pages, rules).first()["verdict"] == "block"
