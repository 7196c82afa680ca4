import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from covertile.llm import licenses, quality, queries, toxicity
from covertile.llm.common import flat_bytes

ODD = [(0, None), (1, ""), (2, " \n\n "), (3, "x"), (4, "x"), (5, "word " * 30_000), (6, "漢字 é ü"), (7, "!!! ### $$$")]


def test_held_out_quality(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    scored = queries.QUERIES["op6_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in scored)
    held = [r for r in scored if r["held_out"]]
    for label in (0, 1):
        assert np.mean([r["predicted"] == label for r in held if r["quality"] == label]) >= 0.9


def test_toxic_documents_are_recalled_and_ordinary_ones_left(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    scored = queries.QUERIES["op10_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in scored)
    held = [r for r in scored if r["held_out"]]
    caught, alarms = (np.mean([r["predicted"] for r in held if r["toxic"] == c]) for c in (1, 0))
    ranked = np.mean([[x["score"] > y["score"] for y in held if y["toxic"] == 0] for x in held if x["toxic"] == 1])
    assert caught >= 0.5 and alarms <= 0.05 and ranked >= 0.9, (caught, alarms, ranked)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_texts_and_no_labels(spark, module):
    docs = spark.createDataFrame([(i, t, i) for i, t in ODD], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(99, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = {r["doc_id"]: r["score"] for r in module.score(docs, module.fit(docs, known)).collect()}
        assert len(rows) == 8 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1] and rows[3] == rows[4]
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    texts = [t or "" for _, t in ODD] + ["Der Der Der die.", "A | b | c", "line\nline\nother"]
    data, offsets = flat_bytes(pa.array(texts))
    together = quality.statistics(data, offsets)
    for k, t in enumerate(texts):
        alone = quality.statistics(*flat_bytes(pa.array([t])))
        assert np.allclose(alone[0], together[k])
    named = dict(zip(quality.FEATURES, together[-1], strict=True))
    assert named["repeated_lines"] == pytest.approx(1 / 3) and named["lines"] == 1.0


def test_flat_trees_equal_a_walk():
    rnd = np.random.default_rng(0)
    x = rnd.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.BoostedTrees.fit(x, y, trees=30, depth=3)
    got = model.scores(x)
    for i in range(0, 400, 37):
        margin = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            margin += leaf[node - 7]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((got > 0.5) == y).mean() > 0.95


def test_class_models_are_distributions():
    texts = pa.array(["abab abba", "abab baab", "cccc abcd", "dddd"])
    data, starts, ends, _ = toxicity.words_of(texts)
    flat, begin = toxicity.marked(data, starts, ends)
    weights = np.array([[1, 0], [1, 0], [1, 0], [1, 1], [0, 1], [0, 1], [0, 2]])[: len(starts)]
    models = toxicity.SpellingModels(flat, begin, weights)
    same = toxicity.SpellingModels(flat, begin, np.ones((len(starts), 2)))
    assert np.allclose(same.evidence(flat, begin), 0)
    value = models.evidence(flat, begin)
    assert value[0] < 0 < value[-1]


def test_planted_insult_is_found_in_a_long_text():
    rnd = np.random.default_rng(1)
    syllables = ["on", "er", "th", "an", "re", "ing", "st", "ou"]
    word = lambda: "".join(rnd.choice(syllables, rnd.integers(1, 4)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(150)]
    toxic = [" ".join([word() for _ in range(40)] + ["glumpf"] + [word() for _ in range(30)]) for _ in range(60)]
    model = toxicity.ToxicityModel(pa.array(clean[:100] + toxic[:40]), np.r_[np.zeros(100, int), np.ones(40, int)])
    assert model.scores(pa.array(toxic[40:])).min() > 0.5 > model.scores(pa.array(clean[100:])).max()


def test_all_labelled_documents_are_counted(spark):
    """An insult of documents beyond the logistic part's sample is known; counts equal those of one pass over all texts."""
    rnd = np.random.default_rng(2)
    syllables = ["on", "er", "th", "an", "re", "ing", "st", "ou"]
    prose = lambda n: " ".join("".join(rnd.choice(syllables, rnd.integers(1, 4))) for _ in range(n))
    order = [r[0] for r in spark.range(240).selectExpr("id").orderBy(toxicity.F.xxhash64("id"), "id").collect()]
    word = {i: "" if i % 3 else "braxil" if k < 100 else "glumpf" for k, i in enumerate(order)}
    rows = [(i, f"{prose(20)} {word[i]} {prose(20)}") for i in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_rows=20)
    fresh = pa.array([f"{prose(20)} {w} {prose(20)}" for w in ("glumpf", "braxil", "", "") for _ in range(5)])
    assert (model.scores(fresh) > 0.5).tolist() == [True] * 10 + [False] * 10
    labelled = docs.join(labels, "doc_id").withColumn("_fold", (toxicity.F.col("doc_id") % 3).cast("int"))
    keys, counts = toxicity.labelled_counts(labelled, "text", "toxic", 3, chunk_bytes=700, most_keys=50)
    want = toxicity.gram_counts(pa.array([t for _, t in rows]), np.array([int(i % 3 == 0) * 3 + i % 3 for i, _ in rows]), 6)
    assert np.array_equal(keys, want[0]) and np.array_equal(counts.reshape(-1, 6), want[1])


LICENSED = {
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY 4.0.": "cc-by", "All rights reserved.": "unknown", "Licensed under the Frobnicate license v2": "unknown", "the cat sat on the mat": "none",
}


def by_hand(line):
    weights, bias = licenses.model()
    own = [weights[g] for g in licenses.grams(line) if g in weights]
    guess = licenses.judged([sum(x) for x in zip(bias, *own, strict=True)]) if own else "none"
    tokens = set(licenses.re.findall(licenses.TOKEN, line.lower()))
    if guess in licenses.FAMILIES and not any(f == guess and len(tokens & set(t)) >= 0.6 * len(t) for f, t in licenses.template_words()):
        return "unknown"
    return guess


def test_fit_leaves_no_models_of_folds_behind(spark):
    """The models of the folds serve one job; the driver keeps their broadcast no longer than that."""
    texts = [f"plain words of number {k} " + ("vile grunk" if k % 4 == 0 else "kind praise") for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id long, toxic int")
    before = set(os.listdir(spark.sparkContext._temp_dir))
    model = toxicity.fit(docs, labels)
    assert set(os.listdir(spark.sparkContext._temp_dir)) <= before
    assert np.diff(model.scores(pa.array(["kind praise", "vile grunk"])))[0] > 0


def test_licences(spark):
    for line, want in LICENSED.items():
        assert by_hand(line) == want
    texts = [None, "", "\n".join(LICENSED), "MIT\nmit license\n" + "x " * 5000, *LICENSED, *[t for ts in licenses.TEMPLATES.values() for t in ts]]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = {(r["doc_id"], r["line"]): r["family"] for r in licenses.scan(df).collect()}
    want = {(i, k): by_hand(line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))}
    assert got == {k: v for k, v in want.items() if v != "none"}
    rows = {r["doc_id"]: r for r in licenses.by_document(df).collect()}
    assert len(rows) == len(texts) and rows[0]["families"] == "" and rows[2]["families"] == "apache,cc-by,cc-by-nc,gpl,mit" and rows[2]["n_unknown"] == 2
    assert licenses.by_document(df.limit(0)).count() == 0


def test_licences_of_rows_that_share_an_id(spark):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", None]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").repartition(2)
    rows = [tuple(r) for r in licenses.by_document(df).collect()]
    assert rows == [(1, "apache,mit", 3, 0, 0)] * 4


def test_of_several_labels_the_least_counts(spark):
    docs = spark.createDataFrame([(i, f"{'good words here ' * (i % 5 + 1)}{i}") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    one = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    two = quality.fit(docs, spark.createDataFrame([*labels, *((i, 1) for i in range(40))], "doc_id long, quality int").repartition(5))
    assert [r["score"] for r in quality.score(docs, one).orderBy("doc_id").collect()] == [r["score"] for r in quality.score(docs, two).orderBy("doc_id").collect()]


def test_class_probabilities_sum_to_one():
    """Exact Kneser-Ney sums: after a context that both classes know, the shares of all bytes that can follow add up to one."""
    texts = pa.array(["abab abba", "abab baab abc", "cccc abcd", "dddd abd"])
    data, starts, ends, _ = toxicity.words_of(texts)
    flat, begin = toxicity.marked(data, starts, ends)
    models = toxicity.SpellingModels(flat, begin, np.tile([2, 1], (len(starts), 1)))
    context = np.frombuffer(bytes([toxicity.START]) + b"ab", np.uint8)
    tries = [np.r_[context, np.uint8(b)] for b in range(256)]
    flat = np.concatenate(tries)
    at = np.arange(256) * 4 + 3
    hashed = toxicity.RangeHash(flat)
    p = np.full(256, 1 / 256)
    for n in range(toxicity.ORDER - 1):
        if n < 3:
            count, known = models.low[n]
            p = models._mixed(count(hashed(at - n, at + 1)), known(hashed(at - n, at)), p, toxicity.SHARED_DISCOUNTS)
            assert p.sum() == pytest.approx(1)
    for count, known in models.full:
        assert models._mixed(count(hashed(at - 3, at + 1)), known(hashed(at - 3, at)), p, toxicity.CLASS_DISCOUNTS).sum() == pytest.approx(1)
