import re

import numpy as np
import pytest

from covertile.llm import minhash_dedup, suffix_dedup
from covertile.llm.common import byte_hashes


def repeats(rows, length):
    first = {}
    out = {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        own = [raw[p : p + length] for p in range(len(raw) - length + 1)]
        gone = np.zeros(len(raw), bool)
        for p, w in enumerate(own):
            if w in first:
                gone[p : p + length] = True
        for w in own:
            first.setdefault(w, i)
        out[i] = (len(raw), bytes(b for b, g in zip(raw, gone, strict=True) if not g), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0)
    return out


def documents(seed, n=60):
    rnd = np.random.default_rng(seed)
    letters = list("abcd é\n")
    base = ["".join(rnd.choice(letters, rnd.integers(0, 400))) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        if i % 4 == 1:
            t = base[i - 1] if i % 8 == 1 else base[rnd.integers(0, n)][:120] + t[:50]
        if i % 7 == 3:
            t = "ab" * 90 + t
        out.append((i * 3 % 101 + 1000 * (i % 2), t))
    return [*out, (5000, None), (5001, ""), (5002, "short"), (5003, "é" * 40), (5004, "é" * 41)]


@pytest.mark.parametrize(("length", "k", "hot"), [(50, 20, 20_000), (50, 20, 1), (12, 5, 1), (16, 16, 2)])
def test_repeats_equal_brute_force(spark, length, k, hot):
    rows = documents(length)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, start long, kind string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(df, length=length, k=k, bucket_bytes=3000, hot=hot).collect()}
    assert got == repeats(rows, length)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_contexts_that_repeat_inside_a_document_lose_the_same_bytes(spark, hot):
    """A document holds a passage several times that a smaller one shares in part; long texts go in slices."""
    rnd = np.random.default_rng(3)
    some = lambda n: "".join(rnd.choice(list("abcdefgh \n"), n))
    passage = some(55)
    rows = [(-9, some(30) + passage + some(30)), (4, "".join(f"x{passage[:53]}y{some(k)}" for k in range(6))), (7, "#" + "-" * 150), (8, "." + "-" * 90 + "+" + "-" * 200 + some(9))]
    rows += [(20 + k, passage[k:] * 4 + some(7) + passage[: 50 + k] * 3) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for how in ({}, {"slice_bytes": 40}):
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(df, bucket_bytes=500, hot=hot, **how).collect()}
        assert got == repeats(rows, 50)


def test_kept_texts_keep_columns(spark):
    df = spark.createDataFrame([(1, "é" * 60, "de", "s"), (2, "x" + "é" * 60, "de", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    out = suffix_dedup.kept_texts(df)
    assert out.columns == df.columns and [r["text"] for r in out.orderBy("doc_id").collect()] == ["é" * 60, "x", ""]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    nameless = df.union(spark.createDataFrame([(None, "é" * 60, None, None)], df.schema))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in suffix_dedup.kept_texts(nameless).collect()) == [(0, "é" * 60), (1, "é" * 60), (2, "x"), (3, "")]


def test_expansion_finds_exactly_the_common_prefixes():
    rnd = np.random.default_rng(9)
    symbols = rnd.integers(0, 4, 300).astype(np.uint16)
    order, shares = suffix_dedup.expand(symbols, 7)
    text = symbols.tolist()
    assert sorted(order.tolist()) == list(range(300))
    for q in range(1, 300):
        a, b = text[order[q - 1] :][:7], text[order[q] :][:7]
        if len(a) == len(b) == 7:
            assert shares[q] == (a == b)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def classes(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed):
    rnd = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = list(rnd.choice(vocabulary, rnd.integers(1, 120)))
        for _ in range(rnd.integers(1, 6)):
            copy = base.copy()
            for _ in range(rnd.integers(0, max(1, len(base) // 12) + 1)):
                copy[rnd.integers(0, len(copy))] = str(rnd.choice(vocabulary))
            rows.append((int(rnd.permutation(1000)[0]) * 1000 + n, " ".join(copy)))
            n += 1
    # a chain: every member is close to the next only
    base = [f"c{k}" for k in range(60)]
    for step in range(10):
        rows.append((9_000_000 - step, " ".join(base[: 60 - 4 * step] + [f"d{k}" for k in range(4 * step)])))
    return [*rows, (1, None), (2, ""), (3, " \n "), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "one two one two")]


@pytest.mark.parametrize("width", [2, 5])
def test_classes_equal_brute_force(spark, width):
    rows = near_copies(width)
    df = spark.createDataFrame([(i, t, i, 1) for i, t in rows], "doc_id long, text string, id long, n long").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.link_classes(df, width=width).collect()}
    assert got == classes(rows, width)


def test_tables_of_few_ids_are_counted_once(spark, monkeypatch):
    """Labels, hooks, leaders and groups have no more rows than the ids that share a bucket: no job counts each of them again."""
    counted = []
    monkeypatch.setattr(minhash_dedup, "small", lambda df, rows: counted.append(rows) or df)
    texts = [f"w{k} a b c d e f g h i j k l m n o p q r s t u v w x y z {'tail' * (k % 3)}" for k in range(12)] * 2
    got = minhash_dedup.link_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert not counted


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.link_classes(df).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "other words"), (None, None)], df.schema)
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.link_classes(nameless).collect()]
    assert sorted(got, key=repr) == sorted([(7, 7, True), (None, 7, False), (None, None, True), (None, None, True)], key=repr)


def test_sketch_estimates_high_similarity():
    rnd = np.random.default_rng(0)
    common, one, two = (rnd.integers(0, 1 << 63, n, np.uint64) for n in (900, 50, 50))
    values = np.r_[common, one, common, two]
    samples = minhash_dedup.min_hashes(values, np.array([0, 950, 1900]), 360)
    sketch = minhash_dedup.odd_sketches(samples).view(np.uint64)
    far = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    assert abs(minhash_dedup.sketch_similarity(far) - 0.9) < 0.07


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 4), (20, 21), (21, 22), (22, 23), (23, 24), (4, 24)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["label"] for r in minhash_dedup.components(df).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4, 20, 21, 22, 23, 24)}, 10: 10, 11: 10, 12: 10}


def test_set_sketches_never_exceed_the_difference():
    """The bound that excludes pairs: XORed bits are at most the shingles that differ, and close to them."""
    rnd = np.random.default_rng(11)
    for n, new in ((1, 0), (1, 1), (30, 4), (400, 50), (400, 399), (5000, 700)):
        common = rnd.integers(0, 1 << 63, n - new, np.uint64)
        sets = [np.sort(np.r_[common, rnd.integers(0, 1 << 63, new + k, np.uint64)]) for k in (0, new // 3)]
        bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
        flat, ends = minhash_dedup.set_sketches(np.concatenate(sets), bounds)
        one, two = (flat[a:b].view(np.uint64) for a, b in zip(ends[:-1], ends[1:], strict=True))
        width = min(len(one), len(two))
        differing = int(np.bitwise_count(minhash_dedup.folded(one, width) ^ minhash_dedup.folded(two, width)).sum())
        truth = len(np.setxor1d(*sets))
        assert differing <= truth and (truth > n / 4 or differing >= 0.85 * truth - 2)


def edited(rnd, base, share):
    return [f"e{rnd.integers(1 << 40)}" if rnd.random() < share else w for w in base]


@pytest.mark.parametrize(("rows", "nearest"), [(1_000, 3), (7, 1)])
def test_group_at_the_threshold_equals_brute_force(spark, monkeypatch, rows, nearest):
    """Near copies of one text with similarities around 0.8: every link counts, whatever the cells' size."""
    monkeypatch.setattr(minhash_dedup, "CELL_ROWS", rows)
    monkeypatch.setattr(minhash_dedup, "NEAREST", nearest)
    monkeypatch.setattr(minhash_dedup, "SMALL_ROWS", 0 if nearest == 1 else 500_000)
    rnd = np.random.default_rng(rows)
    docs = []
    for length in (40, 200):
        base = [f"w{k}" for k in range(length)]
        docs += [" ".join(edited(rnd, base, rnd.choice([0.01, 0.05, 0.06, 0.07, 0.12]))) for _ in range(60)]
    data = [(int(i), t) for i, t in zip(rnd.permutation(10_000), docs, strict=False)]
    expected = classes(data, 2)
    assert 20 < sum(kept for _, _, kept in expected.values()) < 110
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.link_classes(df).collect()}
    assert got == expected


def test_long_texts_link(spark):
    rnd = np.random.default_rng(2)
    base = [f"w{k}" for k in range(60_000)]
    data = [(3, " ".join(base)), (1, " ".join(edited(rnd, base, 0.05))), (2, " ".join(edited(rnd, base, 0.2))), (4, "short " * 50_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.link_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: x[:2] for i, x in classes(data, 2).items()} and got[3][1] == 1 and got[2][1] == 2


def swapped_words(n):
    """The Thue-Morse word of n letters a and b, and the one with a and b swapped: equal under every polynomial modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_long_words_of_one_structure_are_told_apart(spark, n):
    one, two = swapped_words(n)
    rows = [(1, one), (2, two), (3, f"{one} and {one}"), (4, f"{two} and {two}"), (5, one.upper())]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_exact_sets_are_the_shingles(width):
    texts = [b"", b" ", b"a", b"a b", b"B a", b"a b c d e f", b"A b c D e f", b"a a a a a a a", b"\xc3\xa9 b c d e", b"b c d e f"]
    sets = minhash_dedup.exact_sets(texts, width)
    plain = []
    for t in texts:
        w = t.lower().split()
        plain.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    for i, s in enumerate(sets):
        assert len(s) == len(plain[i])
        for j, t in enumerate(sets):
            assert len(np.intersect1d(s, t)) == len(plain[i] & plain[j])


def test_byte_hashes_follow_the_bytes():
    rnd = np.random.default_rng(3)
    words = [bytes(rnd.integers(97, 99, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 16, 17, 63, 64, 65, 200) for _ in range(20)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found = byte_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist())))
    assert byte_hashes(data[:0], np.zeros(1, np.int64), np.zeros(1, np.int64))[0] == found[0]


def test_one_of_each_class_stays_whatever_the_ids(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    a, b, c = " ".join(words), " ".join(words[::-1]), " ".join(words[::2] * 3)
    rows = [(None, a, "x"), (None, a, "x"), (5, a, "y"), (3, a, "z"), (None, b, "x"), (None, b, "q"), (7, c, "x"), (7, c, "w"), (None, None, "n"), (None, "", "n"), (8, "", "n"), (9, a + " more", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    got = sorted(minhash_dedup.without_copies(df).select("doc_id", "text").collect(), key=repr)
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted([(3, a), (None, b), (7, c), (None, None), (None, ""), (8, "")], key=repr)
    unique = spark.createDataFrame([(1, a), (2, a), (3, b), (4, None)], "doc_id long, text string")
    assert sorted(r[0] for r in minhash_dedup.without_copies(unique).collect()) == [1, 3, 4]
    assert minhash_dedup.without_copies(unique.where("false")).count() == 0
