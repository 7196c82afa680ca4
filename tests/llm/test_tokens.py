import zlib

import numpy as np
import pyarrow as pa
import pytest

from covertile.llm import packing, queries, sentence_pieces

WORD, PIECE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", " a", "\n", "▁", "▁a b", "a" * 70, " " * 50, "=" * 99, "naïve ﬁx ß É é ÀÖ", "it's we'RE 12 ÷×", "<|endoftext|> x", "</s> <0x0A> <unk>", "漢字かな 😀‍😀", "x\x00y", "İstanbul ΣΑΣ", "a\u2028b\u3000c\x85d\x1ce", "e\u0301 \u0301x", "tab\tnew\r\nline"]


@pytest.fixture(scope="module")
def texts():
    rnd = np.random.default_rng(7)
    parts = ["a", "b", "ab", " ", "  ", "\n", "é", "漢", "▁", "😀", "the", "ing", "ß", "0", "12", "'s", "aaaa", "=", "́", "İ", "."]
    return ODD + ["".join(rnd.choice(parts, rnd.integers(1, 40))) for _ in range(1500)]


def test_pieces_equal_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    model = sentence_pieces.load_model(PIECE)
    ids, at = sentence_pieces.Encoder(model)(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*library.encode(t or ""), 2], repr(t)
    for k, raw in enumerate(model.decode_flat(ids, at)):
        assert raw.decode("utf-8", "replace") == library.decode(ids[at[k] : at[k + 1]].tolist())


def test_words_equal_library(texts):
    encoder = packing.WordEncoder(WORD)
    want = encoder.tokenizer.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, ends = encoder(pa.array(texts))
    for k, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert ids[ends[k] : ends[k + 1]].tolist() == w.ids, repr(t)
    encoder.memo = 0  # emptied, with one word at a time
    again = encoder(pa.array(texts[:300]), block=1)
    assert np.array_equal(again[0], ids[: ends[300]]) and np.array_equal(again[1], ends[:301])


def test_cuts_equal_cut():
    sizes = np.r_[1:5000:7, 2048, 4096, 4128, 4129]
    owner, start, length = packing.cuts(sizes)
    for k, n in enumerate(sizes.tolist()):
        assert length[owner == k].tolist() == packing.cut(n) and start[owner == k].tolist() == np.r_[0, np.cumsum(packing.cut(n))][:-1].tolist()


def test_memo_is_emptied_without_effect(texts):
    small = sentence_pieces.Encoder(sentence_pieces.load_model(PIECE), memo=3)
    large = sentence_pieces.Encoder(sentence_pieces.load_model(PIECE))
    for part in (texts[:50], texts[20:80], texts[:10]):
        assert all(np.array_equal(a, b) for a, b in zip(small(part), large(part), strict=True))


def test_encode_operator(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = {r["doc_id"]: r for r in sentence_pieces.encode(df, PIECE).collect()}
    assert len(out) == len(ODD) and out[0]["ids"] == [2] and out[1]["ids"] == [2] and out[0]["decoded"] == ""
    assert sentence_pieces.encode(df.limit(0), PIECE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 40, 3000])
def test_plan_places_every_item(n):
    rnd = np.random.default_rng(n)
    histogram: dict[int, int] = {}
    for size in rnd.lognormal(5.5, 1.4, n).astype(int) + 1:
        for piece in packing.cut(int(size)):
            histogram[piece] = histogram.get(piece, 0) + 1
    used: dict[int, int] = {}
    padding = total = 0
    for copies, items, padded in packing.plan(histogram):
        fill = sum(s * k for s, k in items.items())
        assert copies > 0 and fill <= padded <= 2048 and (padded == 2048 or padded == fill and fill & (fill - 1) == 0)
        padding, total = padding + copies * (padded - fill), total + copies * fill
        for s, k in items.items():
            used[s] = used.get(s, 0) + copies * k
    assert used == histogram and padding <= max(2048, 0.01 * total)


def test_knapsack_prices_the_best_pattern():
    sizes, values = np.array([7, 5, 3]), np.array([0.9, 0.6, 0.35])
    best = max(a * 0.9 + b * 0.6 + c * 0.35 for a in range(3) for b in range(4) for c in range(6) if 7 * a + 5 * b + 3 * c <= 17)
    value, counts = packing.best_pattern(values, sizes, 17)
    assert value == pytest.approx(best) == pytest.approx(float(counts @ values)) and counts @ sizes <= 17


def test_packed_sequences(spark):
    rows = [(i, t, i, i) for i, t in enumerate([*ODD, "word " * 5000, "word " * 5000, "z y " * 1500])]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, offset long")
    out = packing.pack_documents(df, WORD).collect()
    tokenizer = packing.load_tokenizer(WORD).library
    by: dict = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        own = sorted(by[i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(bytes(r["tokens"]), "<u4") for r in own])
        assert ids.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert own[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(own, own[1:], strict=False)) and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(zlib.crc32(bytes(r["tokens"])) >= 0 and len(r["tokens"]) == 4 * r["length"] for r in own)
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
    for items in sequences.values():
        items.sort()
        assert items[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(items, items[1:], strict=False)) and items[-1][0] + items[-1][1] <= items[0][2] <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(df.limit(0), WORD).count() == 0
