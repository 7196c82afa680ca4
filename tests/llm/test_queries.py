import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same, views

from covertile.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """A folder with a ``documents`` table of odd, repeated and long texts."""
    rnd = np.random.default_rng(4)
    shared = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "übung"], 40))
    texts = [None, "", " ", "a", "x" * 192, "é" * 96 + "y", shared, f"{shared} and more", f"Other {shared[:120]} words", shared, "It's <|endoftext|> here", "漢字 😀 ﬁx", "word " * 40_000, "the " * 700]
    texts += [" ".join(rnd.choice(["tok", "en", "ize", "naïve", "42", "x.y", "=="], rnd.integers(0, 900))) for _ in range(30)]
    folder = tmp_path_factory.mktemp("tables")
    ids = [int(i) for i in rnd.permutation(1000)[: len(texts)]]
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": [len(t or "") for t in texts]}), folder / "documents.parquet")
    return str(folder), dict(zip(ids, texts, strict=True))


def test_packing_query(spark, documents):
    from tokenizers import Tokenizer

    folder, texts = documents
    library, parts, sequences = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in QUERIES["op1_packing"](spark, folder).collect():
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048


def test_media_query(spark, documents):
    folder, texts = documents
    features = {}
    for r in QUERIES["op2_media"](spark, folder).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert features.setdefault(raw, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert len(features) == len({(t or "").encode() for t in texts.values()})


def test_repeats_query(spark, documents):
    from test_dedup import repeats

    folder, texts = documents
    want = {i: (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for i, (n, kept, spans) in repeats(texts.items(), 50).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op4_suffix_dedup"](spark, folder).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_pieces_query(spark, documents):
    import sentencepiece

    folder, texts = documents
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for r in QUERIES["op7_pieces"](spark, folder).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *digests)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_take_odd_tables(spark, sf, documents, stage):
    """Null, empty, long and repeated texts, further columns and no rows."""
    import corpus_pipeline as pipeline

    name, run = pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{documents[0]}/documents.parquet").selectExpr("*", "1 AS score", "2 AS _kept", "3 AS id")
    out = run(spark, docs, sf)
    assert out.count() > 0 and (name == "packing" or out.columns == pipeline.COLUMNS)
    assert run(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), views(sf), ORACLE_SQL[name])


def test_pipeline_stages(spark, sf):
    """Each stage on its own input: columns, no new rows, and the last stages against brute force."""
    import corpus_pipeline as pipeline
    from test_dedup import classes, repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = stages["quality"](spark, stages["toxicity"](spark, docs, sf), sf).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = stages["near_duplicates"](spark, clean, sf).cache()
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in classes(rows, 5).items() if c[2]}
    cut = stages["repeats"](spark, single, sf).cache()
    assert cut.columns == docs.columns
    want = {i: kept.decode("utf-8", "ignore") for i, (_, kept, _) in repeats([(r["doc_id"], r["text"]) for r in single.collect()], 50).items()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    packed = stages["packing"](spark, cut, sf).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    assert len(pipeline.run(spark, sf).columns) == 8


def test_pipeline_leaves_only_its_result(spark, sf, monkeypatch):
    """A stage begins with its input alone in the shared folder, and the run ends with its result alone."""
    import os

    import corpus_pipeline as pipeline

    from covertile.llm.common import release, shared_dir

    folder = f"{shared_dir(spark)}/covertile"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before, found = tables(), []

    def told(stage):
        return lambda *given: (found.append(len(tables() - before)), stage(*given))[1]

    monkeypatch.setattr(pipeline, "STAGES", [(name, told(stage)) for name, stage in pipeline.STAGES])
    out = pipeline.run(spark, sf)
    assert found == [0, 1, 1, 1, 1]
    assert {t.rpartition("-")[0] for t in tables() - before} == {"stage-packing"} and out.count() > 0
    release(out)
    release(out)  # what is gone already is left alone
    assert tables() == before
