"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words (runs that no vocabulary piece crosses), each distinct word is encoded once,
and all new words of a batch are encoded together in flat numpy arrays: every round finds the
smallest pair rank per word with a segmented minimum, merges all of a word's pairs of that rank
from the left, compacts the arrays, and goes on until no word has a pair left.  Where a merge
would create a pair that ranks before the remaining ones, only the word's leftmost pair is merged
in that round, which is the order of the library's agenda.

Defined results: null and empty texts give the end id alone and decode to the empty text; repeated
texts give equal rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, segment_arange
from .merges import PairTable, merge_rounds

SPACE = "▁"


class PieceModel:
    """A BPE model file with byte fallback and identity normalisation, read once per process."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or trainer.model_type != 2 or not trainer.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation are supported")
        self.end_id = trainer.eos_id
        self.size = len(proto.pieces)
        self.control = np.zeros(self.size, bool)
        self.piece_bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        score = np.zeros(self.size)
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                normal[p.piece] = i
                score[i] = p.score
                self.piece_bytes.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.piece_bytes.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type in (2, 3):
                self.control[i] = True
                self.piece_bytes.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        chars = sorted({c for piece in normal for c in piece} - normal.keys())
        self.symbol = normal | {c: self.size + k for k, c in enumerate(chars)}
        self.unknown = self.size + len(chars)
        self.base = self.unknown + 1
        ranks = np.unique(-score[list(normal.values())], return_inverse=True)[1]
        rank = dict(zip(normal.values(), ranks.tolist(), strict=True))
        keys, ids, order = [], [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    ids.append(i)
                    order.append(rank[i])
        self.pairs = PairTable(self.base, np.array(keys, np.int64), np.array(ids, np.int64), np.array(order, np.int64))
        alone = "".join(re.escape(c) for c in "\n\t" if c not in self.symbol)
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("a piece holds a word boundary")
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.piece_len = np.array([len(b) for b in self.piece_bytes], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_flat = np.frombuffer(b"".join(self.piece_bytes), np.uint8)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, merged side by side, and the words' offsets."""
        lens = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), self.unknown) for c in kinds], np.int64)[inverse]
        sym, place, word = merge_rounds(sym, np.repeat(np.arange(len(words)), lens), self.pairs)
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):  # characters that no piece holds: their bytes
            raw = [text[p].encode("utf-8", "surrogatepass") for p in place[odd].tolist()]
            count = np.ones(len(sym), np.int64)
            count[odd] = [len(b) for b in raw]
            ids = np.repeat(sym, count)
            ids[np.repeat(sym >= self.size, count)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            word, sym = np.repeat(word, count), ids
        return sym.astype(np.int32), np.searchsorted(word, np.arange(len(words) + 1))

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row of ids."""
        ids = ids.astype(np.int64)
        lens = self.piece_len[ids]
        flat = self.piece_flat[np.repeat(self.piece_at[ids], lens) + segment_arange(lens)].tobytes()
        ends = np.r_[0, np.cumsum(lens)][offsets].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            row = flat[a:b]
            out.append(row[1:] if row[:1] == b" " else row)  # the dummy prefix
        return out


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts with a memo of words that is emptied when it holds ``memo`` of them."""

    def __init__(self, model: PieceModel, memo: int = 600_000):
        self.model, self.memo = model, memo
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.ends, self.held = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        ids, offsets = self.model.encode_words(words)
        n = len(self.code)
        while self.held + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + 1 + len(words) > len(self.ends):
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        self.flat[self.held : self.held + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = self.held + offsets[1:]
        self.held += len(ids)
        self.code.update(zip(words, range(n, n + len(words)), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, an end id after each text, and row offsets."""
        if len(self.code) > self.memo:
            self.clear()
        split, words, counts = self.model.words.findall, [], []
        for t in texts:
            had = len(words)
            if t:
                words += split(SPACE + t.replace(" ", SPACE))
            counts.append(len(words) - had)
        part, size = [], 0
        for w in set(words).difference(self.code):
            part.append(w)
            size += len(w)
            if size > 1_000_000:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        begin, count = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        offsets = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(counts)].astype(np.int64)].astype(np.int64)
        offsets += np.arange(len(offsets))  # the end ids
        ids = np.full(int(offsets[-1]), self.model.end_id, np.int32)
        inner = np.ones(len(ids), bool)
        inner[offsets[1:] - 1] = False
        ids[inner] = self.flat[np.repeat(begin, count) + segment_arange(count)]
        return ids, offsets


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = 2_000_000) -> DataFrame:
    """``key, ids array<int>, decoded string``: the ids of every whole text, an end id last, and the text decoded from them.

    ``model_path`` is a file that every executor has.  Work is per row, without any shuffle; memory
    is bounded by ``chunk_bytes`` of text (or one longer text) and the memo of words.
    """

    def work(batches):
        model = load_model(model_path)
        run = Encoder(model)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = np.r_[0, np.cumsum([len(t) if t else 0 for t in texts])]
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + chunk_bytes, "right")) - 1)
                ids, offs = run(texts[at:end])
                decoded = [b.decode("utf-8", "replace") for b in model.decode_flat(ids, offs)]
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys[at:end], lists, pa.array(decoded, pa.string())], [key, "ids", "decoded"])
                at = end

    kind = df.schema[key].dataType.simpleString()
    return in_arrow(df.select(key, text), work, f"`{key}` {kind}, ids array<int>, decoded string")
