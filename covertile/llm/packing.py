"""Packing of tokenised documents into fixed-length sequences: cutting stock by column generation.

1. Every document is tokenised (ids and one end id) and cut into full pieces of ``capacity``
   tokens, a rest in multiples of a grain, and a tail below the grain.  The number of item lengths
   is so bounded by a constant, whatever the corpus.
2. A histogram of item lengths (at most ``capacity / grain + grain`` rows) goes to the driver.  A
   linear program over patterns (columns) is solved by revised simplex; an unbounded-knapsack dynamic
   program over the capacity prices new columns with the dual values.
3. The patterns are rounded down; what is left is filled by bounded-knapsack patterns, and the
   last, partial sequence is split at powers of two, which need no padding.
4. Items are ranked per length (hash bucket, then document id) and the rounded patterns are dealt
   to the ranks by arithmetic: sequence and offset follow from rank, pattern and slot.

Defined results: null and empty texts are one end id; repeated texts are packed each on its own;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, give_back, in_arrow, lowered, row_chunks, segment_arange, staged
from .merges import PairTable, merge_rounds

CAPACITY, GRAIN, END_ID = 2048, 32, 1


# ---- tokens ---------------------------------------------------------------------------------
class WordTokenizer:
    """The tokenizer file's ids, with merges done for many words at once where that is certain to agree.

    Words of printable ASCII and of Latin-1's two-byte letters need no Unicode rules beyond lower case: they are cut
    by the file's pattern and merged in rounds, all in flat byte arrays.  Other words, and those with an
    apostrophe (contractions), go to the library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = spec["model"]["type"] == "BPE" and pattern == self.PATTERN and spec["model"]["end_of_word_suffix"] == "</w>"
        vocab, self.special = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
        if self.plain:
            letters = byte_letters()
            self.inner = np.array([vocab[c] for c in letters], np.int64)
            self.final = np.array([vocab[c + "</w>"] for c in letters], np.int64)
            base, keys, ids = len(vocab) + len(self.special), [], []
            for merge in spec["model"]["merges"]:
                a, b = merge.split(" ") if isinstance(merge, str) else merge
                keys.append(vocab[a] * base + vocab[b])
                ids.append(vocab[a + b])
            self.pairs = PairTable(base, np.array(keys, np.int64), np.array(ids, np.int64), np.arange(len(keys)))
        del spec, vocab
        give_back()

    def parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Parts of words without ASCII white space, which parts are whole words for the library, and the parts before each word."""
        raw, offsets = flat_bytes(words)
        owner = np.repeat(np.arange(len(words)), np.diff(offsets))
        lead = raw == 0xC3  # of U+00C0 to U+00FF; two of them are no letters
        second = np.r_[False, lead[:-1]][: len(raw)]
        high = second & (raw != 0x97) & (raw != 0xB7)
        known = ((raw > 32) & (raw < 127) & (raw != 39)) | lead | high
        other = np.zeros(len(words), bool)
        other[owner[~known] if self.plain else slice(None)] = True
        mine = ~other[owner]
        low = lowered(raw)
        low[high & (raw < 0x9F)] += 32
        low[~mine] = raw[~mine]
        kind = np.where(lead | high | ((low >= 97) & (low <= 122)), 0, np.where((low >= 48) & (low <= 57), 1, 2))
        new_word = np.r_[True, owner[1:] != owner[:-1]][: len(raw)]
        begins = new_word | (mine & np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 1)][: len(raw)])
        first = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[first, len(low)].astype(np.int32)), pa.py_buffer(low)])
        return parts, other[owner[first]], np.searchsorted(owner[first], np.arange(len(words) + 1))

    def merged(self, parts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of parts, and their offsets."""
        raw, offsets = flat_bytes(parts)
        owner = np.repeat(np.arange(len(parts)), np.diff(offsets))
        mine = ~whole[owner]
        low, at = raw[mine], owner[mine]
        out_ids, out_part = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(low):
            last = np.r_[at[1:] != at[:-1], True]
            sym, _, part = merge_rounds(np.where(last, self.final[low], self.inner[low]), at, self.pairs)
            out_ids.append(sym)
            out_part.append(part)
        rest = np.flatnonzero(whole)
        if len(rest):
            got = [e.ids for e in self.library.encode_batch([parts[k].as_py().decode() for k in rest], add_special_tokens=False)]
            out_ids.append(np.array([i for ids in got for i in ids], np.int64))
            out_part.append(np.repeat(rest, [len(x) for x in got]))
        ids, part = np.concatenate(out_ids), np.concatenate(out_part)
        by = np.argsort(part, kind="stable")
        return ids[by], np.searchsorted(part[by], np.arange(len(parts) + 1))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, others from 256 up."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in keep)}
    return [chr(moved.get(b, b)) for b in range(256)]


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def gathered(flat: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``codes`` of a flat list of rows, one after the other, and their offsets."""
    begin, count = ends[codes], ends[codes + 1] - ends[codes]
    return flat[np.repeat(begin, count) + segment_arange(count)], np.r_[0, np.cumsum(count)]


class WordEncoder:
    """Ids of whole texts from a memo of the parts of words between ASCII white space.

    The tokenizer drops white space and never crosses it, so a text's ids are those of its words in
    order.  Texts that hold special-token strings go to the library whole.
    """

    def __init__(self, path: str, memo: int = 150_000):
        self.tokenizer, self.memo = load_tokenizer(path), memo
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.ends, self.held = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _learn(self, parts: pa.Array, whole: np.ndarray, names: list[bytes]) -> None:
        ids, offsets = self.tokenizer.merged(parts, whole)
        n = len(self.code)
        while self.held + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + 1 + len(parts) > len(self.ends):
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        self.flat[self.held : self.held + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(parts)] = self.held + offsets[1:]
        self.held += len(ids)
        self.code.update(zip(names, range(n, n + len(parts)), strict=True))

    def __call__(self, texts: pa.Array, block: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts in them; ``block`` new parts are in work at a time."""
        if len(self.code) > self.memo:
            self.clear()
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for mark in self.tokenizer.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        parts, alone, within = self.tokenizer.parts(words.dictionary)
        coded = parts.dictionary_encode()
        place, parts = coded.indices.to_numpy(), coded.dictionary
        library = np.zeros(len(parts), bool)
        library[place[alone]] = True
        names = parts.to_numpy(zero_copy_only=False).tolist()
        fresh = np.array([k for k, p in enumerate(names) if p not in self.code], np.int64)
        for at in range(0, len(fresh), block):
            some = fresh[at : at + block]
            self._learn(parts.take(pa.array(some)), library[some], [names[k] for k in some])
        codes = np.array([self.code[p] for p in names], np.int64)[place]
        ids, ends = gathered(self.flat, self.ends, codes)
        flat, ends = gathered(ids, ends[within], words.indices.to_numpy())
        ends = ends[bounds - bounds[0]]
        if whole.any():
            rows = np.split(flat, ends[1:-1])
            for k in np.flatnonzero(whole):
                rows[k] = np.array(self.tokenizer.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
            flat, ends = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
        return flat, ends


def cut(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: full pieces, a multiple of the grain, a tail."""
    full, rest = divmod(n, capacity)
    body = rest - rest % grain
    return [capacity] * full + [x for x in (body, rest - body) if x]


def cuts(sizes: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cut`` of many documents at once: each piece's document, start and length."""
    full, rest = sizes // capacity, sizes % capacity
    tail = rest % grain
    pieces = full + (rest > tail) + (tail > 0)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    place = segment_arange(pieces)
    body = rest - tail
    length = np.where(place < full[owner], capacity, np.where((place == full[owner]) & (body[owner] > 0), body[owner], tail[owner]))
    start = np.where(place <= full[owner], place * capacity, full[owner] * capacity + body[owner])
    return owner, start, length


def tokenised_pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, chunk_bytes: int = 2_000_000) -> DataFrame:
    """``key, start, length, doc_tokens, tokens`` with a row per piece; tokens are little-endian unsigned 32-bit ids."""

    def work(batches):
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            for a, b in row_chunks(flat_bytes(batch.column(1))[1], chunk_bytes):
                ids, ends = encoder(batch.column(1)[a:b])
                sizes = np.diff(ends) + 1
                marked = np.full(len(ids) + b - a, END_ID, "<u4")
                marked[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(ends))] = ids
                owner, start, length = cuts(sizes, capacity, grain)
                tokens = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((4 * np.r_[0, np.cumsum(length)]).astype(np.int32)), pa.py_buffer(marked)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(sizes[owner]), tokens], [key, "start", "length", "doc_tokens", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return in_arrow(df.select(key, text), work, f"`{key}` {kind}, start long, length long, doc_tokens long, tokens binary")


# ---- the plan, on the driver, from a histogram of bounded size ------------------------------
def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded-knapsack dynamic program: the pattern of largest value, and its value."""
    gain, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, worth = sizes[order], values[order]
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(small, room, "right"))
        gain[room] = gain[room - 1]
        if k:
            options = gain[room - small[:k]] + worth[:k]
            top = int(np.argmax(options))
            if options[top] > gain[room] + 1e-12:
                gain[room], pick[room] = options[top], order[top]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(gain[capacity]), counts


def fullest_pattern(left: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bounded-knapsack pattern over what is left: the fullest sequence, large items first."""
    made = np.full(capacity + 1, -1)  # the item length by which a fill was first reached
    used = np.zeros(capacity + 1, np.int64)  # and how many of it
    made[0] = len(sizes)
    for j in np.argsort(-sizes):
        if left[j]:
            size = int(sizes[j])
            steps = -(-(capacity + 1) // size)
            known = np.zeros(steps * size, bool)
            known[: capacity + 1] = made >= 0
            # per residue: steps since the last fill that is reached without this length
            step = np.arange(steps)[:, None]
            last = np.maximum.accumulate(np.where(known.reshape(steps, size), step, -(1 << 60)), axis=0)
            count = (step - last).ravel()[: capacity + 1]
            new = (made < 0) & (count <= left[j])
            made[new], used[new] = j, count[new]
        if made[capacity] >= 0:
            break
    fill = int(np.flatnonzero(made >= 0)[-1])
    counts = np.zeros(len(sizes), np.int64)
    while fill:
        counts[made[fill]] += used[fill]
        fill -= int(used[fill] * sizes[made[fill]])
    return counts


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation: the linear program's patterns and how often it uses each."""
    m = len(sizes)
    columns = [np.where(np.arange(m) == j, capacity // sizes[j], 0) for j in range(m)]
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for step in range(rounds):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        value, pattern = best_pattern(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern
        ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out] = pattern
        if step % 50 == 49:  # against rounding errors
            inverse = np.linalg.inv(np.array(columns, float).T)
        else:
            row = inverse[out] / column[out]
            inverse = inverse - np.outer(column, row)
            inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    return list(zip(columns, x, strict=True))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int], int]]:
    """``(copies, {length: items per sequence}, padded length)`` for all items; deterministic."""
    out: list[tuple[int, dict[int, int], int]] = []
    if histogram.get(capacity):
        out.append((histogram[capacity], {capacity: 1}, capacity))
    sizes = np.array(sorted((s for s, n in histogram.items() if n and s != capacity), reverse=True), np.int64)
    if not len(sizes):
        return out
    left = np.array([histogram[int(s)] for s in sizes], np.int64)

    def take(pattern: np.ndarray, copies: int) -> None:
        left[:] -= pattern * copies
        total = int((pattern * sizes).sum())
        out.append((copies, {int(s): int(k) for s, k in zip(sizes, pattern, strict=True) if k}, total if total & (total - 1) == 0 else capacity))

    for pattern, times in relaxed(sizes, left.astype(float), capacity):
        copies = int(times + 1e-9)
        if copies and (pattern * sizes).sum() == capacity:
            copies = min(copies, int(min(left[pattern > 0] // pattern[pattern > 0])))
            if copies > 0:
                take(pattern, copies)
    while left.any():
        pattern = fullest_pattern(left, sizes, capacity)
        if (pattern * sizes).sum() == capacity:
            take(pattern, int(min(left[pattern > 0] // pattern[pattern > 0])))
            continue
        # nothing fills a sequence any more: sequences of powers of two need no padding
        room = 1 << (int((left * sizes).sum()).bit_length() - 1)
        while room:
            small = fullest_pattern(left, sizes, min(room, capacity))
            if small.any() and (small * sizes).sum() == min(room, capacity):
                take(small, 1)
                break
            room >>= 1
        else:
            take(pattern, 1)
    return out


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, rows_per_bucket: int = 5_000) -> DataFrame:
    """Adds ``sequence_id, offset, padded_length`` to pieces (``key, start, length``, further columns stay).

    Ranks are made per length and hash bucket, the number of buckets follows the number of pieces,
    and bucket starts come from sums, so no length, however common, is ranked in one task.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = min(1 << 20, max(8, sum(histogram.values()) // rows_per_bucket))
    starts, sequence = [], 0  # per pattern and length: where its ranks begin
    seen: dict[int, int] = {}
    for copies, items, padded in plan(histogram, capacity):
        offset = 0
        for size, per in items.items():
            begin = seen.get(size, 0)
            starts.append((size, begin, begin + copies * per, per, sequence, offset, padded))
            seen[size] = begin + copies * per
            offset += size * per
        sequence += copies
    rows = spark.createDataFrame(starts or [(0, 0, 0, 1, 0, 0, 0)], "length long, r0 long, r1 long, per long, seq0 long, off0 long, padded_length long")
    by_length = rows.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("r0", "r1", "per", "seq0", "off0", "padded_length"))).alias("slots"))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "start"), F.lit(buckets)))
    sums = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(key, "start")
    ranked = bucketed.withColumn("r", F.row_number().over(within).cast("long") - 1).join(sums, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    # the table of slots has at most (lengths x patterns) rows, both bounded by capacity and grain
    found = ranked.join(F.broadcast(by_length), "length").withColumn("slot", F.expr("filter(slots, s -> s.r0 <= r and r < s.r1)[0]"))
    position = F.col("r") - F.col("slot.r0")
    return found.select(
        *pieces.columns,
        (F.col("slot.seq0") + F.floor(position / F.col("slot.per"))).cast("long").alias("sequence_id"),
        (F.col("slot.off0") + (position % F.col("slot.per")) * F.col("length")).cast("long").alias("offset"),
        F.col("slot.padded_length").alias("padded_length"),
    )


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """All documents, tokenised once (staged in the shared folder) and packed."""
    return pack(staged(tokenised_pieces(df, tokenizer_path, key, text, capacity, grain), "pieces"), key, capacity)
