"""Removal of byte strings that earlier documents hold: distributed suffix sorting with threshold-bounded expansion.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id.
Each such string (window) has an anchor: the k-mer of least hash in it, which equal windows share.
The windows of one anchor form a context of at most ``2 * length - k`` bytes.

1. Every task finds its rows' contexts and keys them by content.  Of equal contexts only those of the
   smallest document in the batch travel on; for the others the windows are known to be repeats.
   Thus a passage that a third of all documents share leaves a task once per batch.
2. By anchor: of equal contexts all but the smallest document's are repeats.  Anchors with unequal
   contexts of several documents can still share windows; one copy of each is asked for, with the
   starts of its twins (equal contexts of the same document, which lose and keep the same bytes).
3. Those contexts are fetched from the texts and dealt by anchor; anchors with very many of them
   are dealt by 15 more bytes on the left and on the right, one of which any shared window holds.
4. Per bucket, a Burrows-Wheeler transform of the contexts is expanded breadth-first: intervals of
   suffixes with a common prefix are extended backwards symbol by symbol, so that prefix lengths
   come out in increasing order, and the expansion stops at ``length``.  Suffixes in one of the
   intervals left share their window, and all but the smallest document's are repeats.
5. Spans meet their texts and are cut out.

Rows travel in compressed blocks by bucket.  The number of buckets follows the bytes of the table, so
a bucket stays within a task's memory.

Defined results: null and empty texts stay empty; texts under ``length`` bytes stay whole; repeats
inside one document stay; of equal texts only the smallest id's keeps its bytes; ids must be unique
64-bit integers; rows with a null id neither give nor lose bytes; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, flat_bytes, in_arrow, mix64, row_chunks, segment_arange, staged, tidy

LENGTH, K = 50, 20
#: A bucket is expanded in so many parts, one after the other, which bounds a worker's memory.
PARTS = 16
BLOCK = "bucket int, kind string, size long, block binary"
_KIND = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), ("block", pa.binary())])


# ---- compressed blocks of columns -----------------------------------------------------------
def dump(*columns: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    parts = []
    for c in columns:
        parts += [c.dtype.str.encode().ljust(8), len(c).to_bytes(8, "little"), c.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def load(block: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 8].strip().decode()), int.from_bytes(raw[at + 8 : at + 16], "little")
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def summed(x: np.ndarray) -> np.ndarray:
    """What ``deltas`` were taken of, in its own type."""
    return np.cumsum(x, dtype=x.dtype)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(key.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int32)


def _rows(kind: str, made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*made, strict=True) if made else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array([kind] * len(a), pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], schema=_KIND)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by document and start, with those that overlap or touch joined."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + group * (1 << 34)) - group * (1 << 34)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch:
    doc, start, end = merged(doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    to = _bucket(doc, buckets)
    made = []
    for b in np.unique(to).tolist():
        at = to == b
        made.append((b, int(at.sum()), dump(deltas(doc[at]), start[at].astype(np.uint32), (end[at] - start[at]).astype(np.uint32))))
    return _rows("span", made)


# ---- anchors and contexts -------------------------------------------------------------------
def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """Per context: row, start in the row, length, anchor hash, content key."""
    n, w = len(data), length - k + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashed = RangeHash(data)
    at = np.arange(n - k + 1)
    kmer = hashed(at, at + k)
    least = (kmer & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)  # ordered by hash, then from the left
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
    anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    start = np.repeat(offsets[:-1], windows) + segment_arange(windows)
    row = np.repeat(np.arange(len(size)), windows)
    mine = anchor[start]
    first = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (row[1:] != row[:-1])]) if len(mine) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(mine)][: len(first)] - 1
    lo, hi, mine, row = start[first], start[last] + length, mine[first], row[first]
    h = kmer[mine]
    return row, lo - offsets[row], hi - lo, h, mix64(hashed(lo, hi) + h * np.uint64(0x9E3779B97F4A7C15) + (mine - lo).astype(np.uint64))


def find_contexts(df: DataFrame, key: str, text: str, buckets: int, length: int, k: int, gather_bytes: int = 12_000_000, slice_bytes: int = 4_000_000) -> DataFrame:
    """Blocks of contexts by anchor, and of spans that a smaller document among the same ``gather_bytes`` repeats, by document.

    A text of over 400,000 bytes is taken in slices of window starts; a context cut there becomes two of the same anchor.
    """

    def gathered(batches):
        parts, held = [], 0
        for batch in batches:
            data, offsets = flat_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in row_chunks(offsets, 400_000):
                begin, end = int(offsets[a]), int(offsets[b])
                for p in range(begin, end, slice_bytes if b == a + 1 else max(1, end - begin)):
                    q = min(p + slice_bytes + length - 1, end) if b == a + 1 else end
                    row, start, size, anchor, content = contexts(data[p:q], np.clip(offsets[a : b + 1], p, q) - p, length, k)
                    parts.append((ids[a + row], (start + p - begin).astype(np.uint32), size.astype(np.uint16), anchor, content))
            held += len(data)
            if held >= gather_bytes:
                yield parts
                parts, held = [], 0
        if parts:
            yield parts

    def work(batches):
        for parts in gathered(batches):
            doc, start, size, anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            if not len(doc):
                continue
            by = np.argsort(content)
            first = np.flatnonzero(np.r_[True, content[by[1:]] != content[by[:-1]]])
            owner = np.empty(len(doc), np.int64)
            owner[by] = np.repeat(np.minimum.reduceat(doc[by], first), np.diff(np.r_[first, len(by)]))
            repeat = doc > owner
            if repeat.any():
                yield span_rows(doc[repeat], start[repeat], start[repeat].astype(np.int64) + size[repeat], buckets)
            doc, start, size, anchor, content = (x[~repeat] for x in (doc, start, size, anchor, content))
            to = _bucket(anchor, buckets)
            by = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            made = []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                at = by[ends[b] : ends[b + 1]]
                made.append((b, len(at), dump(anchor[at], content[at], deltas(doc[at]), start[at], size[at])))
            yield _rows("context", made)

    return in_arrow(df.select(key, text), work, BLOCK)


def resolve_contexts(found: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Spans of contexts that a smaller document repeats, and requests for one copy of each context that may do so in part."""

    def work(table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("block")
        out = [table.filter(pa.array([x == "span" for x in kinds]))]
        got = [load(blocks[i].as_py()) for i, x in enumerate(kinds) if x == "context"]
        if got:
            anchor, content, doc, start, size = (np.concatenate([np.cumsum(g[c]) if c == 2 else g[c] for g in got]) for c in range(5))
            del got
            # contexts of anchors that occur once are done
            by = np.argsort(anchor)
            same = anchor[by[1:]] == anchor[by[:-1]]
            by = by[np.r_[False, same] | np.r_[same, False]] if len(by) > 1 else by[:0]
            anchor, content, doc, start, size = (x[by] for x in (anchor, content, doc, start, size))
            by = np.lexsort((start, doc, content, anchor))
            anchor, content, doc, start, size = (x[by] for x in (anchor, content, doc, start, size))
            if len(doc):
                new = np.r_[True, (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])]
                first = np.flatnonzero(new)
                repeat = doc > np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
                if repeat.any():
                    out.append(pa.Table.from_batches([span_rows(doc[repeat], start[repeat], start[repeat].astype(np.int64) + size[repeat], buckets)]))
                group = np.flatnonzero(np.r_[True, anchor[first][1:] != anchor[first][:-1]])
                count = np.diff(np.r_[group, len(first)])
                owners = doc[first]
                several = (count > 1) & (np.minimum.reduceat(owners, group) < np.maximum.reduceat(owners, group))
                ask = first[np.repeat(several, count)]
                twins = (np.add.reduceat(~repeat, first) - 1)[np.repeat(several, count)]
                busy = np.repeat(count > hot, count)[np.repeat(several, count)]
                to = _bucket(doc[ask], buckets)
                made = []
                for b in np.unique(to).tolist():
                    at = np.flatnonzero(to == b)
                    at = at[np.argsort(doc[ask[at]], kind="stable")]
                    i = ask[at]
                    more = start[np.repeat(i + 1, twins[at]) + segment_arange(twins[at])]
                    made.append((b, int(size[i].sum(dtype=np.int64)), dump(anchor[i], deltas(doc[i]), start[i], size[i], busy[at].astype(np.uint8), twins[at].astype(np.uint32), deltas(more))))
                if made:
                    out.append(pa.Table.from_batches([_rows("ask", made)]))
        return pa.concat_tables([t.cast(_KIND) for t in out])

    return found.groupBy("bucket").applyInArrow(tidy(work), BLOCK)


def pack_texts(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Compressed blocks of whole texts by document bucket."""

    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            to, size = _bucket(ids, buckets), np.diff(offsets)
            by = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            made = []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                at = by[ends[b] : ends[b + 1]]
                body = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in at])
                made.append((b, len(body), dump(ids[at], size[at], body, level=3)))
            yield _rows("text", made)

    return in_arrow(df.select(key, text), work, BLOCK)


def _texts(table: pa.Table):
    """Documents of the text blocks, by id: ids, starts, ends, bytes."""
    got = [load(b.as_py()) for kind, b in zip(table.column("kind").to_pylist(), table.column("block"), strict=True) if kind == "text"]
    if not got:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint8),)
    ids, size, data = (np.concatenate(x) for x in zip(*got, strict=True))
    end = np.cumsum(size)
    by = np.argsort(ids)
    return ids[by], (end - size)[by], end[by], data


def fetch_contexts(texts: DataFrame, asked: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    """Blocks of context bytes by anchor bucket; busy anchors by anchor and the bytes on either side."""
    side = (length - k) // 2

    def work(table: pa.Table) -> pa.Table:
        got = [load(b.as_py()) for kind, b in zip(table.column("kind").to_pylist(), table.column("block"), strict=True) if kind == "ask"]
        if not got:
            return pa.Table.from_batches([], _KIND)
        ids, begin, _, data = _texts(table)
        anchor, doc, start, size, busy, twins, more = (np.concatenate([summed(g[c]) if c in (1, 6) else g[c] for g in got]) for c in range(7))
        twins = twins.astype(np.int64)
        their = np.cumsum(twins) - twins
        lo, size = begin[np.searchsorted(ids, doc)] + start, size.astype(np.int64)
        deal = [(np.arange(len(doc)), anchor)]
        if busy.any():
            deal = [(np.flatnonzero(busy == 0), anchor[busy == 0])]
        for many in np.array_split(np.flatnonzero(busy), 1 + np.count_nonzero(busy) // 10_000):
            # where in the context the anchor stands: its k-mer is the one with the anchor's hash
            each = size[many]
            hashed = RangeHash(data[np.repeat(lo[many], each) + segment_arange(each)])
            from_, reach = np.cumsum(each) - each, each - k + 1
            at = np.repeat(from_, reach) + segment_arange(reach)
            hit = np.flatnonzero(hashed(at, at + k) == np.repeat(anchor[many], reach))
            which = np.repeat(np.arange(len(many)), reach)[hit]
            first = np.r_[True, which[1:] != which[:-1]][: len(which)]
            which, p = which[first], at[hit[first]]
            for shift, salt in ((-side, 1), (0, 2)):
                a, b = p + shift, p + shift + k + side
                ok = (a >= from_[which]) & (b <= from_[which] + each[which])
                deal.append((many[which[ok]], hashed(a[ok], b[ok]) + np.uint64(salt)))
        made = []
        for rows, by_key in deal:
            to = _bucket(by_key, buckets)
            for b in np.unique(to).tolist():
                at = rows[to == b]
                by = np.argsort(doc[at], kind="stable")
                at = at[by]
                body = data[np.repeat(lo[at], size[at]) + segment_arange(size[at])]
                part = (mix64(by_key[to == b]) % np.uint64(PARTS)).astype(np.uint8)[by]
                also = more[np.repeat(their[at], twins[at]) + segment_arange(twins[at])]
                made.append((b, len(body), dump(deltas(doc[at]), start[at], size[at].astype(np.uint16), part, body, twins[at].astype(np.uint32), deltas(also))))
        return pa.Table.from_batches([_rows("bytes", made)])

    return asked.unionByName(texts).groupBy("bucket").applyInArrow(tidy(work), BLOCK)


# ---- the transform and its expansion --------------------------------------------------------
def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling from four symbols)."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.uint64), np.zeros(4, np.uint64)]
    key = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]]).astype(np.uint64) + np.uint64(1)
        if known >= depth or int(rank.max()) == n:
            return order
        key = rank << np.uint64(32)
        key[: n - known] |= rank[known:]
        known *= 2


def expand(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, per rank, whether the suffix shares ``length`` symbols with the one before.

    ``psi`` inverts the transform's step: the suffix of rank q is its first symbol (the
    transform's symbol at rank ``psi[q]``) in front of the suffix of rank ``psi[q]``.  Intervals of
    level d, extended backwards by every symbol in front of them, are the intervals of level d + 1;
    a boundary found at level d is a common prefix of d symbols, and is never looked at again.
    """
    order = suffix_order(symbols, length + 1)
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    psi = rank[np.where(order + 1 < n, order + 1, 0)]
    front = symbols[order]
    boundary = np.r_[True, front[1:] != front[:-1]]
    boundary[rank[n - 1]] = True  # the empty rest follows the last symbol
    if rank[n - 1] + 1 < n:
        boundary[rank[n - 1] + 1] = True
    open_ = np.flatnonzero(~boundary)
    for _ in range(1, length):
        interval = np.cumsum(boundary, dtype=np.int32)
        parted = interval[psi[open_]] != interval[psi[open_ - 1]]
        if parted.any():
            boundary[open_[parted]] = True
            open_ = open_[~parted]
        if not len(open_):
            break
    return order, ~boundary


def repeated_windows(doc: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Context index and offset in it of every window that a context of a smaller document holds."""
    spaced = np.zeros(len(data) + len(doc), np.uint16)
    where = np.repeat(np.cumsum(size) - size + np.arange(len(size)), size) + segment_arange(size)
    spaced[where] = data.astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(doc)), size + 1)
    offset = segment_arange(size + 1)
    order, shares = expand(spaced, length)
    usable = (offset + length <= size[owner])[order]
    group = np.cumsum(~shares)[usable]
    order = order[usable]
    if not len(order):
        return order, order
    d = doc[owner[order]]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(d)]))
    order = order[d > least]
    return owner[order], offset[order]


def expand_buckets(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        got = [load(b.as_py()) for b in table.column("block")]
        doc, start, size, part, data, twins, more = (np.concatenate([summed(g[c]) if c in (0, 6) else g[c] for g in got]) for c in range(7))
        del got
        size, twins = size.astype(np.int64), twins.astype(np.int64)
        begin, their, found = np.cumsum(size) - size, np.cumsum(twins) - twins, []
        for p in np.unique(part):  # contexts that share a window share a part
            own = np.flatnonzero(part == p)
            which, offset = repeated_windows(doc[own], size[own], data[np.repeat(begin[own], size[own]) + segment_arange(size[own])], length)
            which, lo, hi = merged(own[which], offset, offset + length)
            n = twins[which]
            also = more[np.repeat(their[which], n) + segment_arange(n)].astype(np.int64)
            at = np.r_[start[which].astype(np.int64), also]
            found.append(merged(np.r_[doc[which], np.repeat(doc[which], n)], at + np.r_[lo, np.repeat(lo, n)], at + np.r_[hi, np.repeat(hi, n)]))
        return pa.Table.from_batches([span_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets)])

    return blocks.groupBy("bucket").applyInArrow(tidy(work), BLOCK)


# ---- the operator ---------------------------------------------------------------------------
def cut_spans(texts: DataFrame, spans: DataFrame, key: str, as_text: bool) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        ids, begin, end, data = _texts(table)
        got = [load(b.as_py()) for kind, b in zip(table.column("kind").to_pylist(), table.column("block"), strict=True) if kind == "span"]
        doc = np.concatenate([np.cumsum(g[0]) for g in got]) if got else np.zeros(0, np.int64)
        start = np.concatenate([g[1] for g in got]).astype(np.int64) if got else doc
        stop = start + np.concatenate([g[2] for g in got]) if got else doc
        doc, start, stop = merged(doc, start, stop)
        edge = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        rows, kept = [], []
        for k in range(len(ids)):
            a, b, text = edge[0][k], edge[1][k], data[begin[k] : end[k]]
            cuts = np.c_[start[a:b], stop[a:b]]
            if len(cuts):
                keep = np.ones(len(text), bool)
                for x, y in cuts.tolist():
                    keep[x:y] = False
                text = text[keep]
            kept.append(text.tobytes().decode("utf-8", "ignore") if as_text else text.tobytes())
            rows.append([{"start": x, "end": y} for x, y in cuts.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(ids), pa.array(end - begin, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string() if as_text else pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return texts.unionByName(spans).groupBy("bucket").applyInArrow(tidy(work), f"`{key}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, bucket_bytes: int = 8_000_000, hot: int = 20_000, as_text: bool = False, slice_bytes: int = 4_000_000) -> DataFrame:
    """``key, n_bytes, spans, kept``: the bytes of every text that no smaller document repeats, and what went.

    ``kept`` is binary, as a cut may part a character; ``as_text`` makes it a string without such parts.
    """
    if not 4 <= k <= length:
        raise ValueError("k must be between 4 and the length")
    df = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    nameless = df.where(F.col(key).isNull())
    df = df.where(F.col(key).isNotNull())
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(min(65_536, max(8, total // bucket_bytes)))
    resolved = staged(resolve_contexts(find_contexts(df, key, text, buckets, length, k, slice_bytes=slice_bytes), buckets, hot), "spans")
    texts = pack_texts(df, key, text, buckets)
    more = expand_buckets(fetch_contexts(texts, resolved.where("kind = 'ask'"), buckets, length, k), buckets, length)
    out = cut_spans(texts, resolved.where("kind = 'span'").unionByName(more), key, as_text)
    untouched = nameless.select(key, F.octet_length(text).cast("bigint").alias("n_bytes"), F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col(text).cast("string" if as_text else "binary").alias("kept"))
    return out.unionByName(untouched)


def kept_texts(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns of ``df`` with the text that is left; bytes of characters cut in two are dropped."""
    done = remove_repeats(df, key, text, as_text=True, **how).select(key, F.col("kept").alias("_kept"))
    own = df.where(F.col(key).isNotNull()).drop(text).join(done, key).withColumnRenamed("_kept", text).select(df.columns)
    return own.unionByName(df.where(F.col(key).isNull()).withColumn(text, F.coalesce(F.col(text), F.lit(""))))
