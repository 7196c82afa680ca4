"""Near-duplicates by banded MinHash, odd sketches and exact confirmation.

1. One pass over the texts gives each document's word-shingle set size, a 128-bit set identity, the MinHash bands
   and two odd sketches (parity bitmaps): of its MinHash samples, and of its whole set, at 4 to 8 bits a shingle.
2. Equal sets collapse to their smallest document; the rest works on such representatives.
3. A band bucket's smallest document leads it.  Every document is compared with its leaders; the pairs that the
   sketches leave are confirmed on full sets and contracted to components.
4. All documents of a leader stand in one group, so two that share a bucket share a group.  In groups with several
   components the rows outside the largest one are compared with all rows, in cells of bounded size, and again what
   the sketches leave is confirmed: first each row's nearest to every other component, then, after contraction,
   all pairs that are left across components of those groups.

The XOR of two odd sketches of samples estimates the similarity; it only sets the order, nearest first.  The XOR of two
odd sketches of whole sets has never more bits than the sets have different shingles: a pair with more bits than the
threshold allows is certainly no link, and only such pairs go unconfirmed.  So no link is lost but by the bands:
with 60 of 6 rows a pair of similarity 0.8 shares no bucket with a chance of about 1e-8.

Defined results: null and empty texts (and those without words) have no shingles and no link;
fewer words than a shingle make one shingle of the whole sequence; repeated rows with different
ids are one class; ids must be unique 64-bit integers; rows with a null id
join the class of their set but found none, and are kept only where there is none; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import ranked
from .common import byte_hashes, flat_bytes, in_arrow, lowered, mix64, release, row_chunks, small, staged, tidy, word_spans

BANDS, ROWS, SKETCH_BITS = 60, 6, 512
#: Tables of ids and labels (16 bytes a row) up to so many rows are broadcast, larger ones shuffled.
SMALL_ROWS = 500_000
#: Rows and sketch bytes of one side of a cell.
CELL_ROWS, CELL_BYTES = 1_000, 2_000_000
#: Pairs of a row with another component that are confirmed before the components are contracted again.
NEAREST = 3
_C = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of every row, flat, and their offsets."""
    data = lowered(data)
    starts, ends, bounds = word_spans(data, offsets)
    word = byte_hashes(data, starts, ends)
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word))
    whole = place + width <= bounds[row + 1] if len(word) else np.zeros(0, bool)
    first = place[whole]
    value = word[first].copy()
    for step in range(1, width):
        value = mix64(value * _C + word[first + step])
    value, owner = [value], [row[whole]]
    for n in range(1, width):  # rows of n words, fewer than a shingle has
        short = np.flatnonzero(count == n)
        v = word[bounds[short]].copy()
        for step in range(1, n):
            v = mix64(v * _C + word[bounds[short] + step])
        value.append(mix64(v ^ np.uint64(n * 0x9E3779B1)))
        owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    by = np.lexsort((value, owner))
    value, owner = value[by], owner[by]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as numbers that stand for their words' bytes among these texts; nothing is hashed to a fixed size."""
    number: dict[bytes, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int64) for t in texts]
    count = np.array([len(w) for w in words])
    flat, ends = np.concatenate([np.zeros(0, np.int64), *words]), np.cumsum(count)
    first = np.flatnonzero(np.arange(len(flat)) + width <= np.repeat(ends, count))
    code = flat[first]
    for step in range(1, width):
        code = np.unique(code * len(number) + flat[first + step], return_inverse=True)[1]
    edges = np.searchsorted(first, np.r_[0, ends])
    short: dict[tuple, int] = {}
    return [np.unique(code[edges[k] : edges[k + 1]]) if count[k] >= width else np.array([-1 - short.setdefault(tuple(words[k].tolist()), len(short))] * bool(count[k]), np.int64) for k in range(len(texts))]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(0, 1 << 32, n, np.uint32), random.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(value: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``(rows, n)`` MinHash samples; every row has a shingle."""
    flip, times = _constants(n)
    out = np.empty((len(bounds) - 1, n), np.uint32)
    small = (value >> np.uint64(32)).astype(np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((small ^ flip[i]) * times[i], bounds[:-1])
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """``(rows, bits / 64)`` words: the parity of how many samples fall on each bit."""
    n, k = samples.shape
    at = mix64(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    count = np.bincount((at.astype(np.int64) + (np.arange(n) * bits)[:, None]).ravel(), minlength=n * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, bits), axis=1).view("<i8")


def sketch_similarity(differing_bits: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> float:
    """The similarity that a population count of XORed sketches of samples stands for."""
    return 1 + bits / (4 * samples) * np.log(max(1e-9, 1 - 2 * differing_bits / bits))


def set_sketches(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches of whole sets, flat bytes, and their offsets; a power of two of at least 64 and four times the set's size in bits."""
    size = np.diff(bounds)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    at = (mix64(value ^ _C) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(base, size)
    odd = np.bincount(at, minlength=int(width.sum())).astype(np.uint8) & 1
    return np.packbits(odd), np.r_[base, width.sum()] // 8


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches ``(rows, words)`` of a smaller power of two of words: halves over each other."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class Sketches:
    """Set sizes and sketches of whole sets of the rows of an Arrow table."""

    def __init__(self, n, bits):
        self.n = n.to_numpy()
        self.flat, self.ends = flat_bytes(bits)
        self.width = np.diff(self.ends) // 8

    def words(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Set sketches of rows of one width, folded to ``width`` words."""
        own = int(self.width[rows[0]])
        at = self.ends[rows][:, None] + np.arange(own * 8)
        return folded(self.flat[at].view(np.uint64), width)


def may_link(percent: int, n, m, differing):
    """Whether sets of sizes n and m with at least so many different shingles can reach the threshold."""
    return ((100 + percent) * differing <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def signatures(df: DataFrame, key: str, text: str, width: int, chunk_bytes: int = 1_000_000) -> DataFrame:
    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(1))
            for a, b in row_chunks(offsets, chunk_bytes):
                value, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                size = np.diff(bounds)
                n, full = b - a, np.flatnonzero(size)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
                if len(full):
                    edge = np.r_[bounds[full], bounds[-1]]
                    one[full] = np.add.reduceat(mix64(value), edge[:-1])
                    two[full] = np.bitwise_xor.reduceat(mix64(value ^ _C), edge[:-1])
                    samples = min_hashes(value, edge, BANDS * ROWS)
                    sketch[full] = odd_sketches(samples)
                    hashed = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        hashed = mix64(hashed * _C + samples[:, r::ROWS].astype(np.uint64))
                    bands[full] = hashed.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                samples_of = _binary(sketch.view(np.uint8).ravel(), np.arange(n + 1) * (SKETCH_BITS // 8))
                columns = [batch.column(0)[a:b].cast(pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, samples_of, _binary(*set_sketches(value, bounds))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "bands", "sketch", "bits"])

    return in_arrow(df.select(key, text), work, "id long, n long, k1 long, k2 long, bands array<long>, sketch binary, bits binary")


def _compressed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as zlib bytes, so that the one exchange that moves them moves less."""
    import zlib

    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(1))
            for a, b in row_chunks(offsets, 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array([zlib.compress(data[offsets[k] : offsets[k + 1]].tobytes(), 3) for k in range(a, b)], pa.binary())], ["id", "z"])

    return in_arrow(df.select(key, text), work, "id long, z binary")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b, linked`` of pairs, on their full sets of words' bytes."""
    import zlib

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = np.c_[part.column("a").to_numpy(), part.column("b").to_numpy()]
                blobs = [*part.column("za").to_pylist(), *part.column("zb").to_pylist()]
                names, where = np.unique(ids.T.ravel(), return_inverse=True)
                body = {int(w): zlib.decompress(z) for w, z in dict(zip(where.tolist(), blobs, strict=True)).items()}
                sets = exact_sets([body[k] for k in range(len(names))], width)
                linked = []
                for x, y in zip(where[: len(ids)].tolist(), where[len(ids) :].tolist(), strict=True):
                    s, t = sets[x], sets[y]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    linked.append(100 * common >= percent * (len(s) + len(t) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])

    one = texts.select(F.col("id").alias("a"), F.col("z").alias("za"))
    two = texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    return in_arrow(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "za", "zb"), work, "a long, b long, linked boolean")


def near_leaders(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of ``id, leader`` pairs those that the sketches of whole sets leave, as ``a, b``."""

    def work(batches):
        for batch in batches:
            one, two = Sketches(batch.column("n"), batch.column("bits")), Sketches(batch.column("ln"), batch.column("lbits"))
            keep = np.zeros(batch.num_rows, bool)
            fits = np.flatnonzero(may_link(percent, one.n, two.n, 0))
            sort = one.width[fits] << 32 | two.width[fits]
            for kind in np.unique(sort):
                at = fits[sort == kind]
                for k in range(0, len(at), step := max(1, CELL_BYTES // int(8 * max(one.width[at[0]], two.width[at[0]])))):
                    part, width = at[k : k + step], int(min(one.width[at[0]], two.width[at[0]]))
                    differing = np.bitwise_count(one.words(part, width) ^ two.words(part, width)).sum(1, dtype=np.int64)
                    keep[part] = may_link(percent, one.n[part], two.n[part], differing)
            a, b = batch.column("id").to_numpy()[keep], batch.column("leader").to_numpy()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    own, leads = rows.select("id", "n", "bits"), rows.select(F.col("id").alias("leader"), F.col("n").alias("ln"), F.col("bits").alias("lbits"))
    return in_arrow(pairs.join(own, "id").join(leads, "leader").select("id", "leader", "n", "bits", "ln", "lbits"), work, "a long, b long")


def cell_pairs(table: pa.Table, percent: int, nearest: int | None) -> pa.Table:
    """Pairs of a cell's rows ``lead`` with its other rows, across components, that the sketches of whole sets leave.

    With ``nearest``, a row keeps so many of each other component, nearest by the sketches of samples; ``cut`` marks rows with more.
    """
    rows = Sketches(table.column("n"), table.column("bits"))
    sample = flat_bytes(table.column("sketch"))[0].view(np.uint64).reshape(table.num_rows, -1)
    group, lead, ident, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "lead", "id", "label"))
    found = [(np.zeros(0, np.int64),) * 2]
    kind = np.lexsort((rows.width, lead, group))
    edges = np.flatnonzero(np.r_[True, (np.diff(group[kind]) != 0) | (np.diff(lead[kind].astype(np.int8)) != 0) | (np.diff(rows.width[kind]) != 0), True])
    runs: dict[int, tuple[list, list]] = {}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        runs.setdefault(int(group[kind[a]]), ([], []))[int(lead[kind[a]])].append(kind[a:b])
    for others, leads in runs.values():
        for x in leads:
            for y in others:
                if 100 * rows.n[x].max() < percent * rows.n[y].min() or 100 * rows.n[y].max() < percent * rows.n[x].min():
                    continue
                width = int(min(rows.width[x[0]], rows.width[y[0]]))
                q = rows.words(y, width)
                for k in range(0, len(x), step := max(1, 4 * CELL_BYTES // (8 * width * len(y)))):
                    part = x[k : k + step]
                    differing = np.bitwise_count(rows.words(part, width)[:, None] ^ q[None]).sum(2, dtype=np.int64)
                    keep = may_link(percent, rows.n[part][:, None], rows.n[y][None], differing) & (label[part][:, None] != label[y][None])
                    i, j = np.nonzero(keep)
                    found.append((part[i], y[j]))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    far = np.bitwise_count(sample[x] ^ sample[y]).sum(1, dtype=np.int64)
    by = np.lexsort((ident[y], far, label[y], ident[x], group[x]))
    x, y = x[by], y[by]
    cut = np.zeros(len(x), bool)
    if nearest is not None and len(x):
        new = np.flatnonzero(np.r_[True, (np.diff(ident[x]) != 0) | (np.diff(label[y]) != 0) | (np.diff(group[x]) != 0)])
        size = np.diff(np.r_[new, len(x)])
        cut = np.repeat(size > nearest, size)
        keep = np.arange(len(x)) - np.repeat(new, size) < nearest
        x, y, cut = x[keep], y[keep], cut[keep]
    return pa.table({"a": np.minimum(ident[x], ident[y]), "b": np.maximum(ident[x], ident[y]), "leader": group[x], "cut": cut})


def _if_small(df: DataFrame) -> DataFrame:
    return small(df, SMALL_ROWS)


def across(groups: DataFrame, rows: DataFrame, labels: DataFrame, percent: int, nearest: int | None, handed=_if_small) -> DataFrame:
    """``a, b, leader, cut``: pairs of one group and several components that the sketches leave (``groups``: id, leader).

    Rows outside a group's largest component lead.  Groups are dealt into cells by hash: small ones share a cell,
    large ones are cut into leading parts x parts, so no group has to fit a task.
    """
    known = staged(groups.join(handed(labels), "id"), "known")
    # a set of n shingles has a sketch of n / 2 to n bytes
    counts = known.groupBy("leader", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sums = counts.groupBy("leader").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("labels > 1")
    parts = lambda c, w: F.ceil(F.greatest(c / CELL_ROWS, w / CELL_BYTES)).cast("long")
    left = F.col("c") - F.col("top.c")
    open_ = staged(sums.select("leader", F.col("top.label").alias("main"), F.col("c").alias("size"), parts(F.col("c"), F.col("w")).alias("p"), parts(left, left * F.col("w") / F.col("c")).alias("q")), "open")
    packs = max(1, int(open_.where("p = 1").agg(F.sum("size")).first()[0] or 0) // CELL_ROWS)
    members = known.join(handed(open_), "leader")
    h, pack = F.xxhash64("id"), F.pmod(F.xxhash64("leader"), F.lit(packs))
    place = lambda i, j: F.when((F.col("p") == 1) & (F.col("q") == 1), F.struct(F.lit(-1).cast("long").alias("g"), pack.alias("i"), F.lit(0).cast("long").alias("j"))).otherwise(F.struct(F.col("leader").alias("g"), i.cast("long").alias("i"), j.cast("long").alias("j")))
    other = members.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).withColumn("cell", place(F.col("i"), F.pmod(h, F.col("p"))))
    lead = members.where("label <> main").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))).withColumn("cell", place(F.pmod(h, F.col("q")), F.col("j")))
    dealt = other.select("cell", "leader", F.lit(False).alias("lead"), "id", "label").unionAll(lead.select("cell", "leader", F.lit(True).alias("lead"), "id", "label"))
    return dealt.join(rows, "id").groupBy("cell").applyInArrow(tidy(lambda table: cell_pairs(table, percent, nearest)), "a long, b long, leader long, cut boolean")


def components(edges: DataFrame, handed=_if_small) -> DataFrame:
    """``id, label`` of every vertex of ``a, b`` links: the smallest id that it reaches.

    Each pass hooks every vertex to its smallest neighbour and contracts the links accordingly; the
    vertices left fall at least by half, so the passes grow with the logarithm of the table.
    """
    links = staged(edges.select("a", "b").where("a <> b"), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hook = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "hooks")
        side = handed(hook)
        if labels is None:
            labels = hook
        else:
            step = side.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = staged(labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
        one, two = (side.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        before, links = links, staged(links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b"), "links")
        release(before)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "id long, label long")


def link_classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row per document with its class.

    Documents are linked at ``100 * intersection >= percent * union`` of their shingle sets.
    """
    signed = staged(signatures(df, key, text, width), "signatures")
    some = signed.where("n > 0 AND id IS NOT NULL")
    own = staged(some.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "bands")).alias("x")).select("k1", "k2", "n", F.col("x.id").alias("rep"), "x.bands"), "representatives")
    hashed = own.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = staged(hashed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("leader")).where("c > 1").select("bucket", "leader"), "buckets")
    groups = staged(hashed.join(shared, "bucket").select("id", "leader").distinct(), "groups")
    seen = staged(groups.select("id").distinct(), "active")
    # labels, hooks, leaders and groups are named by ids of this table and have no more rows than it: one count tells for all
    handed = F.broadcast if seen.count() <= SMALL_ROWS else _if_small
    active = handed(seen)
    rows = staged(signed.select("id", "n", "sketch", "bits").join(active, "id"), "sketches")
    texts = staged(_compressed(df, key, text).join(active, "id"), "texts")
    labels = rows.select("id", "n", F.col("id").alias("label"))

    def joined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels after the pairs that are links."""
        found = staged(confirm(pairs, texts, width, percent), "tested").where("linked")
        known = handed(labels)
        one, two = (known.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        moved = components(found.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), handed)
        step = handed(moved).select(F.col("id").alias("label"), F.col("label").alias("next"))
        return staged(labels.join(step, "label", "left").select("id", "n", F.coalesce("next", "label").alias("label")), "labels")

    labels = joined(staged(near_leaders(groups.where("id <> leader"), rows, percent), "pairs"), labels)
    left = groups
    for nearest in (NEAREST, None):
        pairs = staged(across(left, rows, labels, percent, nearest, handed), "pairs")
        before, labels = labels, joined(pairs.select("a", "b").distinct(), labels)
        # in all other groups every pair across components was confirmed or excluded
        again = staged(pairs.where("cut").select("leader").distinct(), "again")
        release(pairs, before)
        if again.isEmpty():
            break
        left = groups.join(handed(again), "leader")
    classes = own.join(handed(labels).select(F.col("id").alias("rep"), "label"), "rep", "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("label"))
    classes = staged(classes, "classes")
    release(own, shared, groups, seen, rows, texts, labels)
    out = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` of which one of each class stays: the one of the smallest id.

    Ids may be null or repeated: rows are then numbered by id (null last), hash of the text and place, and of equal ids the first
    number stays.  Rows without words are linked with nothing and all stay.
    """
    rows, ids = df.agg(F.count("*"), F.count_distinct(key)).first()
    if rows == ids:
        lost = link_classes(df, key, text, width, percent).where("NOT kept").select(key)
        return df.join(lost, key, "left_anti").select(df.columns)
    placed = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_text"), F.col(key).isNull().alias("_null"), F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    keyed = staged(ranked(placed, ["_null", "_id", "_hash", "_at"], "_key").select("_row", "_text", "_key"), "numbered")
    lost = link_classes(keyed, "_key", "_text", width, percent).where("NOT kept").select("_key")
    return keyed.join(lost, "_key", "left_anti").select("_row.*")
