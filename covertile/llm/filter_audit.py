"""How filters overlap, in every order of applying them: what each removes, what an earlier one has removed already.

1. Every document becomes a record with the filters it fails.  The last filter, "identical to the text of a smaller id", needs
   all documents: records go by the 64-bit fingerprint of their text to partitions of an RDD.  A task first keeps collision chains of
   its own rows (full text and smallest id per fingerprint), so of a text it sends the smallest id's row alone with the text; the
   others are duplicates already, and travel without it.
2. A partition's records come in order of fingerprint and id, so one chain is in memory at a time: the first row of each
   text in it is the smallest id, all later ones with a larger id are duplicates.  Texts are compared whole.
3. Documents are counted by part and set of failed filters (a mask), with their labels, and ``combineByKey`` merges these
   counts into one vector of all masks a part.  Every order's steps follow from the vector.

A text that a third of all rows share reaches its partition once from each task (or each ``CHAIN_BYTES`` of its texts); a hot part is a vector a task.

Defined results: a null text counts as empty and a null part as the empty string; a document with a null id is never a
duplicate and makes none; rows that share an id count each, and are duplicates where a smaller id has their text; several labels of an id count
if any of them holds; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Bytes of texts that a task holds in chains before it sends them on, and that a partition of fingerprints receives at most on average.
CHAIN_BYTES, PARTITION_BYTES = 16_000_000, 32_000_000
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))  # of UTF-8: all bytes of a character but its first


def failures(text: bytes) -> int:
    """Bits of A: under 100 words; B: under 80 different words of 100; C: over 10 capitals of 100 characters; D: one of ``# $ % & * |``."""
    words = text.split()  # at ASCII white space
    capitals, characters = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * characters) << 2 | (len(text.translate(None, b"#$%&*|")) < len(text)) << 3


def own_chains(judge: Callable[[bytes], int], repeat: int) -> Callable[[Iterable], Iterator]:
    """Of rows ``fingerprint, id, part, text`` records ``(route, id), (id, part, mask, text)``; the text only where it may be the first of its kind."""

    def work(rows):
        chains, held, sent = {}, 0, 0
        for print_, ident, part, raw in rows:
            raw = bytes(raw or b"")
            mask = judge(raw)
            if ident is None:
                sent += 1
                yield (sent, 0), (None, part, mask, None)
                continue
            chain = chains.setdefault(print_, [])
            link = next((x for x in chain if x[0] == raw), None)
            if link is None:
                chain.append([raw, ident, mask, [part]])
                held += len(raw) + 200
            elif ident == link[1]:
                link[3].append(part)
                held += 8
            else:
                late = [(ident, part)] if ident > link[1] else [(link[1], p) for p in link[3]]
                if ident < link[1]:
                    link[1], link[3] = ident, [part]
                for i, p in late:
                    yield (i * 0x9E3779B97F4A7C15 >> 7, i), (i, p, mask | repeat, None)
            if held > CHAIN_BYTES:
                yield from sent_on(chains)
                chains, held = {}, 0
        yield from sent_on(chains)

    return work


def sent_on(chains: dict) -> Iterator:
    for print_, chain in chains.items():
        for raw, ident, mask, parts in chain:
            for part in parts:
                yield (print_, ident), (ident, part, mask, raw)


def judged(repeat: int) -> Callable[[Iterable], Iterator]:
    """``id, part, mask`` of records in order of fingerprint and id."""

    def work(records):
        now, chain = None, []
        for (print_, _), (ident, part, mask, raw) in records:
            if raw is not None:
                if print_ != now:
                    now, chain = print_, []
                first = next((i for text, i in chain if text == raw), None)
                if first is None:
                    chain.append((raw, ident))
                elif ident > first:
                    mask |= repeat
            yield ident, part, mask

    return work


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", judge: Callable[[bytes], int] = failures, own: int = 4) -> DataFrame:
    """``id, part, mask`` of every document: bits of the ``own`` filters that ``judge`` finds, then that of repeated texts."""
    rows = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))), F.col(key).cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col(text).cast("binary")).rdd
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    records = rows.mapPartitions(own_chains(judge, 1 << own))
    routed = records.repartitionAndSortWithinPartitions(max(rows.getNumPartitions(), total // PARTITION_BYTES, 2), lambda k: k[0])
    return docs.sparkSession.createDataFrame(routed.mapPartitions(judged(1 << own)), "id long, part string, mask int", verifySchema=False)


def mask_vectors(masks: DataFrame, labels: DataFrame, key: str, filters: int):
    """RDD of part and counts ``[mask] -> [documents, good, toxic]``."""
    known = labels.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counts = masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))

    def add(vector, row):
        mask, *values = row
        vector[mask] = [a + b for a, b in zip(vector[mask], values, strict=True)]
        return vector

    merge = lambda a, b: [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]
    fresh = lambda row: add([[0, 0, 0] for _ in range(1 << filters)], row)
    return counts.rdd.map(lambda r: (r["part"], (r["mask"], r["n"], r["good"], r["toxic"]))).combineByKey(fresh, add, merge)


def steps(part: str, vector: list[list[int]], names: str) -> Iterator[tuple]:
    """All orders' steps of a part."""
    orders = list(permutations(range(len(names))))
    total = lambda where, what=0: sum(v[what] for m, v in enumerate(vector) if where(m))
    rows, removed_by = [], [0] * len(names)
    for order in orders:
        before = 0
        for at, f in enumerate(order):
            bit = 1 << f
            here = lambda m, bit=bit, before=before: m & bit and not m & before
            removed = total(here)
            removed_by[f] += removed
            rows.append((f, "".join(names[x] for x in order), at + 1, total(lambda m, all_=bit | before: not m & all_), removed, total(lambda m, bit=bit: m & bit) - removed, vector[bit][0], total(here, 1), total(here, 2)))
            before |= bit
    for f, *row in rows:
        yield (part, *row, removed_by[f])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", judge: Callable[[bytes], int] = failures, names: str = "ABCDE") -> DataFrame:
    """A row per part, order of the filters and step; the last of ``names`` is the filter of repeated texts, the others are ``judge``'s bits."""
    masks = staged(failed_filters(docs, key, text, part, judge, len(names) - 1), "masks")
    rows = mask_vectors(masks, labels, key, len(names)).flatMap(lambda x: steps(*x, names))
    columns = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return docs.sparkSession.createDataFrame(rows, f"part string, filter_order string, step int, {columns}", verifySchema=False)
