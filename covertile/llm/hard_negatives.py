"""Hard negatives by full sorts of each anchor's scores.

Anchors and rows meet in cells, a block of anchors with a block of rows, each of bounded size.  In a cell every anchor's
integer scores of all its rows are computed and sorted (score downwards, ties to the smaller id); what a cell finds
is merged per anchor as a top list, so no anchor's scores have to fit a task.

1. Positives: cells of anchors and rows of the same label give each anchor's best ``positives`` rows.
2. Negatives: in cells of all rows each positive's upper limit is found in the anchor's sorted scores by binary search, and
   from there the first ``negatives`` rows of other labels down to the lower limit are read.

Scores are inner products of ``floor(scale * x)`` with x as a double.  A negative's score must lie between ``low`` and ``high``
hundredths of the positive's.  There is no candidate search: every anchor is scored against every row.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; of rows
that share an id the one of the least label, then vector, takes part; vectors of different lengths have no score;
an anchor without a row of its label has no positives and gives no row; an empty table gives none; further columns are not read.
Scores beyond 64 bits are held at the ends of the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, columns, dealt, inner_products, quantised, sides, top, vectors_by_length, whole
from .common import staged, tidy

#: Scores that are sorted at a time.
SCORES = 1_000_000


def sorted_scores(anchors: pa.Table, rows: pa.Table):
    """Every anchor's place, with the places and scores of all rows of its vector's length: by score downwards, then by id."""
    others = vectors_by_length(rows)
    for dim, (own, matrix) in vectors_by_length(anchors).items():
        if dim not in others:
            continue
        place, block = others[dim]
        step = max(1, SCORES // len(place))
        for k in range(0, len(own), step):
            scores = inner_products(matrix[k : k + step], block.T).astype(np.int64)
            order = np.argsort(~scores, axis=1, kind="stable")  # rows are in order of id already
            for a, s, by in zip(own[k : k + step].tolist(), scores, order, strict=True):
                yield a, place[by], s[by]


def best_of_label(table: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of each anchor's label."""
    anchors, rows = sides(table)
    (own, own_label), (ids, label) = columns(anchors, "id", "label"), columns(rows, "id", "label")
    found = [(np.zeros(0, np.int64),) * 3]
    for a, place, scores in sorted_scores(anchors, rows):
        at = np.flatnonzero((label[place] == own_label[a]) & (ids[place] != own[a]))[:k]
        found.append((np.full(len(at), own[a]), ids[place[at]], scores[at]))
    return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def within_limits(table: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """``k`` rows of other labels for each of an anchor's ``positives``, from the upper limit of the score downwards."""
    anchors, rows = sides(table)
    (own, own_label), (ids, label) = columns(anchors, "id", "label"), columns(rows, "id", "label")
    found = [(np.zeros(0, np.int64),) * 5]
    for a, place, scores in sorted_scores(anchors, rows):
        other = np.flatnonzero(label[place] != own_label[a])
        rising = ~scores[other]
        for positive in anchors.column("positives")[a].as_py():
            p = positive["positive_score"]
            # 100 * score is at most high * p and at least low * p
            top, bottom = (min(max(x, -(2**63)), 2**63 - 1) for x in (high * p // 100, -(-low * p // 100)))
            at = other[np.searchsorted(rising, ~top, "left") : np.searchsorted(rising, ~bottom, "right")][:k]
            found.append((np.full(len(at), own[a]), np.full(len(at), positive["positive_id"]), ids[place[at]], np.full(len(at), p), scores[at]))
    return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def mine(df: DataFrame, anchor: str, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank int, negative_id, positive_score, negative_score`` for the rows for which the condition ``anchor`` holds."""
    spark = df.sparkSession
    usable = quantised(df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(F.expr(anchor), F.lit(False)).alias("asks")), "id", "vector", scale, "label", "asks")
    one = usable.where("label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("x")).select("id", "x.*")
    rows = staged(one, "vectors")
    anchors = rows.where("asks").drop("asks")
    n = {r[0]: r[1] for r in rows.groupBy("asks").count().collect()}
    total, asked = sum(n.values()), n.get(True, 0)
    # rows of one label share cells; small labels are packed together, large ones are cut
    own = rows.groupBy("label").agg(F.count("*").alias("rows"), F.count_if("asks").alias("anchors")).where("anchors > 0")
    packs = max(1, -(-total // block))
    group = F.when(F.col("rows") * 2 > block, F.struct(F.lit(1).alias("own"), F.col("label").alias("of"))).otherwise(F.struct(F.lit(0).alias("own"), F.pmod(F.xxhash64("label"), F.lit(packs)).alias("of")))
    own = staged(own.withColumn("g", group), "labels")
    parts = own.groupBy("g").agg(F.ceil(F.sum("anchors") / block).cast("long").alias("p"), F.ceil(F.sum("rows") / block).cast("long").alias("q"))
    named = own.select("label", "g").join(parts, "g")
    cells = dealt(anchors.join(named, "label"), rows.drop("asks").join(named, "label"), "label")
    near = cells.applyInArrow(tidy(lambda table: best_of_label(table, positives)), "anchor_id long, positive_id long, positive_score long")
    best = staged(top(near, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    lists = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))  # of ``positives`` rows at most
    place = whole(total, asked, block, spark.sparkContext.defaultParallelism)
    every = dealt(anchors.join(lists, "id").withColumns(place), rows.drop("asks").withColumns(place), "label", "positives")
    far = every.applyInArrow(tidy(lambda table: within_limits(table, negatives, low, high)), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = top(far, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
