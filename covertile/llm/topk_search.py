"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merging.

Queries and rows meet in cells, a block of queries with a block of rows.  A cell multiplies tiles of both, keeps the best k of each tile
by partial selection and folds the tile into its queries' running lists; the lists of all cells are merged as a tree of
two levels: per query and one of 64 branches, then per query.  Nothing passes the driver but counts.

Components become ``floor(scale * x)`` with x as a double, so scores are exact integers and ties are
real: they go to the smaller id.  Vectors meet vectors of their own length only.  Null ids, null vectors and null or
non-finite components take no part.  Rows that share an id are rows of their own, and none of them is an answer to that id's queries; queries that
share an id have one list.  Scores beyond 64 bits are held at the ends of the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, NOTHING, columns, dealt, inner_products, quantised, sides, top, vectors_by_length, whole
from .common import staged, tidy


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id: partial selection by score, then all ties of the last place."""
    n = scores.shape[1]
    if n > k:
        last = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        at = np.flatnonzero((scores >= last).any(axis=0))
        scores, ids = scores[:, at], ids[:, at]
    by = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)


def cell_tops(table: pa.Table, k: int, tile: int, tile_queries: int) -> pa.Table:
    """The best k rows of a cell for each of its queries."""
    asking, rows = sides(table)
    (own,), (ids,) = columns(asking, "id"), columns(rows, "id")
    others, found = vectors_by_length(rows), [(np.zeros(0, np.int64),) * 3]
    for dim, (at, q) in vectors_by_length(asking).items():
        if dim not in others:
            continue
        place, matrix = others[dim]
        qid = own[at]
        top_s, top_i = np.full((len(qid), k), NOTHING), np.full((len(qid), k), np.iinfo(np.int64).max)
        for a in range(0, len(place), tile):
            near, block = ids[place[a : a + tile]], matrix[a : a + tile].T
            for b in range(0, len(qid), tile_queries):
                scores = inner_products(q[b : b + tile_queries], block)
                other = qid[b : b + tile_queries, None] != near[None, :]
                # only queries with a score that can enter their list
                hot = np.flatnonzero(((scores >= top_s[b : b + tile_queries, -1:]) & other).any(axis=1))
                if not len(hot):
                    continue
                s, i = _best(np.where(other[hot], scores[hot].astype(np.int64), NOTHING), np.broadcast_to(near, (len(hot), len(near))), k)
                hot += b
                top_s[hot], top_i[hot] = _best(np.concatenate([top_s[hot], s], 1), np.concatenate([top_i[hot], i], 1), k)
        r, c = np.nonzero(top_s > NOTHING)
        found.append((qid[r], top_i[r, c], top_s[r, c]))
    return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def search(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, tile: int = 512, tile_queries: int = 256) -> DataFrame:
    """``query_id, rank int, <key>, score long`` for every query with a usable vector; a query's own row is left out."""
    named = lambda x: quantised(x.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")), "id", "vector", scale)
    rows, wanted = staged(named(df), "vectors"), staged(named(queries), "queries")
    place = whole(rows.count(), wanted.count(), block, df.sparkSession.sparkContext.defaultParallelism)
    cells = dealt(wanted.withColumns(place), rows.withColumns(place))
    lists = cells.applyInArrow(tidy(lambda table: cell_tops(table, k, tile, tile_queries)), "query_id long, id long, score long")
    return top(lists, ["query_id"], "score", "id", k).select("query_id", "rank", F.col("id").alias(key), "score")
