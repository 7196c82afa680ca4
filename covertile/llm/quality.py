"""Document quality by histogram gradient-boosted trees over text statistics.

The statistics come from whole texts in numpy (lengths, character classes, word shapes, repetition of
words, word pairs and lines).  Trees are grown on the driver by second-order boosting on histograms of
binned statistics of a bounded sample of labelled rows (``most_rows``, by hash order); they are complete
trees of one depth, flattened into arrays of features, thresholds and leaves, and traversed for all
rows and trees at once.

Defined results: null and empty texts have all-zero statistics and get the trees' score for those; equal
texts get equal scores; without labels every score is 0.5, with labels of one class their share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_hashes, flat_bytes, give_back, in_arrow, lowered, mix64, row_chunks, word_spans

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "marks", "symbols", "other_bytes",
    "distinct_words", "top_word", "repeats_previous", "distinct_pairs", "top_pair", "ends_stop", "ends_mark", "ends_symbol", "symbol_words", "capital_words", "upper_words",
    "lines", "repeated_lines", "repeated_line_bytes", "one_char_words",
]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_SPACE, _MARK, _SYMBOL = _table(" \t\n\r\v\f"), _table(".,;:!?'\"-()"), _table("#$%&*+/<=>@[\\]^_`{|}~")
_HIGH = np.arange(256) >= 128


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def _repetition(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values, and how often the commonest stands there."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(value):
        by = np.lexsort((value, row))
        value, row = value[by], row[by]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        count = np.diff(np.r_[first, len(value)])
        distinct = np.bincount(row[first], minlength=n).astype(float)
        edge = np.flatnonzero(np.r_[True, row[first][1:] != row[first][:-1]])
        most[row[first][edge]] = np.maximum.reduceat(count, edge)
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``(rows, len(FEATURES))`` numbers; shares are between 0 and 1."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    starts, ends, bounds = word_spans(data, offsets)
    words = np.diff(bounds).astype(float)
    row = np.repeat(np.arange(n), np.diff(bounds))
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    small = lowered(data)
    word, length = byte_hashes(small, starts, ends), ends - starts
    distinct, top = _repetition(word, row, n)
    paired = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pair = mix64(word[paired] * np.uint64(0x9FB21C651E98DF25) + word[paired + 1])
    distinct_pairs, top_pair = _repetition(pair, row[paired], n)
    pairs = 1 / np.maximum(words - 1, 1)
    count = lambda flags: np.bincount(row[flags], minlength=n) * per_word
    last, first = data[ends - 1], data[starts]
    symbols, uppers = np.r_[0, np.cumsum(_SYMBOL[data])], np.r_[0, np.cumsum(_UPPER[data])]
    smalls = np.r_[0, np.cumsum(_LOWER[data])]
    upper_word = (uppers[ends] - uppers[starts] > 1) & (smalls[ends] == smalls[starts])
    longest = np.zeros(n)
    full = np.flatnonzero(words)
    if len(full):
        longest[full] = np.maximum.reduceat(length, bounds[full])
    # lines: runs without line feeds
    brk = np.flatnonzero(data == 10)
    cut = np.unique(np.r_[offsets[:-1], brk + 1, offsets[-1]])
    ls = cut[:-1]
    lrow = np.searchsorted(offsets, ls, "right") - 1
    le = np.minimum(cut[1:], offsets[lrow + 1])
    le = le - (data[le - 1] == 10)
    real = le > ls
    ls, le, lrow = ls[real], le[real], lrow[real]
    line = byte_hashes(small, ls, le)
    lines, distinct_lines = np.bincount(lrow, minlength=n).astype(float), _repetition(line, lrow, n)[0]
    by = np.lexsort((line, lrow))
    again = np.r_[False, (line[by][1:] == line[by][:-1]) & (lrow[by][1:] == lrow[by][:-1])] if len(line) else np.zeros(0, bool)
    repeated_bytes = np.bincount(lrow[by][again], (le - ls)[by][again], n)
    values = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(words),
        "word_length": np.bincount(row, length, n) * per_word,
        "longest_word": np.log1p(longest),
        "letters": (_by_row(_LOWER[data], offsets) + _by_row(_UPPER[data], offsets)) * per_byte,
        "upper": _by_row(_UPPER[data], offsets) * per_byte,
        "digits": _by_row(_DIGIT[data], offsets) * per_byte,
        "spaces": _by_row(_SPACE[data], offsets) * per_byte,
        "marks": _by_row(_MARK[data], offsets) * per_byte,
        "symbols": _by_row(_SYMBOL[data], offsets) * per_byte,
        "other_bytes": _by_row(_HIGH[data], offsets) * per_byte,
        "distinct_words": distinct * per_word,
        "top_word": top * per_word,
        "repeats_previous": np.bincount(row[paired[word[paired] == word[paired + 1]]], minlength=n) * pairs,
        "distinct_pairs": distinct_pairs * pairs,
        "top_pair": top_pair * pairs,
        "ends_stop": count((last == 46) | (last == 63)),
        "ends_mark": count(last == 33),
        "ends_symbol": count(_SYMBOL[last]),
        "symbol_words": count(symbols[ends] > symbols[starts]),
        "capital_words": count(_UPPER[first]),
        "upper_words": count(upper_word),
        "lines": lines * per_word,
        "repeated_lines": 1 - distinct_lines / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        "repeated_line_bytes": repeated_bytes * per_byte,
        "one_char_words": count(length == 1),
    }
    for j, name in enumerate(FEATURES):
        out[:, j] = values[name]
    return out


class BoostedTrees:
    """Complete trees in flat arrays: ``feature`` and ``threshold`` per inner node, ``leaf`` per leaf."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, (1 << depth) - 1), np.int64)
        self.threshold = np.zeros((0, (1 << depth) - 1))
        self.leaf = np.zeros((0, 1 << depth))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least_rows: int = 5) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        model = cls(depth, float(np.log(share / (1 - share))))
        if not 0 < y.sum() < len(y):
            return model
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(m)], 1)
        columns = (binned + np.arange(m) * bins).astype(np.int64)
        margin = np.full(n, model.base)
        features, thresholds, leaves = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                width = 1 << level
                cell = (node[:, None] * (m * bins) + columns).ravel()
                g, h, c = (np.bincount(cell, np.repeat(w, m), width * m * bins).reshape(width, m, bins).cumsum(2) for w in (grad, hess, np.ones(n)))
                total_g, total_h, total_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                gain = np.where((c >= least_rows) & (total_c - c >= least_rows), gain, -1).reshape(width, -1)
                best = gain.argmax(1)
                for k in range(width):
                    if gain[k, best[k]] > 1e-9:
                        f, b = divmod(int(best[k]), bins)
                        if b < len(edges[f]):
                            feature[width - 1 + k], threshold[width - 1 + k] = f, edges[f][b]
                at = width - 1 + node
                node = 2 * node + (x[np.arange(n), feature[at]] > threshold[at])
            leaf = -rate * np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + ridge)
            margin += leaf[node]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(leaf)
        model.feature, model.threshold, model.leaf = np.array(features), np.array(thresholds), np.array(leaves)
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees of a block of rows move down a level at a time."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))
        for a in range(0, len(x) if len(trees) else 0, 2000):
            part = x[a : a + 2000]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (part[rows, self.feature[trees, at]] > self.threshold[trees, at])
            out[a : a + 2000] += self.leaf[trees, node].sum(1)
        return 1 / (1 + np.exp(-out))


def with_statistics(df: DataFrame, keep: list[str], text: str = "text", chunk_bytes: int = 800_000) -> DataFrame:
    """``keep`` and ``x array<double>``, the statistics of every whole text."""
    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(len(keep)))
            for a, b in row_chunks(offsets, chunk_bytes):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(keep))), lists], [*keep, "x"])

    return in_arrow(df.select(*keep, text), work, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 20_000, **grown) -> BoostedTrees:
    """``labels`` are only the rows to learn from; at most ``most_rows`` of them are used, by hash of the key; of several labels of a key the least."""
    chosen = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias(label)).orderBy(F.xxhash64(key), key).limit(most_rows)
    rows = with_statistics(docs.join(F.broadcast(chosen), key), [key, label], text).toArrow()
    order = np.argsort(rows.column(key).to_numpy(), kind="stable")
    x = rows.column("x").combine_chunks()
    x = np.asarray(x.flatten()).reshape(-1, len(FEATURES))[order] if rows.num_rows else np.zeros((0, len(FEATURES)))
    trees = BoostedTrees.fit(x, rows.column(label).to_numpy().astype(float)[order], **grown)
    del rows, x, order
    give_back()  # what the fit took of the driver's memory
    return trees


def with_scores(df: DataFrame, model: BoostedTrees, text: str = "text", chunk_bytes: int = 800_000) -> DataFrame:
    """All columns and ``score``, row by row without a shuffle; the columns must not hold a ``score``."""
    from pyspark.sql import types as T

    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches):
        for batch in batches:
            data, offsets = flat_bytes(batch.column(place))
            for a, b in row_chunks(offsets, chunk_bytes):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(shared.value.scores(x))], schema.names)

    return in_arrow(df, work, schema)


def score(df: DataFrame, model: BoostedTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row."""
    return with_scores(df.select(key, text), model, text).select(key, "score")
