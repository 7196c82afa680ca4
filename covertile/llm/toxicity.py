"""Toxicity by class-conditional Kneser-Ney models of words' spelling.

Two interpolated Kneser-Ney models, of toxic and of ordinary documents, give every word a
log-likelihood by its bytes from a start mark to an end mark.  Each class has its own counts for the
full context (up to ``ORDER - 1`` bytes, or back to the start mark); all shorter contexts use
continuation counts that both classes share, so an expression that only one class has seen, or none,
is judged by what is known of its parts.  A document's evidence is the difference of the classes'
log-likelihoods, normalised by length over the whole text, over its best windows of words and over
its strongest words; a logistic regression turns the evidence into a score.

All labelled rows are counted: Spark sums how many documents of each class (and fold) hold an n-gram in
their words, and every table of the models follows from that one table.  It grows with the spellings that
occur, not with the rows, is collected and broadcast.  Only the handful of logistic weights learns from a bounded sample
(``most_rows`` of each class, by hash order).  Texts are scored whole.

Defined results: null texts count as empty; texts without letters have no evidence and get the score
of the intercept; equal texts get equal scores; rows without a label are not used for fitting;
labels of both classes are needed, otherwise every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, byte_hashes, flat_bytes, give_back, in_arrow, row_chunks, segment_arange, small

ORDER = 6
#: Absolute discounts by count (1, 2, 3 or more) of class counts and of shared continuation counts.
CLASS_DISCOUNTS, SHARED_DISCOUNTS = (0.9, 1.5, 2.0), (0.75, 0.75, 0.75)
WINDOWS = (4, 16, 64)
START, END = 1, 2  # marks; control bytes never stand in words
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every run of letters, and the words before each row."""
    data, offsets = flat_bytes(pc.utf8_lower(texts.fill_null("")))
    solid = _LETTER[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words between marks, flat, and where each begins."""
    size = ends - starts + 2
    out = np.empty(int(size.sum()), np.uint8)
    begin = np.cumsum(size) - size
    out[begin], out[begin + size - 1] = START, END
    inner = np.repeat(starts, size - 2) + segment_arange(size - 2)
    out[np.repeat(begin + 1, size - 2) + segment_arange(size - 2)] = data[inner]
    return out, np.r_[begin, len(out)]


def grams(flat: np.ndarray, begin: np.ndarray):
    """Per predicted byte: its word, and for every context length the hashes of context and n-gram (context first, longest first)."""
    size = np.diff(begin) - 1
    word = np.repeat(np.arange(len(size)), size)
    at = np.repeat(begin[:-1] + 1, size) + segment_arange(size)
    reach = np.minimum(at - begin[word], ORDER - 1)
    return word, at, reach, RangeHash(flat)


def packed(flat: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Context and predicted byte as one integer, the predicted byte lowest; no byte of marked words is 0."""
    out = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        out |= np.where(j <= reach, flat[np.maximum(at - j, 0)].astype(np.int64), 0) << (8 * j)
    return out


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``packed``: flat bytes of the n-grams, where each one's predicted byte is, and its context's length."""
    each = (keys[:, None] >> (8 * np.arange(ORDER - 1, -1, -1))).astype(np.uint8)
    size = (each > 0).sum(1)
    return each[each > 0], np.cumsum(size) - 1, size - 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(keys[by]) != 0])
    return keys[by][first], np.add.reduceat(counts[by], first, axis=0)


def gram_counts(texts: pa.Array, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the texts' words, and for each kind of row the sum over words of the rows that hold the word."""
    data, starts, ends, bounds = words_of(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, kinds), np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    _, example, which = np.unique(byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
    once = np.unique(which.astype(np.int64) * len(texts) + row)  # a word counts once in a document
    weights = np.bincount(once // len(texts) * kinds + kind[once % len(texts)], minlength=len(example) * kinds).reshape(-1, kinds)
    flat, begin = marked(data, starts[example], ends[example])
    word, at, reach, _ = grams(flat, begin)
    return summed(packed(flat, at, reach), weights[word])


class Table:
    """Sums of one or several values by hash, looked up with whole arrays; 0 where a hash is not known."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.values = (np.add.reduceat(values, first, axis=0) if len(first) else values).astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), *self.values.shape[1:]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.values[at].astype(float)
        out[self.keys[at] != keys] = 0
        return out


class SpellingModels:
    """Both classes' models; ``evidence`` gives log P(word | toxic) - log P(word | ordinary)."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, weights: np.ndarray):
        """Distinct words between marks, and per word its counts in ordinary and toxic documents."""
        word, at, reach, hashed = grams(flat, begin)
        self._count(at, reach, hashed, weights[word])

    @classmethod
    def of_grams(cls, keys: np.ndarray, weights: np.ndarray) -> SpellingModels:
        """The same models from distinct packed n-grams and their counts in ordinary and toxic documents."""
        flat, at, reach = unpacked(keys)
        models = cls.__new__(cls)
        models._count(at, reach, RangeHash(flat), weights)
        return models

    def _count(self, at: np.ndarray, reach: np.ndarray, hashed: RangeHash, weights: np.ndarray) -> None:
        gram, context = hashed(at - reach, at + 1), hashed(at - reach, at)
        self.full = []
        for c in (0, 1):
            w = weights[:, c].astype(float)
            used = w > 0
            self.full.append(self._counted(gram[used], context[used], w[used]))
        self.low = []
        for n in range(ORDER - 1):  # contexts of n bytes: in how many longer n-grams a byte follows
            longer = np.flatnonzero(reach > n)
            _, one = np.unique(hashed(at[longer] - n - 1, at[longer] + 1), return_index=True)
            a = at[longer[one]]
            self.low.append(self._counted(hashed(a - n, a + 1), hashed(a - n, a), np.ones(len(a))))

    @staticmethod
    def _counted(gram: np.ndarray, context: np.ndarray, weight: np.ndarray) -> tuple[Table, Table]:
        """Counts of n-grams; of contexts, their sums and how many n-grams have 1, 2, and 3 or more."""
        _, one, which = np.unique(gram, return_index=True, return_inverse=True)
        count, context = np.bincount(which, weight, len(one)), context[one]
        kinds = [(count < 2), (count >= 2) & (count < 3), (count >= 3)]
        return Table(gram[one], count), Table(context, np.stack([count, *kinds], 1).astype(float))

    @staticmethod
    def _mixed(count, context, lower, discounts):
        """Discounted share of the context, and what the discounts freed dealt by the lower order."""
        total = context[:, 0]
        known = total > 0
        safe = np.where(known, total, 1)
        less = np.where(count >= 3, discounts[2], np.where(count >= 2, discounts[1], discounts[0]))
        freed = context[:, 1:] @ np.array(discounts)
        return np.where(known, np.maximum(count - less, 0) / safe + freed / safe * lower, lower)

    def evidence(self, flat: np.ndarray, begin: np.ndarray, block: int = 20_000) -> np.ndarray:
        """A number per word; ``block`` words are in work at a time."""
        parts = [self._evidence(flat[begin[k] : begin[min(k + block, len(begin) - 1)]], begin[k : k + block + 1] - begin[k]) for k in range(0, len(begin) - 1, block)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _evidence(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        word, at, reach, hashed = grams(flat, begin)
        # what a byte adds depends on its n-gram alone
        _, one, which = np.unique(packed(flat, at, reach), return_index=True, return_inverse=True)
        at, reach = at[one], reach[one]
        p = np.full(len(at), 1 / 256)
        for n in range(ORDER - 1):
            live = np.flatnonzero(reach > n)
            a = at[live]
            count, context = self.low[n]
            p[live] = self._mixed(count(hashed(a - n, a + 1)), context(hashed(a - n, a)), p[live], SHARED_DISCOUNTS)
        gram, key = hashed(at - reach, at + 1), hashed(at - reach, at)
        both = [np.log(self._mixed(count(gram), context(key), p, CLASS_DISCOUNTS)) for count, context in self.full]
        return np.bincount(word, (both[1] - both[0])[which], len(begin) - 1)


def document_evidence(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row: mean, best window means and strongest words of its words' evidence."""
    n = len(bounds) - 1
    out = np.zeros((n, len(WINDOWS) + 4))
    sums = np.r_[0, np.cumsum(value)]
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    edge = bounds[full]
    out[full, 0] = (sums[bounds[full + 1]] - sums[edge]) / size[full]
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(value))
    for j, w in enumerate(WINDOWS):
        stop = np.minimum(at + w, bounds[row + 1])
        mean = (sums[stop] - sums[at]) / w
        out[full, 1 + j] = np.maximum.reduceat(mean, edge)
    by = np.lexsort((-value, row))
    for j, k in enumerate((1, 2, 4)):
        top = np.minimum(edge + k, bounds[full + 1])
        ranked = np.r_[0, np.cumsum(value[by])]
        out[full, 1 + len(WINDOWS) + j] = np.maximum((ranked[top] - ranked[edge]) / k, -5)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    hold = np.eye(x.shape[1]) * ridge
    hold[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, x.T @ (weight * (y - p)) - hold @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def text_evidence(models: SpellingModels, texts: pa.Array) -> np.ndarray:
    """``document_evidence`` of whole texts."""
    data, starts, ends, bounds = words_of(texts)
    if not len(starts):
        return document_evidence(np.zeros(0), bounds)
    _, example, which = np.unique(byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return document_evidence(models.evidence(*marked(data, starts[example], ends[example]))[which], bounds)


def models_without(keys: np.ndarray, counts: np.ndarray, fold: int | None = None) -> SpellingModels:
    """Models of all counts (by n-gram, class and fold) but those of a fold."""
    weights = counts.sum(2) - (0 if fold is None else counts[:, :, fold])
    seen = weights.sum(1) > 0
    models = SpellingModels.of_grams(keys[seen], weights[seen])
    give_back()
    return models


class ToxicityModel:
    def __init__(self, texts: pa.Array, toxic: np.ndarray, folds: int = 3):
        """The logistic part learns from evidence of models that have not seen the row (``folds`` parts)."""
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.models = None
        if not 0 < toxic.sum() < len(toxic):
            return
        fold = np.arange(len(toxic)) % folds
        keys, counts = gram_counts(texts, toxic * folds + fold, 2 * folds)
        counts = counts.reshape(-1, 2, folds)
        x = np.zeros((len(toxic), len(WINDOWS) + 4))
        for f in range(folds):
            x[fold == f] = text_evidence(models_without(keys, counts, f), texts.filter(pa.array(fold == f)))
        self._weigh(x, toxic)
        self.models = models_without(keys, counts)

    @classmethod
    def of_counts(cls, share: float, keys: np.ndarray, counts: np.ndarray, x: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
        """From counts by n-gram, class and fold, and a sample's evidence by models without its fold."""
        model = cls.__new__(cls)
        model.share, model.models = share, None
        if 0 < share < 1:
            model._weigh(x, toxic)
            model.models = models_without(keys, counts)
        return model

    def _weigh(self, x: np.ndarray, toxic: np.ndarray) -> None:
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-9
        # as if there were eight ordinary documents for a toxic one, if the sample has fewer
        weight = np.where(toxic == 1, 1.0, np.clip(8 * toxic.sum() / (toxic == 0).sum(), 1, 8))
        self.beta = fit_logistic((x - self.shift) / self.scale, toxic.astype(float), weight)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.share)
        x = (text_evidence(self.models, texts) - self.shift) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30)))


def labelled_counts(labelled: DataFrame, text: str, label: str, folds: int, chunk_bytes: int = 800_000, most_keys: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``gram_counts`` of all rows by class and ``_fold``; a task keeps ``most_keys`` sums before it hands them on."""
    names = [f"n{k}" for k in range(2 * folds)]
    schema = pa.schema([("gram", pa.int64()), *((n, pa.int64()) for n in names)])

    def work(batches):
        held = np.zeros(0, np.int64), np.zeros((0, 2 * folds), np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held[0]), *(pa.array(held[1][:, k]) for k in range(2 * folds))], schema=schema)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * folds + batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in row_chunks(flat_bytes(batch.column(0))[1], chunk_bytes):
                new = gram_counts(batch.column(0)[a:b], kind[a:b], 2 * folds)
                held = summed(np.r_[held[0], new[0]], np.r_[held[1], new[1]])
                if len(held[0]) > most_keys:
                    yield give()
                    held = held[0][:0], held[1][:0]
        yield give()

    parts = in_arrow(labelled.select(text, label, "_fold"), work, ", ".join(f"{n} long" for n in schema.names))
    found = parts.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    keys = found.column("gram").to_numpy()
    by = np.argsort(keys)
    return keys[by], np.stack([found.column(n).to_numpy() for n in names], 1)[by].reshape(-1, 2, folds)


def sample_evidence(labelled: DataFrame, models: list[SpellingModels], key: str, text: str, label: str, chunk_bytes: int = 800_000) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each row by the models without its fold, and its class; worked out where the rows are, in order of the key's hash."""
    shared, wide = labelled.sparkSession.sparkContext.broadcast(models), len(WINDOWS) + 4

    def work(batches):
        for batch in batches:
            fold = batch.column(3).to_numpy(zero_copy_only=False)
            for a, b in row_chunks(flat_bytes(batch.column(1))[1], chunk_bytes):
                x = np.zeros((b - a, wide))
                for f in np.unique(fold[a:b]):
                    own = fold[a:b] == f
                    x[own] = text_evidence(shared.value[f], batch.column(1)[a:b].filter(pa.array(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], *(pa.array(x[:, j]) for j in range(wide))], ["_key", "_class", *(f"x{j}" for j in range(wide))])

    rows = in_arrow(labelled.select(F.xxhash64(key).alias("_key"), text, label, "_fold"), work, "_key long, _class int, " + ", ".join(f"x{j} double" for j in range(wide))).toArrow()
    shared.destroy()
    x, toxic = np.stack([rows.column(f"x{j}").to_numpy() for j in range(wide)], 1), rows.column("_class").to_numpy().astype(int)
    by = np.lexsort((*x.T, toxic, rows.column("_key").to_numpy()))
    return x[by], toxic[by]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 2_500, folds: int = 3) -> ToxicityModel:
    """``labels`` are only the rows to learn from.  All of them are counted; the logistic weights take ``most_rows`` of each class."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label)).distinct()
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("_fold")
    with_texts = lambda rows: docs.select(key, text).join(rows, key).select(key, text, label, fold)
    labelled = with_texts(small(known, 500_000))
    n = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if not 0 < share < 1:
        return ToxicityModel.of_counts(share, *[None] * 4)
    keys, counts = labelled_counts(labelled, text, label, folds)
    # drawn among labels that have a document, so that both classes are met
    drawn = [labelled.where(F.col(label) == c).select(key, label).distinct().orderBy(F.xxhash64(key), key).limit(most_rows) for c in (0, 1)]
    sample = with_texts(F.broadcast(drawn[0].unionByName(drawn[1])))
    x, toxic = sample_evidence(sample, [models_without(keys, counts, f) for f in range(folds)], key, text, label)
    model = ToxicityModel.of_counts(share, keys, counts, x, toxic)
    del keys, counts, x, toxic
    give_back()  # what the fit took of the driver's memory
    return model


def with_scores(df: DataFrame, model: ToxicityModel, text: str = "text", chunk_bytes: int = 800_000) -> DataFrame:
    """All columns and ``score``, row by row without a shuffle; the columns must not hold a ``score``."""
    from pyspark.sql import types as T

    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches):
        for batch in batches:
            sizes = flat_bytes(batch.column(place))[1]
            for a, b in row_chunks(sizes, chunk_bytes):
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(shared.value.scores(batch.column(place)[a:b]))], schema.names)

    return in_arrow(df, work, schema)


def score(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row."""
    return with_scores(df.select(key, text), model, text).select(key, "score")
