"""A quality score for texts: a generalised additive model with pairwise interactions.

Shallow boosted trees are fitted feature by feature in turn, so each feature ends with one
additive lookup table over its bins, and some pairs of features with a table over a grid. A score
is the sum of table entries, added for whole batches of texts at once.

Features are shapes of the text: lengths, shares of kinds of bytes and words, repetition. They are
computed over the bytes of a batch, whole texts always. The model is fitted on at most ``TRAIN_ROWS``
labelled texts, picked by a hash of their id, so what meets in one place is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import plain, words

TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "upper", "digit", "sign", "blank", "high",
    "sign_words", "lone_sign_words", "upper_words", "short_words", "different_words", "top_word", "doubled_words",
    "sentence_ends", "capital_after_end", "different_lines",
)
_KINDS = np.zeros((256, 5), np.int64)  # upper, digit, sign, blank, high
_KINDS[65:91, 0] = _KINDS[48:58, 1] = _KINDS[128:, 4] = 1
_KINDS[[9, 10, 11, 12, 13, 32], 3] = 1
for _b in range(33, 127):
    if not chr(_b).isalnum() and chr(_b) not in ".,;:'\"?!-()":
        _KINDS[_b, 2] = 1


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; an empty or null text is all zeros."""
    data, offsets = plain(column)
    out = np.zeros((len(column), len(FEATURES)))
    for w in words(column):
        low, high = int(offsets[w.first]), int(offsets[w.last])
        d, rows, at = data[low:high], offsets[w.first:w.last + 1] - low, w.bounds
        size, n = np.diff(rows), np.diff(at)
        some, any_ = np.maximum(size, 1), np.maximum(n, 1)
        kinds = [_sums(_KINDS[:, k][d], rows) for k in range(5)]
        feeds = _sums(d == 10, rows) + 1
        starts, ends = w.starts - low, w.ends - low
        span = np.stack([starts, ends], axis=1).ravel()
        per_word = lambda flags: np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[span])[::2] if len(span) else span
        signs, upper = per_word(_KINDS[:, 2][d]), per_word(_KINDS[:, 0][d])
        length = ends - starts
        bang = per_word(d == 33)
        ended = np.isin(d[ends - 1], (33, 46, 63)) if len(ends) else np.zeros(0, bool)
        capital = _KINDS[:, 0][d[starts]].astype(bool) | (d[starts] >= 0xC3) if len(starts) else np.zeros(0, bool)
        after = np.append(False, ended[:-1]) & capital if len(ended) else ended
        same = np.append(False, w.hashes[1:] == w.hashes[:-1]) if len(w.hashes) else np.zeros(0, bool)
        for pair in (after, same):  # the first word of a text follows none
            pair[at[:-1][n > 0]] = False
        share = lambda flags: _sums(flags, at) / any_
        f = out[w.first:w.last]
        f[:, 0], f[:, 1], f[:, 2] = np.log1p(size), np.log1p(n), np.log(feeds)
        f[:, 3], f[:, 4] = (size - kinds[3]) / any_, n / feeds
        for k in range(5):
            f[:, 5 + k] = kinds[k] / some
        f[:, 10], f[:, 11] = share(signs > 0), share((signs == length) & (length < 3))
        f[:, 12], f[:, 13] = share((upper > 1) & (upper * 2 >= length)), share(length < 4)
        f[:, 16], f[:, 17], f[:, 18] = share(same), share(ended | (bang > 1)), share(after)
        for r in range(w.last - w.first):
            own = np.sort(w.hashes[at[r]:at[r + 1]])
            if len(own):
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                f[r, 14], f[r, 15] = (len(edge) - 1) / len(own), np.diff(edge).max() / len(own)
                text = d[rows[r]:rows[r + 1]].tobytes().split(b"\n")
                f[r, 19] = len(set(text)) / len(text)
        f[n == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bins, lookup tables of single features, and of pairs of features on coarser bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def coarse(bins: np.ndarray, size: int) -> np.ndarray:
        return bins * _COARSE // max(size, 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse(b[:, i], len(self.tables[i])), self.coarse(b[:, j], len(self.tables[j]))]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


_COARSE = 8


def _stump(gradient: np.ndarray, weight: np.ndarray, leaves: int, penalty: float, least: float) -> np.ndarray:
    """The values of a shallow tree over ordered bins, from per-bin sums."""
    def value(a: int, b: int) -> float:
        return g[a:b].sum() / (h[a:b].sum() + penalty)

    g, h = gradient, weight
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left_g, left_h = cg[:-1], ch[:-1]
            if not len(left_g):
                continue
            right_g, right_h = cg[-1] - left_g, ch[-1] - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - cg[-1]**2 / (ch[-1] + penalty)
            gain[(left_h < least) | (right_h < least)] = 0
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), (a, b), a + at + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.1,
        leaves: int = 3, penalty: float = 2.0, least: float = 0.5, bins: int = 64) -> AdditiveModel:
    """Cyclic boosting: each round adds one small tree to every feature's table, then to every pair's.

    Without labels of both kinds, the score is the smoothed share of label 1.
    """
    model = AdditiveModel()
    total = len(y)
    mean = (y.sum() + 1) / (total + 2)
    model.base = float(np.log(mean / (1 - mean)))
    for k in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if total else np.zeros(0))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    if not total or y.min() == y.max():
        return model
    b = model.bins(x)
    margin = np.full(total, model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * _stump(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), leaves, penalty, least)
            table += step
            margin += step[b[:, k]]
    coarse = np.stack([model.coarse(b[:, k], len(t)) for k, t in enumerate(model.tables)], axis=1)
    g, h = gradient()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = coarse[:, i] * _COARSE + coarse[:, j]
            sg, sh = np.bincount(cell, g, _COARSE**2), np.bincount(cell, h, _COARSE**2)
            gains.append((float((sg**2 / (sh + penalty)).sum()), i, j))
    chosen = sorted(gains, reverse=True)[:pairs]
    for _, i, j in chosen:
        model.pairs[i, j] = np.zeros((_COARSE, _COARSE))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = gradient()
            cell = coarse[:, i] * _COARSE + coarse[:, j]
            sg, sh = np.bincount(cell, g, _COARSE**2), np.bincount(cell, h, _COARSE**2)
            step = rate * sg / (sh + 2 * penalty)
            table += step.reshape(_COARSE, _COARSE)
            margin += step[cell]
    return model


def train_part(key: Column) -> Column:
    """Rows whose label may be learned: all but every fifth by the hash of the id."""
    return F.crc32(key.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled texts of the training part; null labels, ids and others than 0 and 1 are left out."""
    chosen = labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y"))
    chosen = chosen.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & train_part(F.col("k")))
    chosen = chosen.distinct().orderBy(F.xxhash64("k"), "k", "y").limit(rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, k]) for k in range(f.shape[1]))], ["y", *FEATURES])

    joined = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("y", "t")
    table = joined.mapInArrow(make, "y int, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()
    x = np.stack([np.asarray(table.column(c)) for c in FEATURES], axis=1) if table.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(table.column("y")).astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``score`` of every text; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = len(carry)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = shared.value.score(features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(f)], [*names, "score"])

    made = docs.select(*carry, F.col(text).alias("_text"))
    fields = made.schema.fields[:at]
    names = [f"c{k}" for k in range(at)]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)), "score double"])
    return made.mapInArrow(add, schema).toDF(*carry, "score")


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(features(batch.column(place))) >= least))

    return docs.mapInArrow(keep, docs.schema)
