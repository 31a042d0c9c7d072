"""Benchmark items in documents, by latent semantic and word retrieval and a check of what was retrieved.

1. All documents are cut into passages of 32 words; over all of them, document frequencies of hashed
   terms are counted. The different passages are kept once each, as terms, for the next step.
2. Items go in groups of at most ``GROUP``, each with a latent space of its own, so that the axes grow
   with the items: a randomised SVD of the TF-IDF rows of all different passages and of the group's items,
   which together weigh as much. The products with this matrix run as Spark jobs.
3. Every document is cut into overlapping windows fitting the length of an item; windows and items
   with a cosine of ``cosine`` in the latent space are candidates. All windows of all texts count.
4. What few items the cosine misses is found with ``exact``: windows that hold enough of an item's
   rarest words (``Anchors``), or its answer, are candidates at any cosine. No window in which the item
   holds lacks both, so nothing is lost. ``latent`` in the result marks what the cosine found.
5. A candidate holds if the longest common subsequence of words covers enough of the item, or less
   of it and the item's answer (its last sentence, unless given) word for word.

Words are runs of letters and digits, A-Z in lower case. Items of fewer than ``SHORT`` words have no
latent vector to speak of; they are found by their hash, word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .tally import summed
from .words import SIGNS, mix, words

TERM_BITS = 15
PASSAGE = 32
PACKED, LEAST_PACKS = 1 << 15, 32
RANK, OVERSAMPLE, ROUNDS = 128, 10, 2
GROUP, GROUPS = 256, 4
SHORT, BLOCK = 12, 8
RARE, ANCHORED = 4, 2048
ITEM_BYTES = 32 << 20
_COMMON = 0.05
_ROWS = 4096
_RUN, _RUNS = 32, 1024
HITS = "doc_id bigint, item_id bigint, cosine double, share double, answered boolean, at_word bigint, latent boolean"


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _passages(bounds: np.ndarray) -> np.ndarray:
    """For each word of some rows, the number of its passage."""
    sizes = np.diff(bounds)
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    first = np.concatenate([[0], np.cumsum(-(-sizes // PASSAGE))[:-1]])
    return np.repeat(first, sizes) + inside // PASSAGE


def _passage_rows(docs: DataFrame, text: str) -> DataFrame:
    """The different passages of all texts, ``PACKED`` a row: their ``terms`` in order, how many each has, its ``copies``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), gaps=SIGNS):
                if len(w.hashes):
                    passage = _passages(w.bounds)
                    pairs = np.sort(passage << TERM_BITS | _terms(w.hashes))
                    terms = (pairs & ((1 << TERM_BITS) - 1)).astype(np.uint16)
                    bounds = np.append(0, np.cumsum(np.bincount(passage)) * terms.itemsize)
                    made = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(terms)])
                    yield pa.RecordBatch.from_arrays([made.cast(pa.binary())], ["terms"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        terms, sizes = [], []
        for batch in held:
            column = batch.column(0).cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            terms.append(np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if len(column) else np.zeros(0, np.uint8))
            sizes.append(np.diff(bounds).astype(np.int32) // 2)
        made = [np.concatenate(terms), np.concatenate(sizes), np.concatenate([np.asarray(batch.column(1)) for batch in held])]
        return pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], ["terms", "sizes", "copies"])

    made = docs.select(text).mapInArrow(cut, "terms binary").groupBy("terms").agg(F.count(F.lit(1)).alias("copies"))
    return made.mapInArrow(pack, "terms binary, sizes binary, copies binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bytes | float]]:
    """Of each row the terms, how many each passage has, and the third column."""
    for terms, sizes, other in zip(*(batch.column(k).to_pylist() for k in range(3))):
        yield np.frombuffer(terms, np.uint16), np.frombuffer(sizes, np.int32), other


def _tallied(terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, occurrences) of passages whose terms are in order."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (row[1:] != row[:-1]))[:len(terms)])
    return row[first], terms[first], np.diff(np.append(first, len(terms)))


def weights(passages: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Inverse document frequencies of terms over all passages; terms of every twentieth passage weigh nothing.

    And the same frequencies with these terms left in, and the number of different passages.
    """
    size = 1 << TERM_BITS

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for terms, sizes, copies in _unpacked(batch):
            copies = np.frombuffer(copies, np.int64)
            row, term, _ = _tallied(terms, sizes)
            yield np.append(np.bincount(term, copies[row], size).astype(np.int64), [copies.sum(), len(copies)])

    found = summed(passages.select("terms", "sizes", "copies"), count, size + 2)
    found, different = found[:-1], int(found[-1])
    rarity = np.log((found[-1] + 1) / (found[:-1] + 1))
    out = np.where(found[:-1] > _COMMON * found[-1], 0, rarity)
    return out if out.any() else np.ones(size), rarity, different


def _added(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` numbers in ``rows``, the sum of these rows of a table.

    Numpy adds whole rows fast only many at a time: all first rows of some runs, then all second ones, longest runs first.
    """
    if len(sizes) and sizes.max() > _RUN:
        pieces = -(-sizes // _RUN)
        most = np.full(pieces.sum(), _RUN)
        most[np.cumsum(pieces)[pieces > 0] - 1] = (sizes - (pieces - 1) * _RUN)[pieces > 0]
        made = _added(table, rows, most)
        return _added(made, np.arange(len(made)), pieces)
    starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    taken = np.empty((_RUNS, table.shape[1]), table.dtype)
    for low in range(0, np.count_nonzero(sizes), _RUNS):
        mine = order[low:low + _RUNS]
        mine = mine[sizes[mine] > 0]
        at, left = starts[mine], np.cumsum(np.bincount(sizes[mine])[::-1])[::-1]
        made = table[rows[at]]
        for k, n in enumerate(left[2:].tolist(), 1):
            np.take(table, rows[at[:n] + k], axis=0, out=taken[:n], mode="clip")
            made[:n] += taken[:n]
        out[mine] = made
    return out


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, in place, some rows at a time: the driver holds no further copies of them."""
    parts = range(0, len(a), _ROWS)
    tops = []
    for low in parts:
        q, top = np.linalg.qr(a[low:low + _ROWS].astype(np.float64))
        a[low:low + _ROWS] = q
        tops.append(top)
    turn = np.linalg.qr(np.concatenate(tops))[0]
    at = 0
    for low, top in zip(parts, tops):
        a[low:low + _ROWS] = a[low:low + _ROWS].astype(np.float64) @ turn[at:at + len(top)]
        at += len(top)
    return a


def latent_axes(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of weighted TF-IDF rows, by subspace iteration with all of them.

    ``rows`` has packed rows: ``terms`` in order, ``sizes`` and a ``weight``.
    """
    size, width = 1 << TERM_BITS, rank + OVERSAMPLE
    spark, scale = rows.sparkSession, idf.astype(np.float32)[:, None]
    shared_idf = spark.sparkContext.broadcast(idf)

    def product(q: np.ndarray) -> np.ndarray:
        """A'A q, with A the unit rows times their weights."""
        shared = spark.sparkContext.broadcast(q * scale)

        def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for terms, sizes, weight in _unpacked(batch):
                some = shared_idf.value[terms] > 0
                row, terms = np.repeat(np.arange(len(sizes)), sizes)[some], terms[some]
                sizes = np.bincount(row, minlength=len(sizes))
                at, term, n = _tallied(terms, sizes)
                norm = np.bincount(at, (n * shared_idf.value[term])**2, len(sizes))
                made = _added(shared.value, terms, sizes)
                made *= (weight**2 / np.maximum(norm, 1e-24)).astype(np.float32)[:, None]
                yield _added(made, row[np.argsort(terms, kind="stable")], np.bincount(terms, minlength=size)).reshape(-1)

        made = summed(rows, each, size * width, np.float32).reshape(size, width)
        shared.destroy()
        made *= scale
        return made

    made, draw = np.empty((size, width), np.float32), np.random.default_rng(6)
    for low in range(0, size, _ROWS):
        made[low:low + _ROWS] = draw.standard_normal((len(made[low:low + _ROWS]), width))
    for _ in range(ROUNDS):
        q = _orthonormal(made)
        made = product(q)
    shared_idf.destroy()
    both, small = (sum(x[low:low + _ROWS].astype(np.float64).T @ made[low:low + _ROWS] for low in range(0, size, _ROWS)) for x in (made, q))
    return made @ _leading(both, small, rank).astype(np.float32)


def _leading(both: np.ndarray, small: np.ndarray, rank: int) -> np.ndarray:
    """What turns y = A'A q into the leading eigenvectors of y (q'y)^-1 y', by y'y and q'y; as zeros where A has fewer.

    This stands for A'A in the space of y (Nyström), so the choice of axes in it needs no further product.
    """
    def parts(a: np.ndarray, least: float) -> np.ndarray:
        value, turned = np.linalg.eigh((a + a.T) / 2)
        some = value > least * value[-1]
        return turned[:, some] / np.sqrt(value[some])

    basis = parts(both, 1e-10)
    half = basis.T @ both @ parts(small, 1e-6)
    found = basis @ np.linalg.eigh(half @ half.T)[1][:, ::-1][:, :rank]
    return np.pad(found, ((0, 0), (0, rank - found.shape[1])))


@dataclass
class Item:
    id: int | None
    words: np.ndarray
    answer: np.ndarray


def _hashed(text: str | None) -> np.ndarray:
    return np.concatenate([w.hashes for w in words(pa.array([text or ""]), gaps=SIGNS)])


def read_items(rows: list) -> list[Item]:
    """Items with words; the answer is the given one, else the last sentence, if it has three words at least."""
    out = []
    for r in rows:
        own = _hashed(r.text)
        sentences = [s for s in re.split(r"[.!?\n]+", r.text or "") if s.strip()]
        answer = _hashed(r.answer) if r.answer else _hashed(sentences[-1] if len(sentences) > 1 else "")
        if len(own):
            out.append(Item(r.id, own, answer if len(answer) >= 3 else answer[:0]))
    return out


def common_subsequence(item: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; item: the places of each word as bits."""
    full = (1 << size) - 1
    row = full
    for word in text:
        if word in item:
            both = row & item[word]
            row = (row + both | row - both) & full
    return size - row.bit_count()


def _holds(text: np.ndarray, run: np.ndarray) -> bool:
    if not len(run) or len(run) > len(text):
        return False
    at = np.flatnonzero(text[:len(text) - len(run) + 1] == run[0])
    return any((text[a:a + len(run)] == run).all() for a in at)


def _run_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if len(out) else 0):
            out = mix(out + hashes[k:len(hashes) - size + 1 + k] * np.uint64(2 * k + 3))
    return out


def _index(words_of: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words in order, where the numbers of each begin, and the numbers."""
    word = np.concatenate([w for _, w in words_of])
    number = np.repeat([k for k, _ in words_of], [len(w) for _, w in words_of])
    order = np.argsort(word, kind="stable")
    word, begin = np.unique(word[order], return_index=True)
    return word, np.append(begin, len(order)), number[order]


@dataclass
class Anchors:
    """Windows that can hold some items, by exact words.

    A common subsequence of ``n - d`` of an item's ``n`` words leaves out ``d``, so of its ``d + m`` rarest
    words ``m`` are in the window. If less than that is common, the answer is there word for word.
    """

    rare: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    answers: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    least: np.ndarray
    step: np.ndarray
    head: np.ndarray
    offset: np.ndarray

    @classmethod
    def build(cls, items: list[Item], windows: dict[int, int], rarity: np.ndarray, share: float) -> Anchors:
        least, step, offset = (np.zeros(len(items), np.int64) for _ in range(3))
        head, rare, answers = np.zeros((len(items), 3), np.uint64), [], []
        for k, window in windows.items():
            own, answer = items[k].words, items[k].answer
            step[k] = window // 4
            needed = next((c for c in range(1, len(own) + 1) if c / len(own) >= share), None)
            if needed is not None:
                least[k] = min(RARE, needed)
                rarest = np.argsort(-rarity[_terms(own)], kind="stable")[:len(own) - needed + least[k]]
                rare.append((k, np.unique(own[rarest])))
            if len(answer):
                offset[k] = np.argmax(rarity[_terms(answer)])
                head[k] = answer[:3]
                answers.append((k, answer[offset[k]:offset[k] + 1]))
        return cls(_index(rare) if rare else None, _index(answers) if answers else None, least, step, head, offset)

    @staticmethod
    def _found(hashes: np.ndarray, index: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the words of an index."""
        if index is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, begin, number = index
        table = np.zeros(1 << 20, bool)
        table[word >> np.uint64(44)] = True
        at = np.flatnonzero(table[hashes >> np.uint64(44)])
        slot = np.minimum(np.searchsorted(word, hashes[at]), len(word) - 1)
        same = word[slot] == hashes[at]
        at, slot = at[same], slot[same]
        size = begin[slot + 1] - begin[slot]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(at, size), number[np.repeat(begin[slot], size) + inside]

    def windows(self, w) -> np.ndarray:
        """Rows of (item, row, number of the window in the row), each once."""
        place, item = self._found(w.hashes, self.rare)
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        row = np.searchsorted(w.bounds, place, "right") - 1
        last = np.arange(len(place)) + self.least[item] - 1
        ends = np.minimum(last, len(place) - 1)
        full = (last < len(place)) & (item[ends] == item) & (row[ends] == row) & (place[ends] - place < 6 * self.step[item])
        inside = np.zeros(len(place) + 1, np.int64)
        np.add.at(inside, np.flatnonzero(full), 1)
        np.add.at(inside, last[full] + 1, -1)
        near = np.cumsum(inside[:-1]) > 0
        found, n = np.unique(self._around(item[near], row[near], place[near], w), axis=0, return_counts=True)
        found = found[n >= self.least[found[:, 0]]]

        place, item = self._found(w.hashes, self.answers)
        first = place - self.offset[item]
        fits = (first >= 0) & (first + 3 <= len(w.hashes))
        place, item, first = place[fits], item[fits], first[fits]
        same = (w.hashes[first[:, None] + np.arange(3)] == self.head[item]).all(axis=1)
        place, item = place[same], item[same]
        row = np.searchsorted(w.bounds, place, "right") - 1
        return np.unique(np.concatenate([found, self._around(item, row, place, w)]), axis=0)

    def _around(self, item: np.ndarray, row: np.ndarray, place: np.ndarray, w) -> np.ndarray:
        """The windows whose text, a quarter more on both sides, has a place."""
        own = (place - w.bounds[row]) // self.step[item]
        made = np.stack([np.repeat(item, 6), np.repeat(row, 6), (own[:, None] + np.arange(-4, 2)).reshape(-1)], axis=1)
        return made[made[:, 2] >= 0]


@dataclass
class Searcher:
    """All that a task needs for a group of items: term vectors and one of zeros, latent item vectors by window length, the items' words."""

    vectors: np.ndarray
    items: list[Item]
    by_window: dict[int, tuple[list[int], np.ndarray]]
    anchors: list[Anchors]
    short: dict[int, dict[int, int]]
    cosine: float
    share: float
    answered: float

    @classmethod
    def build(cls, items: list[Item], axes: np.ndarray, idf: np.ndarray, rarity: np.ndarray, cosine: float, share: float,
              answered: float, exact: bool = True) -> Searcher:
        vectors = np.zeros((len(axes) + 1, axes.shape[1]), np.float32)  # the last row is that of no term
        np.multiply(axes, idf[:, None], out=vectors[:-1], casting="same_kind")
        by_window: dict[int, list[int]] = {}
        short: dict[int, dict[int, int]] = {}
        for k, item in enumerate(items):
            if len(item.words) < SHORT:
                short.setdefault(len(item.words), {}).setdefault(int(_run_hash(item.words, len(item.words))[0]), []).append(k)
            else:
                window = 32
                while len(item.words) > window * 3 // 4:
                    window *= 2
                by_window.setdefault(window, []).append(k)
        made = {}
        for window, chosen in sorted(by_window.items()):
            at = np.stack([vectors[_terms(items[k].words)].sum(axis=0) for k in chosen])
            made[window] = chosen, at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
        window_of = sorted((k, window) for window, chosen in by_window.items() for k in chosen)
        anchors = [Anchors.build(items, dict(window_of[low:low + ANCHORED]), rarity, share) for low in range(0, len(window_of) * exact, ANCHORED)]
        return cls(vectors, items, made, anchors, short, cosine, share, answered)

    def prepare(self) -> None:
        self.places = []
        for item in self.items:
            places: dict[int, int] = {}
            for k, word in enumerate(item.words.tolist()):
                places[word] = places.get(word, 0) | 1 << k
            self.places.append(places)

    def candidates(self, w) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, cosine, first and last word of the window in the row) of some rows' words."""
        sizes = np.diff(w.bounds)
        blocks = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        inside = np.arange(w.bounds[-1]) - np.repeat(w.bounds[:-1], sizes)
        place = np.repeat(first[:-1], sizes) * BLOCK + inside
        term = np.full((first[-1], BLOCK), len(self.vectors) - 1)  # a block that is not full ends in rows of zeros
        term.reshape(-1)[place] = _terms(w.hashes)
        total = np.zeros((first[-1] + 1, self.vectors.shape[1]))
        for low in range(0, len(term), 1024):
            here = term[low:low + 1024]
            made = self.vectors[here[:, 0]]
            for k in range(1, BLOCK):
                made += self.vectors[here[:, k]]
            total[low + 1:low + 1 + len(here)] = made
        np.cumsum(total, axis=0, out=total)
        row_of = np.repeat(np.arange(len(sizes)), blocks)
        at = np.arange(first[-1])
        exact = np.concatenate([np.zeros((0, 3), np.int64), *(a.windows(w) for a in self.anchors)])
        for window, (chosen, latent) in self.by_window.items():
            wide, step = window // BLOCK, window // BLOCK // 4
            own = at - first[row_of]
            begin = at[(own % step == 0) & ((own == 0) | (own + wide - step < blocks[row_of]))]
            end = np.minimum(begin + wide, first[row_of[begin] + 1])
            mine = exact[np.isin(exact[:, 0], chosen)]
            wanted = first[mine[:, 1]] + mine[:, 2] * step
            slot = np.searchsorted(begin, wanted)
            real = (wanted < first[mine[:, 1] + 1]) & (begin[np.minimum(slot, len(begin) - 1)] == wanted)
            slot, column = slot[real], np.searchsorted(chosen, mine[real, 0])
            for low in range(0, len(begin), 8192):
                b, e = begin[low:low + 8192], end[low:low + 8192]
                made = (total[e] - total[b]).astype(np.float32)
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                near = made @ latent.T
                picked = near >= self.cosine
                here = (slot >= low) & (slot < low + 8192)
                picked[slot[here] - low, column[here]] = True
                for i, k in zip(*np.nonzero(picked)):
                    row = int(row_of[b[i]])
                    start = int(b[i] - first[row]) * BLOCK
                    yield w.first + row, chosen[k], float(near[i, k]), max(0, start - window // 4), start + window + window // 4

    def search(self, w) -> dict[tuple[int, int], tuple[float, float, bool, int, bool]]:
        """For (row, item) that hold: cosine, share, answered and the first word looked at, of the best window; whether the cosine found any."""
        best: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
        near: set[tuple[int, int]] = set()
        for row, k, cosine, start, end in self.candidates(w):
            item, text = self.items[k], w.of(row)[start:end]
            share = common_subsequence(self.places[k], len(item.words), text.tolist()) / len(item.words)
            answered = share >= self.answered and _holds(text, item.answer)
            if share >= self.share or answered:
                found = (cosine, share, answered, start)
                if cosine >= self.cosine:
                    near.add((row, k))
                if (row, k) not in best or (share, cosine, -start) > (best[row, k][1], best[row, k][0], -best[row, k][3]):
                    best[row, k] = found
        for size, hashes in self.short.items():
            wanted = np.array(sorted(hashes), np.uint64)
            runs = _run_hash(w.hashes, size)
            for at in np.flatnonzero(np.isin(runs, wanted)).tolist():
                row = int(np.searchsorted(w.bounds, at, "right")) - 1
                if at + size <= w.bounds[row + 1]:
                    for k in hashes[int(runs[at])]:
                        best.setdefault((w.first + row, k), (1.0, 1.0, False, at - int(w.bounds[row])))
        return {pair: (*hit, pair in near) for pair, hit in best.items()}


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", answer: Column | None = None, cosine: float = 0.75, share: float = 0.8,
               answered: float = 0.6, exact: bool = True) -> DataFrame:
    """The items that documents hold: one row per document row and item, see ``HITS``.

    Holding means a common subsequence of at least ``share`` of the item's words, or of ``answered``
    of them together with the answer word for word, inside a window of the item's size. Items without
    words are held by nothing; null texts hold nothing. Without ``exact`` only the latent search finds
    items of ``SHORT`` words or more. Items beyond ``ITEM_BYTES`` or ``GROUPS`` groups are searched for
    in several passes, so that what is broadcast is bounded.
    """
    found = [docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(_finder(shared), HITS)
             for shared in _searchers(docs, items, text, item_key, item_text, answer, cosine, share, answered, exact)]
    out = docs.sparkSession.createDataFrame([], HITS)
    for f in found:
        out = out.unionByName(f)
    return out


def without_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", answer: Column | None = None, cosine: float = 0.75, share: float = 0.8,
                  answered: float = 0.6, exact: bool = True) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``find_items``."""
    place = docs.columns.index(text)
    for shared in _searchers(docs, items, text, item_key, item_text, answer, cosine, share, answered, exact):
        docs = docs.mapInArrow(_cleaner(shared, place), docs.schema)
    return docs


def _searchers(docs, items, text, item_key, item_text, answer, cosine, share, answered, exact) -> list:
    """For each pass over the items, broadcast searchers of its groups."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("text"),
                          (F.lit(None).cast("string") if answer is None else answer).alias("answer")).where("text IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.octet_length("text") + 64).alias("volume"), F.count(F.lit(1)).alias("items")).first()
    passes = max(1, -(-(size.volume or 0) // ITEM_BYTES), -(-size.items // (GROUP * GROUPS)))
    made = []
    with Scratch(spark) as s:
        passages = s.keep(_passage_rows(docs, text), "passages")
        idf, rarity, different = weights(passages)
        # Every task of a product sends an array as large as the axes, so a task has many packs once there are more than cores.
        tasks = max(spark.sparkContext.defaultParallelism, different // (PACKED * LEAST_PACKS))
        passages = passages.select("terms", "sizes", F.lit(1.0).alias("weight"))

        def searcher(chosen: list[Item]) -> Searcher:
            weight = float(np.sqrt(max(1, different) / len(chosen)))
            terms, sizes = [np.sort(_terms(i.words)).astype(np.uint16) for i in chosen], np.array([len(i.words) for i in chosen], np.int32)
            own = pa.table({"terms": pa.array([np.concatenate(terms).tobytes()]), "sizes": pa.array([sizes.tobytes()]), "weight": pa.array([weight])})
            axes = latent_axes(passages.unionByName(spark.createDataFrame(own)).coalesce(tasks), idf)
            return Searcher.build(chosen, axes, idf, rarity, cosine, share, answered, exact)

        for k in range(passes):
            mine = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).orderBy("id", "text").collect()
            chosen = read_items(mine)
            groups = -(-len(chosen) // GROUP)
            with ThreadPoolExecutor(GROUPS) as pool:
                searchers = list(pool.map(searcher, [chosen[g::groups] for g in range(groups)]))
            if searchers:
                made.append(spark.sparkContext.broadcast(searchers))
    return made


def _prepared(shared) -> list[Searcher]:
    for searcher in shared.value:
        searcher.prepare()
    return shared.value


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = _prepared(shared)
        for batch in batches:
            rows = []
            ids = batch.column(0)
            for w in words(batch.column(1), gaps=SIGNS):
                for searcher in searchers:
                    for (row, k), hit in sorted(searcher.search(w).items()):
                        rows.append((ids[row].as_py(), searcher.items[k].id, *hit))
            if rows:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 ["doc_id", "item_id", "cosine", "share", "answered", "at_word", "latent"])

    return find


def _cleaner(shared, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = _prepared(shared)
        for batch in batches:
            free = np.ones(batch.num_rows, bool)
            for w in words(batch.column(place), gaps=SIGNS):
                for searcher in searchers:
                    free[[row for row, _ in searcher.search(w)]] = False
            yield batch.filter(pa.array(free))

    return clean
