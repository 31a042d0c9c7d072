"""Spelling variants of a vocabulary, found in FM-indexes by search schemes for one error.

Words one edit apart agree exactly in the left half of the first or in its right half, so two searches
per word find all its neighbours: match the left half from the left end and extend to the right with one
error, or match the right half from the right end and extend to the left with one error. Each index holds
a delimited part of the vocabulary in one reading direction (the pair of directions is the bidirectional
index); a search step maps an interval of suffix ranks to that of the pattern with one more letter.

Counting combines within tasks. The vocabulary is then dealt to shards of bounded size by the half that a
search must match, every word once per half it may be found by, and every shard is indexed and searched
by one task. A half that more words share than a shard holds is dealt into slices of words times blocks
of searches. Only the best neighbour and the number of neighbours leave a shard, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SHARD_WORDS = 1 << 15
_FLUSH = 1 << 19
_LONG = 1 << 22
_SEARCHES = 1 << 11


def _runs(text: str) -> Counter:
    if len(text) < _LONG:
        return Counter(LETTERS.findall(text))
    return Counter(m.group() for m in LETTERS.finditer(text))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", delete_every: int = 0, least: int = 5) -> DataFrame:
    """``(word, n)``: the runs of letters of all texts, A-Z in lower case, with their number of occurrences.

    With ``delete_every``, an occurrence loses a letter where that number divides h, the CRC-32 of
    ``<key>:<run>`` in UTF-8: the one at h modulo the length. A null key is written as nothing. Words of
    fewer than ``least`` code points are left out; null and empty texts have none.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for doc, t in zip(batch.column(0), texts):
                seed = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                for run, n in _runs(t.as_py().lower().decode()).items():
                    if delete_every and len(run) >= least:
                        h = zlib.crc32(run.encode(), seed)
                        if h % delete_every == 0:
                            run = run[:h % len(run)] + run[h % len(run) + 1:]
                    if len(run) >= least:
                        total[run] += n
                if len(total) >= _FLUSH:
                    yield packed(total)
                    total = Counter()
        yield packed(total)

    def packed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Suffix ranks of different words, each behind a delimiter, for reading the words from their first letter on.

    The words are laid out backwards, so that one more letter of a pattern is one step of backward search:
    the rank of a suffix with a letter before it is the place of (letter, rank) among all that occur.
    """

    def __init__(self, words: list[str]):
        order = sorted(range(len(words)), key=lambda i: words[i][::-1])
        self.words = np.array(order, np.int64)  # by rank of the whole word
        points = np.frombuffer("".join("\0" + words[i][::-1] for i in order).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(points, return_inverse=True)
        self.size = len(codes)
        bits = max(1, int(len(self.letters) - 1).bit_length())
        known = 60 // bits  # letters that one number holds
        rank = np.zeros(self.size, np.int64)
        for k in range(known):
            rank = (rank << bits) | np.roll(codes, -k)
        while True:
            suffixes = np.argsort(rank, kind="stable")
            found = rank[suffixes]
            rank = np.empty(self.size, np.int64)
            rank[suffixes] = np.cumsum(np.append(0, found[1:] != found[:-1]))
            if rank[suffixes[-1]] == self.size - 1:
                break
            rank = rank * self.size + np.roll(rank, -known)
            known *= 2
        self.before = codes[suffixes - 1]
        places = np.argsort(self.before, kind="stable")
        self.steps = self.before[places] * self.size + places

    def code(self, points: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.letters, points)

    def step(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, letter * self.size + rank)

    def next_letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every interval, the different letters that may come next: interval numbers and letters."""
        many = high - low > len(self.letters)
        wide = np.flatnonzero(many)
        row, letter = np.repeat(wide, len(self.letters) - 1), np.tile(np.arange(1, len(self.letters)), len(wide))
        some = np.flatnonzero(~many)
        count = (high - low)[some]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        seen = np.unique(np.repeat(some, count) * len(self.letters) + self.before[np.repeat(low[some], count) + inside])
        seen = seen[seen % len(self.letters) > 0]
        return np.append(row, seen // len(self.letters)), np.append(letter, seen % len(self.letters))

    def one_error(self, searches: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words one edit away from a search whose first ``exact`` letters they begin with, as numbers (search, word).

        No pair comes twice: of equal neighbouring letters only the last is deleted, and none is inserted before its like.
        """
        size = np.array([len(s) for s in searches], np.int64)
        start = np.cumsum(size) - size
        flat = self.code(np.frombuffer("".join(searches).encode("utf-32-le"), np.uint32))
        at = np.arange(len(searches))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.words))
        queue: list[tuple[np.ndarray, ...]] = []
        j = 0
        while len(at):
            ready = exact[at] <= j
            q, a, b = at[ready], low[ready], high[ready]
            if len(q):
                inner = j < size[q]
                own = np.where(inner, flat[np.minimum(start[q] + j, len(flat) - 1)], -1)
                after = np.where(j + 1 < size[q], flat[np.minimum(start[q] + j + 1, len(flat) - 1)], -1)
                less = inner & (own != after)
                queue.append((q[less], np.full(less.sum(), j + 1), a[less], b[less]))
                row, letter = self.next_letters(a, b)
                differs = letter != own[row]
                row, letter = row[differs], letter[differs]
                a, b = self.step(letter, a[row]), self.step(letter, b[row])
                there = b > a
                row, a, b = row[there], a[there], b[there]
                queue.append((q[row], np.full(len(row), j), a, b))
                swap = inner[row]
                queue.append((q[row[swap]], np.full(swap.sum(), j + 1), a[swap], b[swap]))
            on = j < size[at]
            at, low, high = at[on], low[on], high[on]
            letter = flat[start[at] + j]
            low, high = self.step(letter, low), self.step(letter, high)
            there = high > low
            at, low, high = at[there], low[there], high[there]
            j += 1
        return self._ended(queue, flat, start, size)

    def _ended(self, queue: list, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow what is left of each search without further errors to the end of a word."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        q, place, low, high = (np.concatenate(x) for x in zip(*queue)) if queue else [np.zeros(0, np.int64)] * 4
        while len(q):
            done = place == size[q]
            whole = self.step(np.zeros(done.sum(), np.int64), low[done])
            hit = self.step(np.zeros(done.sum(), np.int64), high[done]) > whole
            found.append((q[done][hit], self.words[whole[hit]]))
            q, place, low, high = (x[~done] for x in (q, place, low, high))
            letter = flat[start[q] + place]
            low, high = self.step(letter, low), self.step(letter, high)
            there = high > low
            q, place, low, high = q[there], place[there] + 1, low[there], high[there]
        return tuple(np.concatenate(x) for x in zip(*found))


def _search(table: pa.Table) -> pa.Table:
    """The neighbours of a shard's searches among its words: their number, and the most frequent one."""
    backwards = table.column("side")[0].as_py() == 1
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    listed, asked = table.column("listed").to_pylist(), table.column("asked").to_pylist()
    held = {w: k for w, k, x in zip(words, n, listed) if x}
    names = list(held)
    searches = [w for w, x in zip(words, asked) if x]
    best: dict[str, list] = {}
    if names and searches:
        index = Index([w[::-1] for w in names] if backwards else names)
        for first in range(0, len(searches), _SEARCHES):
            own = searches[first:first + _SEARCHES]
            exact = np.array([(len(w) + 1) // 2 if backwards else len(w) // 2 for w in own], np.int64)
            for q, v in zip(*(x.tolist() for x in index.one_error([w[::-1] for w in own] if backwards else own, exact))):
                word, near = own[q], names[v]
                if backwards and near.startswith(word[:len(word) // 2]):
                    continue  # the other direction finds it
                entry = best.setdefault(word, [0, 0, ""])
                entry[0] += 1
                if (-held[near], near) < (-entry[1], entry[2]):
                    entry[1:] = held[near], near
    return pa.table({
        "word": pa.array(best.keys(), pa.string()), "n_near": pa.array([x[0] for x in best.values()], pa.int64()),
        "near_n": pa.array([x[1] for x in best.values()], pa.int64()), "near": pa.array([x[2] for x in best.values()], pa.string())})


def _routed(vocabulary: DataFrame, shard_words: int) -> DataFrame:
    """Every word once for each half it may be found by; ``asked`` where the half is its own.

    A half in slices is ``alone``: its slices and blocks share no shard with others, so no search meets a word twice.
    """
    m = F.length("word")
    sides = [(0, F.col("word"), [F.floor((m - 1) / 2), F.floor((m + 1) / 2)], F.floor(m / 2)),
             (1, F.reverse("word"), [F.floor(m / 2), F.floor((m + 2) / 2)], F.floor((m + 1) / 2))]
    halves = [F.struct(F.lit(side).alias("side"), F.substring(read, F.lit(1), k.cast("int")).alias("half"), (k == own).alias("asked"))
              for side, read, ks, own in sides for k in ks]
    rows = vocabulary.select("word", "n", F.explode(F.array(*halves)).alias("h")).select("word", "n", "h.*")
    slices = rows.groupBy("side", "half").agg(F.ceil(F.count("*") / shard_words).alias("slices")).where("slices > 1")
    rows = rows.join(slices, ["side", "half"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)
    # Of a half in one slice a row is both a word and a search; otherwise words go to all blocks and searches to all slices.
    both = F.array(F.struct(F.lit(True).alias("listed"), F.col("asked").alias("asked"), F.lit(0).cast("bigint").alias("slice"), F.lit(0).cast("bigint").alias("block")))
    spread = F.concat(
        F.transform(every, lambda b: F.struct(F.lit(True).alias("listed"), F.lit(False).alias("asked"), own.alias("slice"), b.alias("block"))),
        F.when(F.col("asked"), F.transform(every, lambda s: F.struct(F.lit(False).alias("listed"), F.lit(True).alias("asked"), s.alias("slice"), own.alias("block"))))
        .otherwise(F.filter(both, lambda x: F.lit(False))))
    return rows.select("side", "half", F.when(F.col("slices") > 1, F.col("half")).alias("alone"), "word", "n", F.explode(
        F.when(F.col("slices") > 1, spread).otherwise(both)).alias("r")).select("side", "half", "alone", "word", "n", "r.*")


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n_near, near, near_n)`` of every word of ``(word, n)`` that has others one edit away.

    ``near`` is the one with the largest ``n``; of equal ones, the first in code-point order. Words differ and
    have at least two code points; ``vocabulary`` is read twice.
    """
    shards = max(1, -(-4 * vocabulary.count() // shard_words))
    rows = _routed(vocabulary, shard_words)
    shard = 2 * F.pmod(F.xxhash64("half", "slice", "block"), F.lit(shards)) + F.col("side")
    # Searches take far longer than their bytes suggest: a partition for each shard, however small.
    keys = ["shard", "alone", "slice", "block"]
    dealt = rows.select(shard.alias("shard"), "alone", "slice", "block", "side", "word", "n", "listed", "asked").repartition(2 * shards, *keys)
    found = dealt.groupBy(*keys).applyInArrow(
        _search, "word string, n_near bigint, near_n bigint, near string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def _rooted(s: Scratch, forms: DataFrame) -> DataFrame:
    """``(word, root)``: forms of forms, by doubling the way that is gone in each round."""
    links, k = s.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links0"), 0
    while not links.where("moved").isEmpty():
        k += 1
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = s.keep(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"links{k}")
    return links.select("word", "root")


def group_variants(vocabulary: DataFrame, ratio: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every word of ``(word, n)`` with the spelling it is a variant of: ``word, form, root, n, n_near, form_n``.

    ``n_near`` is the number of words one inserted, deleted or replaced code point away. ``form`` is the one
    of them with the largest ``n`` (ties: the first in code-point order) if that is at least ``ratio`` (over 1)
    times the word's own, else null; ``root`` is the last form reached from form to form, or the word itself.
    Words have at least two code points. Null words are left out and rows of one word are added up; an empty
    table gives none; further columns are not read.
    """
    with Scratch(vocabulary.sparkSession) as s:
        words = s.keep(vocabulary.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
        good = F.col("near_n") >= ratio * F.col("n")
        found = s.keep(words.join(neighbours(words, shard_words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("near")).alias("form"),
            F.when(good, F.col("near_n")).alias("form_n")), "found")
        roots = _rooted(s, found.where("form IS NOT NULL"))
        return s.result(found.join(roots, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", delete_every: int = 0, least: int = 5, seldom: int = 3) -> DataFrame:
    """``group_variants`` of the words of ``docs`` with at least ``least`` code points and ``seldom`` occurrences.

    Repeated rows count as often as they come; null and empty texts hold no words; other columns are not read.
    """
    return group_variants(count_words(docs, key, text, delete_every, least).where(F.col("n") >= seldom))
