"""Removing long passages that repeat across documents, through difference-cover anchors.

The positions 0, 1 and 3 modulo 7 are a difference cover: for any two places in two documents there is a
shift of less than 7 after which both are such positions. So two equal runs of ``7 + 7 - 1 = 13`` words or
more hold equal runs of 7 words at positions that are in the cover on both sides, and only those, three in
seven, are hashed and compared across documents. What shares an anchor is extended to the full window.

1. Documents are dealt once, where they are read, to chunks of some megabytes, kept in buckets by chunk.
2. A chunk sends its different anchor hashes, sorted and packed, to the parts of the hash range. A part
   answers each chunk with one bit per hash: another chunk has it too.
3. Windows around anchors that others share are hashed in full. A chunk sends its different hashes with the
   smallest document of each; a part answers with one bit per hash: a smaller document has it elsewhere.
4. A chunk marks the words under such windows, and under windows that a smaller document in the chunk has.

Whatever repeats inside a chunk is one hash there, so a passage that a third of all documents hold
reaches a part once per chunk. Texts are never shuffled after step 1; bits and packed hashes are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .words import mix, plain, words

PERIOD = 7
COVER = (0, 1, 3)
CHUNK_BYTES = 8 << 20
PART_HASHES = 1 << 20
_LAST = np.iinfo(np.int64).max
_zstd = pa.Codec("zstd")


def _chunks(limit: int) -> Callable:
    """Number runs of rows of some megabytes; a longer text comes alone."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64)
            own = np.empty(len(size), np.int64)
            for k, n in enumerate(size.tolist()):
                if filled and filled + n > limit:
                    chunk, filled = chunk + 1, 0
                own[k] = chunk
                filled += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(size), *batch.columns], ["chunk", "size", *batch.schema.names])

    return number


@dataclass
class Chunk:
    """The words of all texts of a chunk, end to end: hash, place in the text, words of the text, document."""

    hashes: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    length: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        found = list(words(table.column("text"), lower=False)) if table.num_rows else []
        hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in found)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.bounds) for w in found)])
        ids = np.asarray(pc.fill_null(table.column("key"), _LAST))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        return cls(hashes, counts, place, np.repeat(counts, counts), np.repeat(ids, counts))

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` words from each of these places on."""
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total += self.hashes[at + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1)
        return mix(total)

    def anchors(self, size: int) -> np.ndarray:
        """Places in the cover with a run of ``size - 6`` words, in texts of at least ``size`` words."""
        cover = np.isin(np.arange(PERIOD), COVER)
        return np.flatnonzero((self.length >= size) & (self.place + size - PERIOD < self.length) & cover[self.place % PERIOD])

    def windows(self, anchors: np.ndarray, size: int) -> np.ndarray:
        """Starts of the windows of ``size`` words that hold one of the anchors."""
        first = anchors - np.minimum(self.place[anchors], PERIOD - 1)
        last = np.minimum(anchors, anchors - self.place[anchors] + self.length[anchors] - size)
        edge = np.bincount(first, minlength=len(self.hashes) + 1) - np.bincount(last + 1, minlength=len(self.hashes) + 1)
        return np.flatnonzero(np.cumsum(edge)[:len(self.hashes)] > 0)


@dataclass
class Distinct:
    """The different values of some hashes, sorted, with their smallest and largest document, and which is whose."""

    values: np.ndarray
    least: np.ndarray
    most: np.ndarray
    whose: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, docs: np.ndarray) -> Distinct:
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        whose = np.empty(len(order), np.int64)
        whose[order] = np.cumsum(new) - 1
        if not len(starts):
            return cls(ordered, docs[:0], docs[:0], whose)
        return cls(ordered[starts], np.minimum.reduceat(docs[order], starts), np.maximum.reduceat(docs[order], starts), whose)


@dataclass(frozen=True)
class Plan:
    """Window size, bits of an anchor hash, and bits that choose the part."""

    size: int
    bits: int
    part_bits: int

    @classmethod
    def of(cls, size: int, text_bytes: int) -> Plan:
        """One anchor in about a thousand agrees with another by chance; a part takes about ``PART_HASHES``."""
        grams = max(1, text_bytes // 4)
        return cls(size, min(64, max(32, grams.bit_length() + 10)), min(16, max(5, (grams // 4 // PART_HASHES).bit_length())))


def _pack(values: np.ndarray, bits: int, plan: Plan) -> Iterator[tuple[int, slice, bytes]]:
    """Sorted different values as parts: the part's number, which values, and their differences in as few bytes as they fit."""
    part = values >> np.uint64(bits - plan.part_bits)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    for low, high in zip(edges, edges[1:] + [len(values)]):
        inside = values[low:high] - (part[low] << np.uint64(bits - plan.part_bits))
        steps = np.diff(inside, prepend=np.uint64(0))
        width = max(1, -(-int(steps.max()).bit_length() // 8))
        yield int(part[low]), slice(low, high), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)


def _packed_ids(ids: np.ndarray) -> bytes:
    return _zstd.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpacked_ids(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_zstd.decompress(data, 8 * n), np.uint8).reshape(8, n).T).view(np.int64).reshape(-1)


_SENT = "part int, chunk bigint, n int, hashes binary, least binary"
_ANSWER = "chunk bigint, part int, kind int, bits binary"


def _sent(chunk: int, values: np.ndarray, least: np.ndarray | None, bits: int, plan: Plan) -> pa.Table:
    rows = list(_pack(values, bits, plan))
    return pa.table({
        "part": pa.array([p for p, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()),
        "n": pa.array([at.stop - at.start for _, at, _ in rows], pa.int32()), "hashes": pa.array([d for _, _, d in rows], pa.binary()),
        "least": pa.array([None if least is None else _packed_ids(least[at]) for _, at, _ in rows], pa.binary())})


def _answer(kind: int) -> Callable[[pa.Table], pa.Table]:
    """The bits of one part: others have the hash too (0), or others have it in a smaller document (1)."""
    def answer(table: pa.Table) -> pa.Table:
        counts = np.asarray(table.column("n")).astype(np.int64)
        values = np.concatenate([_unpack(d.as_py(), n) for d, n in zip(table.column("hashes"), counts.tolist())])
        order = np.argsort(values, kind="stable")
        new = np.append(True, values[order][1:] != values[order][:-1])
        starts = np.flatnonzero(new)
        mark = np.empty(len(values), bool)
        if kind:
            ids = np.concatenate([_unpacked_ids(d.as_py(), n) for d, n in zip(table.column("least"), counts.tolist())])
            mark[order] = np.minimum.reduceat(ids[order], starts)[np.cumsum(new) - 1] < ids[order]
        else:
            mark[order] = np.diff(np.append(starts, len(values)))[np.cumsum(new) - 1] > 1
        ends = np.cumsum(counts)
        rows = [(c, np.packbits(mark[e - n:e]).tobytes()) for c, n, e in zip(table.column("chunk").to_pylist(), counts.tolist(), ends.tolist())
                if mark[e - n:e].any()]
        return pa.table({
            "chunk": pa.array([c for c, _ in rows], pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(rows), pa.int32()),
            "kind": pa.array([kind] * len(rows), pa.int32()), "bits": pa.array([b for _, b in rows], pa.binary())})

    return answer


def _marks(answers: pa.Table, kind: int, values: np.ndarray, bits: int, plan: Plan) -> np.ndarray:
    """What the parts answered about each of the values sent."""
    own = answers.filter(pc.equal(answers.column("kind"), kind))
    given = dict(zip(own.column("part").to_pylist(), own.column("bits").to_pylist()))
    mark = np.zeros(len(values), bool)
    for part, at, _ in _pack(values, bits, plan):
        if part in given:
            mark[at] = np.unpackbits(np.frombuffer(given[part], np.uint8), count=at.stop - at.start).astype(bool)
    return mark


def _anchored(chunk: Chunk, plan: Plan) -> tuple[np.ndarray, Distinct]:
    at = chunk.anchors(plan.size)
    return at, Distinct.of(chunk.runs(at, plan.size - PERIOD + 1) >> np.uint64(64 - plan.bits), chunk.doc[at])


def _elsewhere(chunk: Chunk, plan: Plan, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, Distinct]:
    """Anchors, whether other documents of the chunk have them, and the windows around those that other chunks have."""
    at, anchors = _anchored(chunk, plan)
    shared = _marks(answers, 0, anchors.values, plan.bits, plan)[anchors.whose]
    windows = chunk.windows(at[shared], plan.size)
    return windows, at[(anchors.most > anchors.least)[anchors.whose]], Distinct.of(chunk.runs(windows, plan.size), chunk.doc[windows])


def _send_anchors(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    def send(table: pa.Table) -> pa.Table:
        return _sent(table.column("chunk")[0].as_py(), _anchored(Chunk.of(table), plan)[1].values, None, plan.bits, plan)

    return send


def _send_windows(plan: Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros(0, np.uint64), None, 64, plan)
        found = _elsewhere(Chunk.of(table), plan, answers)[2]
        return _sent(table.column("chunk")[0].as_py(), found.values, found.least, 64, plan)

    return send


def _covered(chunk: Chunk, plan: Plan, answers: pa.Table) -> np.ndarray:
    """Which words lie in a window that starts in a smaller document too."""
    sent, local, found = _elsewhere(chunk, plan, answers)
    gone = sent[_marks(answers, 1, found.values, 64, plan)[found.whose]]
    near = chunk.windows(local, plan.size)
    inside = Distinct.of(chunk.runs(near, plan.size), chunk.doc[near])
    gone = np.union1d(gone, near[inside.least[inside.whose] < chunk.doc[near]])
    edge = np.bincount(gone, minlength=len(chunk.hashes) + plan.size + 1)[:len(chunk.hashes) + 1]
    edge -= np.bincount(gone + plan.size, minlength=len(chunk.hashes) + 1)
    return np.cumsum(edge)[:len(chunk.hashes)] > 0


def _without(plan: Plan, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        gone = _covered(chunk, plan, answers)
        ends = np.cumsum(chunk.counts)
        data, offsets = plain(table.column("text"))
        texts, lost = [], []
        for k, (n, end) in enumerate(zip(chunk.counts.tolist(), ends.tolist())):
            own = data[offsets[k]:offsets[k + 1]].tobytes().split()
            drop = gone[end - n:end]
            lost.append(int(drop.sum()))
            texts.append(b" ".join(itertools.compress(own, ~drop) if lost[-1] else own))
        made = {"key": table.column("key"), "carried": table.column("carried"), "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(chunk.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
        return pa.table([made[c] for c in columns], columns)

    return drop


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), size: int = 13,
                   chunk_bytes: int = CHUNK_BYTES, finish: Callable[[DataFrame], DataFrame] = lambda kept: kept) -> DataFrame:
    """Texts without the words of passages of ``size`` words or more that a document with a smaller key holds too.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, unchanged. A word goes if a window of ``size``
    (at least 8) consecutive words of its document covers it and the same words follow one another
    anywhere in a document with a smaller key, in the input and not in what is left of it. Returns ``key``, the ``carry``
    columns, ``text`` (words kept, joined by one space), ``n_words`` before and ``n_removed``, a row per row, as a
    checkpoint; ``finish`` may reduce it, to digests for example, before that is written.

    Keys are whole numbers. Rows with equal keys are one document; a null key is larger than all others and
    not smaller than itself. Null texts and texts of fewer than ``size`` words lose nothing; columns that are
    not carried are not read, whatever their names. Windows are compared as 64-bit hashes, among those that share an anchor.
    """
    with Scratch(docs.sparkSession) as s:
        base = docs.select(F.col(key).cast("bigint").alias("key"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
        numbers = base.select(*[F.lit(0).cast("bigint").alias(c) for c in ("chunk", "size")], "*").schema
        held = s.keep_by(base.mapInArrow(_chunks(chunk_bytes), numbers), "held", "chunk")
        plan = Plan.of(size, held.agg(F.sum("size")).first()[0] or 0)
        texts = held.drop("size")
        anchors = texts.select("chunk", "key", "text").groupBy("chunk").applyInArrow(_send_anchors(plan), _SENT)
        first = s.keep(anchors.groupBy("part").applyInArrow(_answer(0), _ANSWER), "anchors")
        windows = texts.select("chunk", "key", "text").groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_send_windows(plan), _SENT)
        second = s.keep(windows.groupBy("part").applyInArrow(_answer(1), _ANSWER), "windows")
        schema = texts.select("key", "carried", "text").withColumns({c: F.lit(0).cast("bigint") for c in ("n_words", "n_removed")}).schema
        kept = texts.groupBy("chunk").cogroup(first.unionAll(second).groupBy("chunk")).applyInArrow(_without(plan, schema.names), schema)
        return s.result(finish(kept.select(
            F.col("key").alias(key), *[F.col(f"carried.{c}").alias(c) for c in carry], F.col("text").alias(text), "n_words", "n_removed")))
