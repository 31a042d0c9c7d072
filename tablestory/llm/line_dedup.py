"""Dropping lines that many documents hold, through a sharded minimal perfect hash.

1. Lines become 128-bit hashes; per hash the different documents are counted and the last one
   is kept, with partial aggregation, so that a hot line is one row per task.
2. Hashes found often enough are cut into shards of bounded size. A task builds a minimal perfect
   hash of its shard, whose slots index three compact arrays: fingerprint, count, last document.
3. Documents probe the arrays where they are; lines are neither joined nor shuffled.

The arrays are broadcast only up to ``limit`` bytes. A larger index is probed in several passes,
each over as many shards as fit, with the marks written to the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .words import mix

SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 64 << 20
_BLANK = b" \t\n\v\f\r"


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + h2 * np.uint64(2 * level + 3) + np.uint64(level)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Different 128-bit keys to 0 … n - 1, in about four bits a key.

    On each level, keys that have a bit to themselves set it; the others go on to the next level.
    A key's slot is the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(h1):
            size = -(-2 * len(h1) // 64) * 64
            place = _place(h1, h2, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[place]
            h1, h2 = h1[rest], h2[rest]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, np.uint64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot or -1."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            place = _place(h1[left], h2[left], level, size) + self.starts[level]
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (self.rank[place >> 6] + below)[found]
            left = left[~found]
        return out


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Number and 16-byte hash of every line whose key has at least so many code points."""
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            line = line.strip(_BLANK).lower()
            if len(line) >= least and (line.isascii() or len(line.decode("utf-8", "replace")) >= least):
                yield k, xxhash.xxh3_128_digest(line)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def repeated_lines(docs: DataFrame, key: str, text: str, least: int, documents: int) -> DataFrame:
    """``(h1, h2, n, last)`` of the line keys found in enough different documents."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                own = {h for _, h in line_keys(t, least)}
                found += own
                ids += [doc] * len(own)
            h1, h2 = _halves(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc", "h1", "h2"])

    made = docs.select(F.col(key).cast("bigint"), text).mapInArrow(keys, "doc bigint, h1 bigint, h2 bigint")
    return made.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= documents)


def _shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its perfect hash and its arrays in slot order."""
    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (np.asarray(table.column(c)).view(np.uint64) for c in ("h1", "h2"))
        made = PerfectHash.build(h1, h2)
        order = np.empty(len(h1), np.int64)
        order[made.slots(h1, h2)] = np.arange(len(h1))
        n = np.minimum(np.asarray(table.column("n")), 2**32 - 1).astype(np.uint32)
        return pa.table({
            "shard": table.column("shard")[:1], "sizes": pa.array([made.sizes], pa.list_(pa.int32())),
            "bits": pa.array([made.bits.tobytes()], pa.binary()), "prints": pa.array([h2[order].tobytes()], pa.binary()),
            "counts": pa.array([n[order].tobytes()], pa.binary()),
            "last": pa.array([np.asarray(table.column("last"))[order].tobytes()], pa.binary()),
        })

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        build, "shard bigint, sizes array<int>, bits binary, prints binary, counts binary, last binary")


def _probe(h1: np.ndarray, h2: np.ndarray, shards: int, index: dict) -> np.ndarray:
    """The last document of each key, or the least long for keys that are not in these shards."""
    last = np.full(len(h1), np.iinfo(np.int64).min)
    shard = np.mod(h1.view(np.int64), shards)
    for s in np.unique(shard):
        if int(s) in index:
            hashed, prints, lasts = index[int(s)]
            rows = np.flatnonzero(shard == s)
            slot = hashed.slots(h1[rows], h2[rows])
            hit = (slot >= 0) & (prints[slot] == h2[rows])
            last[rows[hit]] = lasts[slot[hit]]
    return last


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), least: int = 20,
                documents: int = 3, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Texts without the lines that at least ``documents`` documents hold, which stay in the last of them.

    A text is split at line feeds (null or empty: one empty line). A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case; keys under ``least`` code points
    are left alone. Of the documents with a key, the one with the largest id keeps all its lines.
    Returns ``key``, the ``carry`` columns, ``text`` of the lines kept, ``n_lines`` before, ``n_dropped``;
    a row per row. Rows with equal ids are one document; one without id is never counted and keeps no
    such line. A text that loses every line is empty.
    """
    spark = docs.sparkSession
    with Scratch(spark) as s:
        lines = s.keep(repeated_lines(docs, key, text, least, documents), "lines")
        shards = max(1, -(-lines.count() // SHARD_KEYS))
        index = s.keep(_shards(lines, shards), "index")
        sizes = index.select("shard", (F.length("bits") + F.length("prints") + F.length("counts") + F.length("last")).alias("size"))
        passes: list[list[int]] = [[]]
        filled = 0
        for row in sizes.orderBy("shard").toLocalIterator():
            if filled and filled + row.size > limit:
                passes.append([])
                filled = 0
            passes[-1].append(row.shard)
            filled += row.size
        base = docs.select(F.col(key).alias("key"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"), F.col(text).alias("text"))
        out = base.withColumns({"drop": F.array().cast("array<int>"), "n_lines": F.lit(0).cast("bigint")})
        for k, chosen in enumerate(passes):
            part = index.where(F.col("shard").between(chosen[0], chosen[-1])).collect() if chosen else []
            shared = spark.sparkContext.broadcast(
                [(r.shard, list(r.sizes), bytes(r.bits), bytes(r.prints), bytes(r.last)) for r in part])
            out = out.mapInArrow(_marker(shared, shards, least, k == len(passes) - 1), out.schema)
            if k < len(passes) - 1:
                out = s.keep(out, f"pass{k}")
        result = out.select(F.col("key").alias(key), *(F.col(f"carried.{c}").alias(c) for c in carry), F.col("text").alias(text),
                            "n_lines", F.size("drop").cast("bigint").alias("n_dropped"))
        return s.result(result) if len(passes) > 1 else result


def _marker(shared, shards: int, least: int, final: bool):
    """Add the numbers of the lines to drop; at the end, drop them."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: (PerfectHash(sizes, np.frombuffer(bits, np.uint64)), np.frombuffer(prints, np.uint64),
                     np.frombuffer(last, np.int64)) for s, sizes, bits, prints, last in shared.value}
        none = np.iinfo(np.int64).min
        for batch in batches:
            names = batch.schema.names
            texts = _texts(batch.column("text"))
            owner, number, found = [], [], []
            for row, t in enumerate(texts):
                for k, h in line_keys(t, least):
                    owner.append(row)
                    number.append(k)
                    found.append(h)
            drop = [set(x) for x in batch.column("drop").to_pylist()]
            if found:
                ids = batch.column("key").cast(pa.int64())
                ids = np.asarray(ids.fill_null(none)) if ids.null_count else np.asarray(ids)
                last = _probe(*_halves(found), shards, index)
                for at in np.flatnonzero((last != none) & (last != ids[owner])).tolist():
                    drop[owner[at]].add(number[at])
            columns = {c: batch.column(c) for c in names}
            columns["drop"] = pa.array([sorted(x) for x in drop], pa.list_(pa.int32()))
            if final:
                columns["n_lines"] = pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())
                kept = [b"\n".join(x for k, x in enumerate(t.split(b"\n")) if k not in d) if d else t for t, d in zip(texts, drop)]
                columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return mark
