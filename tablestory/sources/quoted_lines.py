"""Records of delimited text whose quoted fields hold line breaks, without reading a file in one task.

Whether a line begins inside quotes depends on all lines before it, but a block of lines only maps two
possible states to two: what it leaves behind if it begins outside quotes and if it begins inside. One
pass finds both for every block that Spark's text source reads, a window over one row per block strings
them together, and a second pass cuts each block into records, knowing how it begins. Only the pieces of
records that reach over a block's end meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import cells

_QUOTE = b'"'


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether quotes are open at the end of a line. They open only where a field begins; doubled ones stay text."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(_QUOTE, at):
                at = line.find(sep + _QUOTE, at) + len(sep)
                if at < len(sep):
                    return False
            at += 1
        end = line.find(_QUOTE, at)
        while end >= 0 and line.startswith(_QUOTE, end + 1):
            end = line.find(_QUOTE, end + 2)
        if end < 0:
            return True
        inside = False
        at = line.find(sep, end + 1) + len(sep)
        if at < len(sep):
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batches cut where a new block begins."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], starts[k]) != (files[at], starts[at]):
                yield (files[at], starts[at]), batch.slice(at, k - at)
                at = k


_BLOCK = "file bigint, start bigint, from_outside boolean, from_inside boolean, outside_breaks boolean, inside_breaks boolean, spoilt boolean, filled bigint, head binary"
_HEAD_BYTES = 1 << 20


def blocks(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """One row per block: ``file, start, inside`` (quotes are open where it begins)``, breaks`` (a line ends inside quotes),
    ``spoilt`` (NUL or bytes that are not UTF-8), ``filled`` (lines that are not blank) and ``head``, the first of these."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        cut = sep.encode()
        for block, batch in _runs(batches):
            state = found.setdefault(block, [False, True, False, True, False, 0, None])
            values, filled = batch.column(2), batch.column(4)
            for line in values.filter(pc.match_substring(values, _QUOTE)).to_pylist():
                both = state[0] != state[1]
                state[0] = ends_inside(line, state[0], cut)
                state[1] = ends_inside(line, state[1], cut) if both else state[0]
                state[2] |= state[0]
                state[3] |= state[1]
            state[4] |= bool(pc.any(batch.column(3)).as_py())
            if state[6] is None and block[1] == 0 and pc.any(filled).as_py():
                state[6] = values[pc.index(filled, True).as_py()].as_py()[:_HEAD_BYTES]
            state[5] += pc.sum(filled).as_py() or 0
        names = _ARROW.names
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*block, *state))) for block, state in found.items()], _ARROW)

    value = F.col("value")
    read = _lines(spark, path).select(
        "file", "start", value.cast("binary").alias("value"), (~F.is_valid_utf8(value) | value.contains("\0")).alias("spoilt"),
        (F.length(cells.squeeze(value)) > 0).alias("filled"))
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed_ = F.col("from_outside") == F.col("from_inside")
    # A block sets the state, keeps it or turns it over: the last one that sets it, then the parity of those that turn it.
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    made = read.mapInArrow(scan, _BLOCK).withColumn("turns", turns).withColumn(
        "set", F.when(fixed_, F.struct(F.col("from_outside").alias("state"), F.col("turns").alias("turns"))))
    last = F.last("set", ignorenulls=True).over(before)
    seen = F.coalesce(F.last("turns").over(before), F.lit(0))
    inside = F.coalesce(last["state"], F.lit(False)) != ((seen - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)
    return made.withColumn("inside", inside).select(
        "file", "start", "inside", F.when(F.col("inside"), F.col("inside_breaks")).otherwise(F.col("outside_breaks")).alias("breaks"),
        "spoilt", "filled", "head")


_ARROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_()), ("outside_breaks", pa.bool_()),
                    ("inside_breaks", pa.bool_()), ("spoilt", pa.bool_()), ("filled", pa.int64()), ("head", pa.binary())])
_PIECE = "file bigint, start bigint, k bigint, piece int, first boolean, record binary"
_WHOLE, _HEAD, _MORE = 0, 1, 2


def records(spark: SparkSession, path: str, sep: str, found: DataFrame) -> DataFrame:
    """``file, start, k`` (its first line of those of a block) ``, first`` (of its file) and ``record``, lines joined by line feeds.

    A line has a byte at least, so ``start + k`` grows along a file.

    ``found`` are the ``blocks`` of the path; of these one row each is broadcast. Blank lines outside quotes are left out.
    """
    cut = sep.encode()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, begun, lines, k, any_yet = None, False, False, [], 0, False
        out: list[dict] = []

        def give(piece: int, at: int) -> None:
            nonlocal any_yet
            out.append({"file": block[0], "start": block[1], "k": at, "piece": piece, "first": piece != _MORE and block[1] == 0 and not any_yet, "record": b"\n".join(lines)})
            any_yet |= piece != _MORE
            lines.clear()

        def packed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, _PIECES)
            out.clear()
            return made

        for own, batch in _runs(batches):
            if own != block:
                if lines:
                    give(_HEAD if begun else _MORE, k)
                block, inside, begun, k, any_yet = own, batch.column(3)[0].as_py(), False, 0, False
                last = -1
            for line in batch.column(2).to_pylist():
                last += 1
                was, inside = inside, (ends_inside(line, inside, cut) if _QUOTE in line else inside)
                if not was:
                    begun, k = True, last
                    if not inside and not line.strip():
                        continue
                lines.append(line)
                if not inside:
                    give(_WHOLE if begun else _MORE, k)
            if len(out) >= 1000:
                yield packed()
        if lines:
            give(_HEAD if begun else _MORE, k)
        yield packed()

    states = found.select(F.col("file").alias("__f"), F.col("start").alias("__s"), "inside")
    read = _lines(spark, path).select("file", "start", F.col("value").cast("binary").alias("value"))
    known = read.join(F.broadcast(states), (F.col("file") == F.col("__f")) & (F.col("start") == F.col("__s"))).select("file", "start", "value", "inside")
    pieces = known.mapInArrow(assemble, _PIECE)
    whole = pieces.where(F.col("piece") == _WHOLE).select("file", "start", "k", "first", "record")
    order = Window.partitionBy("file").orderBy("start", "k")
    # A block gives at most one piece that goes on and one that was begun before it.
    numbered = pieces.where(F.col("piece") != _WHOLE).withColumn("opened", F.count_if(F.col("piece") == _HEAD).over(order))
    joined = numbered.groupBy("file", "opened").agg(
        F.min(F.struct("start", "k", "first")).alias("at"), F.sort_array(F.collect_list(F.struct("start", "k", F.col("record").alias("record")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"].cast("string")), "\n").cast("binary")
    return whole.unionByName(joined.select("file", "at.start", "at.k", "at.first", text.alias("record")))


_PIECES = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("k", pa.int64()), ("piece", pa.int32()), ("first", pa.bool_()), ("record", pa.binary())])
