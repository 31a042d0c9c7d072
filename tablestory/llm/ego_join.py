"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of at least c are within epsilon = sqrt(2 - 2c) of each other, in every
rotation and in any of its dimensions. Vectors are sorted by the grid cells (of width epsilon) they
have on the leading principal dimensions, and the sequence is cut into blocks, consecutive blocks into
groups. Bounding boxes of groups are joined recursively from the whole sequence down; a task gets two
groups that may hold near vectors and goes on to their blocks and to short runs of rows. What is
provably further apart than epsilon is skipped, the rest is compared exactly.

A block is sent once to every group its own is near to, not once to every near block: while the groups
fit a task's memory there are as many of them at every size, and what is sent grows as the table.
Equal vectors are one class with a count. A task returns link counts and a spanning forest of
the links it found, never the links; components follow from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .components import components, forest
from .scratch import Scratch

#: Principal dimensions that sort the vectors, and that boxes have.
DIMENSIONS, BOX_DIMENSIONS = 8, 64
FINER = 4
BLOCK_ROWS, RUN_ROWS = 1024, 256
#: At least so many groups, so that their pairs keep a cluster busy, and more once a group would exceed so many bytes.
GROUPS, GROUP_BYTES = 8, 32 << 20
FIT_ROWS = 4096
_EDGES = 1 << 17
#: Room for rounding when boxes are compared, far above double precision and far below epsilon.
_ROOM = 1e-9
#: Room for rounding of single-precision products of unit vectors.
_SINGLE = 1e-4


def _unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit rows from a list column, shorter ones filled up with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = np.asarray(vectors.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        out = values.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = values
    if not len(out):
        return out
    # A power of two first, so that squares neither overflow nor vanish.
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1))[1][:, None])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def principal(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Orthonormal columns along which the rows differ most."""
    if not len(rows):
        return np.eye(rows.shape[1])[:, :dimensions]
    centred = rows - rows.mean(axis=0)
    _, directions = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(directions[:, ::-1][:, :dimensions])


def near_intervals(low: np.ndarray, high: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i <= j of boxes within epsilon, by halving the sequence level by level.

    The boxes of a level's intervals enclose those of their halves; a pair of intervals goes
    down a level only while their boxes are near.
    """
    size = 1 << max(0, int(len(low) - 1).bit_length())
    grow = ((0, size - len(low)), (0, 0))
    levels = [(np.pad(low, grow, constant_values=np.inf), np.pad(high, grow, constant_values=-np.inf))]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        levels.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth, (lo, hi) in enumerate(reversed(levels)):
        if depth:
            i, j = (np.repeat(2 * x, 4) + np.tile(add, len(x)) for x, add in ((i, [0, 0, 1, 1]), (j, [0, 1, 0, 1])))
        fit = (i <= j) & np.isfinite(lo[i, 0]) & np.isfinite(lo[j, 0]) if lo.shape[1] else i <= j
        i, j = i[fit], j[fit]
        gap = np.maximum(0, np.maximum(lo[i] - hi[j], lo[j] - hi[i]))
        fit = (gap**2).sum(axis=1) <= (epsilon + _ROOM) ** 2
        i, j = i[fit], j[fit]
    return i, j


def _blocks(classes: DataFrame, axes: np.ndarray, epsilon: float, rows: int) -> DataFrame:
    """The sequence in grid order, cut into blocks with their boxes, numbered by (part, number)."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _unit(batch.column("vector"), shared.value.shape[0]) @ shared.value[:, :DIMENSIONS] / epsilon
            cells = np.floor(np.concatenate([at, FINER * at], axis=1)).astype(np.int32)  # inside a cell by smaller ones
            flat = pa.array(cells.reshape(-1), pa.int32())
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, cells.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch]).select(["id", "count", "vector"])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= rows:
                yield block(part, number, held[:rows])
                held = held[rows:]
                number += 1
        if held is not None and held.num_rows:
            yield block(part, number, held)

    def block(part: int, number: int, held: pa.Table) -> pa.RecordBatch:
        ids, counts, vectors = (held.column(c).combine_chunks() for c in ("id", "count", "vector"))
        at = _unit(vectors, shared.value.shape[0]) @ shared.value
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        box = lambda x: one(pa.array(x, pa.float64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), one(ids), one(counts), one(vectors), box(at.min(axis=0)), box(at.max(axis=0))],
            ["part", "number", "ids", "counts", "vectors", "low", "high"])

    kind = classes.schema["vector"].dataType.elementType.simpleString()
    parts = max(1, -(-classes.count() // (16 * rows)))
    placed = classes.mapInArrow(place, f"id bigint, count bigint, vector array<{kind}>, cells array<int>")
    placed = placed.repartitionByRange(parts, "cells", "id").sortWithinPartitions("cells", "id")
    return placed.mapInArrow(cut, f"part bigint, number bigint, ids array<bigint>, counts array<bigint>, vectors array<array<{kind}>>, low array<double>, high array<double>")


def _grouped(blocks: DataFrame, total: int, width: int) -> tuple[DataFrame, int]:
    """Blocks with the group of consecutive blocks they are in, and the number of groups. One row per part comes to the driver."""
    counts = {r.part: r["count"] for r in blocks.groupBy("part").count().collect()}
    before, all_blocks = {}, 0
    for part in sorted(counts):
        before[part], all_blocks = all_blocks, all_blocks + counts[part]
    wanted = max(min(GROUPS, all_blocks), -(-8 * width * total // GROUP_BYTES), 1)
    each = -(-all_blocks // wanted) or 1
    starts = blocks.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part bigint, before bigint")
    placed = blocks.join(F.broadcast(starts), "part")  # one row per part
    return placed.withColumn("group", F.floor((F.col("before") + F.col("number")) / each).cast("bigint")), -(-all_blocks // each)


def _trees(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges with the components of the links between two runs of rows, fewer than there are rows."""
    open_ = linked.any(axis=1)
    while open_.any():
        row = int(open_.argmax())
        rows, cols = np.zeros(len(x), bool), np.zeros(len(y), bool)
        rows[row] = True
        new = rows.copy()
        while new.any():
            more = linked[new].any(axis=0) & ~cols
            cols |= more
            new = linked[:, more].any(axis=1) & ~rows
            rows |= new
        ends = np.append(x[rows], y[cols])
        ends = ends[ends != x[row]]
        yield np.full(len(ends), x[row]), ends
        open_ &= ~rows


class _Side:
    """The blocks of a group end to end, with the boxes of blocks and of runs of rows."""

    def __init__(self, table: pa.Table, width: int, axes: np.ndarray):
        arrays = {c: pa.concat_arrays([b.values for b in table.column(c)]) if table.num_rows else None for c in ("ids", "counts", "vectors")}
        self.ids, self.counts = (np.asarray(arrays[c]) for c in ("ids", "counts"))
        self.rows = _unit(arrays["vectors"], width)
        at = self.rows @ axes
        starts, self.block = [], []
        for k, n in enumerate(len(b) for b in table.column("ids")):
            first = starts[-1][1] if starts else 0
            for i in range(first, first + n, RUN_ROWS):
                starts.append((i, min(i + RUN_ROWS, first + n)))
                self.block.append(k)
        self.runs = starts
        self.low, self.high = (np.array([f(at[i:j], axis=0) for i, j in starts]) for f in (np.min, np.max))
        lead = -(-at.shape[1] // 2)
        self.lead = at[:, :lead].astype(np.float32)
        self.rest = np.sqrt(np.maximum(0, 1 - (at[:, :lead] ** 2).sum(axis=1))).astype(np.float32)


def _linked(a: _Side, b: _Side, i: int, j: int, least: float) -> np.ndarray | None:
    """Which rows of two runs link; None for none.

    A product is at most that of the leading dimensions plus that of the lengths of what is left, so only
    rows and columns where this bound is reached are multiplied out, in double precision.
    """
    (p, q), (r, t) = a.runs[i], b.runs[j]
    bound = a.lead[p:q] @ b.lead[r:t].T + np.outer(a.rest[p:q], b.rest[r:t])
    near = bound >= least - _SINGLE
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return None
    hit = a.rows[p:q][rows] @ b.rows[r:t][cols].T >= least
    if not hit.any():
        return None
    linked = np.zeros(near.shape, bool)
    linked[np.ix_(rows, cols)] = hit
    return linked


def _compare(least: float, width: int, axes, epsilon: float):
    """Compare two groups run by run; give link counts (n > 0) and forest edges (n = 0)."""
    def compare(table: pa.Table) -> pa.Table:
        first, second = (table.filter(pc.equal(table.column("side"), k)).sort_by([("part", "ascending"), ("number", "ascending")]) for k in (0, 1))
        a = _Side(first, width, axes.value)
        same = not second.num_rows
        b = a if same else _Side(second, width, axes.value)
        found_a, found_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        x, y, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i, (p, q) in enumerate(a.runs):
            gap = np.maximum(0, np.maximum(a.low[i] - b.high, b.low - a.high[i]))
            close = np.flatnonzero((gap**2).sum(axis=1) <= (epsilon + _ROOM) ** 2)
            for j in close[close >= i].tolist() if same else close.tolist():
                linked = _linked(a, b, i, j, least)
                if linked is None:
                    continue
                r, t = b.runs[j]
                if same and i == j:
                    linked |= linked.T
                    np.fill_diagonal(linked, False)
                found_a[p:q] += linked @ b.counts[r:t]
                if not (same and i == j):
                    (found_a if same else found_b)[r:t] += a.counts[p:q] @ linked
                for u, v in _trees(linked, a.ids[p:q], b.ids[r:t]):
                    x.append(u)
                    y.append(v)
                    held += len(u)
                if held > _EDGES:
                    u, v = forest(np.concatenate(x), np.concatenate(y))
                    x, y, held = [u], [v], 0
        u, v = forest(np.concatenate(x), np.concatenate(y))
        links = [(a.ids, found_a)] + ([] if same else [(b.ids, found_b)])
        ids, n = (np.concatenate(c) for c in zip(*[(k[m > 0], m[m > 0]) for k, m in links]))
        return pa.table({"a": np.concatenate([ids, u]), "b": np.concatenate([ids, v]), "n": np.concatenate([n, np.zeros(len(u), np.int64)])})

    return compare


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Links of vectors with a cosine of at least ``least``, in double precision.

    Returns ``vec_id, n_links, component_id, kept`` for every row: how many other rows it links with,
    the smallest id it reaches, and whether that is itself. Vectors that are null, empty or zero, or
    hold a null or a component that is not finite, link with nothing, as does a row without id
    (component null, kept). A shorter vector reads as having zeros at its end. Rows that
    repeat an id share its component; each has the links of its own vector. Other columns are not looked at.
    """
    spark = table.sparkSession
    epsilon = float(np.sqrt(2 - 2 * least))
    limits = {"float": 3.4028234663852886e38}
    with Scratch(spark) as s:
        base = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
        kind = base.schema["vector"].dataType.elementType.simpleString()
        most = limits.get(kind, 1.7976931348623157e308)
        fine = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) <= most)) & F.exists("vector", lambda c: c != 0)
        base = base.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())
        marks = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")}
        good = base.where("fine").withColumns(marks)
        classes = s.keep(good.groupBy("h1", "h2").agg(
            F.min("id").alias("id"), F.count("*").alias("count"), F.first("vector").alias("vector")), "classes")
        total, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
        width = width or 1
        sample = classes.orderBy(F.xxhash64("h1"), "id").limit(FIT_ROWS).select("vector")
        sample = sample.toArrow().column("vector").combine_chunks()
        axes = principal(_unit(sample, width), min(BOX_DIMENSIONS, width))
        blocks = s.keep(_blocks(classes.select("id", "count", "vector"), axes, epsilon, BLOCK_ROWS), "blocks")
        placed, groups = _grouped(blocks, total, width)
        sides = [F.struct(*[f(F.get(side, F.lit(k))).alias(f"d{k}") for k in range(axes.shape[1])]).alias(side) for side, f in (("low", F.min), ("high", F.max))]
        boxes = placed.groupBy("group").agg(*sides).orderBy("group").collect()
        low, high = (np.array([list(r[c]) for r in boxes], float).reshape(-1, axes.shape[1]) for c in ("low", "high"))
        names = np.array([r.group for r in boxes], np.int64)
        i, j = near_intervals(low, high, epsilon) if boxes else (np.zeros(0, np.int64),) * 2
        task, apart = np.arange(len(i)), i != j
        deal = pa.table({"group": np.append(names[i], names[j][apart]) if len(i) else i, "task": np.append(task, task[apart]),
                         "side": np.append(np.zeros(len(i), np.int32), np.ones(apart.sum(), np.int32))})
        kind_of = "group bigint, task bigint, side int"
        deal = spark.createDataFrame(deal, kind_of) if deal.num_rows else spark.createDataFrame([], kind_of)
        met = placed.join(deal, "group").select("task", "side", "part", "number", "ids", "counts", "vectors")
        # Comparing takes far longer than its bytes suggest: a partition for each pair of groups.
        met = met.repartition(max(1, min(len(i), 10_000)), "task").groupBy("task")
        compare = _compare(least, width, spark.sparkContext.broadcast(axes), epsilon)
        found = s.keep(met.applyInArrow(compare, "a bigint, b bigint, n bigint"), "found")
        sums = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
        label = components(found.where("n = 0"), "a", "b")
        facts = classes.select("h1", "h2", "id", "count").join(sums, F.col("id") == sums.a, "left").join(
            label, F.col("id") == label.node, "left").select(
            "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        # Repeated ids under different vectors are one node.
        whole = good.select("id", "h1", "h2").join(facts, ["h1", "h2"]).select("id", "n_links", "component_id")
        alone = base.where("NOT fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
        out = whole.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                              F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
        return s.result(out)
