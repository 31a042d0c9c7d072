"""Row-order functions over tables of any size.

A window without a partition key moves the whole table into one task, and so
does a window over one hot key. Everything here cuts the order into ranges
instead: a uniform sample picks the cut points, each row finds its range with
a plain expression, ordinary windows run inside ``(range, key)``, and a small
frame of per-range totals carries the state from one range to the next. The
result is exact, and a range is a function of the row alone, so a lost
executor only repeats its own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = "__range"
_SAMPLE_PER_RANGE = 32
_SAMPLE_LIMIT = 100_000
_TREE_LIMIT = 128


def range_count(df: DataFrame) -> int:
    """A few ranges per shuffle partition, so that hashing spreads them evenly."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, order_by: list[str], ranges: int) -> list[tuple[str, ...]]:
    """At most ``ranges - 1`` ordered tuples that split the table evenly (as text).

    Only the order columns are read. About 32 sampled rows per range reach the
    driver, whatever the size of the table.
    """
    wanted = min(ranges * _SAMPLE_PER_RANGE, _SAMPLE_LIMIT)
    keys = df.select(*order_by)
    total = keys.count()
    sample = keys if total <= wanted else keys.sample(wanted / total, 7)
    rows = sample.orderBy(*order_by).select(*[F.col(c).cast("string").alias(c) for c in order_by]).collect()
    picks = [tuple(rows[i * len(rows) // ranges]) for i in range(1, ranges)] if rows else []
    return [p for p in dict.fromkeys(picks) if None not in p]


def range_of(df: DataFrame, order_by: list[str], cuts: list[tuple[str, ...]]) -> Column:
    """The number of cut points at or below the row."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def bound(cut: tuple[str, ...]) -> Column:
        parts = [F.lit(v).cast(types[c]) for c, v in zip(order_by, cut)]
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(c) for p, c in zip(parts, order_by)])

    here = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    if not cuts:
        return F.lit(0)
    if len(cuts) <= _TREE_LIMIT:
        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(here >= bound(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

        return tree(0, len(cuts))
    width = int(len(cuts) ** 0.5) + 1
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[bound(b[0]) for b in blocks])
    table = F.array(*[F.array(*map(bound, b)) for b in blocks])
    block = F.size(F.filter(heads, lambda h: h <= here))
    inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda h: h <= here))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def with_ranges(df: DataFrame, order_by: list[str], ranges: int | None = None) -> DataFrame:
    ranges = ranges or range_count(df)
    return df.withColumn(RANGE, range_of(df, order_by, cut_points(df, order_by, ranges)))


@dataclass(frozen=True)
class Running:
    """One running value: sum, count, max, min, first or last of ``value`` so far."""

    kind: str
    value: Column
    before: bool = False  # leave the current row out


_TOTAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(
    df: DataFrame, order_by: list[str], values: dict[str, Running], keys: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add running values in ``order_by`` order, for the whole table or per key.

    ``keys + order_by`` must be unique. First and last skip nulls.
    """
    keys = list(keys or [])
    inputs = {name: f"__in_{i}" for i, name in enumerate(values)}
    base = df.withColumns({inputs[name]: v.value for name, v in values.items()})
    base = with_ranges(base, keys + order_by, ranges)
    order = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)

    inside = Window.partitionBy(RANGE, *keys).orderBy(*order_by)

    def local(name: str, v: Running) -> Column:
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if v.before else 0)
        c = F.col(inputs[name])
        if v.kind == "first":
            return F.first(c, ignorenulls=True).over(frame)
        if v.kind == "last":
            return F.last(c, ignorenulls=True).over(frame)
        return _TOTAL[v.kind](c).over(frame)

    def total(name: str, v: Running) -> Column:
        c = F.col(inputs[name])
        if v.kind == "first":
            return F.min_by(c, F.when(c.isNotNull(), order))
        if v.kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), order))
        return _TOTAL[v.kind](c)

    # One row per (range, key), pre-aggregated before its shuffle. A key has at
    # most one row per range here, so the window over it is small.
    totals = base.groupBy(RANGE, *keys).agg(*[total(n, v).alias(n) for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str, v: Running) -> Column:
        if v.kind == "first":
            return F.first(name, ignorenulls=True).over(earlier)
        if v.kind == "last":
            return F.last(name, ignorenulls=True).over(earlier)
        how = F.sum if v.kind in ("sum", "count") else _TOTAL[v.kind]
        return how(name).over(earlier)

    carry = totals.select(
        RANGE, *keys, F.count(F.lit(1)).over(earlier).alias("__seen"),
        *[carried(n, v).alias(f"__carry_{i}") for i, (n, v) in enumerate(values.items())],
    ).where("__seen > 0").drop("__seen")
    # Ranges follow (key, order), so only the first key of a range can have begun
    # in an earlier one: this frame has at most one row per range.
    joined = base.withColumns({f"__local_{i}": local(n, v) for i, (n, v) in enumerate(values.items())})
    on = [RANGE, *keys]
    carry = carry.withColumnsRenamed({c: f"__k_{c}" for c in on})
    match = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        match = same if match is None else match & same
    joined = joined.join(F.broadcast(carry), match, "left")

    def merged(i: int, v: Running) -> Column:
        here, past = F.col(f"__local_{i}"), F.col(f"__carry_{i}")
        if v.kind in ("sum", "count"):
            both = F.coalesce(here, past) if v.kind == "sum" else F.coalesce(here, F.lit(0))
            return F.when(here.isNotNull() & past.isNotNull(), here + past).otherwise(both)
        if v.kind == "max":
            return F.greatest(here, past)
        if v.kind == "min":
            return F.least(here, past)
        return F.coalesce(past, here) if v.kind == "first" else F.coalesce(here, past)

    return joined.select(
        *[F.col(c) for c in df.columns], *[merged(i, v).alias(n) for i, (n, v) in enumerate(values.items())]
    )


def row_index(df: DataFrame, order_by: list[str], name: str = "row_index", keys: list[str] | None = None) -> DataFrame:
    """Number rows from 0 in ``order_by`` order."""
    counted = running(df, order_by, {name: Running("count", F.lit(1), before=True)}, keys)
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def previous(
    df: DataFrame, order_by: list[str], columns: dict[str, Column], keys: list[str] | None = None
) -> DataFrame:
    """Add the last non-null value before each row."""
    return running(df, order_by, {n: Running("last", c, before=True) for n, c in columns.items()}, keys)
