"""Packing documents into batches of a token budget, in length buckets that waste least.

The histogram of lengths is the only thing gathered; its size is bounded by the longest length
(lengths beyond ``EXACT`` are rounded up by at most 1/256 in it, never in the rows). A dynamic
program over it chooses the boundaries with the least padding: with C and T the running counts
and tokens, best(k, j) = min over i of best(k-1, i) + length_j (C_j - C_i) - (T_j - T_i), a lower
envelope of lines with falling slopes, so each bucket costs one pass over the histogram.

Inside a bucket, batches are numbered without gathering it: rows are numbered within slices of a
bucket, and the slices' counts give the offsets.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT = 1 << 16
SLICE_ROWS = 100_000


def binned(length: Column) -> Column:
    """A length as the histogram has it."""
    step = F.pow(2, F.floor(F.log2(F.greatest(length, F.lit(EXACT)))) - 8).cast("bigint")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step) * step).cast("bigint")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """At most so many lengths, the last the longest, that pad the histogram's (length, count) least."""
    if not histogram:
        return []
    lengths, counts = zip(*sorted(histogram))
    rows = [0, *accumulate(counts)]
    tokens = [0, *accumulate(n * c for n, c in zip(lengths, counts))]
    size = len(lengths)
    best = [0] + [None] * size
    cuts: list[list[int]] = []
    for _ in range(min(buckets, size)):
        found, choice = [0] + [None] * size, [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        top = 0
        for j in range(1, size + 1):
            if best[j - 1] is not None:
                slope, base = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) >= top + 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - slope) >= (base - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((slope, base, j - 1))
            x = lengths[j - 1]
            while len(hull) > top + 1 and hull[top + 1][0] * x + hull[top + 1][1] <= hull[top][0] * x + hull[top][1]:
                top += 1
            if len(hull) > top:
                found[j] = hull[top][0] * x + hull[top][1] + x * rows[j] - tokens[j]
                choice[j] = hull[top][2]
        best = found
        cuts.append(choice)
    out, j = [], size
    for choice in reversed(cuts):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = choice[j]
    return sorted(out)


def padding(histogram: list[tuple[int, int]], chosen: list[int]) -> int:
    return sum(c * (min(b for b in chosen if b >= n) - n) for n, c in histogram)


def pack(docs: DataFrame, key: str = "doc_id", tokens: Column | None = None, buckets: int = 16, budget: int = 65536,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """A bucket and a batch for every row: ``key, carry…, n_tokens, bucket, bucket_tokens, batch, place, padding``.

    ``tokens`` is the length of a row (default: the words of ``text``); null counts as 0. Rows of a
    bucket are padded to ``bucket_tokens``, its boundary. A batch holds ``budget // bucket_tokens``
    rows of one bucket, one at least: a row beyond the budget is a batch by itself. ``place`` is the
    row's place in its batch. Batches are full but for the last of a bucket. An empty table gives
    no rows. Ties and repeated rows are all packed.
    """
    if tokens is None:
        tokens = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(F.col(key).alias("key"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"),
                       F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"))
    rows = rows.withColumn("bin", binned(F.col("n_tokens"))).checkpoint()
    histogram = [(r.bin, r["count"]) for r in rows.groupBy("bin").count().collect()]
    chosen = boundaries(histogram, buckets)
    total = sum(c for _, c in histogram)
    edges = F.array(*(F.lit(b).cast("bigint") for b in chosen)) if chosen else F.array().cast("array<bigint>")
    slices = max(8, -(-total // SLICE_ROWS))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("bin"))).cast("bigint"))
    rows = rows.withColumns({"bucket_tokens": F.get(edges, F.col("bucket").cast("int")),
                             "slice": F.pmod(F.xxhash64("key", "n_tokens"), F.lit(slices))})
    counts = rows.groupBy("bucket", "slice").count()
    offsets = counts.select("bucket", "slice", (F.sum("count").over(
        Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("offset"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("key", "n_tokens")))
    rows = rows.join(offsets, ["bucket", "slice"])
    number = F.col("offset") + F.col("number") - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("bigint")
    return rows.select(F.col("key").alias(key), *(F.col(f"carried.{c}").alias(c) for c in carry), "n_tokens", "bucket", "bucket_tokens",
                       F.floor(number / fits).alias("batch"), (number % fits).alias("place"),
                       (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
