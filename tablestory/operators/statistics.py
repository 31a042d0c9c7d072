"""Statistics as aggregates: one pass over the rows, small frames after that."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.shown import nice_step_column
from .ordering import previous, row_index

__all__ = [
    "pearson", "pearson_pairs", "lag1_corr", "chi_square_significant", "rate_difference",
    "mean_difference", "group_moments", "least_squares", "quantiles", "variation", "thirds_change", "nice_step_column",
]

_EXACT_MAP_LIMIT = 1_000_000
_COLLECT_LIMIT = 200_000


# --- correlation -----------------------------------------------------------------
def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows where both are known; 0 below 3 rows or without variation."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
    return F.when(F.count(x) >= 3, r).otherwise(0.0)


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, pairs, r) for many column pairs from one aggregate."""
    both = [
        F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"),
            F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("pairs"),
            pearson(F.col(x), F.col(y)).alias("r"),
        )
        for x, y in pairs
    ]
    return df.agg(F.array(*both).alias("all")).select(F.inline("all"))


def lag1_corr(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(column, points, r): each column against its own previous known value."""
    behind = {f"__prev_{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    lagged = previous(df.select(*dict.fromkeys([*order_by, *columns])), order_by, behind)
    each = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.col(c)).alias("points"),
            F.when(F.count(F.col(c)) >= 4, pearson(F.col(c), F.col(f"__prev_{i}"))).otherwise(0.0).alias("r"),
        )
        for i, c in enumerate(columns)
    ]
    return lagged.agg(F.array(*each).alias("all")).select(F.inline("all"))


def least_squares(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept aggregates; slope 0 when x does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return slope, F.coalesce(F.regr_intercept(y, x), F.avg(y))


# --- tests against chance ----------------------------------------------------------
def chi_square_significant(statistic: Column, df: Column) -> Column:
    """Whether a chi-square value clears p < 0.01 (Wilson–Hilferty approximation)."""
    df = df.cast("double")
    spread = 2 / (9 * df)
    z = (F.cbrt(statistic / df) - (1 - spread)) / F.sqrt(spread)
    usable = (df >= 1) & (statistic > 0) & (statistic < float("inf"))
    return F.when(usable, z > fixed.CRITICAL_Z).otherwise(False)


def rate_difference(groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chi-square test and Cramér's V over (yes, total) groups, per ``keys``.

    Over both outcomes, Σ (observed − expected)²/expected is the same as
    Σ total·(rate − overall)² / (overall·(1 − overall)). The overall rate is
    joined back: at most one row per key combination.
    """
    keys = list(keys or [])
    overall = groups.groupBy(*keys).agg(F.try_divide(F.sum("yes"), F.sum("total")).alias("overall"))
    both = groups.join(overall, keys) if keys else groups.withColumn("overall", overall.scalar())
    rate = F.try_divide(F.col("yes"), F.col("total"))
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("k"),
        F.sum("yes").cast("bigint").alias("yes"),
        F.sum("total").cast("bigint").alias("total"),
        F.sum(F.col("total") * F.pow(rate - F.col("overall"), 2)).alias("__squares"),
        F.max("overall").alias("overall"),
    )
    flat = (F.col("k") < 2) | (F.col("total") == 0) | (F.col("yes") == 0) | (F.col("yes") == F.col("total"))
    spread = F.col("overall") * (1 - F.col("overall"))
    statistic = F.when(flat, 0.0).otherwise(F.try_divide(F.col("__squares"), spread))
    return sums.select(
        *keys, "k", "yes", "total", "overall", statistic.alias("statistic"),
        F.when(flat, False).otherwise(chi_square_significant(statistic, F.col("k") - 1)).alias("significant"),
        F.when(flat, 0.0).otherwise(F.sqrt(F.try_divide(statistic, F.col("total")))).alias("cramers_v"),
    )


def group_moments(df: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    """Per group: how many values, their mean and their population variance."""
    m = measure.cast("double")
    return df.groupBy(*keys).agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.var_pop(m).alias("variance"))


def mean_difference(groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One-way analysis of variance over (n, mean, variance) groups, per ``keys``.

    The spread between groups is a weighted variance of the means around the
    grand mean, which is joined back: at most one row per key combination.
    """
    keys = list(keys or [])
    groups = groups.where("n > 0")
    grand = groups.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    if keys:
        both = groups.join(grand, keys)
    else:
        both = groups.withColumn("grand", grand.scalar())
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("k"),
        F.sum("n").cast("bigint").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("variance")).alias("within"),
    )
    between, within, k, n = (F.col(c) for c in ("between", "within", "k", "n"))
    none = (k < 2) | (n <= k) | (between + within == 0)
    f = F.try_divide(between / (k - 1), F.try_divide(within, n - k))
    return sums.select(
        *keys, "k", "n", "between", "within",
        F.when(~none, f).alias("f"),
        F.when(none, False).when(within == 0, True)
        .otherwise(F.coalesce(chi_square_significant((k - 1) * f, k - 1), F.lit(False))).alias("significant"),
        F.when(none, 0.0).when(within == 0, 1.0)
        .otherwise(F.try_divide(between, between + within)).alias("eta_squared"),
    )


# --- quantiles -----------------------------------------------------------------------
def quantiles(
    df: DataFrame, column: str, qs: list[float], exact_limit: int = _EXACT_MAP_LIMIT, collect_limit: int = _COLLECT_LIMIT
) -> list[float | None]:
    """Exact quantiles of the finite values, interpolated at (n − 1)·q.

    Equal values are counted before they are brought together, and the
    built-in exact percentile then holds each different value once. It is used
    while there are at most ``exact_limit`` of them. Beyond that the wanted positions
    are bracketed by a sketch, everything outside the brackets is only counted,
    and the brackets shrink until at most ``collect_limit`` rows are left. Both ways
    give the same values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and abs(v) < double('Infinity')")
    facts = values.agg(F.count("v").alias("n"), F.approx_count_distinct("v").alias("d")).first()
    if facts.n == 0:
        return [None] * len(qs)
    if facts.d <= exact_limit:
        counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return list(counted.agg(F.percentile("v", [float(q) for q in qs], F.col("n")).alias("q")).first().q)
    wanted = sorted({k for q in qs for k in (math.floor((facts.n - 1) * q), math.ceil((facts.n - 1) * q))})
    found = _order_statistics(values, facts.n, wanted, collect_limit)
    result = []
    for q in qs:
        place = (facts.n - 1) * q
        low, high = found[math.floor(place)], found[math.ceil(place)]
        result.append(low + (high - low) * (place - math.floor(place)))
    return result


def _order_statistics(values: DataFrame, n: int, wanted: list[int], limit: int = _COLLECT_LIMIT) -> dict[int, float]:
    """The values at 0-based ranks ``wanted``.

    Every round cuts the open intervals that still hold a wanted rank with a
    sketch, and counts exactly what lies between the cuts: two aggregates for
    all ranks together. When few rows are left, they are read off in order.
    """
    found: dict[int, float] = {}
    gaps = [(float("-inf"), float("inf"), 0, n)]  # (above, below, rows before, rows inside)
    v = F.col("v")
    while True:
        holds = {g: [k for k in wanted if k not in found and g[2] <= k < g[2] + g[3]] for g in gaps}
        gaps = [g for g in gaps if holds[g]]
        if not gaps:
            return found
        inside = None
        for low, high, _, _ in gaps:
            here = (v > low) & (v < high)
            inside = here if inside is None else inside | here
        if sum(g[3] for g in gaps) <= limit:
            rows = values.where(inside).groupBy("v").count().orderBy("v").collect()
            for low, high, rank, _ in gaps:
                for row in rows:
                    if low < row["v"] < high:
                        for k in range(rank, rank + row["count"]) if row["count"] < 1000 else wanted:
                            if k in wanted and rank <= k < rank + row["count"]:
                                found[k] = row["v"]
                        rank += row["count"]
            continue
        sketches = []
        for i, (low, high, before, size) in enumerate(gaps):
            places = {min(1.0, max(0.0, (k - before) / max(1, size - 1) + d)) for k in holds[gaps[i]] for d in (-2e-4, 2e-4)}
            here = F.when((v > low) & (v < high), v)
            sketches.append(F.percentile_approx(here, sorted(places), 20_000).alias(f"cut_{i}"))
        cuts = [sorted(set(c)) for c in values.where(inside).agg(*sketches).first()]
        marks = [(i, c) for i, cut in enumerate(cuts) for c in cut]
        counts = values.where(inside).agg(*[
            made for j, (i, c) in enumerate(marks) for made in (
                F.count_if((v > gaps[i][0]) & (v < c)).alias(f"b_{j}"), F.count_if(v == c).alias(f"e_{j}"))
        ]).first()
        narrower = []
        for i, (low, high, before, size) in enumerate(gaps):
            at, left = before, low
            for j, (owner, c) in enumerate(marks):
                if owner != i:
                    continue
                first, same = before + counts[f"b_{j}"], counts[f"e_{j}"]
                narrower.append((left, c, at, first - at))
                found.update({k: c for k in holds[gaps[i]] if first <= k < first + same})
                at, left = first + same, c
            narrower.append((left, high, at, before + size - at))
        gaps = narrower


# --- series (at most a few hundred points) ---------------------------------------------
def variation(value: Column) -> Column:
    """Coefficient of variation: population deviation over the mean."""
    return F.try_divide(F.stddev_pop(value), F.avg(value))


def thirds_change(series: DataFrame, order: str, value: str) -> DataFrame:
    """(early, late, change): mean of the first third of a series against the last third.

    Rows are numbered by ranges of the order, so a series of any length is read by many tasks. Missing
    values are left out of the means; an empty series gives no row.
    """
    slim = series.select(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    numbered = row_index(slim, ["at", "v"], "place")
    total = slim.agg(F.count(F.lit(1))).scalar()
    third = F.greatest(F.lit(1), F.floor(total / 3))
    means = numbered.withColumns({"first": F.col("place") < third, "last": F.col("place") >= total - third}).agg(
        F.avg(F.when(F.col("first"), F.col("v"))).alias("early"), F.avg(F.when(F.col("last"), F.col("v"))).alias("late"), F.count(F.lit(1)).alias("rows"))
    change = F.when(F.col("early") == 0, 0.0).otherwise(F.try_divide(F.col("late") - F.col("early"), F.abs("early")))
    return means.where("rows > 0").select("early", "late", change.alias("change"))
