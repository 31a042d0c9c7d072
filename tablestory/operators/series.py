"""Rows along time or along a counter."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, shown
from .ordering import row_index

GRAINS = tuple(fixed.GRAIN_SIZES)


def bucket(moment: Column, grain: str) -> Column:
    """The start of the calendar step a moment falls in; weeks start on Monday."""
    return F.date_trunc(grain, moment).cast("timestamp_ntz")


def next_bucket(start: Column, grain: str) -> Column:
    unit = {"quarter": "INTERVAL 3 MONTH"}.get(grain, f"INTERVAL 1 {grain.upper()}")
    return (start + F.expr(unit)).cast("timestamp_ntz")


def _step(grain: str) -> str:
    return "INTERVAL 3 MONTH" if grain == "quarter" else f"INTERVAL 1 {grain.upper()}"


def time_buckets(df: DataFrame, time: str, grain: str, measures: list[str] = ()) -> DataFrame:
    """(bucket, rows, then n_i/sum_i/mean_i per measure), rows without a time left out."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, m in enumerate(measures):
        aggregates += [F.count(m).alias(f"n_{i}"), F.sum(m).alias(f"sum_{i}"), F.avg(m).alias(f"mean_{i}")]
    known = df.where(F.col(time).isNotNull())
    return known.groupBy(bucket(F.col(time), grain).alias("bucket")).agg(*aggregates)


def grain_counts(df: DataFrame, time: str, hourly: bool) -> DataFrame:
    """(grain, buckets): different steps of each grain.

    Rows are grouped once by day (by hour when hours can be drawn); the
    coarser grains are counted on that small result.
    """
    base = time_buckets(df, time, "hour" if hourly else "day")
    grains = GRAINS if hourly else GRAINS[1:]
    # Sets of calendar steps: at most the days between the years 1000 and 2200.
    each = [
        F.struct(F.lit(g).alias("grain"), F.size(F.collect_set(bucket(F.col("bucket"), g))).cast("bigint").alias("buckets"))
        for g in grains
    ]
    return base.agg(F.array(*each).alias("all")).select(F.inline("all"))


def choose_grain(
    counts: dict[str, int], rows: int, low: datetime, high: datetime, has_clock: bool, resolution: str | None
) -> str:
    """The finest calendar step that reads cleanly.

    It stays within the bucket limit and the recorded resolution, and holds
    either about one row per step or enough rows for a steady figure.
    """
    span = (high - low) / timedelta(milliseconds=1)
    finest = {"year": "year", "month": "month"}.get(resolution, "hour")
    usable = [
        g for i, g in enumerate(GRAINS)
        if i >= GRAINS.index(finest)
        and span / fixed.GRAIN_SIZES[g] <= fixed.MAX_BUCKETS
        and (g != "hour" or hours_usable(low, high, has_clock))
    ]
    for i, g in enumerate(usable):
        per_bucket = rows / counts[g]
        coarser = counts[usable[i + 1]] if i + 1 < len(usable) else 0
        if per_bucket <= 1.5 or per_bucket >= fixed.STEADY_BUCKET_ROWS or coarser < fixed.MIN_BUCKETS:
            return g
    return usable[-1] if usable else "year"


def hours_usable(low: datetime, high: datetime, has_clock: bool | None) -> bool:
    return bool(has_clock) and high - low <= timedelta(days=3)


def expected_buckets(buckets: DataFrame, grain: str) -> DataFrame:
    """Every step from the first to the last bucket."""
    ends = buckets.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    return ends.where("low is not null").select(
        F.explode(F.sequence("low", "high", F.expr(_step(grain)))).alias("bucket")
    )


def gap_fill(buckets: DataFrame, grain: str) -> DataFrame:
    """Add empty steps as zeros when at most a fifth of the steps are empty.

    The added column ``gaps`` is the number of empty steps.
    """
    values = [c for c in buckets.columns if c != "bucket"]
    full = expected_buckets(buckets, grain).join(buckets.withColumn("__here", F.lit(True)), "bucket", "left")
    every = Window.partitionBy()
    gaps = F.count_if(F.col("__here").isNull()).over(every)
    filled = full.withColumn("gaps", gaps).withColumn("__steps", F.count(F.lit(1)).over(every))
    fill = F.col("gaps") / F.col("__steps") <= 0.2
    kept = filled.where(F.col("__here").isNotNull() | fill)
    return kept.select("bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values], "gaps")


def trim_partial_edges(buckets: DataFrame, grain: str, low: Column, high: Column) -> DataFrame:
    """Drop a first or last step of which the data covers less than three quarters.

    Only for week and coarser, and only from eight steps up. A day is added to
    the last moment, because a date stands for its whole day.
    """
    if grain in ("hour", "day"):
        return buckets
    every = Window.partitionBy()
    start, end = F.col("bucket"), next_bucket(F.col("bucket"), grain)

    def seconds(later: Column, earlier: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6

    first = (start == F.min("bucket").over(every)) & (seconds(end, low) / seconds(end, start) < 0.75)
    after = high + F.expr("INTERVAL 1 DAY")
    last = (start == F.max("bucket").over(every)) & (seconds(after, start) / seconds(end, start) < 0.75)
    enough = F.count(F.lit(1)).over(every) >= fixed.MIN_BUCKETS + 2
    marked = buckets.withColumn("__partial", enough & (first | last))
    return marked.where(~F.col("__partial")).drop("__partial")


def trend_points(
    buckets: DataFrame, grain: str, low: Column, high: Column, measure: int | None = None, additive: bool = False,
    stamped: bool = False,
) -> DataFrame:
    """(bucket, value) of one column of ``time_buckets``: gaps filled and partial edges dropped.

    Means are neither filled nor trimmed; steps without a value are left out.
    ``stamped`` says that the moments already stand for whole steps.
    """
    if measure is None:
        points = buckets.select("bucket", F.col("rows").cast("double").alias("value"))
    elif additive:
        points = buckets.select("bucket", F.coalesce(F.col(f"sum_{measure}"), F.lit(0.0)).alias("value"))
    else:
        return buckets.where(F.col(f"n_{measure}") > 0).select("bucket", F.col(f"mean_{measure}").alias("value"))
    points = gap_fill(points, grain).drop("gaps")
    return points if stamped else trim_partial_edges(points, grain, low, high)


def trend_series(
    df: DataFrame, time: str, grain: str, measure: str | None = None, additive: bool = False, stamped: bool = False
) -> DataFrame:
    """(bucket, value): a count, total or mean per calendar step."""
    buckets = time_buckets(df, time, grain, [measure] if measure else [])
    ends = df.agg(F.struct(F.min(time).alias("low"), F.max(time).alias("high"))).scalar()
    return trend_points(buckets, grain, ends["low"], ends["high"], 0 if measure else None, additive, stamped)


def series_points(series: DataFrame, grain: str, with_year: bool = True, unit: str | None = None) -> DataFrame:
    """(bucket, x, label, value, display): a series placed on a 0–1 axis."""
    every = Window.partitionBy()
    at = F.unix_micros(F.col("bucket").cast("timestamp"))
    span = F.greatest(F.lit(1), F.max(at).over(every) - F.min(at).over(every))
    return series.select(
        "bucket", ((at - F.min(at).over(every)) / span).alias("x"),
        shown.time_bucket_text(F.col("bucket"), grain, with_year).alias("label"), "value",
        shown.number_text(F.col("value"), unit).alias("display"),
    )


def sequence_points(df: DataFrame, sequence: str, measure: str) -> DataFrame:
    """(position, x, step, value): a measure in counter order, numbered from 1."""
    known = df.select(F.col(sequence).alias("step"), F.col(measure).alias("value"))
    known = known.where("step is not null and value is not null")
    placed = row_index(known, ["step"], "place")
    last = known.agg(F.count(F.lit(1)) - 1).scalar()
    x = F.when(last == 0, 0.0).otherwise(F.col("place") / last)
    return placed.select((F.col("place") + 1).alias("position"), x.alias("x"), "step", "value")


# --- spread of one measure --------------------------------------------------------------------
def bin_plan(
    n: int, low: float, high: float, q1: float, q3: float, p02: float, p98: float, integer: bool
) -> dict | None:
    """Where the bars of a histogram start, how wide and how many they are."""
    spread = q3 - q1
    open_high = spread > 0 and high > q3 + 4 * spread
    open_low = spread > 0 and low < q1 - 4 * spread
    high, low = (p98 if open_high else high), (p02 if open_low else low)
    if high <= low:
        return None
    target = max(6, min(14, shown.half_up(math.sqrt(n))))
    step = shown.nice_step((high - low) / target)
    if integer:
        step = max(1, shown.half_up(step))
    first = math.floor(low / step) * step
    count = max(1, math.ceil((high - first) / step + 1e-9))
    return {"first": first, "step": step, "count": count, "open_high": open_high, "open_low": open_low, "spread": spread}


def histogram_bins(df: DataFrame, measure: str, plan: dict) -> DataFrame:
    """(bin, low, high, count): every bar, empty ones too; tails go into the end bars."""
    first, step, count = plan["first"], plan["step"], plan["count"]
    place = F.floor((F.col(measure) - F.lit(first)) / F.lit(step))
    place = F.greatest(F.lit(0), F.least(F.lit(count - 1), place)).cast("bigint")
    counted = df.where(F.col(measure).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bars = df.sparkSession.range(count).select(
        F.col("id").alias("bin"),
        (F.lit(float(first)) + F.col("id") * F.lit(float(step))).alias("low"),
        (F.lit(float(first)) + (F.col("id") + 1) * F.lit(float(step))).alias("high"),
    )
    return bars.join(counted, "bin", "left").fillna(0, ["count"]).orderBy("bin")


# --- two measures, and places -----------------------------------------------------------------
def scatter_points(df: DataFrame, x: str, y: str, stride: int, order_by: list[str] | None = None) -> DataFrame:
    """Every ``stride``-th pair in row order, or a fixed share of the rows when there is no order."""
    keep = list(dict.fromkeys([*(order_by or []), x, y]))
    pairs = df.select(*keep).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if stride <= 1:
        chosen = pairs
    elif order_by:
        chosen = row_index(pairs, order_by, "__place").where(F.col("__place") % stride == 0)
    else:
        # Of n equal pairs n / stride stay, rounded up or down by a hash, so no pair is favoured.
        counted = pairs.groupBy(x, y).agg(F.count("*").alias("__n"))
        lucky = F.pmod(F.xxhash64(x, y), F.lit(stride)) < F.col("__n") % stride
        kept = F.floor(F.col("__n") / stride) + lucky.cast("int")
        chosen = counted.withColumn("__kept", kept).where("__kept > 0").select(x, y, F.explode(F.sequence(F.lit(1), "__kept")))
    return chosen.select(F.col(x).alias("x"), F.col(y).alias("y"))


def place_bounds(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """One row: number of located rows, the box around them, and its width over its height."""
    both = df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    box = both.agg(
        F.count(F.lit(1)).alias("located"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        F.min(lng).alias("min_lng"), F.max(lng).alias("max_lng"),
    )
    on_earth = (F.col("min_lat") >= -90) & (F.col("max_lat") <= 90) & (F.col("min_lng") >= -180) & (F.col("max_lng") <= 180)
    squeeze = F.when(on_earth, F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))).otherwise(1.0)
    width = (F.col("max_lng") - F.col("min_lng")) * squeeze
    aspect = F.try_divide(width, F.col("max_lat") - F.col("min_lat"))
    return box.withColumn("aspect", F.greatest(F.lit(0.25), F.least(F.lit(4.0), aspect)))


def place_points(df: DataFrame, lat: str, lng: str, keep: list[str] = ()) -> DataFrame:
    """(…, x, y): rows placed in a 0–1 box, y growing downward."""
    both = df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    box = place_bounds(df, lat, lng).select(F.struct("min_lat", "max_lat", "min_lng", "max_lng")).scalar()
    x = F.try_divide(F.col(lng) - box["min_lng"], box["max_lng"] - box["min_lng"])
    y = 1 - F.try_divide(F.col(lat) - box["min_lat"], box["max_lat"] - box["min_lat"])
    return both.select(*keep, x.alias("x"), y.alias("y"))


def normalize_points(df: DataFrame, x: str, y: str, keep: list[str] = (), pad: float = 0.08) -> DataFrame:
    """(…, px, py): points in a padded 0–1 box, y growing downward."""
    box = df.agg(F.struct(
        F.min(x).alias("x0"), F.greatest(F.max(x) - F.min(x), F.lit(1e-6)).alias("w"),
        F.min(y).alias("y0"), F.greatest(F.max(y) - F.min(y), F.lit(1e-6)).alias("h"),
    )).scalar()
    inner = 1 - pad * 2
    px = pad + (F.col(x) - box["x0"]) / box["w"] * inner
    py = pad + (1 - (F.col(y) - box["y0"]) / box["h"]) * inner
    return df.select(*keep, px.alias("px"), py.alias("py"))
