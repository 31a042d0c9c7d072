"""The findings a table can support, each with a headline, a score and its own result frame.

The plan is made from the profile. The rows are then read by a few shared
jobs (groups, time steps, row order, pairs and quantiles), and the driver only
sees the few bars or points each headline is about.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as slot
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, shown
from ..functions.names import capitalize, lower_first, named
from ..functions.shown import format_count, format_number, format_ratio, format_share
from ..operators import grouping, series
from ..operators.ordering import Running, running
from ..operators.profile import TableProfile, read_field, value_counts
from ..operators.statistics import mean_difference, pearson, quantiles, rate_difference
from .kinds import Field, ranked_measures

TRAITS = "#yes-no-columns"
WIDE = ("map", "trend", "sequence")


@dataclass(frozen=True)
class Noun:
    """What one row is."""

    singular: str = "row"
    plural: str = "rows"


ROW = Noun()


@dataclass
class View:
    kind: str
    fields: list[str]
    title: str
    subtitle: str
    score: float
    chart: str
    build: Callable[[], DataFrame]
    footnote: str | None = None
    facts: dict = slot(default_factory=dict)
    named_after: list[str] | None = None

    @cached_property
    def result(self) -> DataFrame:
        """The rows of the chart; planned when first asked for."""
        return self.build()

    @property
    def view_id(self) -> str:
        return f"{self.kind}:{'+'.join(self.named_after or self.fields)}"

    @property
    def wide(self) -> bool:
        return self.kind in WIDE


# --- wording -----------------------------------------------------------------------------
def _notes(*parts: str | None) -> str | None:
    return " ".join(p for p in parts if p) or None


def missing_note(field: Field, noun: Noun) -> str | None:
    if not field.missing:
        return None
    rows = noun.singular if field.missing == 1 else noun.plural
    return f"Excludes {format_count(field.missing)} {rows} with no {lower_first(field.label)} recorded."


def aggregate_name(measure: Field, additive: bool) -> str:
    if not additive:
        return f"Average {lower_first(measure.label)}"
    if measure.label.lower() == "total" or measure.label.lower().startswith("total "):
        return measure.label
    return f"Total {lower_first(measure.label)}"


def group_name(dim: Field, label: str) -> str:
    return f"{dim.label} {label}" if dim.kind == "ordinal" else label


def _clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


# --- groups --------------------------------------------------------------------------------
def _position(dims: list[Field]) -> Column:
    """Natural order where a dimension has one, biggest group first elsewhere."""
    place = -F.col("rows").cast("double")
    label = F.col("label")
    for d in dims:
        if d.has_order:
            here = grouping.label_position(label, F.col("rows"), d.kind, d.ordered_labels)
            place = F.when(F.col("dim") == d.name, here).otherwise(place)
    return place


@dataclass
class GroupFacts:
    """The few rows every group headline needs."""

    bars: dict[tuple[str, str], list]  # (dimension, metric) → leading groups
    totals: dict[tuple[str, str], object]
    tests: dict[tuple[str, str], object]
    rates: dict[tuple[str, str], list]
    rate_tests: dict[tuple[str, str], object]


def sums_up(measure: Field, dim: Field) -> bool:
    """Totals over an ordered scale mostly restate how many rows sit at each step."""
    return bool(measure.additive) and dim.kind != "ordinal"


def group_facts(typed: DataFrame, dims: list[Field], measures: list[Field], flags: list[Field]) -> GroupFacts:
    groups = grouping.group_rows(typed, [d.name for d in dims], [m.name for m in measures], [f.name for f in flags])
    groups = groups.withColumn("place", _position(dims)).persist()
    try:
        return _collect_groups(groups, dims, measures, flags)
    finally:
        groups.unpersist()


def _collect_groups(groups: DataFrame, dims: list[Field], measures: list[Field], flags: list[Field]) -> GroupFacts:
    ordinal = F.col("dim").isin([d.name for d in dims if d.kind == "ordinal"] or [""])
    metrics = [F.struct(
        F.lit("").alias("metric"), F.col("rows").alias("n"), F.col("rows").cast("double").alias("value"),
        F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("variance"),
    )]
    for i, m in enumerate(measures):
        total = F.lit(bool(m.additive)) & ~ordinal
        enough = F.col(f"n_{i}") >= F.when(total, 1).otherwise(fixed.MIN_GROUP)
        metrics.append(F.when(enough, F.struct(
            F.lit(m.name).alias("metric"), F.col(f"n_{i}").alias("n"),
            F.when(total, F.col(f"sum_{i}")).otherwise(F.col(f"mean_{i}")).alias("value"),
            F.when(~total, F.col(f"mean_{i}")).alias("mean"), F.col(f"variance_{i}").alias("variance"),
        )))
    long = groups.select("dim", "label", "rows", "place", F.inline(F.filter(F.array(*metrics), lambda x: x.isNotNull())))
    key = F.struct((-F.col("value")).alias("v"), "place", "label")
    totals = long.groupBy("dim", "metric").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("value").alias("total"), F.min("value").alias("low"),
        F.max_by(F.struct("label", "value"), key).alias("bottom"),
    )
    natural = [d.name for d in dims if d.has_order]
    rank = F.row_number().over(Window.partitionBy("dim", "metric").orderBy(F.desc("value"), "place", "label"))
    # A dimension with a natural order has at most twenty labels, so all of them are kept.
    leading = long.where(~F.col("dim").isin(natural or [""])).withColumn("rank", rank).where(F.col("rank") <= fixed.MAX_BARS)
    every = long.where(F.col("dim").isin(natural or [""])).withColumn("rank", F.lit(0))
    bars: dict[tuple[str, str], list] = {}
    for row in leading.unionByName(every).collect():
        bars.setdefault((row.dim, row.metric), []).append(row)
    for rows in bars.values():
        rows.sort(key=lambda r: (-r["value"], r.place, r.label))

    tests = {}
    if measures:
        means = long.where("mean is not null").select("dim", "metric", "n", "mean", "variance")
        tests = {(r.dim, r.metric): r for r in mean_difference(means, ["dim", "metric"]).collect()}

    rates: dict[tuple[str, str], list] = {}
    rate_tests = {}
    narrow = [d for d in dims if d.kind != "entity" and d.distinct <= fixed.MAX_BARS]
    if flags and narrow:
        least = F.lit(10)
        for d in narrow:
            least = F.when(F.col("dim") == d.name, max(10, -(-d.present * 2 // 100))).otherwise(least)
        each = [
            F.struct(F.lit(f.name).alias("flag"), F.col(f"yes_{i}").alias("yes"), F.col(f"known_{i}").alias("total"))
            for i, f in enumerate(flags)
        ]
        known = groups.where(F.col("dim").isin([d.name for d in narrow])).select(
            "dim", "label", "place", F.inline(F.array(*each))
        ).where(F.col("total") >= least)
        for row in known.collect():
            rates.setdefault((row.dim, row.flag), []).append(row)
        rate_tests = {(r.dim, r.flag): r for r in rate_difference(known, ["dim", "flag"]).collect()}
    return GroupFacts(bars, {(r.dim, r.metric): r for r in totals.collect()}, tests, rates, rate_tests)


def count_view(typed: DataFrame, dim: Field, facts: GroupFacts, noun: Noun) -> View | None:
    """How many rows fall in each group."""
    ranked = facts.bars.get((dim.name, ""), [])
    if len(ranked) < 2:
        return None
    totals = facts.totals[(dim.name, "")]
    groups, top, second = totals.groups, ranked[0], ranked[1]
    if groups > 2 and top["value"] == totals.low:
        return None
    share = top["value"] / dim.present
    leader = group_name(dim, top.label)
    if dim.has_order:
        title = f"{leader} has the most {noun.plural} ({format_count(top['value'])})"
    elif second["value"] / top["value"] >= 0.92:
        title = f"{dim.label}: {leader} and {group_name(dim, second.label)} are nearly tied"
    else:
        title = f"{dim.label}: {leader} leads with {format_share(share)} of {noun.plural}"
    score = 0.3 if share > 0.9 else 0.34 if share < 0.25 and groups > fixed.MAX_BARS else 0.5
    limit = fixed.MAX_ORDERED_BARS if dim.has_order else fixed.MAX_BARS
    cut = groups > limit and dim.kind == "entity"
    return View(
        "ranking", [dim.name], capitalize(title), f"Number of {noun.plural} by {lower_first(dim.label)}",
        score - 0.08 if dim.has_order else score, "bars",
        lambda: grouping.count_bars(typed, dim.name, dim.kind, dim.ordered_labels),
        _notes(f"Top {limit} of {format_count(groups)} shown." if cut else None, missing_note(dim, noun)),
    )


def measure_view(typed: DataFrame, dim: Field, measure: Field, facts: GroupFacts, noun: Noun) -> View | None:
    """A measure totalled or averaged per group."""
    at = (dim.name, measure.name)
    ranked, totals = facts.bars.get(at, []), facts.totals.get(at)
    if totals is None or totals.groups < 2:
        return None
    additive = sums_up(measure, dim)
    limit = fixed.MAX_ORDERED_BARS if dim.has_order else fixed.MAX_BARS
    drawn = sorted(ranked, key=lambda r: (r.place, r.label))[:limit] if dim.has_order else ranked[:limit]
    if any(r["value"] < 0 for r in drawn):
        return None
    top, subject = ranked[0], aggregate_name(measure, additive)
    leader = group_name(dim, top.label)
    best = format_number(top["value"], measure.unit)
    if additive:
        title = f"{leader} leads {lower_first(measure.label)} with {best}"
        if totals.total > 0:
            title += f", {format_share(top['value'] / totals.total)} of the total"
        spread = 0 if top["value"] == 0 else 1 - ranked[1]["value"] / top["value"]
        score = 0.6 + _clamp(spread, 0, 1) * 0.2
    else:
        test = facts.tests[at]
        last, worst = group_name(dim, totals.bottom.label), format_number(totals.bottom["value"], measure.unit)
        if not test.significant:
            title, score = f"{subject} is similar across {lower_first(dim.label)}", 0.18
        else:
            if totals.groups == 2:
                title = f"{leader} averages {best} {lower_first(measure.label)}, against {worst} for {last}"
            else:
                title = f"{leader} has the highest {lower_first(subject)} ({best}); {last} the lowest ({worst})"
            score = 0.2 if test.eta_squared > 0.9 else 0.5 + _clamp(test.eta_squared * 0.9, 0, 0.35)
    cut = not dim.has_order and totals.groups > len(drawn)
    return View(
        "ranking", [dim.name, measure.name], capitalize(title), f"{subject} by {lower_first(dim.label)}", score, "bars",
        lambda: grouping.measure_bars(typed, dim.name, measure.name, additive, dim.kind, dim.ordered_labels, measure.unit),
        _notes(
            f"Top {len(drawn)} of {format_count(totals.groups)} shown." if cut else None,
            None if additive else f"Groups with fewer than {fixed.MIN_GROUP} {noun.plural} are left out.",
        ),
    )


def rate_view(typed: DataFrame, dim: Field, flag: Field, facts: GroupFacts, noun: Noun) -> View | None:
    """How often a flag is yes within each group."""
    at = (dim.name, flag.name)
    groups = facts.rates.get(at, [])
    if len(groups) < 2:
        return None
    ranked = sorted(groups, key=lambda r: (-r.yes / r.total, r.place, r.label))
    test = facts.rate_tests[at]
    top, bottom = ranked[0], ranked[-1]
    high, low = top.yes / top.total, bottom.yes / bottom.total
    first, last = group_name(dim, top.label), group_name(dim, bottom.label)
    real = test.significant and high - low >= 0.05
    by_definition = high == 1 or low == 0 or test.cramers_v > 0.8
    if not real:
        title, score = f"{flag.label} is about as common across {lower_first(dim.label)}", 0.15
    else:
        score = 0.28 if by_definition else 0.5 + _clamp(test.cramers_v * 1.2, 0, 0.4)
        if len(groups) > 2:
            title = f"{flag.label} is most common for {first} ({format_share(high)}) and least for {last} ({format_share(low)})"
        elif low > 0 and high / low >= 1.3:
            title = f"{flag.label} is {format_ratio(high / low)} as common for {first} as for {last}"
        else:
            title = f"{flag.label} is more common for {first} ({format_share(high)}) than for {last} ({format_share(low)})"
    return View(
        "rate", [dim.name, flag.name], capitalize(title),
        f"Share of {noun.plural} with {lower_first(flag.label)}, by {lower_first(dim.label)}", score, "bars",
        lambda: grouping.rate_bars(typed, dim.name, flag.name, dim.kind, dim.ordered_labels), missing_note(dim, noun),
        {"overall": test.overall, "reference": f"Overall {format_share(test.overall)}"},
    )


def traits_view(typed: DataFrame, flags: list[Field], noun: Noun) -> View | None:
    """Several yes/no columns side by side; the profile already holds their counts."""
    if len(flags) < 3:
        return None
    rated = sorted(flags, key=lambda f: -f.yes / f.present)
    drawn = rated[:fixed.MAX_BARS]
    top, bottom = rated[0], drawn[-1]
    title = (
        f"{top.label} is the most common, in {format_share(top.yes / top.present)} of {noun.plural}; "
        f"{lower_first(bottom.label)} the least at {format_share(bottom.yes / bottom.present)}"
    )
    note = f"A {noun.singular} can be marked yes in more than one column."
    if len(rated) > len(drawn):
        note = f"Top {len(drawn)} of {len(rated)} yes/no columns shown."
    return View(
        "traits", [TRAITS], capitalize(title), f"Share of {noun.plural} marked yes in each yes/no column", 0.62, "bars",
        lambda: grouping.trait_bars(typed, [f.name for f in flags]), note, named_after=[f.name for f in flags],
    )


# --- time ------------------------------------------------------------------------------------
def trend_views(typed: DataFrame, time: Field, measures: list[Field], noun: Noun, most: int | None = 2) -> list[View]:
    """Rows, and the ``most`` first measures, along a date column: one grouping for all of them."""
    low, high = time.time_min, time.time_max
    known = time.present
    if low is None or low == high or known < 3:
        return []
    hourly = series.hours_usable(low, high, time.has_clock)
    counts = {r.grain: r.buckets for r in series.grain_counts(typed, time.name, hourly).collect()}
    grain = series.choose_grain(counts, known, low, high, bool(time.has_clock), time.resolution)
    drawn = measures[:most]
    steps = series.time_buckets(typed, time.name, grain, [m.name for m in drawn])
    # One row per calendar step: small by construction, so it is kept as a local frame.
    spark = typed.sparkSession
    rows = sorted(steps.collect(), key=lambda r: r.bucket)
    steps = spark.createDataFrame(rows, steps.schema)
    filled = {r.bucket for r in rows}
    along = Steps(steps, grain, rows[0].bucket, rows[-1].bucket, len(filled), series.expected_buckets(steps, grain).count())
    views = [trend_view(along, time, None, None, noun)]
    views += [trend_view(along, time, i, m, noun) for i, m in enumerate(drawn)]
    return [v for v in views if v]


@dataclass
class Steps:
    """Rows grouped by calendar step, and how many steps there should be."""

    frame: DataFrame
    grain: str
    first: object
    last: object
    filled: int
    expected: int


def _correlation(x, y) -> float:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 3 or x.std() == 0 or y.std() == 0:
        return 0.0
    return float(np.corrcoef(x, y)[0, 1])


def trend_view(along: Steps, time: Field, index: int | None, measure: Field | None, noun: Noun) -> View | None:
    grain = along.grain
    additive = bool(measure and measure.additive)
    summed = measure is None or additive
    low, high = (F.lit(str(t)).cast("timestamp_ntz") for t in (time.time_min, time.time_max))
    stamped = time.resolution == grain
    points = series.trend_points(along.frame, grain, low, high, index, additive, stamped)
    unit = measure.unit if measure else None
    with_year = along.first.year != along.last.year
    rows = sorted(points.collect(), key=lambda r: r.bucket)
    if len(rows) < 3:
        return None
    values = [r["value"] for r in rows]
    if measure is None:
        mean = float(np.mean(values))
        if mean == 0 or float(np.std(values)) / mean < 0.12:
            return None
    subject = aggregate_name(measure, additive) if measure else capitalize(noun.plural)
    third = max(1, len(values) // 3)
    early, late = float(np.mean(values[:third])), float(np.mean(values[-third:]))
    change = 0.0 if early == 0 else (late - early) / abs(early)
    drift = _correlation([(r.bucket - rows[0].bucket).total_seconds() for r in rows], values)
    note = None
    if len(values) >= 6 and abs(drift) >= 0.45 and abs(change) >= 0.2:
        verb = "rose" if change > 0 else "fell"
        title = f"{subject} {verb} {format_share(abs(change))} from the start of the period to the end"
        note = "The change compares the average of the first third of the period with the last third."
        highlight = len(values) - 1
    else:
        highlight = int(np.argmax(values))
        peak = rows[highlight]
        place = {"day": "on", "hour": "on", "week": "in the"}.get(grain, "in")
        label = shown.format_time_bucket(peak.bucket, grain, with_year).replace("Week of ", "week of ")
        display = format_number(peak["value"], unit) if measure else format_count(peak["value"])
        title = f"{subject} peaked {place} {label} at {display}"
    gaps = along.expected - along.filled
    kept_gaps = gaps > 0 and not (summed and gaps / along.expected <= 0.2)
    trimmed = 0
    if summed and not stamped and grain not in ("hour", "day"):
        trimmed = (along.first != rows[0].bucket) + (along.last != rows[-1].bucket)
    edge = {
        0: None,
        1: f"The partial {grain} at the edge of the range is only partly covered and not shown.",
        2: f"The first and last {grain}s are only partly covered and not shown.",
    }[trimmed]
    blank = None
    if kept_gaps:
        blank = (
            f"{gaps} {grain}{'' if gaps == 1 else 's'} in the range {'has' if gaps == 1 else 'have'} no {noun.plural} "
            f"and {'is' if gaps == 1 else 'are'} left blank."
        )
    return View(
        "trend", [time.name] + ([measure.name] if measure else []), capitalize(title),
        f"{subject} per {grain}, by {lower_first(time.label)}", 0.9 if measure else 0.86, "line",
        lambda: series.series_points(points, grain, with_year, unit),
        _notes(note, edge, blank, missing_note(time, noun)),
        {"grain": grain, "highlight": highlight, "zero_based": summed, "markers": len(rows) <= 40},
    )


# --- row order ---------------------------------------------------------------------------------
def order_facts(typed: DataFrame, sequence: Field, measures: list[Field]) -> dict[str, object]:
    """Per measure, along the sequence: smoothness, likeness to a clock, and the ends of the series."""
    known = typed.select(sequence.name, *[m.name for m in measures]).where(F.col(sequence.name).isNotNull())
    values = {}
    for i, m in enumerate(measures):
        values[f"__p{i}"] = Running("last", F.col(m.name), before=True)
        values[f"__i{i}"] = Running("count", F.col(m.name))
    ordered = running(known, [sequence.name], values)
    step = F.col(sequence.name)
    each = []
    for i, m in enumerate(measures):
        v = F.col(m.name)
        at = F.when(v.isNotNull(), step)
        each.append(F.struct(
            F.lit(m.name).alias("name"), F.count(v).alias("points"),
            pearson(v, F.col(f"__p{i}")).alias("smooth"),
            pearson(F.when(v.isNotNull(), F.col(f"__i{i}")), v).alias("clock"),
            F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"), F.min(v).alias("low"), F.max(v).alias("high"),
        ))
    rows = ordered.agg(F.array(*each).alias("all")).select(F.inline("all")).collect()
    return {r["name"]: r for r in rows}


def smoothness(fact) -> float:
    return fact.smooth if fact.points >= 4 else 0.0


def sequence_view(typed: DataFrame, sequence: Field, measures: list[Field], facts: dict, noun: Noun) -> View | None:
    """The smoothest measure along the sequence, unless it only counts rows."""
    usable = [
        m for m in measures
        if facts[m.name].points >= 8 and smoothness(facts[m.name]) >= 0.7 and abs(facts[m.name].clock) <= 0.985
    ]
    if not usable:
        return None
    measure = max(usable, key=lambda m: smoothness(facts[m.name]))
    f = facts[measure.name]
    first, last = (format_number(v, measure.unit) for v in (f["first"], f["last"]))
    turn = ""
    if f.high > max(f["first"], f["last"]):
        turn = f", peaking at {format_number(f.high, measure.unit)}"
    elif f.low < min(f["first"], f["last"]):
        turn = f", dipping to {format_number(f.low, measure.unit)}"
    title = f"{measure.label} went from {first} to {last} over {format_count(f.points)} {noun.plural}{turn}"
    return View(
        "sequence", [sequence.name, measure.name], capitalize(title),
        f"{measure.label} at each {noun.singular}, in {lower_first(sequence.label)} order", 0.82, "line",
        lambda: series.sequence_points(typed, sequence.name, measure.name), facts={"zero_based": f.low >= 0},
    )


# --- spread, relation, map -------------------------------------------------------------------------
_QUANTILES = [0.02, 0.25, 0.5, 0.75, 0.98]


def value_facts(typed: DataFrame, spreads: list[Field], related: list[Field]) -> tuple[dict, list]:
    """Quantiles of some measures, and correlations of all pairs of others.

    Quantiles are read off value counts, so that equal values meet before they
    are brought together; the profile says which columns have too many
    different values for that. Pairs of complete columns share the spread of
    each column.
    """
    light = [m.name for m in spreads if 0 < m.distinct <= 1_000_000]
    found = {}
    if light:
        counts = value_counts(typed.select(*light), light)
        middle = F.percentile(F.col("value"), _QUANTILES, F.col("n")).alias("q")
        found = {r["column"]: list(r.q) for r in counts.groupBy("column").agg(middle).collect()}
    for m in spreads:
        if m.distinct > 1_000_000:
            found[m.name] = quantiles(typed, m.name, _QUANTILES)
    pairs = [(a, b) for i, a in enumerate(related) for b in related[i + 1:]]
    if not pairs:
        return found, []
    # Values are taken from their mean, so that plain sums of products lose no digits.
    centred = {m.name: F.col(m.name) - F.lit(float(m.mean)) for m in related}
    whole = {m.name for m in related if not m.missing}
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, m in enumerate(related):
        x = centred[m.name]
        parts += [F.sum(x).alias(f"sum_{i}"), F.sum(x * x).alias(f"square_{i}")]
    for i, (a, b) in enumerate(pairs):
        x, y = centred[a.name], centred[b.name]
        product = F.sum(x * y)
        if a.name in whole and b.name in whole:
            parts.append(product.alias(f"pair_{i}"))
            continue
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        parts.append(F.struct(
            F.count_if(both).alias("n"), product.alias("xy"), F.sum(x).alias("x"), F.sum(y).alias("y"),
            F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"),
        ).alias(f"pair_{i}"))
    row = typed.agg(*parts).first()
    place = {m.name: i for i, m in enumerate(related)}

    def sums(i: int, a: Field, b: Field) -> tuple:
        if a.name in whole and b.name in whole:
            p, q = place[a.name], place[b.name]
            return row["rows"], row[f"pair_{i}"], row[f"sum_{p}"], row[f"sum_{q}"], row[f"square_{p}"], row[f"square_{q}"]
        return tuple(row[f"pair_{i}"])

    return found, [_pair(a, b, *sums(i, a, b)) for i, (a, b) in enumerate(pairs)]


@dataclass
class Pair:
    x: str
    y: str
    pairs: int
    r: float
    slope: float
    intercept: float


def _pair(a: Field, b: Field, n: int, xy: float, x: float, y: float, xx: float, yy: float) -> Pair:
    if n < 3:
        return Pair(a.name, b.name, n, 0.0, 0.0, 0.0)
    mean_x, mean_y = x / n, y / n
    cov, var_x, var_y = xy / n - mean_x * mean_y, xx / n - mean_x ** 2, yy / n - mean_y ** 2
    middle_x, middle_y = a.mean + mean_x, b.mean + mean_y
    if var_x <= 0 or var_y <= 0:
        return Pair(a.name, b.name, n, 0.0, 0.0, middle_y)
    slope = cov / var_x
    return Pair(a.name, b.name, n, cov / (var_x * var_y) ** 0.5, slope, middle_y - slope * middle_x)


def histogram_view(typed: DataFrame, measure: Field, q: list[float] | None, noun: Noun) -> View | None:
    """How one measure is distributed."""
    if q is None or measure.present < 12 or measure.distinct < 6:
        return None
    p02, q1, median, q3, p98 = q
    plan = series.bin_plan(measure.present, measure.min, measure.max, q1, q3, p02, p98, bool(measure.integer))
    if plan is None:
        return None
    name, unit = lower_first(measure.label), measure.unit
    middle = format_number(median, unit)
    if q1 == q3:
        title = f"Most {noun.plural} have {name} of {middle}"
    else:
        title = (
            f"Typical {name} is {middle}; half of {noun.plural} fall between "
            f"{format_number(q1, unit)} and {format_number(q3, unit)}"
        )
    cut = plan["open_high"] or plan["open_low"]
    return View(
        "histogram", [measure.name], capitalize(title), f"Number of {noun.plural} at each level of {name}",
        0.44 if cut else 0.38, "histogram", lambda: label_bins(series.histogram_bins(typed, measure.name, plan), plan, bool(measure.integer), unit),
        _notes("Extreme values are gathered into the end bars." if cut else None, missing_note(measure, noun)),
        {**plan, "median": median, "median_label": f"Median {middle}"},
    )


def label_bins(bins: DataFrame, plan: dict, integer: bool, unit: str | None = None) -> DataFrame:
    """Add the text under each bar; open end bars read "… or more" and "… or less"."""
    low = shown.number_text(F.col("low"), unit)
    top = F.col("high") - 1 if integer else F.col("high")
    high = shown.number_text(top, unit)
    label = low if integer and plan["step"] == 1 else F.concat(low, F.lit(" to "), high)
    if plan["open_low"]:
        label = F.when(F.col("bin") == 0, F.concat(high, F.lit(" or less"))).otherwise(label)
    if plan["open_high"]:
        label = F.when(F.col("bin") == plan["count"] - 1, F.concat(low, F.lit(" or more"))).otherwise(label)
    return bins.withColumn("label", label)


def scatter_view(typed: DataFrame, fields: dict[str, Field], pairs: list, order_by: list[str], noun: Noun) -> View | None:
    """The most strongly related pair of measures, short of one being computed from the other."""
    usable = [p for p in pairs if p.pairs >= 20 and 0.4 <= abs(p.r) <= 0.95]
    if not usable:
        return None
    best = max(usable, key=lambda p: abs(p.r))
    x, y = fields[best.x], fields[best.y]
    stride = -(-best.pairs // fixed.MAX_SCATTER_POINTS)
    drawn = -(-best.pairs // stride)
    title = (
        f"{y.label} {'rises' if best.r > 0 else 'falls'} as {lower_first(x.label)} increases, "
        f"{'closely' if abs(best.r) >= 0.7 else 'loosely'} linked (r = {best.r:.2f})"
    )
    note = None
    if stride > 1:
        about = "" if order_by else "about "
        note = f"Showing {about}{format_count(drawn)} of {format_count(best.pairs)} {noun.plural}."
    return View(
        "scatter", [x.name, y.name], capitalize(title),
        f"Each dot is one {noun.singular}: {lower_first(x.label)} across, {lower_first(y.label)} up",
        0.3 + abs(best.r) * 0.45, "scatter", lambda: series.scatter_points(typed, x.name, y.name, stride, order_by), note,
        {"r": best.r, "slope": best.slope, "intercept": best.intercept, "stride": stride},
    )


def map_view(typed: DataFrame, profile: TableProfile, lat: Field, lng: Field, noun: Noun) -> View | None:
    """Every row placed by its coordinates, and the busiest place; the fact ``places`` makes the bars of all places."""
    box = series.place_bounds(typed, lat.name, lng.name).first()
    if box.located < 5 or box.min_lat == box.max_lat or box.min_lng == box.max_lng:
        return None
    place = next((
        f for f in profile.fields
        if f.kind in ("category", "entity") and named(fixed.PLACE_DIMENSION_NAME, f.name) and f.distinct >= 3
    ), None)
    top = (place.top[0] if not place.ordered_labels else (place.ordered_labels[0], dict(place.top)[place.ordered_labels[0]])) if place else None
    title = f"Where the {format_count(box.located)} {noun.plural} are"
    if top:
        busiest = f"{place.label} {top[0]}" if len(top[0]) <= 4 else top[0]
        title = f"{busiest} has the most {noun.plural}: {format_count(top[1])} of {format_count(box.located)}"
    lost = profile.row_count - box.located
    note = None
    if lost:
        note = (
            f"{format_count(lost)} {noun.singular if lost == 1 else noun.plural} with no coordinates "
            f"{'is' if lost == 1 else 'are'} not shown."
        )
    places = (lambda: grouping.count_bars(typed, place.name, place.kind, place.ordered_labels)) if place and place.label_count >= 3 else None
    return View(
        "map", [lat.name, lng.name] + ([place.name] if place else []), capitalize(title),
        f"Each dot is one {noun.singular}, placed by its coordinates", 0.95, "map",
        lambda: series.place_points(typed, lat.name, lng.name, [place.name] if place else []), note,
        {"aspect": box.aspect, "places": places}, named_after=[lat.name, lng.name],
    )


# --- all of them -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Breadth:
    """How many measures, totals first, are followed in time, compared between groups, spread out and related; None: all."""

    trends: int | None = 2
    groups: int | None = 4
    spreads: int | None = 3
    related: int | None = 8


def candidate_views(df: DataFrame, profile: TableProfile, noun: Noun = ROW, breadth: Breadth = Breadth()) -> list[View]:
    """Every view the table can support within a breadth, in a fixed order."""
    dims = [f for f in profile.fields if f.is_dimension]
    flags = profile.of_kind("flag")
    measures = ranked_measures(profile.fields)
    first = {k: next(iter(profile.of_kind(k)), None) for k in ("time", "sequence", "latitude", "longitude")}
    used = [f for f in profile.fields if f.is_dimension or f.kind in ("flag", "measure", *first)]
    if not used:
        return []
    order = [f"__order_{i}" for i in range(len(profile.order_by))]
    raw = df.select("*", *[F.col(c).alias(o) for c, o in zip(profile.order_by, order)])
    types = {f.name: f.dataType for f in df.schema.fields}
    typed = raw.select(*order, *[read_field(f, types[f.name]).alias(f.name) for f in used])

    views: list[View | None] = []
    if first["latitude"] and first["longitude"]:
        views.append(map_view(typed, profile, first["latitude"], first["longitude"], noun))
    if first["time"]:
        views += trend_views(typed, first["time"], measures, noun, breadth.trends)
    related = measures
    if first["sequence"] and measures:
        facts = order_facts(typed, first["sequence"], measures)
        if not first["time"]:
            views.append(sequence_view(typed, first["sequence"], measures, facts, noun))
        # Two running totals rise together whatever they measure, so those are not compared.
        related = [m for m in measures if smoothness(facts[m.name]) < 0.7]
    views.append(traits_view(typed, flags, noun))
    if dims:
        facts = group_facts(typed, dims, measures[:breadth.groups], flags)
        for dim in dims:
            views.append(count_view(typed, dim, facts, noun))
            views += [measure_view(typed, dim, m, facts, noun) for m in measures[:breadth.groups]]
            views += [rate_view(typed, dim, f, facts, noun) for f in flags]
    spread, pairs = value_facts(typed, measures[:breadth.spreads], related[:breadth.related]) if measures else ({}, [])
    views += [histogram_view(typed, m, spread.get(m.name), noun) for m in measures[:breadth.spreads]]
    views.append(scatter_view(typed, {f.name: f for f in measures}, pairs, order, noun))
    return [v for v in views if v]
