"""How numbers, shares and dates read in headlines and result tables.

Each format exists twice: as a Column expression for result frames, and as a
plain function for the few values that go into a headline.
"""

from __future__ import annotations

import math
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, functions as F

MINUS = "−"


# --- plain values --------------------------------------------------------------
def _fixed(value: float, decimals: int, commas: bool = False) -> str:
    exact = Decimal(value).quantize(Decimal(1).scaleb(-decimals), rounding=ROUND_HALF_UP)
    text = f"{exact:,.{decimals}f}" if commas else f"{exact:.{decimals}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def half_up(value: float) -> int:
    return math.floor(value + 0.5)


def format_number(value: float | None, unit: str | None = None) -> str:
    if value is None or not math.isfinite(value):
        return "–"
    size = abs(value)
    if size >= 1e9:
        body = _fixed(size / 1e9, 1 if size >= 1e10 else 2) + "B"
    elif size >= 1e6:
        body = _fixed(size / 1e6, 1 if size >= 1e7 else 2) + "M"
    elif size >= 1e4:
        body = _fixed(size / 1e3, 0 if size >= 1e5 else 1) + "K"
    else:
        decimals = 0 if float(size).is_integer() or size >= 100 else 1 if size >= 10 else 2 if size >= 1 else 3
        body = _fixed(size, decimals, commas=True)
    sign = MINUS if value < 0 else ""
    return f"{sign}{body}%" if unit == "%" else f"{sign}{unit or ''}{body}"


def format_share(ratio: float) -> str:
    if ratio is None or not math.isfinite(ratio):
        return "–"
    percent = ratio * 100
    if 0 < percent < 1:
        return "<1%"
    if 99 < percent < 100:
        return ">99%"
    if percent < 10 and not float(percent).is_integer():
        return _fixed(percent, 1) + "%"
    return f"{half_up(percent)}%"


def format_count(value: float) -> str:
    return f"{int(value):,}"


def format_ratio(ratio: float) -> str:
    return (str(half_up(ratio)) if ratio >= 10 else _fixed(ratio, 1)) + "×"


def format_day(moment: datetime) -> str:
    return f"{moment:%b} {moment.day}, {moment.year}"


def format_time_bucket(moment: datetime, grain: str, with_year: bool) -> str:
    if grain == "year":
        return str(moment.year)
    if grain == "quarter":
        return f"Q{(moment.month - 1) // 3 + 1} {moment.year}"
    if grain == "month":
        return f"{moment:%b} {moment.year}"
    day = f"{moment:%b} {moment.day}" + (f", {moment.year}" if with_year else "")
    if grain == "week":
        return f"Week of {day}"
    if grain == "hour":
        return f"{day}, {moment.hour % 12 or 12} {'AM' if moment.hour < 12 else 'PM'}"
    return day


def nice_step(rough: float) -> float:
    power = 10.0 ** math.floor(math.log10(rough))
    fraction = rough / power
    return next(m for m in (1, 2, 5, 10) if fraction <= m or m == 10) * power


def nice_ticks(low: float, high: float, target: int = 4) -> list[float]:
    """Evenly spaced round axis values covering low to high."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return [0]
    if low == high:
        return [low]
    step = nice_step((high - low) / max(1, target))
    first = math.floor(low / step) * step
    count = math.ceil((high + step * 0.999 - first) / step - 1e-12)
    return [float(f"{first + i * step:.12g}") for i in range(min(count, 41))]


# --- columns -------------------------------------------------------------------
def _tidy(text: Column) -> Column:
    """Drop zeros that follow a decimal point, and the point when nothing follows it."""
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _rounded(c: Column, decimals: int) -> Column:
    return _tidy(F.format_number(F.round(c, decimals), decimals))


def number_text(c: Column, unit: Column | str | None = None) -> Column:
    """1284 → 1,284; 12940 → 12.9K; 4200000 with $ → $4.2M."""
    c = c.cast("double")
    size = F.abs(c)
    body = (
        F.when(size >= 1e10, F.concat(_rounded(size / 1e9, 1), F.lit("B")))
        .when(size >= 1e9, F.concat(_rounded(size / 1e9, 2), F.lit("B")))
        .when(size >= 1e7, F.concat(_rounded(size / 1e6, 1), F.lit("M")))
        .when(size >= 1e6, F.concat(_rounded(size / 1e6, 2), F.lit("M")))
        .when(size >= 1e5, F.concat(_rounded(size / 1e3, 0), F.lit("K")))
        .when(size >= 1e4, F.concat(_rounded(size / 1e3, 1), F.lit("K")))
        .when((size == F.floor(size)) | (size >= 100), _rounded(size, 0))
        .when(size >= 10, _rounded(size, 1))
        .when(size >= 1, _rounded(size, 2))
        .otherwise(_rounded(size, 3))
    )
    unit = F.lit(unit) if unit is None or isinstance(unit, str) else unit
    unit = F.coalesce(unit.cast("string"), F.lit(""))
    sign = F.when(c < 0, MINUS).otherwise("")
    text = F.when(unit == "%", F.concat(sign, body, unit)).otherwise(F.concat(sign, unit, body))
    return F.when(F.isnan(c) | c.isNull() | (size == float("inf")), "–").otherwise(text)


def share_text(ratio: Column) -> Column:
    percent = ratio.cast("double") * 100
    return (
        F.when(percent.isNull() | F.isnan(percent), "–")
        .when((percent > 0) & (percent < 1), "<1%")
        .when((percent > 99) & (percent < 100), ">99%")
        .when((percent < 10) & (percent != F.floor(percent)), F.concat(_rounded(percent, 1), F.lit("%")))
        .otherwise(F.concat(F.floor(percent + 0.5).cast("string"), F.lit("%")))
    )


def count_text(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def ratio_text(ratio: Column) -> Column:
    near = F.when(ratio >= 10, F.floor(ratio + 0.5).cast("string")).otherwise(_rounded(ratio, 1))
    return F.concat(near, F.lit("×"))


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "MMM d, yyyy")


def time_bucket_text(moment: Column, grain: str, with_year: bool) -> Column:
    if grain == "year":
        return F.date_format(moment, "yyyy")
    if grain == "quarter":
        return F.concat(F.lit("Q"), F.quarter(moment).cast("string"), F.lit(" "), F.date_format(moment, "yyyy"))
    if grain == "month":
        return F.date_format(moment, "MMM yyyy")
    day = F.date_format(moment, "MMM d, yyyy" if with_year else "MMM d")
    if grain == "week":
        return F.concat(F.lit("Week of "), day)
    if grain == "hour":
        return F.concat(day, F.lit(", "), F.date_format(moment, "h a"))
    return day


def lower_first_text(c: Column) -> Column:
    lowered = F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))
    return F.when(c.rlike("^[A-Z]{2}"), c).otherwise(lowered)


def team_code(c: Column) -> Column:
    """Initials of a name of several words, or the first three letters of one word."""
    words = F.filter(F.split(F.btrim(c), r"\s+"), lambda w: F.length(w) > 0)
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    one = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("TEAM"))
    return F.upper(F.substring(F.when(F.size(words) > 1, initials).otherwise(one), 1, 3))


def nice_step_column(rough: Column) -> Column:
    """The 1-2-5 step at or above a rough step."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    fraction = rough / power
    factor = F.when(fraction <= 1, 1).when(fraction <= 2, 2).when(fraction <= 5, 5).otherwise(10)
    return factor * power
