"""Column functions that read one cell: missing values, flags, numbers, dates.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from . import fixed


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(c: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def is_missing(c: Column, dtype: T.DataType | None = None) -> Column:
    """Null, a non-finite number, or one of the placeholder words."""
    if dtype is None or isinstance(dtype, T.StringType):
        return c.isNull() | F.lower(squeeze(c)).isin(*fixed.MISSING_TOKENS)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")).cast(dtype))
    return c.isNull()


def as_flag(c: Column, dtype: T.DataType | None = None) -> Column:
    """true/yes/y/t/1 and false/no/n/f/0; anything else is null."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.NumericType):
        return F.when(c == 1, True).when(c == 0, False)
    word = F.lower(squeeze(c))
    return F.when(word.isin(*fixed.TRUE_TOKENS, "1"), True).when(word.isin(*fixed.FALSE_TOKENS, "0"), False)


def _number_body(text: Column) -> Column:
    """The text without the brackets of an accounting negative."""
    return F.regexp_replace(text, r"^\((.*)\)$", "$1")


def as_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Read a number written with currency, thousands commas, percent or (negative) brackets."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.NumericType):
        value = c.cast("double")
        return F.when(~is_missing(value, T.DoubleType()), value)
    text = squeeze(c)
    body = _number_body(text)
    digits = squeeze(F.regexp_replace(F.translate(body, "$€£,", ""), "%$", ""))
    number = digits.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    signs_at_ends = ~body.rlike("[$€£]") | body.rlike(r"^[-+]?[$€£]|[$€£]$")
    value = F.when(number & signs_at_ends, digits.try_cast("double"))
    value = F.when(text.startswith("(") & text.endswith(")"), -value).otherwise(value)
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


def number_unit(c: Column) -> Column:
    """The unit written next to a number: a percent sign or a currency sign."""
    body = _number_body(squeeze(c))
    currency = F.regexp_extract(body, r"^[-+]?([$€£])|([$€£])$", 0)
    symbol = F.regexp_extract(currency, "[$€£]", 0)
    percent = F.translate(body, "$€£", "").endswith("%")
    return F.when(percent, "%").when(F.length(symbol) > 0, symbol)


# Shapes of dates written as text. Groups are named by the position of each part.
_CLOCK = r"(?:[T\s](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
_YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})" + _CLOCK
_YEAR_LAST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)" + _CLOCK
_YEAR_MONTH = r"^(\d{4})-(\d{1,2})$"
_MONTH_WORD = r"^(?:(\d{1,2})\s+)?([A-Za-z]{3,9})\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})$"


def date_parts(c: Column) -> Column:
    """[year, a, b, hour, minute, second, form] of a date written as text.

    ``a`` and ``b`` are month and day, except in form "L" (d/m/y or m/d/y),
    where their order depends on the column.
    """
    forms = (
        (_YEAR_FIRST, "$1|$3|$4|$5|$6|$7|F"),
        (_YEAR_LAST, "$3|$1|$2|$4|$5|$6|L"),
        (_YEAR_MONTH, "$1|$2|1||||F"),
        (_MONTH_WORD, "$4|$2|$1$3||||W"),
    )

    def flat(text: Column) -> Column:
        found = F.when(F.lit(False), text)
        for pattern, template in forms:
            whole = pattern if pattern.endswith("$") else pattern + r"[\s\S]*$"
            found = found.when(text.rlike(pattern), F.regexp_replace(text, whole, template))
        return found

    return F.split(let(squeeze(c), flat), r"\|")


def moment_of(parts: Column, day_first: bool | Column = False) -> Column:
    """The calendar moment of ``date_parts``; null for impossible days and years outside 1000–2200."""
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    swap = (parts[6] == "L") & day_first
    raw_month = F.when(swap, parts[2]).otherwise(parts[1])
    spelled = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), F.lower(F.substring(parts[1], 1, 3)))
    month = F.when(parts[6] == "W", spelled.cast("int")).otherwise(raw_month.try_cast("int"))
    raw_day = F.when(swap, parts[1]).otherwise(parts[2])
    day = F.when(raw_day == "", 1).otherwise(raw_day.try_cast("int"))
    short = F.when(parts[0] >= "70", F.concat(F.lit("19"), parts[0])).otherwise(F.concat(F.lit("20"), parts[0]))
    year = F.when(F.length(parts[0]) == 2, short).otherwise(parts[0]).try_cast("int")
    start = _day(year, month, day)
    hour, minute, second = (F.coalesce(parts[i].try_cast("int"), F.lit(0)) for i in (3, 4, 5))
    into_day = hour * 3600 + minute * 60 + second
    later = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), into_day.cast("decimal(18,6)"))
    return F.when(parts[3] == "", start).when(into_day < 86_400, later)


def _day(year: Column, month: Column, day: Column) -> Column:
    made = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    return F.when(year.between(1000, 2200), made)


def as_time(c: Column, day_first: bool | Column = False) -> Column:
    """Read a date or date-time written as text; null when it is neither."""
    return let(date_parts(c), lambda parts: moment_of(parts, day_first))


def has_clock(c: Column) -> Column:
    """Whether the text of a date carries a time of day."""
    return squeeze(c).rlike(r"^(\d{4}([-/])\d{1,2}\2\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-](\d{4}|\d{2}))[T\s]\d{1,2}:\d{2}")


def date_first_part(c: Column) -> Column:
    """The first number of d/m/y or m/d/y text; above 12 it can only be a day."""
    return F.regexp_extract(squeeze(c), r"^(\d{1,2})[/.-](\d{1,2})[/.-]", 1).try_cast("int")


def compact_date(c: Column) -> Column:
    """Eight-digit dates: YYYYMMDD first, then MMDDYYYY."""
    number = c.cast("double")
    usable = (number == F.floor(number)) & number.between(1011000, 99991231)
    text = F.lpad(F.when(usable, number.cast("bigint")).cast("string"), 8, "0")

    def piece(start: int, size: int) -> Column:
        return F.substring(text, start, size).try_cast("int")

    return F.coalesce(
        _day(piece(1, 4), piece(5, 2), piece(7, 2)),
        _day(piece(5, 4), piece(1, 2), piece(3, 2)),
    )


def calendar_position(label: Column, names: tuple[str, ...]) -> Column:
    """1-based place of a month or weekday name in the calendar, 0 when it is not one."""
    text = squeeze(label)
    place = F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(text, 1, 3)))
    return F.when(text.rlike(r"^[A-Za-z]{3,9}\.?$"), place).otherwise(F.lit(0))


def normalize_text(c: Column) -> Column:
    """Lower case, one blank between words, none around."""
    return F.lower(F.regexp_replace(squeeze(c), r"\s+", " "))


def label_text(c: Column, dtype: T.DataType) -> Column:
    """The text a value shows as: whole numbers without a decimal point, booleans in lower case."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, T.DecimalType):
        digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(c == 0, "0").otherwise(digits)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")
