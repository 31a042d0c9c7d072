"""Column profiling: what every column holds, in a few jobs for the whole table.

All columns are counted together: one unpivot and one pre-aggregated shuffle
give the different values of each column, and numbers, dates and flags are
parsed once per different value instead of once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import cells, fixed
from ..functions.names import calendar_order
from ..plans import kinds
from ..plans.kinds import Field
from .ordering import previous
from .statistics import pearson

#: Texts beyond this length are grouped by their hash; what they say is read from the whole cell beforehand.
_LONG_TEXT = 256
#: Pairs of columns that share one aggregate of sketches, and the slack of a sketch's count (six standard errors).
_PAIRS_AT_ONCE, _SLACK = 64, 1.1
_TOP = 24
_NESTED = (T.ArrayType, T.MapType, T.StructType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


# --- one cell -------------------------------------------------------------------------
def cell_text(name: str, dtype: T.DataType) -> Column:
    """The text of a cell, null when missing. Midnight stamps show as dates."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        stamp = c.cast("timestamp_ntz")
        whole = stamp == F.date_trunc("day", stamp).cast("timestamp_ntz")
        return F.when(whole, stamp.cast("date").cast("string")).otherwise(stamp.cast("string"))
    text = cells.label_text(c, dtype)
    return F.when(~cells.is_missing(c if not isinstance(dtype, _NESTED) else text, dtype), text)


def _family(dtype: T.DataType) -> str:
    """Columns that can share one value column without losing anything."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "timestamp_ntz" if isinstance(dtype, _TEMPORAL) else "string"


def _families(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c in columns:
        found.setdefault(_family(df.schema[c].dataType), []).append(c)
    return found


def _read_text(text: Column) -> Column:
    """What the text of a cell says: a flag, a number with its unit, the parts of a date."""
    number = cells.as_number(text)
    return F.struct(
        cells.as_flag(text).isNotNull().alias("flag"), number.alias("num"), F.when(number.isNotNull(), cells.number_unit(text)).alias("unit"),
        cells.date_parts(text).alias("parts"), cells.date_first_part(text).alias("first_part"), cells.has_clock(text).alias("clock"))


def value_counts(df: DataFrame, columns: list[str], order_by: list[str] | None = None, read: bool = False) -> DataFrame:
    """(column, value, n[, first_row][, read]): how often each present value of like columns occurs.

    One pre-aggregated shuffle for all of them. Numbers and moments are
    counted as such; very long texts are counted by their SHA-256, which keeps
    the shuffle small. With ``read``, these carry what the whole text says, and
    of short ones it is read once per different value.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str) -> Column:
        family, column = _family(types[c]), F.col(f"`{c}`")
        if family == "double":
            number = F.when(~cells.is_missing(column, types[c]), column.cast("double"))
            return F.when(number == 0, F.lit(0.0)).otherwise(number)
        if family != "string":
            return column.cast(family)
        text = cell_text(c, types[c])
        if isinstance(types[c], (T.StringType, *_NESTED)):
            return F.when(F.length(text) > _LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)
        return text

    order = [F.struct(*order_by).alias("__row")] if order_by else []
    def both(c: str) -> Column:
        text = cell_text(c, types[c])
        return F.struct(value(c).alias("value"), F.when(F.length(text) > _LONG_TEXT, _read_text(text)).alias("read"))

    flat = df.select(*order, *[(both(c) if read else value(c)).alias(c) for c in columns])
    long = flat.unpivot(["__row"] if order_by else [], columns, "column", "cell")
    long = long.select(*(["__row"] if order_by else []), "column", *(["cell.value", "cell.read"] if read else [F.col("cell").alias("value")]))
    first = [F.min("__row").alias("first_row")] if order_by else []
    keys = ["column", "value"] + (["read"] if read else [])
    counted = long.where("value is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first)
    return counted.withColumn("read", F.coalesce("read", _read_text(F.col("value")))) if read else counted


def distinct_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, present, missing, distinct) for every column."""
    columns = list(columns or df.columns)
    counted = None
    for like in _families(df, columns).values():
        part = value_counts(df, like).groupBy("column").agg(
            F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct")
        )
        counted = part if counted is None else counted.unionByName(part)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    rows = df.agg(F.count(F.lit(1)))
    joined = names.join(counted, "column", "left").fillna(0, ["present", "distinct"])
    return joined.select("column", "present", (rows.scalar() - F.col("present")).alias("missing"), "distinct")


def top_labels(df: DataFrame, column: str) -> DataFrame:
    """(value, n) by descending count, then label."""
    text = cells.squeeze(cell_text(column, df.schema[column].dataType))
    counted = df.select(text.alias("value")).where("value is not null").groupBy("value")
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, min, max, sum, mean, integer) from one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def stats(c: str) -> Column:
        v = cells.as_number(F.col(c), types[c])
        return F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.bool_and(v == F.floor(v)).alias("integer"),
        )

    return df.agg(F.array(*map(stats, columns)).alias("all")).select(F.inline("all"))


def monotonic_share(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(column, present, steps, rising, not_falling) in row order, missing values skipped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {f"__v{i}": cells.as_number(F.col(c), types[c]) for i, c in enumerate(columns)}
    slim = df.select(*order_by, *[v.alias(k) for k, v in values.items()])
    lagged = previous(slim, order_by, {f"__p{i}": F.col(f"__v{i}") for i in range(len(columns))})
    each = []
    for i, c in enumerate(columns):
        now, before = F.col(f"__v{i}"), F.col(f"__p{i}")
        each.append(F.struct(
            F.lit(c).alias("column"), F.count(now).alias("present"),
            F.count_if(now.isNotNull() & before.isNotNull()).alias("steps"),
            F.count_if(now > before).alias("rising"), F.count_if(now >= before).alias("not_falling"),
        ))
    counts = lagged.agg(F.array(*each).alias("all")).select(F.inline("all"))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("rising"), F.col("steps")), F.lit(0.0)))


def is_monotonic(df: DataFrame, column: str, order_by: list[str]) -> bool:
    """At least 3 values, and 85 % of the steps do not fall."""
    row = monotonic_share(df, [column], order_by).first()
    return row.present >= 3 and row.not_falling / row.steps >= 0.85


def date_order(df: DataFrame, column: str) -> DataFrame:
    """(day_first): true when any first part can only be a day."""
    return df.agg(F.coalesce(F.max(cells.date_first_part(F.col(column))) > 12, F.lit(False)).alias("day_first"))


def resolution(moment: Column) -> Column:
    """The coarsest calendar step all values sit on: year, month or day."""
    first = (F.dayofmonth(moment) == 1)
    return (
        F.when(F.bool_and(first & (F.month(moment) == 1)), "year").when(F.bool_and(first), "month").otherwise("day")
    )


def restatements(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(first, second, paired, bijective) for pairs of label columns.

    All pairs share one pre-aggregated shuffle of their different value pairs.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    both = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"),
                 F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
        for a, b in pairs
    ]
    seen = (
        df.select(*columns).select(F.inline(F.array(*both))).where("x is not null and y is not null")
        .groupBy("first", "second", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    return seen.groupBy("first", "second").agg(
        F.sum("n").alias("paired"),
        ((F.count(F.lit(1)) == F.count_distinct("x")) & (F.count(F.lit(1)) == F.count_distinct("y"))).alias("bijective"),
    )


def near_pairs(df: DataFrame, pairs: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    """The pairs of columns that may restate each other; ``pairs`` gives the different values of either column.

    One sketch of the different value pairs each, many pairs in one aggregate: rows are never multiplied.
    """
    found, names = [], list(pairs)
    for at in range(0, len(names), _PAIRS_AT_ONCE):
        some = names[at:at + _PAIRS_AT_ONCE]
        counts = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(a, b)), F.lit(12))).alias(f"p{k}")
            for k, (a, b) in enumerate(some)]).first()
        found += [p for p, n in zip(some, counts) if (n or 0) <= pairs[p] * _SLACK + 1]
    return found


def flag_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``restatements`` of all pairs of flag columns, from the four counts of yes and no.

    A task adds up the products of its columns as matrices and sends one row per pair.
    """
    k = len(columns)
    low, high = np.triu_indices(k, 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, known = np.zeros((k, k)), np.zeros((k, k))
        mixed = np.zeros((k, k))
        for batch in batches:
            there = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(np.float64)
            true = np.stack([np.asarray(c.fill_null(False)) for c in batch.columns], axis=1).astype(np.float64)
            yes, known, mixed = yes + true.T @ true, known + there.T @ there, mixed + true.T @ there
        counts = [yes[low, high], mixed[low, high] - yes[low, high], mixed[high, low] - yes[low, high]]
        counts.append(known[low, high] - sum(counts))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (low, high, *counts)], ["a", "b", "yy", "yn", "ny", "nn"])

    made = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        products, "a bigint, b bigint, yy bigint, yn bigint, ny bigint, nn bigint")
    cells_ = ["yy", "yn", "ny", "nn"]
    sums = made.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in cells_])
    name = F.array(*map(F.lit, columns))

    def values(*sides: str) -> Column:
        return sum(((F.expr(side) > 0).cast("int") for side in sides), F.lit(0))

    different = values(*cells_)
    return sums.select(
        name[F.col("a").cast("int")].alias("first"), name[F.col("b").cast("int")].alias("second"), F.expr("yy + yn + ny + nn").alias("paired"),
        ((different == values("yy + yn", "ny + nn")) & (different == values("yy + ny", "yn + nn"))).alias("bijective"))


# --- the whole table ----------------------------------------------------------------------
@dataclass
class TableProfile:
    """Roles of all columns, and the way back from raw cells to typed values."""

    row_count: int
    fields: list[Field]
    order_by: list[str]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def of_kind(self, *wanted: str) -> list[Field]:
        return [f for f in self.fields if f.kind in wanted]

    def has_row_order(self) -> bool:
        return bool(self.of_kind("time", "sequence"))

    def typed(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Typed columns under their own names: labels, numbers, flags and moments."""
        types = {f.name: f.dataType for f in df.schema.fields}
        fields = [f for f in self.fields if names is None or f.name in names]
        return df.select(*[read_field(f, types[f.name]).alias(f.name) for f in fields])

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                f.name, f.label, f.kind, f.present, f.missing, f.distinct, [tuple(t) for t in f.top],
                f.ordered_labels, f.min, f.max, f.mean, f.sum, f.integer, f.additive, f.unit, f.has_clock, f.resolution,
            )
            for f in self.fields
        ]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)


PROFILE_SCHEMA = (
    "column string, label string, kind string, present bigint, missing bigint, distinct bigint, "
    "top array<struct<value:string,count:bigint>>, ordered_labels array<string>, min double, max double, "
    "mean double, sum double, integer boolean, additive boolean, unit string, has_clock boolean, resolution string"
)


def read_field(field: Field, dtype: T.DataType) -> Column:
    """The typed value of a cell, by the role of its column."""
    c = F.col(f"`{field.name}`")
    if field.kind == "time":
        if isinstance(dtype, _TEMPORAL):
            return c.cast("timestamp_ntz")
        if field.reader == "compact":
            return cells.compact_date(cells.as_number(c, dtype))
        if field.reader == "year":
            year = cells.as_number(c, dtype).cast("int")
            return F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        return F.when(~cells.is_missing(c), cells.as_time(c, field.day_first))
    if field.kind == "flag":
        return cells.as_flag(c, dtype)
    if field.kind == "ordinal":
        return cells.label_text(cells.as_number(c, dtype), T.DoubleType())
    if field.kind in ("measure", "sequence", "latitude", "longitude"):
        return cells.as_number(c, dtype)
    return cells.squeeze(cell_text(field.name, dtype))


_STEPS = "min timestamp_ntz, max timestamp_ntz, resolution string, found bigint"


def _column_facts(df: DataFrame, order_by: list[str]) -> DataFrame:
    """One row of facts per column; only text is parsed, once per different value."""
    facts = None
    for family, columns in _families(df, df.columns).items():
        text = family == "string"
        counts = value_counts(df, columns, order_by if text else None, read=text)
        part = {"string": _text_facts, "timestamp_ntz": _moment_facts}.get(family, _number_facts)(counts, bool(order_by))
        facts = part if facts is None else facts.unionByName(part)
    return facts


def _calendar(moment: Column, n: Column) -> Column:
    """Range, resolution and number of the moments that could be read."""
    return F.struct(
        F.min(moment).alias("min"), F.max(moment).alias("max"), resolution(moment).alias("resolution"),
        F.sum(F.when(moment.isNotNull(), n).otherwise(0)).alias("found"),
    )


def _no_calendar() -> Column:
    return F.lit(None).cast(f"struct<{_STEPS.replace(' ', ':').replace(',:', ',')}>")


def _year_start(number: Column) -> Column:
    year = F.when((number == F.floor(number)) & number.between(1000, 2200), number.cast("int"))
    return F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def _number_columns(num: Column, n: Column, flag: Column) -> list[Column]:
    return [
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"),
        F.sum(F.when(flag, n).otherwise(0)).alias("flags"),
        F.sum(F.when(num.isNotNull(), n).otherwise(0)).alias("numbers"),
        F.min(num).alias("num_min"), F.max(num).alias("num_max"), F.sum(num * n).alias("num_sum"),
        F.bool_and(num == F.floor(num)).alias("integer"),
    ]


def _number_facts(counts: DataFrame, ordered: bool) -> DataFrame:
    v, n = F.col("value").cast("double"), F.col("n")
    read = counts.withColumn("num", v).withColumn("compact", cells.compact_date(F.col("num")))
    return read.groupBy("column").agg(
        *_number_columns(F.col("num"), n, F.col("num").isin(0.0, 1.0)),
        F.lit(None).cast("string").alias("unit"), F.lit(False).alias("day_first"), F.lit(False).alias("clock"),
        _calendar(F.col("compact"), n).alias("compact"), _calendar(_year_start(F.col("num")), n).alias("year"),
        _no_calendar().alias("mdy"), _no_calendar().alias("dmy"),
    )


def _moment_facts(counts: DataFrame, ordered: bool) -> DataFrame:
    v, n = F.col("value"), F.col("n")
    none = F.lit(None).cast("double")
    return counts.groupBy("column").agg(
        *_number_columns(none, n, F.lit(False)),
        F.lit(None).cast("string").alias("unit"), F.lit(False).alias("day_first"),
        F.bool_or(v != F.date_trunc("day", v).cast("timestamp_ntz")).alias("clock"),
        _no_calendar().alias("compact"), _no_calendar().alias("year"),
        _calendar(v, n).alias("mdy"), _no_calendar().alias("dmy"),
    )


def _text_facts(counts: DataFrame, ordered: bool) -> DataFrame:
    n = F.col("n")
    # Staged, so that each step is computed once per different value.
    parsed = counts.select("column", "n", *(["first_row"] if ordered else []), "read.*").withColumns({
        "month_first": cells.moment_of(F.col("parts"), False), "day_first": cells.moment_of(F.col("parts"), True),
        "compact": cells.compact_date(F.col("num")),
    })
    # The unit is the one met first in row order; without an order, the most frequent one.
    if ordered:
        unit = F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("first_row")))
    else:
        used = [F.struct(F.sum(F.when(F.col("unit") == u, n).otherwise(0)), F.lit(u).alias("unit")) for u in "$€£%"]
        unit = F.when(F.count("unit") > 0, F.array_max(F.array(*used))["unit"])
    return parsed.groupBy("column").agg(
        *_number_columns(F.col("num"), n, F.col("flag")),
        unit.alias("unit"),
        F.coalesce(F.max("first_part") > 12, F.lit(False)).alias("day_first"),
        F.coalesce(F.bool_or("clock"), F.lit(False)).alias("clock"),
        _calendar(F.col("compact"), n).alias("compact"), _calendar(_year_start(F.col("num")), n).alias("year"),
        _calendar(F.col("month_first"), n).alias("mdy"), _calendar(F.col("day_first"), n).alias("dmy"),
    )


def profile_table(df: DataFrame, order_by: list[str] | None = None) -> TableProfile:
    """Assign a role to every column.

    ``order_by`` states the row order. Roles that depend on it (a running
    counter, a clock) are only given when it is there.
    """
    order_by = list(order_by or [])
    types = {f.name: f.dataType for f in df.schema.fields}
    facts = {r["column"]: r for r in _column_facts(df, order_by).collect()}
    row_count = df.count()
    fields: list[Field] = []
    for name in df.columns:
        field = Field(name, types[name].simpleString(), reader=_reader(types[name]))
        row = facts.get(name)
        field.present, field.distinct = (row.present, row.distinct) if row else (0, 0)
        field.missing = row_count - field.present
        fields.append(field)

    candidates = [f.name for f in fields if f.present and kinds.may_be_sequence(f, facts[f.name])]
    rising: dict[str, float] = {}
    if order_by and candidates:
        rising = {r["column"]: r["share"] for r in monotonic_share(df, candidates, order_by).collect()}
    for field in fields:
        kinds.classify(field, facts.get(field.name), rising.get(field.name))
        if field.kind == "time" and isinstance(types[field.name], _TEMPORAL):
            field.reader = "native"
    kinds.pair_coordinates(fields)
    sequences = [f for f in fields if f.kind == "sequence"]
    for extra in sequences[1:]:
        extra.kind = "id"
    profile = TableProfile(row_count, fields, order_by)
    if sequences:
        _drop_clocks(df, profile, sequences[0])
    _add_labels(df, profile)
    _drop_restatements(df, profile)
    return profile


def profile(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per column: role, counts, top labels and number facts."""
    return profile_table(df, order_by).to_df(df.sparkSession)


def _reader(dtype: T.DataType) -> str:
    return "text" if isinstance(dtype, (T.StringType, *_TEMPORAL)) else "other"


def _drop_clocks(df: DataFrame, profile: TableProfile, sequence: Field) -> None:
    """A measure that moves in step with the row order is a clock, not a finding."""
    measures = [f.name for f in profile.fields if f.kind == "measure"]
    if not measures:
        return
    typed = profile.typed(df, [sequence.name, *measures])
    for row in clock_scores(typed, sequence.name, measures).collect():
        if row.clock:
            profile.field(row["column"]).kind = "id"


def clock_scores(df: DataFrame, sequence: str, measures: list[str]) -> DataFrame:
    """(column, pairs, r, clock): correlation of each measure with the sequence, in one aggregate."""
    each = [
        F.struct(
            F.lit(m).alias("column"),
            F.count_if(F.col(m).isNotNull() & F.col(sequence).isNotNull()).alias("pairs"),
            pearson(F.col(sequence), F.col(m)).alias("r"),
        )
        for m in measures
    ]
    scored = df.agg(F.array(*each).alias("all")).select(F.inline("all"))
    return scored.withColumn("clock", (F.col("pairs") >= 8) & (F.abs("r") > 0.97))


def _add_labels(df: DataFrame, profile: TableProfile) -> None:
    """Top labels and label lengths of every column that can group rows."""
    grouping = [f for f in profile.fields if f.kind in kinds.GROUPABLE]
    if not grouping:
        return
    typed = profile.typed(df, [f.name for f in grouping])
    text = typed.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in grouping])
    counts = (
        text.unpivot([], [f.name for f in grouping], "column", "label").where("label is not null")
        .groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("labels"), F.avg(F.length("label")).alias("length")
    )
    place = Window.partitionBy("column").orderBy(F.desc("n"), "label")
    top = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= _TOP)
    for row in top.join(F.broadcast(totals), "column").orderBy("column", "place").collect():
        field = profile.field(row["column"])
        field.top.append((row.label, row.n))
        field.label_count, field.mean_label_length = row.labels, row.length
    for field in grouping:
        if field.kind == "flag":
            field.yes = dict(field.top).get("true", 0)
            field.top = []
        elif field.kind == "category":
            field.ordered_labels = calendar_order([label for label, _ in field.top])


def _drop_restatements(df: DataFrame, profile: TableProfile) -> None:
    """Of two columns that say the same thing, the one that reads worse becomes text."""
    grouping = [f for f in profile.fields if f.kind in kinds.GROUPABLE]
    pairs = {
        (a.name, b.name): (a, b) for i, a in enumerate(grouping) for b in grouping[i + 1:] if a.distinct == b.distinct
    }
    if not pairs:
        return
    typed = profile.typed(df, list(dict.fromkeys(c for p in pairs for c in p)))
    flags = [f.name for f in grouping if f.kind == "flag"]
    near = near_pairs(typed, {p: a.distinct for p, (a, b) in pairs.items() if not (a.kind == b.kind == "flag")})
    rows = flag_pairs(typed, flags).collect() if len(flags) > 1 else []
    rows += restatements(typed, near).collect() if near else []
    same = {(r["first"], r["second"]): r.paired for r in rows if r.bijective}
    for pair, (a, b) in pairs.items():
        if "text" not in (a.kind, b.kind) and same.get(pair, 0) >= max(4, min(a.present, b.present) * 0.9):
            kinds.worse(a, b).kind = "text"


# --- shape of a table -----------------------------------------------------------------------
_NATIVE_TYPES = {"numeric": "number", "boolean": "boolean"}


def column_role(field: Field, inferred: str) -> str:
    """id, numeric, categorical, boolean, time, geo, place or empty."""
    from ..functions.names import named, normalize_name

    if field.kind == "empty":
        return "empty"
    if field.kind in ("latitude", "longitude"):
        return "geo"
    if named(fixed.PLACE_ROLE_NAME, field.name) or named(fixed.PLACE_ROLE_NAME, normalize_name(field.name)):
        return "place"
    if field.kind == "flag" or named(fixed.EATING_NAME, field.name):
        return "boolean"
    by_kind = {"time": "time", "sequence": "time", "id": "id", "measure": "numeric", "ordinal": "numeric"}
    if field.kind in by_kind:
        return by_kind[field.kind]
    return "numeric" if field.kind == "constant" and inferred == "number" else "categorical"


def inferred_type(dtype: T.DataType) -> str:
    """The type of already typed cells."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "number" if isinstance(dtype, T.NumericType) else "string"


def table_shape(df: DataFrame, table_profile: TableProfile | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """(column, type, role, cardinality, unique_ratio) per column."""
    p = table_profile or profile_table(df)
    rows = []
    for f in p.fields:
        inferred = (types or {}).get(f.name) or (
            "empty" if f.kind == "empty" else inferred_type(df.schema[f.name].dataType)
        )
        ratio = f.distinct / p.row_count if p.row_count else 0.0
        rows.append((f.name, inferred, column_role(f, inferred), f.distinct, float(ratio)))
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, role string, cardinality bigint, unique_ratio double"
    )


def shape_facts(df: DataFrame, order_by: list[str], table_profile: TableProfile | None = None) -> DataFrame:
    """One row about the whole table: size, coordinate pair, columns by role, and whether a counter rises with the rows."""
    p = table_profile or profile_table(df, order_by)
    roles: dict[str, list[str]] = {}
    for r in table_shape(df, p).collect():
        roles.setdefault(r.role, []).append(r["column"])
    lat, lng = (next((f.name for f in p.of_kind(k)), None) for k in ("latitude", "longitude"))
    # Only numbers can rise; a column named play_id decides alone when there is one.
    counters = [c for c in roles.get("time", []) if isinstance(df.schema[c].dataType, (T.NumericType, T.StringType))]
    counters = ["play_id"] if "play_id" in df.columns else counters
    steps = monotonic_share(df, counters, order_by).collect() if counters else []
    sequential = any(s.present >= 3 and s.not_falling / s.steps >= 0.85 for s in steps)
    row = (p.row_count, len(p.fields), lat, lng, *(roles.get(k, []) for k in ("place", "time", "boolean")), sequential)
    return df.sparkSession.createDataFrame(
        [row], "rows bigint, columns int, latitude string, longitude string, places array<string>, times array<string>, "
        "booleans array<string>, sequential boolean",
    )


def schema_summary(df: DataFrame, table_profile: TableProfile | None = None, types: dict[str, str] | None = None) -> list[str]:
    """Short description: "60 × 11", "Places", "Numbers 3", "Text 2" …"""
    p = table_profile or profile_table(df)
    shape = table_shape(df, p, types).collect()
    parts = [f"{p.row_count} × {len(p.fields)}"]
    if any(r.role in ("geo", "place") for r in shape):
        parts.append("Places")
    names = {"number": "Numbers", "string": "Text", "boolean": "Yes/no", "empty": "Empty"}
    for key, name in names.items():
        count = sum(1 for r in shape if r.type == key and r.role not in ("geo", "place"))
        if count:
            parts.append(name if count == 1 else f"{name} {count}")
    return parts
