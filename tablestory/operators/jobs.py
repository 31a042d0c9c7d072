"""Preparation jobs: cut a slice, credit rows to entities, split by time, label and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells, fixed
from ..functions.names import named
from .grouping import leaderboard
from .ordering import previous, row_index


def cut_slice(df: DataFrame, conditions: list[Column], order_by: list[str]) -> DataFrame:
    """Rows that meet every condition, in a stated order."""
    for condition in conditions:
        df = df.where(condition)
    return df.orderBy(*order_by)


def credit(df: DataFrame, cases: list[tuple[Column, str, str]], skip: Column | None = None) -> DataFrame:
    """Add (credited_to, credited_by): the entity of the first case that applies, unless the row is skipped.

    A case is (condition, entity column, name of the rule).
    """
    who, how = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, column, rule in reversed(cases):
        applies = condition & F.col(column).isNotNull()
        who = F.when(applies, F.col(column).cast("string")).otherwise(who)
        how = F.when(applies, F.lit(rule)).otherwise(how)
    if skip is not None:
        skipped = F.coalesce(skip, F.lit(False))
        who, how = F.when(~skipped, who), F.when(~skipped, how)
    return df.withColumn("credited_to", who).withColumn("credited_by", how)


def temporal_split(df: DataFrame, first_half: Column, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The input half, the label half, and a check row (first_rows, second_rows, crossed)."""
    first = F.coalesce(first_half, F.lit(False))
    check = df.agg(
        F.count_if(first).alias("first_rows"), F.count_if(~first).alias("second_rows"),
        F.coalesce(F.max(F.when(first, F.col(order))) >= F.min(F.when(~first, F.col(order))), F.lit(False)).alias("crossed"),
    )
    return df.where(first), df.where(~first), check


def project_allowed(df: DataFrame, fields: list[str], forbidden: set[str] | list[str]) -> DataFrame:
    """Only the allowed input columns; asking for a forbidden one is an error."""
    leaks = sorted(set(fields) & set(forbidden))
    if leaks:
        raise ValueError(f"Inputs would leak the outcome: {', '.join(leaks)}")
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"Unknown input columns: {', '.join(unknown)}")
    return df.select(*fields)


def label_winner(totals: DataFrame, names: dict[str, str] | DataFrame, other: str = "Other/Tie") -> DataFrame:
    """(label): the class of the single leader, or ``other`` when tied, unknown or absent.

    ``totals`` comes from ``leaderboard``. Names may be a small mapping or a frame (entity, label).
    """
    lead = totals.where("leads and not tied").select(F.col("entity").cast("string").alias("entity"))
    if isinstance(names, dict):
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        labelled = lead.select(F.try_element_at(known, F.col("entity")).alias("label"))
    else:
        labelled = lead.join(names.withColumn("entity", F.col("entity").cast("string")), "entity", "left").select("label")
    return labelled.agg(F.coalesce(F.max("label"), F.lit(other)).alias("label"))


def lookup_identity(df: DataFrame, dim: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, expected, found): rows whose fields differ from the record with the same key."""
    known = dim.select(F.col(key), F.lit(True).alias("__known"), *[F.col(f).alias(f"__d_{f}") for f in fields])
    both = df.select(key, *fields).join(known, key, "left")
    each = [
        F.when(~F.col(f).cast("string").eqNullSafe(F.col(f"__d_{f}").cast("string")), F.struct(
            F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"__d_{f}").cast("string").alias("found")
        ))
        for f in fields
    ]
    absent = F.array(F.struct(F.lit("*").alias("field"), F.lit("a record").alias("expected"), F.lit(None).cast("string").alias("found")))
    wrong = F.when(F.col("__known").isNull(), absent).otherwise(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return both.select(key, F.inline(wrong))


def clean_export(df: DataFrame, spec: list[tuple[str, str, str]], order_by: list[str]) -> DataFrame:
    """Rename and clean raw text columns by kind: text, coordinate, date (MMDDYYYY) or flag."""
    def cleaned(source: str, kind: str) -> Column:
        text = F.trim(F.col(f"`{source}`").cast("string"))
        if kind == "flag":
            return F.coalesce(F.lower(text) == "true", F.lit(False))
        known = F.when((text != "") & (text != "?"), text)
        if kind == "coordinate":
            return F.floor(known.try_cast("double") * 1e6 + 0.5) / 1e6
        if kind == "date":
            return F.when(known.rlike(r"^\d{8}$"), F.concat_ws(
                "-", F.substring(known, 5, 4), F.substring(known, 1, 2), F.substring(known, 3, 2)
            ))
        return known

    return df.select(*[cleaned(source, kind).alias(name) for source, name, kind in spec]).orderBy(*order_by)


def derive_rows(df: DataFrame, key: list[str], columns: dict[str, Column], number: str = "play") -> DataFrame:
    """Number rows from 1 in key order and add recoded columns."""
    keep = row_index(df, key, number).withColumn(number, F.col(number) + 1)
    return keep.select(number, *[c.alias(n) for n, c in columns.items()])


def constraint_report(df: DataFrame, rules: dict[str, Column], counts: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """(rule, broken, ok): rows that break each rule, and pinned counts, from one aggregate.

    A rule that is null for a row counts as broken.
    """
    each = [
        F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("broken"))
        for name, rule in rules.items()
    ]
    each += [
        F.struct(F.lit(name).alias("rule"), F.abs(F.count_if(c) - F.lit(wanted)).cast("bigint").alias("broken"))
        for name, (c, wanted) in (counts or {}).items()
    ]
    report = df.agg(F.array(*each).alias("all")).select(F.inline("all"))
    return report.withColumn("ok", F.col("broken") == 0)


def order_report(df: DataFrame, order_by: list[str], rising: list[str], keys: list[str] | None = None) -> DataFrame:
    """(column, not_rising): steps of each column that do not rise strictly in row order."""
    before = previous(df, order_by, {f"__p_{c}": F.col(c) for c in rising}, keys)
    each = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) <= F.col(f"__p_{c}")).alias("not_rising")) for c in rising
    ]
    return before.agg(F.array(*each).alias("all")).select(F.inline("all"))


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The first latitude- and longitude-like column names."""
    lat = next((c for c in columns if named(fixed.LAT_NAME, c)), None)
    lng = next((c for c in columns if named(fixed.LNG_NAME, c)), None)
    return (lat, lng) if lat and lng else None


def coords_of(df: DataFrame) -> DataFrame:
    """Add (latitude, longitude), null where not both are usable numbers.

    Columns named for degrees must be in range; x and y may be any plane.
    """
    pair = coordinate_columns(df.columns)
    if pair is None:
        nothing = F.lit(None).cast("double")
        return df.withColumn("latitude", nothing).withColumn("longitude", nothing)
    types = {f.name: f.dataType for f in df.schema.fields}
    lat, lng = (cells.as_number(F.col(c), types[c]) for c in pair)
    ok = lat.isNotNull() & lng.isNotNull()
    if pair[0].lower() != "y":
        ok = ok & lat.between(-90, 90)
    if pair[1].lower() != "x":
        ok = ok & lng.between(-180, 180)
    return df.withColumns({"__lat": F.when(ok, lat), "__lng": F.when(ok, lng)}).drop(
        *[c for c in df.columns if c in ("latitude", "longitude")]
    ).withColumnsRenamed({"__lat": "latitude", "__lng": "longitude"})


__all__ = [
    "clean_export", "constraint_report", "coordinate_columns", "coords_of", "credit", "cut_slice", "derive_rows",
    "label_winner", "leaderboard", "lookup_identity", "order_report", "project_allowed", "temporal_split",
]
