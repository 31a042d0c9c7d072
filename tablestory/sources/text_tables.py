"""Delimited text in and out, with checks on what was read."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import cells, fixed
from ..session import pinned
from . import quoted_lines


class TableError(ValueError):
    """A table that cannot be used as it is."""


# --- reading ---------------------------------------------------------------------------------
def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """(delimiter): the most frequent of comma, tab, semicolon and bar in the first line, else a comma.

    ``lines`` has one text column ``value``, its first row being the header.
    Delimiters inside quotes do not count.
    """
    header = lines.limit(1).select(F.regexp_replace("value", r'"([^"]|"")*"', "").alias("line"))
    counts = [F.length("line") - F.length(F.replace(F.col("line"), F.lit(d), F.lit(""))) for d in fixed.DELIMITERS]
    most = F.greatest(*counts)
    best = F.when(most == 0, F.lit(","))
    for d, n in zip(fixed.DELIMITERS, counts):
        best = best.when(n == most, F.lit(d))
    return header.select(best.alias("delimiter"))


def tidy_header(names: list[str]) -> list[str]:
    """Trim names, drop wrapping or stray trailing quotes, and reject unusable headers."""
    tidy = []
    for name in names:
        cell = name.strip()
        if len(cell) >= 2 and cell[0] == cell[-1] == '"':
            cell = cell[1:-1].strip()
        if cell.endswith('"') and cell.count('"') == 1:
            cell = cell[:-1].strip()
        tidy.append(cell)
    if not tidy or any(not c or len(c) > fixed.CSV_MAX_HEADER_LENGTH for c in tidy):
        raise TableError("The header is missing or invalid")
    if len({c.lower() for c in tidy}) < len(tidy):
        raise TableError("The header names a column twice")
    return tidy


def _header(text: str, sep: str) -> list[str]:
    return tidy_header(next(csv.reader(io.StringIO(text.lstrip("\ufeff")), delimiter=sep), []))


def _reject(found: DataFrame) -> tuple[bool, str]:
    """Whether lines break inside quotes, and the first line, of files that are delimited text."""
    head = F.decode(F.min(F.when(F.col("start") == 0, F.col("head"))), "UTF-8")
    seen = found.agg(
        F.bool_or("breaks").alias("breaks"), F.bool_or("spoilt").alias("spoilt"), F.sum("filled").alias("filled"), head.alias("head"),
        F.bool_or(F.decode("head", "UTF-8").rlike(fixed.NOT_DELIMITED)).alias("other")).first()
    if seen.spoilt or seen.other:
        raise TableError("The file is not delimited text")
    if not seen.filled:
        raise TableError("The file has no data rows")
    return bool(seen.breaks), seen.head


def read_csv(
    spark: SparkSession, path: str, sep: str | None = None, multi_line: bool | None = None,
    required: list[str] = (), row_index: str | None = None,
) -> DataFrame:
    """Read delimited text (plain or gzip) as strings: short rows padded, blank rows dropped.

    A first pass over the lines rejects HTML, NUL bytes and text that is not UTF-8, and finds out whether
    quoted fields hold line breaks; such files are still read in blocks, by many tasks, and the breaks
    become line feeds. ``multi_line`` says what the pass would find. No data rows are an error. ``row_index``
    adds a number that grows with the place in a file.
    """
    if sep is None:
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1)
        found = sniff_delimiter(first).first()
        if found is None:
            raise TableError("The file has no data rows")
        sep = found.delimiter
    found = pinned(quoted_lines.blocks(spark, path, sep))
    breaks, head = _reject(found)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if breaks if multi_line is None else multi_line:
        records = quoted_lines.records(spark, path, sep, found)
        names = _header(records.where("first").agg(F.min("record").cast("string").alias("header")).first().header or "", sep)
        columns = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = F.from_csv(F.col("record").cast("string"), columns, {**options, "lineSep": "\x01"})
        df = records.where("NOT first").select((F.col("start") + F.col("k")).alias("__at"), parsed.alias("row"))
        df = df.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)], F.col("__at").alias(row_index or "__at"))
        df = df if row_index else df.drop("__at")
    else:
        names = _header(head, sep)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, **options).toDF(*names)
        if row_index:
            df = df.withColumn(row_index, F.monotonically_increasing_id())
    missing = [c for c in required if c not in names]
    if missing:
        raise TableError(f"Required columns are missing: {', '.join(missing)}")
    filled = None
    for c in names:
        here = F.length(F.trim(F.col(f"`{c}`"))) > 0
        filled = here if filled is None else filled | here
    df = df.where(F.coalesce(filled, F.lit(False)))
    if df.isEmpty():
        raise TableError("The file has no data rows")
    return df


def check_bounds(
    df: DataFrame, max_rows: int = fixed.CSV_MAX_ROWS, max_columns: int = fixed.CSV_MAX_COLUMNS,
    max_cell: int = fixed.CSV_MAX_CELL_LENGTH,
) -> DataFrame:
    """(rule, found, allowed) for every limit the table breaks, from one aggregate."""
    longest = F.greatest(F.lit(0), *[F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c in df.columns])
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), longest.cast("bigint").alias("cell"))
    rules = F.array(
        F.struct(F.lit("rows").alias("rule"), F.col("rows").alias("found"), F.lit(max_rows).cast("bigint").alias("allowed")),
        F.struct(F.lit("columns").alias("rule"), F.lit(len(df.columns)).cast("bigint").alias("found"),
                 F.lit(max_columns).cast("bigint").alias("allowed")),
        F.struct(F.lit("cell").alias("rule"), F.col("cell").alias("found"), F.lit(max_cell).cast("bigint").alias("allowed")),
    )
    return sizes.select(F.inline(rules)).where("found > allowed")


# --- types -------------------------------------------------------------------------------------
_BOOLEAN_WORD = r"(?i)^(true|false|yes|no)$"
_NUMBER_WORD = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type): empty, boolean, number or string, from one aggregate over the text of all columns."""
    def kind(c: str) -> Column:
        text = cells.squeeze(F.col(f"`{c}`").cast("string"))
        text = F.when(F.length(text) > 0, text)
        words, numbers = F.count_if(text.rlike(_BOOLEAN_WORD)), F.count_if(text.rlike(_NUMBER_WORD))
        filled = F.count(text)
        name = (
            F.when(filled == 0, "empty").when(words == filled, "boolean").when(numbers == filled, "number")
            .otherwise("string")
        )
        return F.struct(F.lit(c).alias("column"), name.alias("type"))

    return df.agg(F.array(*map(kind, df.columns)).alias("all")).select(F.inline("all"))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Type text columns: blanks to null, numbers to double, true/yes and false/no to boolean.

    A column typed number only holds numbers, so nothing is lost by the cast.
    """
    def typed(c: str) -> Column:
        raw = F.col(f"`{c}`").cast("string")
        text = cells.squeeze(raw)
        if types[c] == "number":
            return text.try_cast("double")
        if types[c] == "boolean":
            word = F.lower(text)
            return F.when(word.isin("true", "yes"), True).when(word.isin("false", "no"), False)
        return F.when(F.length(text) > 0, raw)

    return df.select(*[typed(c).alias(c) for c in df.columns])


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read delimited text and type its columns."""
    raw = read_csv(spark, path, **options)
    return coerce(raw, {r["column"]: r["type"] for r in infer_types(raw).collect()})


def flatten_values(df: DataFrame) -> DataFrame:
    """Keep scalar columns; arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- writing -----------------------------------------------------------------------------------
def escape_formulas(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Put an apostrophe before cells a spreadsheet would run as a formula."""
    def safe(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)

    columns = columns or df.columns
    return df.select(*[safe(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def csv_text(df: DataFrame) -> DataFrame:
    """Cells as they are written: whole numbers without a point, lower-case booleans, blanks for null."""
    return df.select(*[
        cells.label_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in flatten_values(df).schema.fields
    ])


def write_csv(df: DataFrame, path: str, safe: bool = False) -> None:
    """Write comma-separated text, quoted only where needed."""
    out = csv_text(flatten_values(df))
    if safe:
        out = escape_formulas(out)
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def safe_file_name(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", text)[:80] or "run"
