"""Stored tables: hashes, metadata, and Parquet datasets keyed by dataset and row."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..operators.ordering import row_index
from ..session import configure


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def hash_sums(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, sums): what a content hash is made of, eight sums over the pieces of all row hashes.

    Sums of parts of a table add up to those of the whole, so nothing but a few numbers is brought together.
    """
    hashed = df.select(row_hash(df, columns).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(8)]
    zero = F.lit(0).cast("decimal(38,0)")
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.coalesce(p, zero) for p in pieces]).alias("sums"))


def add_sums(*parts: DataFrame) -> DataFrame:
    """The sums of a table from those of its parts."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionAll(more)
    sums = [F.sum(F.col("sums")[i]).cast("decimal(38,0)") for i in range(8)]
    return both.agg(F.sum("rows").alias("rows"), F.array(*sums).alias("sums"))


def finish_hash(sums: DataFrame) -> DataFrame:
    """(rows, content_hash) from ``hash_sums``."""
    text = F.array_join(F.transform("sums", lambda s: s.cast("string")), "|")
    whole = F.concat_ws("|", F.col("rows").cast("string"), F.when(F.col("rows") > 0, text).otherwise(""))
    return sums.select("rows", F.sha2(whole, 256).alias("content_hash"))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, content_hash): one hash for the rows of a table, whatever their order and partitions."""
    return finish_hash(hash_sums(df, columns))


def preview(df: DataFrame, order_by: list[str], n: int = fixed.CSV_PREVIEW_ROWS) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order_by).limit(n)


def table_metadata(
    df: DataFrame, dataset_id: str | None = None, display_name: str = "", source_type: str = "upload",
    created_at: int | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """One row that describes a table."""
    created = created_at if created_at is not None else int(time.time() * 1000)
    names = columns or df.columns
    return content_hash(df, names).select(
        F.lit(dataset_id or str(uuid.uuid4())).alias("dataset_id"), F.lit(source_type).alias("source_type"),
        F.lit(display_name).alias("display_name"), "content_hash", F.array(*map(F.lit, names)).alias("columns"),
        F.col("rows").alias("accepted_row_count"), F.lit(created).cast("bigint").alias("created_at"),
    )


_SUMS = "rows bigint, sums array<decimal(38,0)>"


def _sums_path(path: str, dataset_id: str) -> str:
    return f"{path}/_sums/{dataset_id}"  # readers of the rows pass over names with an underscore


def _kept_sums(spark: SparkSession, path: str, dataset_id: str, rows: int) -> DataFrame | None:
    """The sums kept for a dataset, if they are there and speak of so many rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_sums_path(path, dataset_id))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    kept = spark.read.schema(_SUMS).parquet(_sums_path(path, dataset_id)).collect()
    return spark.createDataFrame(kept, _SUMS) if len(kept) == 1 and kept[0].rows == rows else None


def _keep_sums(sums: DataFrame, path: str, dataset_id: str) -> None:
    made = sums.sparkSession.createDataFrame(sums.collect(), _SUMS)  # one row; the old one was read from the same place
    made.coalesce(1).write.mode("overwrite").parquet(_sums_path(path, dataset_id))


def stored_hash(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """(rows, content_hash) of a stored dataset: from the sums kept beside it, without its rows.

    Sums that do not go with the number of rows, as after a write that failed, are made anew.
    """
    own = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id)
    rows = own.count()
    kept = _kept_sums(spark, path, dataset_id, rows)
    if kept is None:
        kept = hash_sums(own, [c for c in own.columns if c not in ("dataset_id", "row_index", "row_hash")])
        _keep_sums(kept, path, dataset_id)
    return finish_hash(kept)


def write_table(df: DataFrame, path: str, dataset_id: str, order_by: list[str] | None = None) -> None:
    """Replace the rows of one dataset: one partition folder per dataset, rows numbered in order."""
    configure(df.sparkSession)
    if order_by:
        df = row_index(df, order_by)
    elif "row_index" not in df.columns:
        raise ValueError("write_table needs order_by or a row_index column")
    values = [c for c in df.columns if c != "row_index"]
    stored = df.select(
        F.lit(dataset_id).alias("dataset_id"), "row_index", row_hash(df, values).alias("row_hash"), *values
    )
    ranged = stored.repartitionByRange("row_index").sortWithinPartitions("row_index")
    ranged.write.mode("overwrite").partitionBy("dataset_id").parquet(path)
    _keep_sums(hash_sums(df, values), path, dataset_id)
    if stored.isEmpty():  # such a write replaces no partition
        jvm = df.sparkSession._jvm
        old = jvm.org.apache.hadoop.fs.Path(path, f"dataset_id={dataset_id}")
        old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(old, True)


def append_rows(df: DataFrame, path: str, dataset_id: str, order_by: list[str]) -> None:
    """Add rows behind those of a stored dataset, numbered on in order; a new dataset starts at 0.

    Every row is appended, equal ones too. One writer at a time: two would number from the same row. The
    content hash of the dataset follows from the appended rows alone, see ``stored_hash``.
    """
    spark = configure(df.sparkSession)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, f"dataset_id={dataset_id}")
    last, held = None, spark.createDataFrame([], _SUMS)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        own = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id)
        last, count = own.agg(F.max("row_index"), F.count("*")).first()
        held = _kept_sums(spark, path, dataset_id, count)
        held = held if held is not None else hash_sums(own, df.columns)
    numbered = row_index(df, order_by).withColumn("row_index", F.col("row_index") + F.lit(0 if last is None else last + 1))
    stored = numbered.select(
        F.lit(dataset_id).alias("dataset_id"), "row_index", row_hash(df, df.columns).alias("row_hash"), *df.columns
    )
    ranged = stored.repartitionByRange("row_index").sortWithinPartitions("row_index")
    sums = add_sums(held, hash_sums(df, df.columns))
    sums = spark.createDataFrame(sums.collect(), _SUMS)  # before the rows that it speaks of are there
    ranged.write.mode("append").partitionBy("dataset_id").parquet(path)
    _keep_sums(sums, path, dataset_id)


def read_table(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """The rows of one dataset in row order; only its folder is read."""
    return spark.read.parquet(path).where(F.col("dataset_id") == dataset_id).orderBy("row_index")


def list_tables(tables: DataFrame, limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """What a visitor may browse, oldest first."""
    shown = tables.select("dataset_id", "display_name", "source_type", "accepted_row_count", "created_at")
    return shown.orderBy("created_at", "dataset_id").limit(limit)


def list_runs(runs: DataFrame, limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Runs with a title cut from their question, oldest first."""
    shown = runs.select(
        "run_id", "dataset_id", F.substring("query", 1, 80).alias("title"), "status", "completed_rows", "total_rows",
        "created_at",
    )
    return shown.orderBy("created_at", "run_id").limit(limit)
