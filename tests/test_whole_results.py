"""Results that must not lose rows or values."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablestory.functions.cells import label_text
from tablestory.operators import statistics
from tablestory.operators.scoring import score_rows
from tablestory.operators.series import scatter_points
from tablestory.session import checkpoint_dir
from tablestory.sources.tables import read_table, write_table
from tablestory.streaming import feed, records


@pytest.mark.parametrize("pairs, stride", [(15, 67), (2, 3), (7, 3)])
def test_scatter_without_order_keeps_its_share_of_few_pairs(spark, pairs, stride):
    df = spark.range(10_000).select((F.col("id") % pairs).alias("x"), (F.col("id") % pairs * 2).alias("y"))
    points = scatter_points(df, "x", "y", stride)
    assert abs(points.count() - 10_000 / stride) <= pairs
    assert points.distinct().count() == pairs


def test_quantiles_leave_out_infinities_on_both_paths(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").cast("double").alias("v")).union(
        spark.range(60).select(F.when(F.col("id") % 2 == 0, float("inf")).otherwise(float("-inf"))))
    qs = [0.0, 0.25, 0.5, 1.0]
    assert statistics.quantiles(df, "v", qs) == [0.0, 499.75, 999.5, 1999.0]
    monkeypatch.setattr(statistics, "_EXACT_MAP_LIMIT", 10)
    assert statistics.quantiles(df, "v", qs) == [0.0, 499.75, 999.5, 1999.0]


def test_a_row_that_fails_takes_no_other_with_it(spark):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["id"] % 100 == 7).any():
            raise ValueError("no")
        return pd.DataFrame({"value": batch["id"] * 2.0})

    out = score_rows(spark.range(400), ["id"], scorer).toPandas()
    failed = out[out["error"].notna()]
    assert sorted(failed["id"]) == [7, 107, 207, 307]
    assert (out[out["error"].isna()]["value"] == out[out["error"].isna()]["id"] * 2).all() and len(out) == 400


def test_an_empty_table_replaces_a_full_one(spark):
    path = f"{checkpoint_dir(spark)}/replaced"
    df = spark.createDataFrame([(i, f"x{i}") for i in range(5)], "k int, v string")
    write_table(df, path, "a", order_by=["k"])
    write_table(df, path, "b", order_by=["k"])
    write_table(df.limit(0), path, "a", order_by=["k"])
    assert read_table(spark, path, "a").count() == 0 and read_table(spark, path, "b").count() == 5


def test_long_decimals_stay_different(spark):
    df = spark.range(1000).select((F.lit("1234567890123456789000").cast("decimal(25,0)") + F.col("id")).cast("decimal(25,0)").alias("v"))
    assert df.select(label_text(F.col("v"), df.schema["v"].dataType)).distinct().count() == 1000
    small = spark.createDataFrame([("1.50",), ("2.00",), ("0.00",), ("-30.00",), ("0.05",)], "v string").select(F.col("v").cast("decimal(12,2)"))
    assert [r[0] for r in small.select(label_text(F.col("v"), small.schema["v"].dataType)).collect()] == ["1.5", "2", "0", "-30", "0.05"]


def test_a_stream_of_steps_ends_with_the_open_and_the_late_ones(spark):
    folder = f"{checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}"  # the shared folder outlives a session
    for days in (["2024-01-03 10:00", "2024-01-04 23:59", "2024-01-04 08:00"], ["2024-01-01 05:00", "2024-01-03 00:00", "2024-01-05 00:01"]):
        df = spark.createDataFrame([(d,) for d in days], "at string").select(F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}-in")
    reader = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1)
    sink = reader.parquet(f"{folder}-in").writeStream.foreachBatch(feed.trend_batches(f"{folder}-out", "at", "1 day"))
    sink.option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start().awaitTermination()
    out = records.read_stored(spark, f"{folder}-out", "bucket", "bucket timestamp, rows bigint", latest=True)
    assert {r.bucket.day: r.rows for r in out.collect()} == {1: 1, 3: 2, 4: 2, 5: 1} and out.count() == 4
