"""What the registered queries share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, configure


class Tables:
    """The supplied tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder every executor can reach."""
    return f"{checkpoint_dir(spark)}/tablestory-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def pick(key: Column, *choices: Column | str | None) -> Column:
    """One of several spellings, by the remainder of a key."""
    made = [F.lit(c) if c is None or isinstance(c, str) else c for c in choices]
    place = F.pmod(key, F.lit(len(made)))
    out = made[-1]
    for i, c in enumerate(made[:-1]):
        out = F.when(place == i, c).otherwise(out)
    return out
