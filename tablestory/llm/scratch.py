"""Tables between the steps of an operator, in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


class Scratch:
    """A folder below ``spark.checkpoint.dir`` that goes when the ``with`` block ends.

    ``keep`` writes a frame as Parquet and reads it again; ``result`` cuts a small frame
    loose from the folder with ``checkpoint()``, so that it may leave the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, self.folder)

    def keep(self, df: DataFrame, name: str, files: int = 0) -> DataFrame:
        """With ``files``, at most so many."""
        # Snappy takes direct buffers, which pile up outside the heap over many small files; zstd does not.
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def keep_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Like ``keep``, in buckets by a column, so that grouping and joining by it need no shuffle of this frame."""
        buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        table = f"{self.folder.rsplit('/', 1)[-1]}_{name}".replace("-", "_")
        self.tables.append(table)
        df.write.bucketBy(buckets, column).options(path=f"{self.folder}/{name}", compression="zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.folder}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder from the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
