"""A keyed table that streams write to: buckets by key hash, versions by micro-batch, and a log of what counts.

Every micro-batch reads and writes only the buckets that its keys fall in. Files of a version count from the
moment its entry in the log exists, which is created as one file after all others; a batch that is played
again finds its entry and writes nothing, and one that failed before writes the same folders anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


class KeyedStore:
    """Rows by key below ``path``.

    ``rows/__b=b/__v=v`` holds what version v wrote to bucket b: with ``put`` further rows, with
    ``replace`` all rows of the bucket. A store is used with one of the two.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self._log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
        self._fs = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def log(self) -> dict[int, list[int]]:
        """The buckets that each version wrote. The names of the entries are all there is to read."""
        if not self._fs.exists(self._log):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._log))
        masks = {int(v): int(m, 16) for v, _, m in (n.partition("~") for n in names if "~" in n and not n.startswith("."))}
        return {v: [b for b in range(self.buckets) if m >> b & 1] for v, m in masks.items()}

    def holds(self, version: int) -> bool:
        return version in self.log()

    def _commit(self, version: int, buckets: list[int]) -> None:
        self._fs.mkdirs(self._log)
        mask = sum(1 << b for b in buckets)
        entry = self.spark._jvm.org.apache.hadoop.fs.Path(self._log, f"{version:012d}~{mask:x}")
        self._fs.create(entry, False).close()

    def read(self, schema, buckets: list[int] | None = None, latest: bool = False) -> DataFrame:
        """Rows of all versions, or with ``latest`` of the last version of each bucket; of some buckets only."""
        log = self.log()
        pairs = {(b, v) for v, held in log.items() for b in held if buckets is None or b in buckets}
        if latest:
            newest = {b: max(v for x, v in pairs if x == b) for b, _ in pairs}
            pairs = set(newest.items())
        paths = [f"{self.path}/rows/__b={b}/__v={v}" for b, v in sorted(pairs)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def rewrite(self, rows: DataFrame, version: int, buckets: list[int]) -> None:
        """Write a version of these buckets as a whole and log it."""
        held = rows.withColumns({"__b": self.bucket(), "__v": F.lit(version)}).repartition("__b")
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__b", "__v").parquet(f"{self.path}/rows")
        there = self._fs.exists
        made = [b for b in buckets if there(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/__b={b}/__v={version}"))]
        self._commit(version, made)

    def put(self, rows: DataFrame, version: int, order_by: list[str]) -> None:
        """Add the first row of every key that is not held yet; a version that is held writes nothing."""
        if self.holds(version):
            return
        rest = [c for c in rows.columns if c != self.key]
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__row")).select(self.key, "__row.*")
        buckets = self.touched(rows)
        held = self.read(f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}", buckets)
        self.rewrite(first.join(held, self.key, "left_anti"), version, buckets)

    def replace(self, rows: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of these rows with ``merge(held, rows)``; the files of other buckets stay as they are."""
        if self.holds(version):
            return
        buckets = self.touched(rows)
        self.rewrite(merge(self.read(rows.schema, buckets, latest=True), rows), version, buckets)


class Batches:
    """What a stream wrote, a folder per micro-batch, beside the state that it carries from one to the next.

    A batch counts once its state is in the store's log; ``write`` makes rows and state of one batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.states = KeyedStore(spark, f"{path}/state", key, buckets)

    def write(self, batch: DataFrame, number: int, schema: str, rows: Callable, states: Callable) -> None:
        """``rows(batch, held)`` are the batch's rows, given the states of its buckets; ``states(held, rows)`` those states after it.

        The source is read once; what reads the batch again reads it in even parts, however few files it came in.
        """
        if self.states.holds(number):
            return
        batch = batch.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).persist()
        try:
            buckets = self.states.touched(batch)
            held = self.states.read(schema, buckets, latest=True)
            made = rows(batch, held)
            folder = f"{self.path}/rows/batch={number}"
            made.write.mode("overwrite").parquet(folder)
            self.states.rewrite(states(held, self.spark.read.schema(made.schema).parquet(folder)), number, buckets)
        finally:
            batch.unpersist()

    def read(self, schema) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}" for v in sorted(self.states.log())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
