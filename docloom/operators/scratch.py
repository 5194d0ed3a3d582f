"""Tables that running operators write to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset is one chosen: on one
    machine a temporary folder, elsewhere a folder in the warehouse."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/docloom"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docloom_work"


class Scratch:
    """Tables that a running operator writes to the shared folder to cut lineage.

    A written table survives the loss of executors. drop() removes a table which is no longer needed. Those that a
    returned DataFrame reads stay until clear(), the end of cleared() or the end of the application, whichever is first.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.key = uuid.uuid4().hex
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{self.key}"
        self.catalogued: set[str] = set()
        p, fs = self._place(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        Scratch.open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        """Writes df and returns it as read back; shuffle files of the write go at once."""
        with no_shuffle_left(self.spark):
            df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_sorted(self, df: DataFrame, name: str, buckets: int, *by: str) -> DataFrame:
        """Writes df as a table bucketed and sorted by columns, which joins on them read without an exchange."""
        table = f"docloom_{self.key}_{name.replace('-', '_')}"
        with no_shuffle_left(self.spark):
            df.write.bucketBy(buckets, *by).sortBy(*by).option("path", self.path(name)).saveAsTable(table)
        self.catalogued.add(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            table = f"docloom_{self.key}_{name.replace('-', '_')}"
            if table in self.catalogued:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self.catalogued.discard(table)
            self._delete(self.path(name))

    def clear(self) -> None:
        for table in sorted(self.catalogued):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.catalogued.clear()
        self._delete(self.root)
        if self in Scratch.open:
            Scratch.open.remove(self)

    def _place(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._place(path)
        fs.delete(p, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Clears the scratch folders that operators opened inside; their results must have been written by then."""
    before = list(Scratch.open)
    try:
        yield
    finally:
        for scratch in [s for s in Scratch.open if s not in before]:
            scratch.clear()


@contextmanager
def holding(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def no_shuffle_left(spark: SparkSession):
    """While it holds, an action's shuffle files are removed when the action ends."""
    return holding(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
