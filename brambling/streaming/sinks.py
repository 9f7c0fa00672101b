"""Sinks of streams that hold every row once, also when a batch is written again.

Each batch has a folder of its own, which a repetition overwrites, and counts once its line is in the ledger. So a batch
that was cut off leaves nothing behind that a reader sees, and one that was written but not yet noted by the stream is
recognised by its number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Ledger:
    """A table in ``path`` that streams append to: ``data/batch=n`` and ``ledger/n``."""

    spark: SparkSession
    path: str

    def _names(self) -> list[int]:
        """Numbers of the batches that count."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(folder))

    def _note(self, batch: int) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/{batch}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True).close()

    def read(self, schema: str) -> DataFrame:
        """All rows that count, with ``batch``. ``schema``: the columns as they were written."""
        done = self._names()
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in done])

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch, unless it is there; says whether it did."""
        if batch in self._names():
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        self._note(batch)
        return True

    def append_absent(self, rows: DataFrame, batch: int, keys: list[str], first: str) -> bool:
        """As ``append``, but only rows whose key no earlier batch has, and of those with one key the first by ``first``. A null key is a key."""
        if batch in self._names():
            return False
        w = Window.partitionBy(*keys).orderBy(F.col(first).asc_nulls_last(), F.xxhash64(*rows.columns))
        one = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        known = self.read(columns).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return self.append(one.join(known, same, "left_anti"), batch)


def events_sink(ledger: Ledger) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every row of the stream once."""
    return lambda rows, batch: ledger.append(rows, batch) and None


def absent_sink(ledger: Ledger, keys: list[str], first: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the first row of every key once (a cache by the hash of its content)."""
    return lambda rows, batch: ledger.append_absent(rows, batch, keys, first) and None
