"""Change capture: the log of what happened to a table between its versions, and the table at any version."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """op (insert, update, delete), the keys, before and after (structs of all columns; null where there was or is no row).

    Rows that are in both go first (``exceptAll``), so only those that differ meet by key. Keys are unique in either table;
    nulls are values like any other.
    """
    columns = after.columns
    gone, new = before.select(*columns).exceptAll(after), after.exceptAll(before.select(*columns))
    left = gone.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*columns).alias("before"))
    right = new.select(*keys, F.struct(*columns).alias("after"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    both = left.join(right, same, "full_outer")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(op.alias("op"), *[F.when(F.col("after").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], "before", "after")


def differing(before: Column, after: Column, columns: list[str]) -> Column:
    """Names of the columns that an update changed."""
    return F.array_compact(F.array(*[F.when(~before[c].eqNullSafe(after[c]), F.lit(c)) for c in columns]))


@dataclass(frozen=True)
class ChangeLog:
    """The log of a table in ``path``, a folder per version. Versions count from 1; writing one again replaces it, so a failed write may be repeated."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    #: Columns of the table, as DDL.
    schema: str

    def _logged(self, until: int | None = None) -> DataFrame:
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        image = self.spark.createDataFrame([], self.schema).select(F.struct(*kinds).alias("s")).dtypes[0][1]
        keys = ", ".join(f"`{k}` {kinds[k]}" for k in self.keys)
        whole = f"op string, {keys}, before {image}, after {image}, version int"
        places = [f"{self.path}/version={v}" for v in range(1, (self.latest() if until is None else min(until, self.latest())) + 1)]
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*places) if places else self.spark.createDataFrame([], whole)

    def latest(self) -> int:
        """The last version; only finished ones count."""
        jvm = self.spark._jvm
        v = 0
        while True:
            mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={v + 1}/_SUCCESS")
            if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
                return v
            v += 1

    def record(self, table: DataFrame) -> int:
        """Logs what ``table`` changed against the last version, and gives the new one."""
        last = self.latest()
        kinds = self.spark.createDataFrame([], self.schema).dtypes
        now = table.select(*[F.col(c).cast(t).alias(c) for c, t in kinds])
        changed(self.state(last), now, list(self.keys)).write.mode("overwrite").parquet(f"{self.path}/version={last + 1}")
        return last + 1

    def changes(self, since: int = 0, until: int | None = None) -> DataFrame:
        """version, op, keys, before, after of the versions after ``since`` up to ``until``."""
        return self._logged(until).filter(F.col("version") > since).select("version", "op", *self.keys, "before", "after")

    def state(self, version: int) -> DataFrame:
        """The table as it was at a version, from the last change of every key up to it."""
        columns = self.spark.createDataFrame([], self.schema).columns
        last = self._logged(version).groupBy(*self.keys).agg(F.max_by(F.struct("op", "after"), "version").alias("c"))
        return last.filter("c.op <> 'delete'").select(*[F.col(f"c.after.{c}").alias(c) for c in columns])
