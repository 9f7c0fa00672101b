"""Reading tables, paged and filtered scans, and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brambling.operators.collections import insert_absent, latest_per_key
from brambling.operators.joins import changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over all cores if it is too small to give each a block of its own.

    A file of one row group is one task, however many cores there are; where rows cost much work, dealing them is the
    lesser cost. A table with a full block for every core (by the size that Spark knows) is read as it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    block = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * block else df


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The one row of a key. More than one is an error when the result is computed."""
    found = df.filter(F.col(key) == value)
    n = F.count(F.lit(1)).over(_all())
    return found.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"more than one row with {key} = {value}")).cast("long")).otherwise(F.col("_n"))).filter(F.col("_n") == 1).drop("_n")


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy()  # of the rows of one key only


def scan(df: DataFrame, equal: dict[str, object] | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None, like: tuple[str, str] | None = None, member: tuple[str, object] | None = None) -> DataFrame:
    """Rows that meet every filter given: equality, a half-open range, a part of a text without case, membership in an array."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if since:
        df = df.filter(F.col(since[0]) >= since[1])
    if until:
        df = df.filter(F.col(until[0]) < until[1])
    if like:
        df = df.filter(F.contains(F.lower(F.col(like[0])), F.lit(like[1].lower())))
    if member:
        df = df.filter(F.array_contains(member[0], member[1]))
    return df


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page in a total order. ``order`` must end with a unique column."""
    return df.orderBy(*order).offset(offset).limit(size)


def any_contains(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows of which any column holds its text as a part, without case."""
    hit = F.lit(False)
    for c, text in wanted.items():
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.filter(hit)


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def write_csv(df: DataFrame, path: str) -> None:
    """Named columns, quotes doubled, UTF-8."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def comparison(df: DataFrame, key: str, metrics: list[str], keys: list[str]) -> DataFrame:
    """Metrics as rows, the given keys as columns."""
    stacked = df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics])).alias("s")).select(key, "s.*")
    return stacked.groupBy("metric").pivot(key, keys).agg(F.first("value"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors see; without it, on one machine only, in a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        there = tempfile.mkdtemp(prefix="brambling-")
    return f"{there.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def portable(tables: dict[str, DataFrame], user: str, value) -> DataFrame:
    """All rows of one user in all tables: (store, record as JSON)."""
    out = None
    for name, df in tables.items():
        rows = df.filter(F.col(user) == value).select(F.lit(name).alias("store"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], then: Callable[[DataFrame], DataFrame] = lambda d: d) -> str:
    """Writes old and new rows (new ones win) as a new version beside the table and returns its path.

    The old version stays for running readers; the caller points to the new one (a name in a catalog, a setting) when it
    likes, and may call again with either path.
    """
    to = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    then(latest_per_key(new, spark.read.parquet(path), keys)).write.parquet(to)
    return to


def audit_violations(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What an append-only table must never show between two versions: rows that changed or are gone. New rows are no violation."""
    return changes(before, after, keys, values).filter("change <> 'added'").select(*keys, "change")


def append_absent(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key the table does not have yet."""
    insert_absent(new, spark.read.parquet(path), keys).write.mode("append").parquet(path)


def from_json_rows(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """A JSON column by an explicit schema; what does not fit is kept in ``_corrupt``."""
    return df.withColumn("_j", F.from_json(column, StructType([*schema.fields]).add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).select("*", "_j.*").drop("_j")
