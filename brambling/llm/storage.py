"""Shared storage for intermediate tables: the folder in ``spark.checkpoint.dir``, which every executor sees."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES, ARROW_BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH_BYTES = 4 << 20
#: Names of intermediate tables: what they hold, and a random number.
NAME = re.compile("[a-z0-9-]+-[0-9a-f]{32}")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of whole texts bounded to a few MB for this session, unless it sets a size of its own.

    Spark reads the setting when the job runs, so it stays set; Arrow batches are only cut smaller by it.
    """
    conf = df.sparkSession.conf
    if str(conf.get(ARROW_BYTES, None)).rstrip("b") in ("None", str(ARROW_BYTES_DEFAULT)):
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Gives freed memory back to the system, which Python and numpy otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives what it freed back to the system when its task ends: Python workers live on between tasks, idle ones too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only on one machine (tests) a temporary one is made where none is set."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(there)
        return there
    made = sc._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brambling-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get()


#: Folders made in this process, in order.
MADE: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def drop_unread(spark: SparkSession, folders: list[str], kept: DataFrame) -> None:
    """Deletes those of the folders that ``kept`` does not read."""
    read = kept.inputFiles()
    for folder in folders:
        name = folder.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in read):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, older_than_seconds: float = 0) -> int:
    """Deletes the intermediate tables of this library in the shared folder, once no result that reads them is needed; gives their number."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    now = jvm.java.lang.System.currentTimeMillis()
    gone = 0
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if NAME.fullmatch(name) and now - status.getModificationTime() >= older_than_seconds * 1000:
            gone += files.delete(status.getPath(), True)
    for t in spark.catalog.listTables():
        if t.name.startswith("brambling_texts_"):
            place = spark.sql(f"DESCRIBE EXTENDED `{t.name}`").filter("col_name = 'Location'").first()
            if place is None or not files.exists(jvm.org.apache.hadoop.fs.Path(place["data_type"])):
                spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    return gone
