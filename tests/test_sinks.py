import pytest
from pyspark.sql import functions as F

from brambling.sources.change_log import ChangeLog, changed, differing
from brambling.sources.tables import scratch
from brambling.streaming.sinks import Ledger, absent_sink, events_sink

KIND = "k int, v string"


@pytest.fixture
def ledger(spark):
    return Ledger(spark, scratch(spark, "ledger"))


def rows_of(ledger):
    return [(r.batch, r.k, r.v) for r in ledger.read(KIND).collect()]


def test_a_batch_counts_once(spark, ledger):
    first, second = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], KIND), spark.createDataFrame([(3, "c")], KIND)
    assert rows_of(ledger) == []
    assert ledger.append(first, 0) and ledger.append(second, 1)
    assert not ledger.append(first, 0) and not ledger.append(first, 1)
    assert sorted(rows_of(ledger), key=str) == [(0, 1, "a"), (0, 1, "a"), (0, 2, None), (1, 3, "c")]


def test_a_batch_that_was_cut_off_is_not_seen_and_may_be_repeated(spark, ledger):
    class Lost(Ledger):
        def _note(self, batch):
            raise OSError("lost")

    with pytest.raises(OSError):
        Lost(spark, ledger.path).append(spark.createDataFrame([(1, "half")], KIND), 0)
    assert rows_of(ledger) == []
    assert ledger.append(spark.createDataFrame([(1, "whole")], KIND), 0)
    assert rows_of(ledger) == [(0, 1, "whole")]


def test_absent_keys_only(spark, ledger):
    assert ledger.append_absent(spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], KIND), 0, ["k"], "v")
    assert ledger.append_absent(spark.createDataFrame([(1, "0"), (None, "m"), (2, "c"), (2, "c")], KIND), 1, ["k"], "v")
    want = [(0, 1, "a"), (0, None, "n"), (1, 2, "c")]
    assert sorted(rows_of(ledger), key=str) == sorted(want, key=str)
    assert not ledger.append_absent(spark.createDataFrame([(9, "x")], KIND), 1, ["k"], "v")


@pytest.mark.parametrize("absent", [False, True])
def test_stream_that_lost_its_last_commit(spark, ledger, absent):
    """The sink wrote a batch, the stream did not note it: after a restart the batch comes again and changes nothing."""
    source, state = scratch(spark, "source"), scratch(spark, "state")
    sink = absent_sink(ledger, ["k"], "v") if absent else events_sink(ledger)

    def lost(rows, batch):
        sink(rows, batch)
        if batch == 1:
            raise OSError("lost")

    def run(each):
        spark.readStream.schema(KIND).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for i, data in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(source)
        if i == 0:
            run(lost)
    with pytest.raises(Exception, match="lost"):
        run(lost)
    run(sink)
    got = sorted(rows_of(ledger))
    assert got == ([(0, 1, "a"), (0, 2, "b"), (1, 3, "d")] if absent else [(0, 1, "a"), (0, 2, "b"), (1, 2, "c"), (1, 3, "d")])


TABLE = "k int, s string, x double"


def test_log_and_any_version(spark):
    log = ChangeLog(spark, scratch(spark, "log"), ("k",), TABLE)
    versions = [[], [(1, "a", 1.0), (2, None, None), (None, "n", 0.0)], [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], [(1, "z", 1.5), (2, "b", None), (None, "n", 1.0)], []]
    for i, rows in enumerate(versions):
        assert log.record(spark.createDataFrame(rows, TABLE)) == i + 1
    for i, rows in enumerate(versions):
        assert sorted(map(str, map(tuple, log.state(i + 1).collect()))) == sorted(map(str, rows))
    assert log.state(0).count() == 0 and log.state(99).count() == 0
    fourth = {r.k: (r.op, r.before and tuple(r.before), r.after and tuple(r.after)) for r in log.changes(3, 4).collect()}
    assert fourth == {1: ("update", (1, "a", 1.0), (1, "z", 1.5)), 3: ("delete", (3, "c", 3.0), None), None: ("insert", None, (None, "n", 1.0))}
    named = log.changes(3, 4).filter("op = 'update'").select(differing(F.col("before"), F.col("after"), ["k", "s", "x"]).alias("d")).first().d
    assert named == ["s", "x"]


def test_a_version_that_was_cut_off_is_written_again(spark):
    log = ChangeLog(spark, scratch(spark, "log"), ("k",), TABLE)
    log.record(spark.createDataFrame([(1, "a", 1.0)], TABLE))
    spark.createDataFrame([("insert", 9)], "op string, k int").write.parquet(f"{log.path}/version=2")
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{log.path}/version=2/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert log.latest() == 1 and log.state(9).count() == 1
    assert log.record(spark.createDataFrame([(1, "b", 1.0)], TABLE)) == 2
    assert [r.s for r in log.state(2).collect()] == ["b"]


def test_repeated_rows_are_alike(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], KIND)
    assert changed(a, a, ["k"]).count() == 0
