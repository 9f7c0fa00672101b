import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brambling.sources.tables import scratch
from brambling.streaming.alerting import AlertLife, OUT, alert_life, broken_rules

KIND = "rule string, action string, at long, tie long, value double"
HOUR = 3_600


def plain(steps, pause):
    """What happens to the alerts of each rule, step by step."""
    out = []
    for rule in {s[0] for s in steps if s[0]}:
        alert, seen, until = None, False, -1
        for _, a, at, _, v in sorted((s for s in steps if s[0] == rule), key=lambda s: (s[2], s[3])):
            if a == "trigger":
                if alert is None and at >= until:
                    alert, seen, until = at, False, at + pause
                    out.append((rule, alert, "opened", at, v))
                else:
                    out.append((rule, alert, "suppressed", at, v))
            elif alert is not None and a == "acknowledge" and not seen:
                seen = True
                out.append((rule, alert, "acknowledged", at, v))
            elif alert is not None and a == "resolve":
                out.append((rule, alert, "resolved", at, v))
                alert = None
    return sorted(out, key=str)


class Stream:
    def __init__(self, spark, late="1 hour"):
        self.spark, self.late = spark, late
        self.source, self.sink, self.state = (scratch(spark, n) for n in ("s", "out", "cp"))

    def run(self, *batches):
        """Each batch is a file; the stream ends after them and starts again from its checkpoint the next time."""
        for rows in batches:
            self.spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(self.source)
            steps = self.spark.readStream.schema(KIND).parquet(self.source).withColumn("ts", F.timestamp_seconds("at"))
            life = alert_life(steps, "rule", "action", "ts", "tie", "value", "2 HOURS", self.late)
            life.writeStream.format("parquet").option("checkpointLocation", self.state).trigger(availableNow=True).start(self.sink).awaitTermination()
        return self.found()

    def found(self):
        rows = self.spark.read.schema(OUT).parquet(self.sink).select("key", F.unix_seconds("alert"), "event", F.unix_seconds("ts"), "value").collect()
        return sorted(map(tuple, rows), key=str)

    def kept(self, variable):
        return self.spark.read.format("statestore").option("path", self.state).option("stateVarName", variable).load().count()


def tick(hours, n=0):
    return [("clock", "tick", int(hours * HOUR), n, 0.0)]


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(8)
    return [(rng.choice("abc"), rng.choice(["trigger", "trigger", "acknowledge", "resolve", "other"]), 600 * i + rng.randrange(600), i, float(i)) for i in range(1, 120)]


@pytest.fixture(scope="module")
def ran(spark, steps):
    """Four runs from one checkpoint, whose steps are mixed within the hour that late ones have."""
    stream = Stream(spark, late="30 hours")
    rng = random.Random(9)
    mixed = sorted(steps, key=lambda s: s[2] + rng.randrange(10 * HOUR))
    stream.run(mixed[:40], mixed[40:80], mixed[80:], tick(200))
    return stream


def test_equals_the_plain_walk_over_restarts(ran, steps):
    assert ran.found() == plain(steps, 2 * HOUR)


def test_state_goes(spark):
    stream = Stream(spark)
    got = stream.run([("a", "trigger", 10, 1, 1.0), ("a", "resolve", 20, 2, 2.0), ("b", "trigger", 10, 3, 3.0)], tick(1.6))
    assert [r[:3] for r in got] == [("a", 10, "opened"), ("a", 10, "resolved"), ("b", 10, "opened")]
    assert (stream.kept("open"), stream.kept("quiet")) == (1, 2)  # b is open; both have a cooldown
    stream.run(tick(5))
    assert (stream.kept("open"), stream.kept("quiet")) == (1, 1)  # nothing is left of a
    got = stream.run([("a", "trigger", 5 * HOUR, 5, 5.0), ("b", "resolve", 5 * HOUR, 6, 6.0)], tick(20))
    assert {r[:3] for r in got} == {("a", 10, "opened"), ("a", 10, "resolved"), ("a", 18_000, "opened"), ("b", 10, "opened"), ("b", 10, "resolved")}
    stream.run(tick(40))
    assert (stream.kept("open"), stream.kept("waiting")) == (1, 1)  # a again; the clock's own tick still waits


def test_late_steps_are_left_out(spark):
    stream = Stream(spark)
    stream.run([("a", "trigger", 10 * HOUR, 1, 1.0)], tick(12))
    got = stream.run([("a", "trigger", 8 * HOUR, 2, 2.0), (None, "trigger", 13 * HOUR, 3, 3.0)], tick(15))
    assert got == [("a", 36_000, "opened", 36_000, 1.0)]


def test_broken_rules(spark):
    rows = spark.createDataFrame([(0, 5.0, 1), (1, 6.0, None)], "t long, x double, n int")
    found = broken_rules(rows, F.timestamp_seconds("t"), [("high", "x", ">=", 6), ("low", "n", "<", 2), ("same", "x", "=", 5)])
    assert sorted((r.rule, r.value) for r in found.collect()) == [("high", 6.0), ("low", 1.0), ("same", 5.0)]


def test_a_key_has_one_timer_for_all_that_waits():
    class Handle:
        def __init__(self):
            self.timers, self.states = set(), {}

        def state(self, name, _):
            return self.states.setdefault(name, State())

        getListState = getValueState = state

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, ms):
            self.timers.add(ms)

    class State:
        def __init__(self):
            self.rows = []

        def appendList(self, rows):
            self.rows += rows

        def put(self, rows):
            self.rows = rows

        def get(self):
            return iter(self.rows)

        def exists(self):
            return False

        def clear(self):
            self.rows = []

        update = put

    class Now:
        def getCurrentWatermarkInMs(self):
            return 500

    handle, life = Handle(), AlertLife(1_000)
    life.init(handle)
    list(life.handleInputRows(("a",), iter([Row(at=i * 1_000, tie=i, action="acknowledge", value=0.0) for i in range(1_000, 0, -1)]), Now()))
    assert handle.timers == {1}
    handle.timers.clear()
    assert list(life.handleExpiredTimer(("a",), Now(), None)) == [] and len(life.waiting.rows) == 500 and handle.timers == {501}
