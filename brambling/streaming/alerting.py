"""The life of alerts as a stream with timed state: opened, acknowledged, resolved, at most one notice per cooldown.

Steps of a key wait in its state until the watermark has passed them, when a timer lets them through in order of time. So
the result does not depend on how the stream was cut into batches, nor on a restart, and equals a batch computation over all
steps that were not later than the watermark allows. When a key has no open alert, nothing waiting and no cooldown left, a
timer removes all of its state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What happens to an alert; ``suppressed``: a trigger while the alert is open or the cooldown lasts.
EVENTS = ("opened", "suppressed", "acknowledged", "resolved")
OUT = "key string, alert timestamp, event string, ts timestamp, value double"


class AlertLife(StatefulProcessor):
    """State of a key: steps that wait, the open alert (when it opened, whether it is acknowledged), the end of the cooldown, the timer that is set."""

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, action string, value double")
        self.open = handle.getValueState("open", "at long, acknowledged boolean")
        self.quiet = handle.getValueState("quiet", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.at, r.tie, r.action, r.value) for r in rows]
        self.waiting.appendList(new)
        due, timers = self._due(min(at for at, _, _, _ in new)), list(self.handle.listTimers())
        if not timers or due < min(timers):
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        steps = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ripe = [s for s in steps if s[0] <= now * 1000]
        later = steps[len(ripe) :]
        if ripe or not steps:
            self.waiting.put(later) if later else self.waiting.clear()
        out = []
        opened = self.open.get() if self.open.exists() else None
        opened = tuple(opened) if opened is not None else None
        until = self.quiet.get()[0] if self.quiet.exists() else None
        for at, _, action, value in ripe:
            if action == "trigger":
                free = opened is None and (until is None or at >= until)
                if free:
                    opened, until = (at, False), at + self.cooldown * 1000
                if free or opened is not None:
                    out.append(self._row(key, opened[0], "opened" if free else "suppressed", at, value))
                else:
                    out.append(self._row(key, None, "suppressed", at, value))
            elif opened is not None and action == "acknowledge" and not opened[1]:
                opened = (opened[0], True)
                out.append(self._row(key, opened[0], "acknowledged", at, value))
            elif opened is not None and action == "resolve":
                out.append(self._row(key, opened[0], "resolved", at, value))
                opened = None
        if opened is not None:
            self.open.update(opened)
        else:
            self.open.clear()
        wanted = {self._due(later[0][0])} if later else set()
        if until is not None and (opened is not None or now * 1000 < until):
            self.quiet.update((until,))
            if opened is None:
                wanted.add(self._due(until))
        elif not later:
            self.quiet.clear()
        for ms in wanted - set(self.handle.listTimers()) if wanted else ():
            self.handle.registerTimer(ms)
        return iter(out)

    @staticmethod
    def _due(micros: int) -> int:
        """The timer of a time, which is set for the first step that waits only: it lets through all that are ripe."""
        return -(-micros // 1000)

    @staticmethod
    def _row(key, alert: int | None, event: str, at: int, value: float | None) -> Row:
        return Row(key=key[0], alert=_stamp(alert), event=event, ts=_stamp(at), value=value)

    def close(self) -> None:
        pass


def _stamp(micros: int | None):
    import datetime

    return None if micros is None else datetime.datetime.fromtimestamp(micros // 1_000_000, datetime.timezone.utc) + datetime.timedelta(microseconds=micros % 1_000_000)


def timed(spark: SparkSession) -> None:
    """State with timers and lists is kept in RocksDB, on the disks of the executors and in the checkpoint, not in memory."""
    spark.conf.set(STATES, ROCKS)


def alert_life(steps: DataFrame, key: str, action: str, ts: str, tie: str, value: str, cooldown: str, late: str) -> DataFrame:
    """key, alert (when it opened), event, ts, value: what happens to the alerts of each key.

    A trigger opens an alert unless one is open or the cooldown since the last opening lasts; then it is suppressed (with a
    null alert if none is open). An acknowledgement counts once, a resolution closes the alert; without an open alert both do
    nothing, as do other actions, which only move time on. Steps later than ``late`` are left out, so are those without a
    time or a key. Steps of one time go by ``tie``.
    """
    timed(steps.sparkSession)
    ms = int(steps.sparkSession.range(1).select((F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {cooldown})") / 1000).cast("long")).first()[0])
    rows = steps.select(F.col(key).cast("string").alias("key"), F.col(action).alias("action"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value")).dropna(subset=["key", "ts"])
    marked = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return marked.groupBy("key").transformWithState(AlertLife(ms), OUT, "Append", "EventTime")


def broken_rules(metrics: DataFrame, ts: Column, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """Triggers: rule, ts, value of every metric row that breaks a rule (name, metric column, comparator, threshold)."""
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    broken = F.array_compact(F.array(*[F.when(compare[op](F.col(m), F.lit(limit)), F.struct(F.lit(n).alias("rule"), F.col(m).cast("double").alias("value"))) for n, m, op, limit in rules]))
    return metrics.select(ts.alias("ts"), F.explode(broken).alias("b")).select("b.rule", "ts", "b.value")
