"""Structured Streaming: per-minute metrics, sessions, rate limits, alerts with cooldown, learned patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stamped(events: DataFrame, ts: str) -> DataFrame:
    """``ts`` as a timestamp with zone, as watermarks need it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def minute_metrics(events: DataFrame, ts: str, keys: list[str], value: str, failed: Column, late: str = "60 minutes", width: str = "1 minute") -> DataFrame:
    rows = stamped(events, ts).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.sum(value).alias("total"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "n_failed", "total", "high")


def session_stats(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "60 minutes") -> DataFrame:
    rows = stamped(events, ts).withWatermark(ts, late)
    out = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """key, ts, allowed: the window of a key opens at its first event; events that are refused do not count.

    The state of a key is the start of its window and the events let through. It goes once the watermark passes the end.
    """
    kind = events.schema[key].dataType.simpleString()

    def decide(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (-(1 << 62), 0)
        rows = pd.concat(list(batches)).sort_values("_ts")
        allowed = []
        for at in (rows["_ts"].astype("datetime64[us]").astype("int64")).tolist():
            if at >= start + seconds * 1_000_000:
                start, used = at, 0
            allowed.append(used < most)
            used += allowed[-1]
        state.update((start, used))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], "ts": rows["_ts"], "allowed": allowed})

    rows = events.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    return rows.groupBy(key).applyInPandasWithState(decide, f"`{key}` {kind}, ts timestamp, allowed boolean", "start long, used int", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(metrics: DataFrame, rules: list[tuple[str, str, str, float, int]], ts: str) -> DataFrame:
    """rule, ts, value: metric rows that break a rule, at most one per rule and cooldown.

    rules: (name, metric column, comparator, threshold, cooldown in seconds); comparators > >= < <= =.
    """
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    broken = F.array_compact(F.array(*[F.when(compare[op](F.col(m), F.lit(limit)), F.struct(F.lit(n).alias("rule"), F.col(m).cast("double").alias("value"), F.lit(pause).alias("pause"))) for n, m, op, limit, pause in rules]))
    rows = metrics.select(F.col(ts).cast("timestamp").alias("ts"), F.explode(broken).alias("b")).select("ts", "b.*")

    def cool(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (-(1 << 62),)
        found = pd.concat(list(batches)).sort_values("ts")
        keep = []
        for at, pause in zip(found["ts"].astype("datetime64[us]").astype("int64").tolist(), found["pause"].tolist()):
            fire = at >= last + pause * 1_000_000
            last = at if fire else last
            keep.append(fire)
        state.update((last,))
        yield found[keep][["rule", "ts", "value"]]

    return rows.groupBy("rule").applyInPandasWithState(cool, "rule string, ts timestamp, value double", "last long", "append", GroupStateTimeout.NoTimeout)


def learned_patterns(finds: DataFrame, pattern: str, kind: str, example: str, source: str, examples: int = 5, sources: int = 10) -> DataFrame:
    """Counts per pattern with a few different examples and sources, in batch or complete-mode streams.

    The values of a pattern fall into as many classes (by a hash) as may be kept, and the least of each class is. So what is
    held for a pattern is bounded however often it occurs, partial results merge, and the order of rows does not matter.
    """
    few = lambda c, n: F.array_sort(F.array_compact(F.array(*[F.min(F.when(F.pmod(F.xxhash64(c), F.lit(n)) == i, c)) for i in range(n)])))
    counted = finds.groupBy(pattern, kind).agg(F.count(F.lit(1)).alias("occurrences"), few(F.substring(example, 1, 200), examples).alias("examples"), few(F.col(source), sources).alias("sources"))
    return counted.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.05 * F.col("occurrences")), 3))
