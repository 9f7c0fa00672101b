"""Work in stages: stage logs and timings, bounded retries, zero-filled usage and cache statistics, drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.numbers import percentiles, ratio


def stage_logs(events: DataFrame, key: str, stage: str, ts: str) -> DataFrame:
    """key, stages (JSON array in order), n_stages: a document has few stages, so a list per document is small."""
    per = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("at"), F.col(stage).alias("stage")))).alias("s"))
    return per.select(key, F.to_json("s").alias("stages"), F.size("s").alias("n_stages"))


def stage_timings(events: DataFrame, key: str, stage: str, ts: str) -> DataFrame:
    """Seconds from the stage before to this one, per key."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("seconds", (at - F.lag(at).over(Window.partitionBy(key).orderBy(ts, stage))) / 1_000_000)


def retried(rows: DataFrame, work: Callable[[DataFrame], DataFrame], failed: Column, key: str, most: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on all rows, then again on those that failed, at most ``most`` times; ``keep`` writes each pass (so no pass is computed twice)."""
    done = keep(work(rows).withColumn("attempt", F.lit(1)))
    result = done.filter(~failed)
    left = done.filter(failed)
    for attempt in range(2, most + 1):
        again = keep(work(rows.join(left.select(key), key, "left_semi")).withColumn("attempt", F.lit(attempt)))
        result = result.unionByName(again.filter(~failed))
        left = again.filter(failed)
    return result.unionByName(left)


def zero_filled(rows: DataFrame, key: str, members: list[str]) -> DataFrame:
    """Counts by member, with zero for members that do not occur."""
    every = rows.sparkSession.createDataFrame([(m,) for m in members], f"{key} string")
    return every.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna(0, ["n"])


def cache_stats(events: DataFrame, keys: list[str], hit: Column, error: Column, ttl: list[tuple[float, int]]) -> DataFrame:
    """Hits, misses, rates, and a time to live by hit rate. ttl: (hit rate from, seconds), greatest first."""
    out = events.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(error).alias("errors"))
    rate = ratio(F.col("hits").cast("double"), F.col("hits") + F.col("misses"))
    seconds = F.lit(60)
    for limit, s in reversed(ttl):
        seconds = F.when(rate >= limit, s).otherwise(seconds)
    return out.withColumn("hit_rate", F.round(rate, 4)).withColumn("ttl_seconds", seconds)


def recent_health(logs: DataFrame, ts: str, provider: str, ok: Column, cap: int | None = None) -> DataFrame:
    """Totals per provider; with ``cap`` over the latest rows only (then the cap changes the answer)."""
    rows = logs.orderBy(F.desc(ts)).limit(cap) if cap else logs
    return rows.groupBy(provider).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.round(ratio(F.count_if(ok).cast("double"), F.count(F.lit(1))), 4).alias("success_rate"))


def translation_coverage(keys: DataFrame, translations: DataFrame, key: str, locale: str) -> DataFrame:
    """Percent of keys that each locale has."""
    total = keys.agg(F.count_distinct(key).alias("_t"))
    have = translations.join(keys.select(key).distinct(), key, "left_semi").groupBy(locale).agg(F.count_distinct(key).alias("n"))
    return have.crossJoin(F.broadcast(total)).select(locale, "n", F.round(100.0 * F.col("n") / F.col("_t"), 2).alias("percent"))


def drift(scores: DataFrame, value: Column, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """Percentiles of recent scores less the thresholds in use. thresholds: name -> (share, threshold)."""
    p = scores.select(value.alias("v")).agg(F.count("v").alias("n"), percentiles("v", *[s for s, _ in thresholds.values()]).alias("p"))
    return p.select("n", *[F.round(F.col("p")[i] - t, 4).alias(k) for i, (k, (_, t)) in enumerate(thresholds.items())])


def cumulative_choice(point: Column, weights: dict[str, float]) -> Column:
    """The member whose stretch of the running weights holds the point (0 to the total)."""
    out, top = F.lit(None).cast("string"), sum(weights.values())
    for name, w in reversed(weights.items()):
        top -= w
        out = F.coalesce(F.when(point >= top, F.lit(name)) if out is None else F.when((point >= top) & out.isNull(), F.lit(name)), out)
    return out
