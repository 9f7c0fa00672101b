"""Aggregations: period roll-ups, spines with empty buckets, percentiles, votes, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.numbers import half_up, nearest_rank, percentiles, ratio


def rate(part: Column, n: Column, digits: int = 4) -> Column:
    return F.round(ratio(part.cast("double"), n), digits)


def period_rollup(logs: DataFrame, ts: str, period: str, value: str, ok: Column, kind: str) -> DataFrame:
    """One row per period: counts, success rate, statistics of a value, and a map of counts by kind.

    The kinds are counted first (few rows per period), so no list of all rows of a period is built.
    """
    start = F.date_trunc(period, ts).alias("period_start")
    parts = logs.groupBy(start, F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("known"))
    return parts.groupBy("period_start").agg(
        F.sum("n").alias("n"),
        F.sum("ok").alias("n_ok"),
        rate(F.sum("ok"), F.sum("n")).alias("success_rate"),
        F.sum("total").alias("total"),
        (F.sum("total") / F.sum("known")).alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("by_kind"),
    )


#: Sketches: bits of the registers (relative error 1.04 / 2**(bits / 2), so 1.6 in 100), and the size that gives ranks within 2 in 100.
REGISTERS, QUANTILES = 12, 200


def sketched(logs: DataFrame, ts: str, period: str, keys: list[str], who: str, value: str) -> DataFrame:
    """start, keys, n, total, users, spread: a roll-up that merges further; ``users`` counts different ``who``, ``spread`` holds the distribution of ``value``.

    A table of such rows is kept in place of the logs: a longer period is ``merged`` from shorter ones.
    """
    start = F.date_trunc(period, ts).alias("start")
    return logs.groupBy(start, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.hll_sketch_agg(who, REGISTERS).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES).alias("spread"))


def merged(sketches: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """The roll-up of a longer period, or of fewer keys, from that of a shorter one."""
    start = F.date_trunc(period, "start").alias("start")
    return sketches.groupBy(start, *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"))


def estimated(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches as numbers: different users, and the named quantiles (null where no value is known)."""
    known = F.kll_sketch_get_n_double("spread") > 0
    points = [F.when(known, F.kll_sketch_get_quantile_double("spread", F.lit(q))).alias(k) for k, q in quantiles.items()]
    others = [c for c in sketches.columns if c not in ("users", "spread")]
    return sketches.select(*others, F.hll_sketch_estimate("users").alias("n_users"), *points)


def grouped_totals(logs: DataFrame, groups: dict[str, Column | str], measures: dict[str, Column], alone: bool = True) -> DataFrame:
    """The measures by each group alone and in total, as one table (dimension, member, ...): one pass by grouping sets."""
    names = list(groups)
    rows = logs.select("*", *[(F.col(c) if isinstance(c, str) else c).cast("string").alias(f"_{k}") for k, c in groups.items()])
    keys = [F.col(f"_{k}") for k in names]
    sets = [[k] for k in keys] + [[]] if alone else [keys]
    bits = F.grouping_id()
    out = rows.groupingSets(sets, *keys).agg(bits.alias("_id"), *[c.alias(k) for k, c in measures.items()])
    masks = {k: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i, k in enumerate(names)}
    dimension = F.coalesce(*[F.when(F.col("_id") == m, k) for k, m in masks.items()], F.lit("total"))
    member = F.coalesce(*[F.when(F.col("_id") == m, F.col(f"_{k}")) for k, m in masks.items()])
    return out.select(dimension.alias("dimension"), member.alias("member"), *measures)


def spine(spark, start: str, end: str, step: str) -> DataFrame:
    """bucket timestamps from start to end (included), one per step such as ``1 hour``."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {step})) AS bucket")


def filled(buckets: DataFrame, aggregated: DataFrame, *zero: str) -> DataFrame:
    """The aggregates of every bucket of the spine, zero where there are none. The spine is bounded by its ends, so it may be broadcast."""
    return buckets.join(aggregated, "bucket", "left").fillna(0, list(zero))


def endpoint_stats(logs: DataFrame, keys: list[str], value: str, failed: Column) -> DataFrame:
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        nearest_rank(value, 0.95).alias("p95"),
        F.round(100 * ratio(F.count_if(failed).cast("double"), F.count(F.lit(1))), 4).alias("error_percent"),
    )


def score_distribution(scores: DataFrame, value: str, *keys: str) -> DataFrame:
    """Moments and interpolated deciles and quartiles, rounded to two digits."""
    shares = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    found = scores.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), percentiles(value, *shares.values()).alias("_p"))
    two = lambda c, k: F.round(c, 2).alias(k)
    return found.select(*keys, "n", *[two(F.col(k), k) for k in ("low", "high", "mean", "deviation")], *[two(F.col("_p")[i], k) for i, k in enumerate(shares)])


def grade_thresholds(scores: DataFrame, value: str) -> DataFrame:
    """Recommended limits of the grades: the 90th, 75th, 50th and 25th percentile, rounded."""
    p = scores.agg(percentiles(value, 0.9, 0.75, 0.5, 0.25).alias("p"))
    return p.select(*[half_up(F.col("p")[i]).cast("double").alias(k) for i, k in enumerate(("grade_a", "grade_b", "grade_c", "grade_d"))])


def floor_index_percentile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """sorted[floor(share * n)], the last one at most: by rank, so no group is collected into one row."""
    w = Window.partitionBy(*keys)
    ranked = rows.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.filter(F.col("_r") == F.least(F.floor(F.col("_n") * share) + 1, F.col("_n"))).select(*keys, F.col(value).alias("value"))


def weighted_mean(value: Column, weight: Column, missing: float = -1.0) -> Column:
    """Mean of the values that are not the sentinel."""
    good = value.isNotNull() & (value != missing)
    return F.sum(F.when(good, value * weight)) / F.sum(F.when(good, weight))


def top_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def weighted_vote(votes: DataFrame, keys: list[str], choice: str, weight: Column, agreement: float = 0.8) -> DataFrame:
    """The choice with the most weight (ties: the lesser one), its share, and whether the share is too low."""
    sums = votes.groupBy(*keys, choice).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(*keys).agg(F.sum("w").alias("total"), F.min(F.struct((-F.col("w")).alias("m"), F.col(choice).alias("c"))).alias("best"))
    share = ratio(-F.col("best.m"), F.col("total"))
    return best.select(*keys, F.col("best.c").alias("winner"), F.round(share, 4).alias("share"), (share < agreement).alias("disputed"))


def consensus(fields: DataFrame, keys: list[str], value: Column, confidence: str) -> DataFrame:
    """Per key: the value all agree on, else the one of the greatest confidence."""
    rows = fields.withColumn("_v", value)
    return rows.groupBy(*keys).agg(
        (F.count_distinct("_v") == 1).alias("agreed"), F.max_by("_v", F.struct(F.col(confidence), F.col("_v"))).alias("value"), F.count("_v").alias("n")
    )


def period_change(rows: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Previous value, difference, ratio, and how bad a fall is."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    out = rows.withColumn("previous", previous).withColumn("delta", F.col(value) - F.col("previous"))
    share = F.col(value) / F.when(F.col("previous") != 0, F.col("previous"))
    return out.withColumn("ratio", F.round(share, 4)).withColumn("severity", F.when(F.col("previous").isNull() | (F.col("delta") >= 0), "none").when(share < 0.5, "critical").when(share < 0.8, "warning").otherwise("info"))


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Start, end and size of runs of events with no pause as long as ``gap``."""
    return events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def burst(events: DataFrame, keys: list[str], ts: str, seconds: int, warn: int, critical: int) -> DataFrame:
    """Events at which the trailing window holds ``warn`` or more of their key."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = events.withColumn("_at", at).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("_at")
    return counted.filter(F.col("in_window") >= warn).withColumn("level", F.when(F.col("in_window") >= critical, "critical").otherwise("high"))


def anchored_limit(events: DataFrame, keys: list[str], ts: str, seconds: int, most: int) -> DataFrame:
    """Each event with ``allowed``: a window opens at the first event of a key after the last one closed; ``most`` events pass in it.

    The window depends on earlier windows of the key, so a key is walked in order: batch after batch, with one state per
    key, not with the rows of a key in memory.
    """
    import pyarrow as pa

    names = [f.name for f in events.schema]
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", *[n for n in names if n not in keys])

    def run(batches):
        last, start, used = None, 0, 0
        for batch in batches:
            columns = [batch.column(names.index(k)).to_pylist() for k in keys]
            allowed = []
            for *key, at in zip(*columns, batch.column(len(names)).to_pylist()):
                if key != last or at >= start + seconds * 1_000_000:
                    last, start, used = key, at, 0
                allowed.append(used < most)
                used += allowed[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(allowed)], names=[*names, "allowed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return dealt.mapInArrow(run, f"{kinds}, allowed boolean")
