"""Ranks, winners, positions in a range, and multi-criteria ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.numbers import clamp, half_up
from brambling.sources.tables import scratch


def positions(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 0) in one order of all rows, which must end with a unique column.

    Rows are dealt by ranges of the order and written once, so that places stand; a range's rows come after those of all
    ranges before it. Only the number of rows of each range comes to the driver.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "positions")
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed.write.parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    before, starts = 0, []
    for r in kept.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["count"]
    table = spark.createDataFrame(starts, "_range int, _before long")
    return kept.join(F.broadcast(table), "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def ranks(rows: DataFrame, sets: list[str], by: dict[str, Column], tie: str) -> DataFrame:
    """One unique rank per named order within each set; without sets all rows are one, which no task holds."""
    if not sets:
        for k, c in by.items():
            rows = positions(rows, [c, tie], k).withColumn(k, (F.col(k) + 1).cast("int"))
        return rows
    return rows.withColumns({k: F.row_number().over(Window.partitionBy(*sets).orderBy(c, tie)) for k, c in by.items()})


def set_percentile(sets: list[str], order: Column) -> Column:
    """100 for the best of a set, 0 for the last; ties share the better value."""
    w = Window.partitionBy(*sets)
    n = F.count(F.lit(1)).over(w)
    return half_up((1 - (F.rank().over(w.orderBy(order)) - 1) / F.greatest(n - 1, F.lit(1))) * 100)


def extremes(rows: DataFrame, sets: list[str], value: str, most: bool = True) -> DataFrame:
    """Flags of the best and the worst value of each set."""
    w = Window.partitionBy(*sets)
    top, low = F.max(value).over(w), F.min(value).over(w)
    best, worst = (top, low) if most else (low, top)
    return rows.withColumns({"is_best": F.col(value) == best, "is_worst": F.col(value) == worst})


def winner(key: str, value: str, tie: str, most: bool = True) -> Column:
    """Aggregate: the key of the greatest (or least) value, the earliest on a tie."""
    return F.min_by(key, F.struct(-F.col(value) if most else F.col(value), F.col(tie)))


def range_position(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, 0 to 100; 50 if they are equal."""
    return F.when(high <= low, 50.0).otherwise(clamp((value - low) / (high - low) * 100, 0, 100))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def versions(changes: DataFrame, key: str, order: list[str], image: str) -> DataFrame:
    """Version numbers per key, with the image before, and a flag of the latest."""
    w = Window.partitionBy(key).orderBy(*order)
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumns({"version": F.row_number().over(w), "previous": F.lag(image).over(w), "is_latest": F.row_number().over(back) == 1})


def evict(entries: DataFrame, hits: str, tie: str, most: int, share: float = 0.2) -> DataFrame:
    """What stays of a cache: if it holds more than ``most``, the ceil(share) entries with the fewest hits go.

    The cut is by the place of an entry in the order of hits, so no task holds what goes.
    """
    n = entries.count()
    if n <= most:
        return entries
    gone = -(-n * int(share * 100) // 100)
    return positions(entries, [hits, tie], "_place").filter(F.col("_place") >= gone).drop("_place")


def topsis(rows: DataFrame, sets: list[str], key: str, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Closeness to the ideal and rank per set. criteria: column -> (weight, more is better).

    The sums, least and greatest values of a set are aggregates joined back (pre-aggregated before the shuffle), so a
    set with very many rows is not one window partition; only the final rank is.
    """
    closeness = _closeness(criteria, {c: w for c, (w, _) in criteria.items()})
    out = _with_ends(rows, sets, criteria).select(*sets, key, closeness.alias("closeness"))
    return ranks(out, sets, {"rank": F.desc("closeness")}, key)


def _with_ends(rows: DataFrame, sets: list[str], criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """``rows`` with the norm, the least and the greatest value of each criterion in their set."""
    found = [(f"_n_{c}", F.sqrt(F.sum(F.col(c) * F.col(c)))) for c in criteria] + [(f"_{k}_{c}", f(c)) for c in criteria for k, f in (("hi", F.max), ("lo", F.min))]
    per_set = rows.groupBy(*sets).agg(*[a.alias(n) for n, a in found])
    return _with(rows, per_set, sets)


def _closeness(criteria: dict[str, tuple[float, bool]], weights: dict[str, float]) -> Column:
    """Closeness of a row of ``_with_ends`` under ``weights``. Norms and weights are not negative, so the ends of scaled values are the scaled ends."""
    total = sum(weights.values())
    scaled = lambda c, v: F.when(F.col(f"_n_{c}") == 0, 0.0).otherwise(F.col(v) / F.col(f"_n_{c}")) * (weights[c] / total)
    far = lambda most: F.sqrt(reduce(lambda a, b: a + b, (F.pow(scaled(c, c) - scaled(c, f"_hi_{c}" if more == most else f"_lo_{c}"), 2) for c, (_, more) in criteria.items())))
    plus, minus = far(True), far(False)
    return F.round(F.when(plus + minus == 0, 0.5).otherwise(minus / (plus + minus)), 4)


def _with(rows: DataFrame, per_set: DataFrame, sets: list[str]) -> DataFrame:
    return rows.join(per_set, sets) if sets else rows.crossJoin(F.broadcast(per_set))


def topsis_sensitivity(rows: DataFrame, sets: list[str], key: str, criteria: dict[str, tuple[float, bool]], steps: tuple[float, ...] = (-0.1, -0.05, 0.05, 0.1)) -> DataFrame:
    """Per set: the winner, how many of the changed weightings keep it, and that share as stability.

    All weightings are read off the same rows: each is one aggregate of the set, so rows are neither repeated nor ranked.
    """
    base = {c: w for c, (w, _) in criteria.items()}
    changed = [base | {c: max(0.0, w + step)} for c, w in base.items() for step in steps]

    def best(weights: dict[str, float]) -> Column:
        near = _closeness(criteria, weights)
        return F.min(F.struct(near.isNull().alias("none"), (~F.isnan(near)).alias("number"), (-near).alias("near"), F.col(key).alias("key")))["key"]

    won = _with_ends(rows, sets, criteria).groupBy(*sets).agg(best(base).alias("winner"), F.array(*[best(w) for w in changed]).alias("_others"))
    flips = F.size(F.filter("_others", lambda o: o != F.col("winner"))).cast("long")
    counts = won.select(*sets, "winner", F.size("_others").cast("long").alias("n_scenarios"), flips.alias("n_flips"))
    return counts.withColumn("stability", F.round(1 - F.col("n_flips") / F.col("n_scenarios"), 4))
