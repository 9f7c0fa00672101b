"""Market and region dimensions: rankings, shares, comparisons, benchmarks with provenance, costs, and whole evaluations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.dictionaries import matching
from brambling.functions.numbers import clamp, half_up, ratio
from brambling.operators.joins import small
from brambling.operators.scoring import severity_weight


def ranked(rows: DataFrame, sets: list[str], key: str, value: Column, ascending: bool) -> DataFrame:
    """Rank of a metric in its own direction, and percent above or below the unweighted mean of the set."""
    found = rows.select(*sets, key, value.alias("value"))
    means = found.groupBy(*sets).agg(F.avg("value").alias("_m"))
    joined = found.join(means, sets) if sets else found.crossJoin(F.broadcast(means))
    order = F.asc("value") if ascending else F.desc("value")
    percent = half_up(ratio(F.col("value") - F.col("_m"), F.col("_m")) * 100, 1)
    return joined.select(*sets, key, "value", percent.alias("vs_mean"), F.row_number().over(Window.partitionBy(*sets).orderBy(order, key)).alias("rank"))


def region_deltas(regions: DataFrame, source: str, key: str, premium: str) -> DataFrame:
    """One region against all others (a small dimension): difference and percent, cheapest first."""
    own = regions.filter(F.col(key) == source).select(F.col(premium).alias("_own"))
    out = small(regions.filter(F.col(key) != source)).crossJoin(F.broadcast(own))
    return out.select(key, premium, (F.col(premium) - F.col("_own")).alias("delta"), half_up(ratio(F.col(premium) - F.col("_own"), F.col("_own")) * 100, 1).alias("percent")).orderBy("delta", key)


def shares(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """Sum per key, share of the whole, and rank by share."""
    sums = rows.groupBy(key).agg(F.sum(weight).alias("total"))
    whole = rows.agg(F.sum(weight).alias("_w"))
    out = sums.crossJoin(F.broadcast(whole)).withColumn("share", ratio(F.col("total").cast("double"), F.col("_w"))).drop("_w")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))


def regional_risk(zone: Column, floods: Column, thefts: Column, accidents: Column) -> Column:
    """0 to 100 from earthquake zone (1 is worst), floods a year, thefts and accidents per unit."""
    return half_up(F.least(F.lit(100.0), (6 - zone) * 15 + floods * 1.5 + thefts / 250 * 20 + accidents / 900 * 15)).cast("double")


def market_position(premium: Column, low: Column, high: Column, coverage: Column) -> Column:
    """struct(premium_percentile, coverage_percentile): 100 is the cheapest; coverage against twenty premiums."""
    p = F.when(high > low, clamp(100 - (premium - low) / (high - low) * 100, 0, 100)).otherwise(50.0)
    c = F.when((coverage > 0) & (premium > 0), F.least(F.lit(100.0), coverage / (premium * 20) * 50)).otherwise(50.0)
    return F.struct(half_up(p).cast("double").alias("premium_percentile"), half_up(c).cast("double").alias("coverage_percentile"))


def trusted(benchmarks: DataFrame, source: str, data_date: str, today: Column, oldest_days: int = 540) -> DataFrame:
    """Benchmarks with ``status``: verified with a source and fresh data, stale, or untrusted without a source."""
    age = F.datediff(today, F.col(data_date))
    return benchmarks.withColumn("status", F.when(F.coalesce(F.trim(source), F.lit("")) == "", "untrusted").when(age.isNull() | (age > oldest_days), "stale").otherwise("verified"))


def replaced_wholesale(static: DataFrame, stored: DataFrame, kind: str) -> DataFrame:
    """Kinds that the stored table has come from it alone, all others from the static list."""
    return static.join(stored.select(kind).distinct(), kind, "left_anti").unionByName(stored, allowMissingColumns=True)


def token_cost(logs: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Cost by the price of the model (per 1,000 tokens, a small table), else of the default row (null model)."""
    default = prices.filter("model is null").select(F.col("price_in").alias("_di"), F.col("price_out").alias("_do"))
    own = prices.filter("model is not null").select(F.col("model").alias("_model"), "price_in", "price_out")
    out = logs.join(small(own), F.col(model) == F.col("_model"), "left").crossJoin(F.broadcast(default.limit(1)))
    price = (F.col(tokens_in) * F.coalesce("price_in", "_di") + F.col(tokens_out) * F.coalesce("price_out", "_do")) / 1000
    return out.select(*logs.columns, price.cast("decimal(18,6)").alias("cost"))


def usage_weighted(versions: DataFrame, key: str, uses: str, means: list[str]) -> DataFrame:
    """Means of means, weighted by use; 0 without any."""
    return versions.groupBy(key).agg(F.sum(uses).alias("total_usage"), *[ratio(F.sum(F.col(m) * F.col(uses)), F.sum(uses)).alias(m) for m in means])


def financial_summary(gaps: DataFrame, key: str, loss: str, expected: str, cost: str) -> DataFrame:
    sums = gaps.groupBy(key).agg(F.sum(loss).alias("potential_loss"), F.sum(expected).alias("expected_loss"), F.coalesce(F.sum(cost), F.lit(0)).alias("cost"))
    return sums.withColumn("benefit", ratio(F.col("expected_loss").cast("double"), F.col("cost")))


def merged_coverages(rows: DataFrame, keys: list[str], name: str, limit: str, order: str, firsts: list[str]) -> DataFrame:
    """One row per lower-case name: the greatest limit, and of the other columns the first value there is."""
    k = F.lower(F.trim(name)).alias("name_key")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return rows.groupBy(*keys, k).agg(F.max(limit).alias(limit), *first)


def exclusion_impacts(texts: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """Per exclusion text: the scenarios of all patterns that match, the worst severity, and whether a person must look.

    patterns (a table of rules): name, pattern, severity, scenarios array<string>. Equal texts are matched once.
    """
    different = texts.select(F.col(text).alias("_t")).distinct()
    hits = matching(different, "_t", patterns, "pattern")
    worst = F.max_by("severity", severity_weight(F.col("severity")))
    per = hits.groupBy("_t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scenarios")))).alias("scenarios"), worst.alias("severity"))
    out = texts.join(per, F.col(text) == F.col("_t"), "left")
    return out.select(key, text, F.coalesce("scenarios", F.array().cast("array<string>")).alias("scenarios"), F.coalesce("severity", F.lit("info")).alias("severity"), F.col("severity").isNull().alias("needs_review"))


def gap_run(parts: list[DataFrame], key: str) -> DataFrame:
    """The gaps of all analysers (key, category, name, severity, score, loss, confidence, difficulty): the strongest per name, ranked per policy."""
    from brambling.operators.scoring import gap_priority, strongest, urgency

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    kept = strongest(every, [key, "category", "name"], "score", "severity")
    scored = kept.withColumn("priority", gap_priority(F.col("severity"), F.col("loss"), F.col("confidence"), F.col("difficulty")))
    return scored.withColumn("urgency", urgency("priority")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "category", "name")))


def score_bundle(quality: Column, structure: Column, safety: Column) -> Column:
    """Whole mean of the three scores that need no benchmark; a missing one counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return half_up((zero(quality) + zero(structure) + zero(safety)) / 3).cast("double")


def insurer_key(c: Column) -> Column:
    """Insurer names without legal suffixes. Unicode compatibility forms have no JVM function, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower().replace("i̇", "i"))

    out = F.trim(F.regexp_replace(folded(c), r"\s+", " "))
    for suffix in (r"a\.?\s*ş\.?", r"ltd\.?\s*şti\.?", r"ltd\.?", "sigorta", "[ıi]nsurance"):  # in this order
        out = F.regexp_replace(out, rf"\s+{suffix}$", "")
    return F.trim(out)
