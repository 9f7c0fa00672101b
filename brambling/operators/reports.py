"""What a reader sees: formatted limits, scenario cards and insights by rules tables, summary lines, reading order, workflow states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.text import coverage_key
from brambling.operators.joins import small


def shown_limit(coverage: Column, currency: str = "TRY", words: dict[str, str] | None = None) -> Column:
    """A limit as text: the amount, or in words unlimited, market value, included or not given."""
    w = {"unlimited": "Unlimited", "market": "Market value", "included": "Included", "none": "Not specified"} | (words or {})
    return (
        F.when(coverage["limit"] > 0, F.concat(F.format_number(coverage["limit"], 2), F.lit(f" {currency}")))
        .when(F.coalesce(coverage["is_unlimited"], F.lit(False)), w["unlimited"])
        .when(F.coalesce(coverage["is_market_value"], F.lit(False)), w["market"])
        .when(F.coalesce(coverage["included"], F.lit(False)), w["included"])
        .otherwise(w["none"])
    )


def reviewer_rows(policies: DataFrame, key: str, coverages: str, currency: str = "TRY") -> DataFrame:
    """One row per coverage in order: name, limit and deductible as text, and whether it is included."""
    rows = policies.select(key, F.posexplode(coverages).alias("position", "c"))
    deductible = F.when(F.col("c.deductible") > 0, F.concat(F.format_number(F.col("c.deductible"), 2), F.lit(f" {currency}"))).otherwise("None")
    return rows.select(key, "position", F.col("c.name").alias("name"), shown_limit(F.col("c"), currency).alias("limit"), deductible.alias("deductible"), F.coalesce("c.included", F.lit(True)).alias("included"))


def scenario_cards(policies: DataFrame, key: str, kind: str, coverages: str, scenarios: DataFrame) -> DataFrame:
    """What each scenario of a policy's kind costs its holder: covered, limited (with the limit) or open.

    scenarios (a small table): kind, scenario, needs (part of a coverage name). The largest matching coverage counts.
    """
    cards = policies.join(small(scenarios.withColumnRenamed("kind", "_kind")), F.col(kind) == F.col("_kind"))
    fits = F.filter(coverages, lambda c: F.coalesce(c["included"], F.lit(True)) & F.contains(coverage_key(c["name"]), coverage_key(F.col("needs"))))
    unlimited = F.exists("_fits", lambda c: F.coalesce(c["is_unlimited"], F.lit(False)))
    most = F.array_max(F.transform("_fits", lambda c: F.coalesce(c["limit"], F.lit(0.0))))
    status = F.when(F.size("_fits") == 0, "open").when(unlimited, "covered").otherwise("limited")
    return cards.withColumn("_fits", fits).select(key, "scenario", status.alias("status"), F.when(status == "limited", most).alias("insurer_pays"))


def insights(rows: DataFrame, key: str, rules: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """key, rule, kind, severity of the rules that hold. rules: name -> (kind, severity, condition)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for n, (k, s, c) in rules.items()]))
    return rows.select(key, F.explode(found).alias("i")).select(key, "i.*")


def safe_wording(text: Column, promises: dict[str, str]) -> Column:
    """Absolute promises replaced by guarded words."""
    for pattern, words in promises.items():
        text = F.regexp_replace(text, rf"(?i)\b{pattern}\b", words)
    return text


def summary_lines(rows: DataFrame, template: str, *columns: str) -> DataFrame:
    """One text line per row, for ``write.text``. template: a format with %s."""
    return rows.select(F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value"))


def reading_order(tokens: DataFrame, page: list[str], x: str, y: str, step: float = 50.0) -> DataFrame:
    """Position by rows of ``step`` height, then from left to right. (Comparing neighbours within a tolerance has no order.)"""
    w = Window.partitionBy(*page).orderBy(F.floor(F.col(y) / step), x, y)
    return tokens.withColumn("position", F.row_number().over(w))


def workflow_states(events: DataFrame, key: str, stage: str, ok: Column, ts: str, order: list[str]) -> DataFrame:
    """Per document the furthest stage passed, and done, failed (the last event of a stage was no success) or running."""
    place = F.create_map(*[F.lit(v) for k, s in enumerate(order, 1) for v in (s, k)])[F.col(stage)]
    per_stage = events.groupBy(key, stage).agg(F.max_by(ok, ts).alias("passed"), F.max(ts).alias("at"))
    found = per_stage.withColumn("_p", F.when(F.col("passed"), place)).groupBy(key).agg(F.max("_p").alias("furthest"), F.max_by("passed", "at").alias("last"))
    names = F.array(*[F.lit(s) for s in order])
    state = F.when(F.col("furthest") == len(order), "done").when(~F.col("last"), "failed").otherwise("running")
    return found.select(key, F.try_element_at(names, F.col("furthest")).alias("stage"), state.alias("state"))
