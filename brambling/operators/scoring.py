"""Scores, gaps and rules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.dictionaries import matching
from brambling.functions.numbers import URGENCY, banded, clamp, half_up
from brambling.functions.text import coverage_key

# Weights of severities and difficulties.
SEVERITY = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
EASE = {"easy": 30, "moderate": 20}


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, w) for k, w in SEVERITY.items()], F.lit(0))


def weighted_score(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not the sentinel -1; null if all are."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in parts.items():
        good = F.col(c).isNotNull() & (F.col(c) != -1)
        total = total + F.when(good, F.col(c) * w).otherwise(0.0)
        weight = weight + F.when(good, w).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def premium_score(premium: Column, low: Column, mean: Column, high: Column, trusted: Column, cap: float = 75) -> Column:
    """-1 without a premium, 70 without a trusted benchmark; 60 below the range, at most ``cap`` up to the mean, falling from 90 to 60 up to its end, 40 above.

    Not monotone by design: the cap holds up to the mean only.
    """
    return (
        F.when(premium.isNull() | (premium <= 0), -1.0)
        .when(~F.coalesce(trusted, F.lit(False)) | mean.isNull(), 70.0)
        .when(premium < low, 60.0)
        .when(premium <= mean, F.least(F.lit(float(cap)), 90 + half_up((mean - premium) / mean * 10)))
        .when(premium <= high, 90 - half_up((premium - mean) / F.when(high > mean, high - mean) * 30))
        .otherwise(40.0)
    )


def value_premium(premium: Column, value: Column, low: Column, mean: Column, high: Column) -> Column:
    """struct(rate, score, position) of a premium as a share of the insured value."""
    rate = F.when(value > 0, premium / value).otherwise(0.0)
    below = (mean - rate) / F.when(mean > low, mean - low)
    above = (rate - mean) / F.when(high > mean, high - mean)
    score = F.when(rate < low * 0.5, 60.0).when(rate <= low, 95.0).when(rate <= mean, 80 + half_up(below * 15)).when(rate <= high, 80 - half_up(above * 30)).otherwise(40.0)
    position = F.when(rate < low * 0.5, "average").when(rate <= low, "excellent").when(rate <= mean, F.when(score >= 90, "excellent").otherwise("good")).when(rate <= high, F.when(above < 0.5, "average").otherwise("high")).otherwise("very_high")
    known = low.isNotNull() & mean.isNotNull() & high.isNotNull() & (low > 0) & (mean > 0) & (high > 0)
    return F.when(known, F.struct(rate.alias("rate"), score.alias("score"), position.alias("position"))).otherwise(F.struct(F.lit(0.0).alias("rate"), F.lit(70.0).alias("score"), F.lit("average").alias("position")))


def evaluation(parts: DataFrame, weights: dict[str, float], critical: Column, untrusted: Column) -> DataFrame:
    """score (capped at 60 with a critical finding, else at 85 without a trusted benchmark), grade and status."""
    from brambling.functions.numbers import grade, score_status

    raw = half_up(weighted_score(weights))
    score = F.when(critical, F.least(raw, F.lit(60))).when(untrusted, F.least(raw, F.lit(85))).otherwise(raw).cast("double")
    return parts.withColumn("score", score).withColumn("grade", grade("score")).withColumn("status", score_status("score"))


def gap_priority(severity: Column, expected_loss: Column, confidence: Column, difficulty: Column) -> Column:
    ease = F.coalesce(*[F.when(difficulty == k, w) for k, w in EASE.items()], F.lit(10))
    return F.least(F.lit(100.0), severity_weight(severity) * 0.4 + F.least(F.lit(100.0), expected_loss / 10_000 * 50) * 0.3 + confidence * 20 * 0.15 + ease * 0.15)


def urgency(priority: Column | str) -> Column:
    return banded(priority, URGENCY, "monitor")


def gap_score(gaps: DataFrame, key: str, score: str, severity: str, category_weight: Column, order: str) -> DataFrame:
    """Severity scores weighted by category and severity, times 0.7 to 1 by their number.

    Scores lie on halves often, and a sum of doubles falls on either side of them by the order of its terms. So a key's
    gaps are summed in the order of ``order``, one after the other, however rows are dealt; a window streams them.
    """
    w = category_weight * severity_weight(F.col(severity)) / 100
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = gaps.select(key, order, (F.col(score) * w).alias("_s"), w.alias("_w"))
    run = weighed.select(key, F.sum("_s").over(so_far).alias("s"), F.sum("_w").over(so_far).alias("w"), F.count(F.lit(1)).over(so_far).alias("n"))
    sums = run.groupBy(key).agg(F.max("n").alias("n_gaps"), F.max_by("s", "n").alias("s"), F.max_by("w", "n").alias("w"))
    base = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0)
    return sums.select(key, "n_gaps", F.least(F.lit(100.0), half_up(base * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("n_gaps") / 10))).cast("double")).alias("gap_score"))


def strongest(gaps: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """One gap per key: the greatest score, the first on a tie."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), order)
    return gaps.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def missing_coverages(policies: DataFrame, required: DataFrame, key: str, kind: str, name: str, importance: str) -> DataFrame:
    """Required coverages of a policy's kind that it does not have, by normal form. policies: key, kind, name (one row per coverage)."""
    have = policies.select(key, coverage_key(name).alias("_k"))
    need = policies.select(key, kind).distinct().join(required.select(kind, F.col(name), importance, coverage_key(name).alias("_k")), kind)
    return need.join(have, [key, "_k"], "left_anti").select(key, kind, name, importance)


def limit_gap(limit: Column, market: Column, factor: Column) -> Column:
    """struct(percent of market, severity) of a limit against the regional market limit."""
    percent = limit / F.when(market * factor > 0, market * factor) * 100
    return F.struct(half_up(percent, 2).alias("percent"), F.when(percent < 30, "critical").when(percent < 50, "high").when(percent < 75, "medium").when(percent < 100, "low").alias("severity"))


def deductible_gap(deductible: Column, typical: Column) -> Column:
    share = deductible / F.when(typical > 0, typical)
    return F.when(share > 2.5, "high").when(share > 2, "medium").when(share > 1.5, "low")


def temporal_gap(start: Column, expiry: Column, today: Column, warn: int = 30) -> Column:
    """struct(kind, severity, score) of the term: an expired policy is milder than one about to expire, as nothing can be done."""
    left = F.datediff(expiry, today)
    gap = lambda k, s, n: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(n).alias("score"))
    return (
        F.when(expiry.isNull(), gap("no_expiry", "medium", 50)).when(left < 0, gap("expired", "info", 20)).when(left <= 7, gap("expiring_now", "critical", 90))
        .when(left <= warn, gap("expiring", "high", 70)).when(F.datediff(expiry, start) < 365, gap("short_term", "low", 30))
    )


def market_gap_score(missing: Column, under: Column, deductibles: Column, exclusions: Column) -> Column:
    """Additive points for four arrays of levels, up to 100."""
    # Points by level.
    def points(levels: Column, table: dict[str, int], other: int) -> Column:
        each = lambda x: F.coalesce(*[F.when(x == k, v) for k, v in table.items()], F.lit(other))
        return F.aggregate(levels, F.lit(0), lambda a, x: a + each(x))

    return F.least(F.lit(100), points(missing, {"critical": 15, "recommended": 8}, 3) + points(under, {"high": 12, "medium": 6}, 2) + points(deductibles, {"high": 5, "medium": 3}, 1) + points(exclusions, {"high": 8, "medium": 4}, 1))


def closure_cost(missing_cost: Column, factor: Column, mean_premium: Column, current: Column, recommended: Column) -> Column:
    """Cost of the missing parts plus log-growing cost of raised limits, at the regional factor."""
    upgrade = F.when((current > 0) & (recommended > 0), F.log2(recommended / F.when(current > 0, current))).otherwise(0.0) * 0.15
    return half_up((missing_cost + mean_premium * 0.1 * upgrade) * factor).cast("double")


def display_mode(critical: Column, warning: Column) -> Column:
    return F.when(critical > 0, "human_review").when(warning > 0, "restricted").otherwise("full")


def validation_score(errors: Column, warnings: Column, infos: Column, bonus: Column) -> Column:
    return clamp(100 - errors * 15 - warnings * 5 - infos + bonus, 0, 100)


def level_probabilities(rows: DataFrame, key: str, score: str, spread: float = 15.0) -> DataFrame:
    """Probability of each risk level: weights by distance of the score to the middle of the level, normalised."""
    levels = [("very_low", 10.0), ("low", 27.5), ("moderate", 45.0), ("high", 65.0), ("very_high", 87.5)]
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(m).alias("middle")) for k, m in levels])
    weighed = F.transform(pairs, lambda p: F.struct(p["level"].alias("level"), F.exp(-F.pow((F.col(score) - p["middle"]) / spread, 2) / 2).alias("w")))
    out = rows.withColumn("_p", weighed).withColumn("_t", F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["w"]))
    return out.select(key, score, F.explode("_p").alias("p"), "_t").select(key, score, "p.level", F.round(F.col("p.w") / F.col("_t"), 6).alias("probability"))


def rule_findings(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, findings array<struct<rule, severity>>, and counts by severity. rules: name -> (severity, failed)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, bad) in rules.items()]))
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    return rows.select(key, found.alias("findings")).select(key, "findings", count("critical").alias("n_critical"), count("warning").alias("n_warning"), count("info").alias("n_info"))


def pattern_findings(texts: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """key, pattern, severity of every pattern (a table of rules: name, pattern, severity) that a text matches."""
    return matching(texts.select(key, text), text, patterns, "pattern").select(key, "name", "severity")


def budget_check(budgets: DataFrame, request: dict[str, str], cost: float) -> DataFrame:
    """Budgets that apply to a request, with what it would do. budgets: applies_to, target, used, limit, warn_at, action."""
    applies = F.lit(False)
    for kind, value in request.items():
        applies = applies | ((F.col("applies_to") == kind) & (F.col("target") == value))
    projected = F.col("used") + cost
    verdict = F.when(projected > F.col("limit"), F.col("action")).when(projected > F.col("limit") * F.col("warn_at"), "warn").otherwise("pass")
    return budgets.filter((F.col("applies_to") == "all") | applies).withColumn("projected", projected).withColumn("verdict", verdict)


def budget_checks(requests: DataFrame, key: str, targets: dict[str, str], cost: str, budgets: DataFrame) -> DataFrame:
    """key, n_budgets, n_warn, n_notify, allowed of every request, by the budgets that apply to it.

    targets: kind of budget -> the request's column that names its target; budgets of the kind ``all`` (with an empty target)
    apply to every request. budgets: applies_to, target, used, limit, warn_at, action. A request meets its budgets by kind and
    target, so neither is paired with what does not apply; one without any is not returned.
    """
    kinds = F.array(F.struct(F.lit("all").alias("applies_to"), F.lit("").alias("target")), *[F.struct(F.lit(k).alias("applies_to"), F.col(c).cast("string").alias("target")) for k, c in targets.items()])
    asked = requests.select(key, F.col(cost).alias("_cost"), F.explode(kinds).alias("t")).select(key, "_cost", "t.*")
    projected = F.round(F.col("used") + F.col("_cost"), 4)
    verdict = F.when(projected > F.col("limit"), F.col("action")).when(projected > F.col("limit") * F.col("warn_at"), "warn").otherwise("pass")
    met = asked.join(budgets, ["applies_to", "target"]).select(key, verdict.alias("verdict"))
    count = lambda v: F.count_if(F.col("verdict") == v)
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("n_budgets"), count("warn").alias("n_warn"), count("notify").alias("n_notify"), (count("block") == 0).alias("allowed"))


def running_budget(costs: DataFrame, budget: str, period: Column, ts: str, cost: str, limit: float) -> DataFrame:
    """Costs so far in the period of each budget, and whether they exceed the limit."""
    w = Window.partitionBy(budget, "period").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = costs.withColumn("period", period).withColumn("spent", F.sum(cost).over(w))
    return out.withColumn("over", F.col("spent") > limit)
