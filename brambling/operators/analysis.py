"""Extractions as analysed policies: canonical labels, projections, safety, compliance and market views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.functions.dictionaries import first_inside, rules_of
from brambling.functions.numbers import banded, clamp, half_up, ratio
from brambling.functions.text import col, label_key
from brambling.operators.joins import small


def canonical_label(c: Column | str, rules: list[tuple[str, list[str], list[str]]], dictionary: dict[str, str], default: str = "UNKNOWN") -> Column:
    """The concept of a coverage label: the first rule of which a part occurs or a whole equals it, else the dictionary, else the default.

    rules: (concept, parts, wholes), tried in order on the label in Turkish lower case and with a dotless i as i.
    """
    turkish = label_key(c)
    english = F.translate(turkish, "ı", "i")
    out = F.lit(default)
    if dictionary:
        table = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
        out = F.coalesce(table[turkish], table[english], F.lit(default))
    for concept, parts, wholes in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(turkish, F.lit(p)) | F.contains(english, F.lit(p))
        if wholes:
            hit = hit | turkish.isin(wholes) | english.isin(wholes)
        out = F.when(hit, F.lit(concept)).otherwise(out)
    return F.when(F.coalesce(F.trim(col(c)), F.lit("")) == "", F.lit(default)).otherwise(out)


def canonical_labels(rows: DataFrame, c: str, rules: DataFrame, dictionary: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """``rows`` with the concept of a label, as ``canonical_label`` finds it, from tables of any length.

    rules: pos, part, whole, concept (a rule has a part, which may stand anywhere in the label, or a whole); dictionary: label,
    concept. Parts of all rules are found by one automaton, wholes and labels by joins; labels are compared in Turkish lower
    case and with a dotless i as i, a whole or dictionary label with either form.
    """
    parts = rules_of(rules.filter("part IS NOT NULL"), "pos", "part", "concept")
    inside = first_inside(F.concat_ws("\n", F.col("_tr"), F.translate("_tr", "ı", "i")), [p for _, p, _ in parts], [f"{pos}\n{concept}" for pos, _, concept in parts])
    by = F.split(inside, "\n")
    different = rows.select(F.col(c).alias("_c")).distinct().withColumn("_tr", label_key("_c")).filter("trim(_tr) <> ''")
    known = rules.filter("whole IS NOT NULL").select("whole", F.struct(F.col("pos").cast("int").alias("pos"), "concept").alias("hit"))
    listed = dictionary.select(F.col("label").alias("whole"), F.struct(F.lit(2**31 - 1).alias("pos"), "concept").alias("hit"))
    forms = different.select("_c", F.explode(F.array_distinct(F.array("_tr", F.translate("_tr", "ı", "i")))).alias("whole"))
    wholes = forms.join(known.unionByName(listed), "whole").select("_c", "hit")
    found = different.withColumn("_by", by).filter("_by IS NOT NULL").select("_c", F.struct(F.element_at("_by", 1).cast("int").alias("pos"), F.element_at("_by", 2).alias("concept")).alias("hit"))
    best = wholes.unionByName(found).groupBy("_c").agg(F.min("hit").alias("_hit"))
    return rows.join(best, F.col(c) == F.col("_c"), "left").select(*rows.columns, F.coalesce("_hit.concept", F.lit(default)).alias("label"))


def money(amount: Column, currency: Column) -> Column:
    """struct(amount, currency), or null without an amount."""
    return F.when(amount.isNotNull(), F.struct(amount.cast("double").alias("amount"), currency.alias("currency")))


def with_evidence(value: Column, quote: Column) -> Column:
    """A field and what shows it; without a quote it was inferred."""
    return F.struct(value.alias("value"), quote.alias("quote"), F.when(quote.isNotNull(), "extracted").otherwise("inferred").alias("source"))


def actuarial_input(policies: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The input of the actuarial stages. policies: id, kind, product, premium, currency, start, expiry, insured, deductible_percent, n_conditional, parts, network (null: not given)."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")], F.lit("other"))
    given = lambda c, other: with_evidence(F.coalesce(F.col(c), F.lit(other)), F.col(c))
    return policies.select(
        "id", kind.alias("kind"), "product", money(F.col("premium"), F.col("currency")).alias("premium"), "start", "expiry", F.when(F.col("insured") > 0, money(F.col("insured"), F.col("currency"))).alias("insured_value"),
        given("parts", "unspecified").alias("parts"), given("network", "unspecified").alias("network"), F.col("premium").isNull().alias("premium_missing"),
        (F.coalesce("deductible_percent", F.lit(0.0)) > 0).alias("has_percentage_deductible"), (F.coalesce("n_conditional", F.lit(0)) > 0).alias("has_conditional_deductibles"),
    )


def analysed(extractions: DataFrame, today: Column, label) -> DataFrame:
    """Extractions as analysed policies: coverages under canonical labels (one per label, the greatest limit), totals, term, status and warnings.

    extractions: id, kind, premium, start, expiry, coverages array<struct<name, limit, included>>. label: name -> canonical label.
    """
    named = F.transform("coverages", lambda c: F.struct(label(c["name"]).alias("label"), c["name"].alias("name"), c["limit"].alias("limit"), F.coalesce(c["included"], F.lit(True)).alias("included")))
    rows = extractions.withColumn("_c", named)
    labels = F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["label"])))
    most = lambda x: F.array_max(F.transform(F.filter("_c", lambda c: c["label"] == x), lambda c: F.coalesce(c["limit"], F.lit(0.0))))
    rows = rows.withColumn("coverages", F.transform(labels, lambda x: F.struct(x.alias("label"), most(x).alias("limit"))))
    left = F.datediff("expiry", today)
    status = F.when(F.col("expiry").isNull(), "unknown").when(left < 0, "expired").when(left <= 30, "expiring").otherwise("active")
    warnings = F.array_compact(F.array(F.when(F.col("premium").isNull(), "premium"), F.when(F.size("coverages") == 0, "coverages"), F.when(F.col("start") > F.col("expiry"), "dates"), F.when(F.exists("_c", lambda c: c["label"] == "UNKNOWN"), "labels")))
    return rows.select(
        "id", "kind", "premium", half_up(F.col("premium") / 12).alias("monthly_premium"), "coverages", F.aggregate("coverages", F.lit(0.0), lambda a, c: a + c["limit"]).alias("total"), left.alias("days_left"), status.alias("status"), warnings.alias("warnings")
    )


def safety_flags(currency: Column, premium: Column, coverages: Column, has_evidence: Column, branch: dict[str, tuple[str, Column]]) -> Column:
    """array<struct<field, level>>: what makes an extraction unsafe to show. An error blocks. branch: name -> (level, failed) of its kind."""
    flag = lambda f, lv: F.struct(F.lit(f).alias("field"), F.lit(lv).alias("level"))
    none = F.coalesce(F.size(coverages), F.lit(0)) <= 0
    negative = F.coalesce(F.exists(coverages, lambda c: c["deductible"] < 0), F.lit(False))
    open_limit = F.coalesce(F.exists(coverages, lambda c: c["limit"].isNull() & ~F.coalesce(c["is_unlimited"], F.lit(False)) & ~F.coalesce(c["is_market_value"], F.lit(False))), F.lit(False))
    found = [
        F.when(F.coalesce(currency, F.lit("")) == "", flag("currency", "error")), F.when(premium.isNull(), flag("premium", "warning")), F.when(none, flag("coverages", "warning")),
        F.when(negative, flag("deductible", "error")), F.when(open_limit, flag("limit", "warning")), F.when(~F.coalesce(has_evidence, F.lit(False)), flag("evidence", "warning")),
    ]
    found += [F.when(F.coalesce(bad, F.lit(False)), flag(n, lv)) for n, (lv, bad) in branch.items()]
    return F.array_compact(F.array(*found))


def compliance_gaps(policies: DataFrame, key: str, kind: str, coverages: str, requirements: DataFrame) -> DataFrame:
    """key, requirement, severity, shortfall: required coverages of a kind that no coverage name holds, or whose limit is too low.

    coverages: array<struct<name, limit>>. requirements (a small table): kind, requirement, pattern, minimum (or null), severity.
    """
    r = small(requirements.withColumnRenamed("kind", "_kind"))
    fits = F.filter(coverages, lambda c: F.regexp_like(F.lower(c["name"]), F.col("pattern")))
    most = F.array_max(F.transform("_fits", lambda c: F.coalesce(c["limit"], F.lit(0.0))))
    rows = policies.join(r, F.col(kind) == F.col("_kind")).withColumn("_fits", fits)
    short = F.when(F.size("_fits") == 0, F.coalesce("minimum", F.lit(0.0))).when(most < F.col("minimum"), F.col("minimum") - most)
    return rows.withColumn("shortfall", short).filter("shortfall is not null").select(key, "requirement", "severity", F.when(F.size("_fits") == 0, "missing").otherwise("too_low").alias("gap"), "shortfall")


def compliance_score(findings: Column, penalties: dict[str, int]) -> Column:
    """struct(score, compliant): 100 less the penalty of each finding's level; nothing that blocks may be among them."""
    cost = lambda f: F.coalesce(*[F.when(f["level"] == k, v) for k, v in penalties.items()], F.lit(0))
    score = clamp(F.lit(100) - F.aggregate(findings, F.lit(0), lambda a, f: a + cost(f)), 0, 100)
    return F.struct(score.cast("double").alias("score"), (~F.exists(findings, lambda f: f["level"] == "blocking")).alias("compliant"))


def market_comparison(policies: DataFrame, kind: str, premium: str, coverage: str, benchmarks: DataFrame) -> DataFrame:
    """Policies beside the market of their kind: places in its ranges (0 to 100), ratings, value for money and the trend.

    benchmarks (a small table): kind, low, mean, high of premiums, coverage_low, coverage_mean, coverage_high, trend (percent a year).
    """
    b = small(benchmarks.withColumnRenamed("kind", "_kind"))
    place = lambda v, low, high: clamp((F.col(v) - F.col(low)) / F.when(F.col(high) > F.col(low), F.col(high) - F.col(low)) * 100, 0, 100)
    rows = policies.join(b, F.col(kind) == F.col("_kind"))
    rows = rows.withColumns({"premium_percentile": place(premium, "low", "high"), "coverage_percentile": place(coverage, "coverage_low", "coverage_high"), "value_ratio": ratio(F.col(coverage).cast("double"), F.col(premium)), "market_ratio": F.col("coverage_mean") / F.col("mean")})
    better = F.col("value_ratio") / F.col("market_ratio")
    return rows.withColumns({
        "premium_rating": banded("premium_percentile", [(25, "excellent"), (50, "good"), (75, "average")], "high", up_to=True),
        "coverage_rating": banded("coverage_percentile", [(75, "excellent"), (50, "good"), (25, "average")], "low"),
        "value_rating": banded(better, [(1.2, "excellent"), (1.0, "good"), (0.8, "average")], "poor"),
        "market_trend": F.when(F.col("trend") > 5, "increasing").when(F.col("trend") < -5, "decreasing").otherwise("stable"),
    }).drop("_kind")
