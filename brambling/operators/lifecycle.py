"""What happens to things over time and by rules: alerts, access, learned patterns, QA reports, rule packs, quarantine, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.numbers import clamp, half_up, ratio
from brambling.functions.text import col
from brambling.operators.joins import small


def alert_states(steps: DataFrame, key: str, action: str, at: str, tie: str) -> DataFrame:
    """key, alert, opened, closed, n_triggers, state: a trigger opens an alert unless one is open; it is active, acknowledged or resolved.

    An acknowledgement or a resolution without an open alert does nothing. The number of the alert of a key is that of the
    resolutions before it, so the steps of a key are one sorted window and no state is kept by hand.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    kept = F.col(action).isin("trigger", "resolve")
    before = F.last(F.when(kept, F.col(action)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col(action) == "trigger") & ~before.eqNullSafe(F.lit("trigger"))
    numbered = steps.withColumn("_opens", opens).withColumn("alert", F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    idle = ~F.col(action).eqNullSafe(F.lit("trigger")) & before.eqNullSafe(F.lit("resolve"))
    live = numbered.withColumn("_idle", idle).filter("alert > 0 and not _idle")
    found = live.groupBy(key, "alert").agg(
        F.min(at).alias("opened"), F.max(F.when(F.col(action) == "resolve", F.col(at))).alias("closed"), F.count_if(F.col(action) == "trigger").alias("n_triggers"), F.count_if(F.col(action) == "acknowledge").alias("_n")
    )
    state = F.when(F.col("closed").isNotNull(), "resolved").when(F.col("_n") > 0, "acknowledged").otherwise("active")
    return found.withColumn("state", state).drop("_n")


def unusual_access(events: DataFrame, key: str, ts: str, resource: str, minutes: int = 5, slide: int = 1, per_minute: float = 30, resources: int = 20, sensitivity: float = 1.0, least: int = 5) -> DataFrame:
    """key, start, n, n_resources, finding of the sliding windows in which a key asks too often (scraping) or for too many different things."""
    window = F.window(F.col(ts), f"{minutes} minutes", f"{slide} minutes")
    counted = events.groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(resource).alias("n_resources"))
    scraping, many = F.col("n") / minutes > per_minute * sensitivity, F.col("n_resources") > resources * sensitivity
    finding = F.array_compact(F.array(F.when(scraping, "scraping"), F.when(many, "unusual")))
    return counted.filter(F.col("n") >= least).select(key, F.col("w.start").alias("start"), "n", "n_resources", F.explode(finding).alias("finding"))


def pruned(patterns: DataFrame, occurrences: str, confidence: str, promoted: str, least: int = 3) -> DataFrame:
    """Patterns without those that are rare and doubtful, unless they were promoted."""
    return patterns.filter(F.coalesce(F.col(promoted), F.lit(False)) | (F.col(confidence) >= 0.5) | (F.col(occurrences) >= least))


def top_failing(patterns: DataFrame, name: str, failures: str, occurrences: str, n: int = 10, least: int = 2) -> DataFrame:
    """The patterns with the greatest share of failures among those that occurred often enough."""
    rate = F.col(failures) / F.col(occurrences)
    return patterns.filter(F.col(occurrences) >= least).withColumn("failure_rate", F.round(rate, 6)).orderBy(rate.desc(), name).limit(n)


def pattern_rules(patterns: DataFrame, pattern: str, confidence: str, occurrences: str, least: float = 0.8, often: int = 3) -> DataFrame:
    """Learned patterns as rules: those sure and frequent enough, with every character of regular expressions escaped."""
    kept = patterns.filter((F.col(confidence) >= least) & (F.col(occurrences) >= often))
    return kept.withColumn("rule", F.regexp_replace(F.col(pattern), r"([.*+?^${}()|\[\]\\])", r"\\$1"))


def document_report(chunks: DataFrame, key: str, status: str) -> DataFrame:
    """Counts of chunk verdicts per document and the verdict of the whole: passed, partial or failed."""
    n = lambda s: F.count_if(F.col(status) == s)
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), n("passed").alias("passed"), n("failed").alias("failed"), n("passed_after_retry").alias("retried"), n("manual_review").alias("review"))
    whole = F.when((F.col("failed") == 0) & (F.col("review") == 0), "passed").when(F.col("passed") + F.col("retried") > 0, "partial").otherwise("failed")
    return counts.withColumn("overall", whole)


def batch_summary(results: DataFrame, text_ok: Column, model_ok: Column, coverages: Column, clean: Column) -> DataFrame:
    """One row: how many files, texts and extractions worked, how many leak phrases, and the mean number of coverages."""
    mean = F.avg(F.when(model_ok, coverages))
    return results.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(text_ok).alias("text_ok"), F.count_if(~text_ok).alias("text_failed"), F.count_if(model_ok).alias("model_ok"), F.count_if(~model_ok).alias("model_failed"),
        F.count_if(~clean).alias("leaks"), F.coalesce(half_up(mean, 1), F.lit(0.0)).alias("mean_coverages"),
    )


def trend_metrics(coverages: Column, exclusions: Column, deductibles: Column, insights: Column, bundles: Column) -> dict[str, Column]:
    """Six sizes of a structured extraction; an absent array has none."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = lambda c: F.when(c.isNull(), 0).otherwise(n(c))
    return {
        "coverages": size(coverages), "exclusions": size(exclusions), "conditional_deductibles": size(deductibles), "ai_insights": size(insights),
        "supplementary_count": size(F.filter(coverages, lambda c: c["category"] == "supplementary")), "bundle_products": size(bundles),
    }


def normalised_features(f: dict[str, Column]) -> dict[str, Column]:
    """Risk features on scales from 0 to 1, as the risk model takes them."""
    return {
        "coverage_ratio": f["coverage_ratio"], "coverage_gap": F.least(f["gaps"] / 5, F.lit(1.0)), "has_minimum": F.when(f["has_minimum"], 0).otherwise(1),
        "deductible_ratio": F.least(F.coalesce(f["deductible_ratio"], F.lit(0.0)), F.lit(1.0)), "provider": F.when(F.coalesce(f["rating"], F.lit(0.0)) != 0, 1 - (f["rating"] - 1) / 4).otherwise(0.5),
        "expiry": F.when(f["expired"], 1.0).when(f["renewal"], 0.7).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(f["days_left"], F.lit(365)) / 365)),
        "region": (f["region"] - 0.8) / 0.7, "urban": (f["urban"] - 0.9) / 0.3, "exclusions": F.when(f["high_risk_exclusions"], 0.8).otherwise(0.2),
        "conditions": F.least(f["conditions"] / 10, F.lit(1.0)), "pricing": F.coalesce(F.abs(f["price_ratio"] - 1), F.lit(0.5)),
    }


def risk_interval(score: Column, confidence: Column) -> Column:
    """struct(low, median, high): the less sure a score, the wider, by 20 points at most."""
    spread = (1 - confidence) * 20
    return F.struct(F.greatest(F.lit(0.0), score - spread).alias("low"), score.cast("double").alias("median"), F.least(F.lit(100.0), score + spread).alias("high"))


def selected_pack(rows: DataFrame, packs: DataFrame, hint: str, detected: str, confidence: str, fallback: str = "fallback") -> DataFrame:
    """The rule pack of each row: that of the hint, else the detected one, else the fallback; how it was found and how sure that is.

    packs (a small table, the registry): pack, and what belongs to it.
    """
    names = packs.select("pack").distinct()
    known = lambda c, flag: small(names.select(F.col("pack").alias(f"_{c}"), F.lit(True).alias(flag)))
    out = rows.join(known("h", "_by_hint"), F.col(hint) == F.col("_h"), "left").join(known("d", "_by_text"), F.col(detected) == F.col("_d"), "left")
    method = F.when(F.col("_by_hint"), "hint").when(F.col("_by_text"), "auto").otherwise("fallback")
    pack = F.when(F.col("_by_hint"), F.col(hint)).when(F.col("_by_text"), F.col(detected)).otherwise(F.lit(fallback))
    sure = F.when(F.col("_by_hint"), 1.0).when(F.col("_by_text"), F.col(confidence)).otherwise(0.5)
    return out.select(*rows.columns, pack.alias("pack"), method.alias("method"), sure.alias("pack_confidence"))


def pack_findings(rows: DataFrame, key: str, pack: str, rules: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """key, rule, severity: the rules of a row's pack that fail. rules (a small table): pack, rule, severity, check; checks: name -> passes.

    Packs are data: a new one is new rows of the table, and its rules name the checks that the caller offers.
    """
    given = F.create_map(*[x for name, ok in checks.items() for x in (F.lit(name), F.coalesce(ok, F.lit(False)))])
    r = small(rules.select(F.col("pack").alias("_pack"), "rule", "severity", "check"))
    return rows.withColumn("_checks", given).join(r, F.col(pack) == F.col("_pack")).filter(~F.coalesce(F.col("_checks")[F.col("check")], F.lit(True))).select(key, "rule", "severity")


def gate(rows: DataFrame, key: str, findings: DataFrame) -> DataFrame:
    """key, counts by severity, passed (nothing critical), read_again (critical or three errors), quarantine (the first critical rule)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = findings.groupBy(key).agg(n("critical").alias("n_critical"), n("error").alias("n_error"), n("warn").alias("n_warn"), F.min(F.when(F.col("severity") == "critical", F.col("rule"))).alias("quarantine"))
    out = rows.select(key).join(counts, key, "left").fillna(0, ["n_critical", "n_error", "n_warn"])
    return out.select(key, "n_critical", "n_error", "n_warn", (F.col("n_critical") == 0).alias("passed"), ((F.col("n_critical") > 0) | (F.col("n_error") >= 3)).alias("read_again"), "quarantine")


def product_mismatch(name: Column | str, codes: Column, products: list[tuple[list[str], list[str]]], aliases: dict[str, list[str]], full: tuple[str, ...] = ("tam", "full", "genişletilmiş")) -> Column:
    """struct(missing, severity) of a product that is named for more than it covers, else null.

    codes: the included coverage codes. products: (parts of the name, required codes), the first that fits counts; one whose
    own names promise everything blocks.
    """
    lower = F.lower(F.trim(col(name)))
    have = F.transform(codes, lambda c: F.upper(c))
    out = F.lit(None).cast("struct<missing: array<string>, severity: string>")
    for names, required in reversed(products):
        fits = F.lit(False)
        for n in names:
            fits = fits | F.contains(lower, F.lit(n))
        gone = F.array_compact(F.array(*[F.when(~F.arrays_overlap(have, F.array(*[F.lit(a) for a in aliases.get(r, [r])])), F.lit(r)) for r in required]))
        level = "blocking" if any(f in n for n in names for f in full) else "critical"
        found = F.when(F.size(gone) > 0, F.struct(gone.alias("missing"), F.lit(level).alias("severity")))
        out = F.when(fits, found).otherwise(out)
    return F.when(F.coalesce(lower, F.lit("")) != "", out)


def overridden(defaults: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Parameters with those of ``changes`` (a small table) where it has any; null there means unchanged."""
    c = small(changes.select(key, *[F.col(v).alias(f"_{v}") for v in values]))
    return defaults.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in values else F.col(x) for x in defaults.columns])


def benchmark_confidence(factors: dict[str, Column]) -> dict[str, Column]:
    """How many of the facts behind a benchmark are known, as a level and a share."""
    known = sum((F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0) for ok in factors.values()), F.lit(0))
    share = known / len(factors)
    return {"known": known, "share": F.round(share, 4), "level": F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")}


def evidence_report(facts: DataFrame, key: str, source: str, verified: Column) -> DataFrame:
    """Per policy how many facts have evidence, how many of that is verified, as whole percent."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n_facts"), F.count(source).alias("n_evidence"), F.count_if(F.col(source).isNotNull() & verified).alias("n_verified"))
    percent = lambda a: clamp(half_up(ratio(F.col(a).cast("double"), F.col("n_facts")) * 100), 0, 100)
    return counts.withColumns({"evidence_percent": percent("n_evidence").cast("double"), "verified_percent": percent("n_verified").cast("double")})


def deductible_class(name: Column | str, rules: list[tuple[str, str]], default: str = "general") -> Column:
    """The class of a named deductible: the first rule of which a word occurs in it."""
    lower = F.lower(col(name))
    out = F.lit(default)
    for words, label in reversed(rules):
        hit = F.lit(False)
        for w in words.split():
            hit = hit | F.contains(lower, F.lit(w))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def compliance_gate(start: Column, end: Column, product: Column, today: Column, rules: dict[str, tuple[str, Column]]) -> Column:
    """array<struct<code, level>> of what stops a policy: its dates, its product, and the rules of its branch (name -> (level, failed))."""
    entry = lambda c, lv: F.struct(F.lit(c).alias("code"), F.lit(lv).alias("level"))
    found = [
        F.when(start.isNull() | end.isNull(), entry("dates_missing", "blocking")), F.when(start > end, entry("dates_reversed", "blocking")), F.when(end < today, entry("expired", "warning")),
        F.when(start > today, entry("not_started", "info")), F.when(F.coalesce(F.trim(product), F.lit("")) == "", entry("product_missing", "blocking")),
    ]
    found += [F.when(F.coalesce(bad, F.lit(False)), entry(n, lv)) for n, (lv, bad) in rules.items()]
    return F.array_compact(F.array(*found))


def staged_evaluation(rows: DataFrame, key: str, gate_findings: Column, score: Column, loss: Column) -> DataFrame:
    """key, stage, verdict, score: a policy that the gate blocks ends there; the others are scored, then weighed by their expected loss."""
    blocked = F.exists(gate_findings, lambda f: f["level"] == "blocking")
    out = rows.select(key, blocked.alias("_b"), score.alias("_s"), loss.alias("_l"))
    final = clamp(F.col("_s") - F.least(F.col("_l") / 1_000, F.lit(30.0)), 0, 100)
    return out.select(
        key, F.when(F.col("_b"), "compliance").otherwise("complete").alias("stage"),
        F.when(F.col("_b"), "blocked").when(final >= 70, "good").when(final >= 40, "fair").otherwise("poor").alias("verdict"), F.when(~F.col("_b"), final).alias("score"),
    )
