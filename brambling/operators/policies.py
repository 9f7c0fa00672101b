"""Policies as rows with arrays of coverages: projections, sub-scores, compliance, clause annotations, portfolio views.

A coverage is a struct (name, limit, deductible, included, is_unlimited, is_market_value). All rules are expressions over
these arrays or joins with rules tables; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.dictionaries import first_of_rules
from brambling.functions.numbers import clamp, half_up, near
from brambling.functions.text import coverage_key, ocr_alike, tokens
from brambling.operators.joins import small

COVERAGES = "array<struct<name: string, limit: double, deductible: double, included: boolean, is_unlimited: boolean, is_market_value: boolean>>"


def projected(rows: DataFrame, names: dict[str, str], data: str, schema: str) -> DataFrame:
    """Stored rows as policies: columns renamed, the JSON column unpacked, the monthly premium as a whole number."""
    out = rows.select(*[F.col(a).alias(b) for a, b in names.items()], F.from_json(data, schema).alias("_d")).select(*names.values(), "_d.*")
    return out.withColumn("monthly_premium", half_up(F.col("premium") / 12)) if "premium" in out.columns else out


def branch_coverages(rows: DataFrame, kind: str, branches: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """One coverage array from the fields of each branch. branches: kind -> [(coverage name, limit column)]; absent limits give no coverage."""
    empty = F.array().cast("array<struct<name: string, limit: double>>")
    out = empty
    for name, fields in branches.items():
        made = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("limit"))) for n, c in fields]))
        out = F.when(F.col(kind) == name, made).otherwise(out)
    return rows.withColumn("coverages", out)


def renamed_by_insurer(rows: DataFrame, insurer: str, mapping: DataFrame) -> DataFrame:
    """Long rows (…, field, value) with the canonical field of the insurer, else of the default (null insurer), else unchanged."""
    own = mapping.filter("insurer is not null").select(F.lower("insurer").alias("_i"), F.col("field").alias("_f"), F.col("canonical").alias("_own"))
    default = mapping.filter("insurer is null").select(F.col("field").alias("_g"), F.col("canonical").alias("_default"))
    joined = rows.join(small(own), (F.lower(F.trim(insurer)) == F.col("_i")) & (F.col("field") == F.col("_f")), "left").join(small(default), F.col("field") == F.col("_g"), "left")
    return joined.select(*[c for c in rows.columns if c != "field"], F.coalesce("_own", "_default", "field").alias("field"))


def included(coverages: Column) -> Column:
    return F.filter(coverages, lambda c: F.coalesce(c["included"], F.lit(True)))


def names_any(coverages: Column, *parts: str) -> Column:
    return F.exists(coverages, lambda c: F.contains(F.lower(c["name"]), F.lit(parts[0])) | (F.contains(F.lower(c["name"]), F.lit(parts[1])) if len(parts) > 1 else F.lit(False)))


def missing_names(coverages: Column, required: list[str]) -> Column:
    """Required names that no included coverage contains, by normal form."""
    have = F.transform(included(coverages), lambda c: coverage_key(c["name"]))
    return F.filter(F.array(*[F.lit(r) for r in required]) if required else F.array().cast("array<string>"), lambda r: ~F.exists(have, lambda h: F.contains(h, coverage_key(r))))


def coverage_score(coverages: Column, premium: Column, total: Column, motor: Column, required: list[str]) -> Column:
    """0 to 100: a base by branch, points for what is covered, for how many coverages there are, less what is missing."""
    own = included(coverages)
    count = F.size(own)
    per_premium = F.when(premium > 0, F.when(total > 0, total).otherwise(F.aggregate(own, F.lit(0.0), lambda a, c: a + F.coalesce(c["limit"], F.lit(0.0)))) / premium).otherwise(0.0)
    named = F.when(names_any(own, "ferdi kaza", "koltuk"), 5).otherwise(0) + F.when(names_any(own, "ikame", "replacement"), 5).otherwise(0) + F.when(names_any(own, "hukuki", "legal"), 3).otherwise(0)
    market = F.exists(own, lambda c: F.coalesce(c["is_market_value"], F.lit(False))) | (total == 0)
    unlimited = F.exists(own, lambda c: F.coalesce(c["is_unlimited"], F.lit(False)))
    base = F.when(motor, 75 + F.when(market, 10).otherwise(0) + F.when(unlimited, 10).otherwise(0) + named).otherwise(70 + F.when(per_premium > 20, 15).when((per_premium < 10) & (premium > 0), -10).otherwise(0))
    by_count = F.when(count >= 10, 10).when(count >= 6, 5).when((count < 3) & ~motor, -15).otherwise(0)
    gone = F.size(missing_names(coverages, required)) * F.when(motor, 5).otherwise(10)
    low = F.size(F.filter(own, lambda c: (c["limit"] > 0) & (c["limit"] < 50_000) & ~F.coalesce(c["is_unlimited"], F.lit(False))))
    return clamp(base + by_count - gone - F.when(~motor & (low > 2), 10).otherwise(0), 0, 100).cast("double")


def deductible_score(share: Column, conditional: Column, certain: Column) -> Column:
    """-1 if it is not known, 80 if it depends, 95 for none, then falling with its share of the value."""
    return F.when(~certain, -1.0).when(conditional, 80.0).when(share == 0, 95.0).when(share <= 0.01, 90.0).when(share <= 0.02, 80.0).when(share <= 0.05, 65.0).when(share <= 0.10, 50.0).otherwise(30.0)


def value_score(premium_score: Column, coverage_score: Column, adjustment: Column) -> Column:
    known = premium_score >= 0
    return clamp(half_up(F.when(known, premium_score * 0.4 + coverage_score * 0.6).otherwise(coverage_score) + adjustment), 0, 100)


def limit_check(limits: DataFrame, versions: DataFrame, key: str, at: str, codes: list[str]) -> DataFrame:
    """One row per policy and limit that is missing (warning) or below the minimum in force (blocking).

    limits: key, at, one column per code. versions: valid_from, valid_to, one column per code.
    """
    from brambling.operators.joins import asof

    minima = [f"minimum_{c}" for c in codes]
    named = versions.select("valid_from", "valid_to", *[F.col(c).alias(m) for c, m in zip(codes, minima)])
    found = asof(limits, named, [], at, "valid_from", "valid_to", key, minima)
    each = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("code"), F.lit("warning").alias("level"), F.col(c).cast("double").alias("value"), F.col(m).cast("double").alias("minimum")))
        .when(F.col(c) < F.col(m), F.struct(F.lit(c).alias("code"), F.lit("blocking").alias("level"), F.col(c).cast("double").alias("value"), F.col(m).cast("double").alias("minimum")))
        for c, m in zip(codes, minima)
    ]))
    return found.select(key, F.explode(each).alias("f")).select(key, "f.*")


def ncd_projection(step: Column, discounts: list[float]) -> Column:
    """struct(step, next, after_claim) with discounts: one step up after a year, two down after a claim, within the table."""
    last = len(discounts)
    table = F.array(*[F.lit(d) for d in discounts])
    at = lambda s: F.struct(s.alias("step"), F.element_at(table, s).alias("discount"))
    now = F.least(F.greatest(step, F.lit(1)), F.lit(last)).cast("int")
    return F.when(step.isNotNull(), F.struct(at(now).alias("now"), at(F.least(now + 1, F.lit(last))).alias("next_year"), at(F.greatest(now - 2, F.lit(1))).alias("after_claim")))


def annotated(coverages: DataFrame, edges: DataFrame, key: str, name: str, weights: dict[str, int]) -> DataFrame:
    """Coverages with the clause edges that point to them, strongest first. edges: key, target, kind, description."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")]
    per = edges.select(key, F.lower(F.trim("target")).alias("_t"), F.struct(F.coalesce(w, F.lit(10)).alias("w"), "kind", "description").alias("e"))
    lists = per.groupBy(key, "_t").agg(F.sort_array(F.collect_list("e"), asc=False).alias("annotations"))
    out = coverages.join(lists, (coverages[key] == lists[key]) & (F.lower(F.trim(name)) == F.col("_t")), "left").drop(lists[key])
    return out.select(*coverages.columns, F.coalesce("annotations", F.array().cast("array<struct<w: int, kind: string, description: string>>")).alias("annotations"))


def known_share(label: Column, known: Column, share: float = 0.5) -> Column:
    """True if at least ``share`` of the words of a label occur in one known label."""
    words = tokens(label, 2)
    return F.exists(known, lambda k: F.size(F.array_intersect(words, tokens(k, 2))) >= share * F.greatest(F.size(words), F.lit(1)))


def parity(found: Column, listed: Column) -> Column:
    """Do the structured rows match the bullets of the text? Two bullets or fewer say nothing."""
    ratio, short = listed / F.when(found > 0, found), F.greatest(found - listed, F.lit(0))
    return F.when(found <= 2, "pass").when(ratio >= 0.9, "pass").when((ratio < 0.5) & (short >= 5), "critical").otherwise("warn")


def canonical(coverages: DataFrame, keys: list[str], name: str, limit: str, position: str, rules: DataFrame) -> DataFrame:
    """Coverages under their canonical label, one per label: the greatest limit, then the earliest.

    rules (a small table): pos, part, label; the first rule whose part the normal form contains names the label.
    """
    k = coverage_key(name)
    labelled = coverages.withColumn("label", F.coalesce(first_of_rules(k, rules, "pos", "part", "label"), k))
    w = Window.partitionBy(*keys, "label").orderBy(F.desc_nulls_last(limit), position)
    return labelled.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def risk_score(categories: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of category scores (0 to 1) as whole percent. categories: key, category, score."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("category")]
    sums = categories.groupBy(key).agg(F.sum(F.col("score") * w).alias("s"), F.sum(F.when(F.col("score").isNotNull(), w)).alias("w"))
    return sums.select(key, clamp(half_up(F.when(F.col("w") > 0, F.col("s") / F.col("w") * 100).otherwise(50.0)), 0, 100).cast("double").alias("risk"))


def common_risks(categories: DataFrame, key: str, least: float = 50) -> DataFrame:
    """Categories at or above ``least`` in at least half of all policies."""
    policies = categories.agg(F.count_distinct(key).alias("_n"))
    per = categories.groupBy("category").agg(F.count_distinct(F.when(F.col("score") >= least, F.col(key))).alias("n_high"), F.avg("score").alias("mean"))
    return per.crossJoin(F.broadcast(policies)).filter(F.col("n_high") >= F.ceil(F.col("_n") / 2)).drop("_n")


def mitigations(scores: DataFrame, key: str, templates: DataFrame) -> DataFrame:
    """Recommendations whose trigger a category score reaches, by priority and impact. templates (small): category, trigger, priority, impact, difficulty, text."""
    order = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    hits = scores.join(small(templates), "category").filter(F.col("score") >= F.col("trigger"))
    return hits.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order, F.desc("impact"), "text")))


def quick_wins(found: DataFrame, key: str, n: int = 3) -> DataFrame:
    easy = found.filter((F.col("difficulty") == "easy") & (F.col("impact") >= 10))
    return easy.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).filter(F.col("_n") <= n).drop("_n")


def qa_score(fields: dict[str, tuple[Column, int]], bonus: Column, deduction: Column, gates: list[tuple[Column, int]]) -> Column:
    """Points of the fields present (100 in all) with bonus and deduction, then the ceiling of every gate that fails."""
    total = sum((F.when(F.coalesce(ok, F.lit(False)), points).otherwise(0) for ok, points in fields.values()), F.lit(0))
    score = clamp(total + bonus - deduction, 0, 100)
    for passed, ceiling in gates:
        score = F.when(F.coalesce(passed, F.lit(False)), score).otherwise(F.least(score, F.lit(ceiling)))
    return score


def same_policy(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Duplicate verdict of two policies: number, insurer and person alike after OCR folding."""
    person = a["person"].isNull() | b["person"].isNull() | ocr_alike(a["person"], b["person"], 0.8)
    return ocr_alike(a["number"], b["number"], 0.85) & ocr_alike(a["insurer"], b["insurer"], 0.8) & person


def coverages_alike(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """Equally many coverages, and for each of one side some of the other side has the same name and a near limit."""
    has = lambda xs, y: F.exists(xs, lambda x: ocr_alike(x["name"], y["name"]) & near(x["limit"], y["limit"], tolerance))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda y: has(b, y)) & F.forall(b, lambda y: has(a, y))


def expiring(policies: DataFrame, users: DataFrame, preferences: DataFrame, user: str, expiry: str, today: Column, days: int) -> DataFrame:
    """Policies that end within ``days`` of users who want reminders, soonest first, and which of a user's is the most urgent."""
    due = policies.filter(F.col(expiry).between(today, F.date_add(today, days)))
    out = due.join(users, user).join(preferences.filter("remind"), user).withColumn("days_left", F.datediff(expiry, today))
    return out.withColumn("most_urgent", F.row_number().over(Window.partitionBy(user).orderBy("days_left")) == 1).orderBy("days_left", user)
