"""Operators over one set of all rows, hot pieces, bounded aggregates and sketches."""

import datetime
import random

from pyspark.sql import functions as F

from brambling import queries
from brambling.operators import joins, ranking, rollups, scoring
from brambling.streaming.metrics import learned_patterns
from tests.test_plans import DIR, plan


def test_places_in_one_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = {r.k: r.position for r in ranking.positions(df, [F.desc_nulls_last("v"), "k"]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i for i, (k, _) in enumerate(want)}
    assert ranking.positions(df.limit(0), ["k"]).count() == 0


def test_no_task_holds_all_rows(spark):
    for name in ("global_ranks", "cache_left"):
        text = plan(spark, name)
        assert "TakeOrdered" not in text and "Window" not in text, name


def test_candidates_are_few_though_all_share_a_piece(spark):
    names = [f"customer#{i:09d}" for i in range(0, 4000, 3)]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, t string")
    reps = rows.select("k", "t", F.lit(1).alias("b"), F.length("t").alias("n"))
    pairs = {(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if sum(x != y for x, y in zip(names[a], names[b])) <= 1}
    found = joins._by_rare_pieces(reps, 0.9).select("k", "k2").distinct()
    met = {tuple(r) for r in found.collect()}
    assert pairs <= met and len(met) < len(names) ** 2 / 2 / 10


def test_candidates_follow_the_pairs_in_dense_names(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("t"))
    reps = rows.select("k", "t", F.lit(1).alias("b"), F.length("t").alias("n"))
    met = joins._by_deletions(reps, 0.9).select("k", "k2").distinct()
    found = joins.similar_pairs(rows, "k", "t", F.lit(0), 0.9).count()
    assert 0 < found and met.count() < 5 * found  # of 200 million pairs, all of which share their first ten characters


def test_pairs_like_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice("abcdxy") for _ in range(rng.randrange(1, 24)))
        for _ in range(rng.randrange(1, 4)):
            t = list(base)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randrange(2)] = rng.choice(["", "a", "q"])
            texts.append("".join(t))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for threshold in (0.75, 0.85, 0.6):
        want = sorted((min(a, b), max(a, b)) for s, a in first.items() for t, b in first.items() if s < t and round(1 - distance(s, t) / max(len(s), len(t)), 4) >= threshold)
        got = sorted((r.key, r.other) for r in joins.similar_pairs(rows, "k", "t", F.lit(0), threshold).collect())
        assert got == want


def test_patterns_keep_a_bounded_few(spark):
    rows = [("p", "k", f"example {i % 40}", f"s{i % 3}") for i in range(400)] + [("q", "k", None, "s")]
    df = spark.createDataFrame(rows, "pattern string, kind string, example string, source string")
    found = {r.pattern: r for r in learned_patterns(df.repartition(7), "pattern", "kind", "example", "source").collect()}
    assert found["p"].occurrences == 400 and 1 <= len(found["p"].examples) <= 5 and set(found["p"].sources) <= {"s0", "s1", "s2"}
    again = {r.pattern: r for r in learned_patterns(df.coalesce(1), "pattern", "kind", "example", "source").collect()}
    assert found == again and found["q"].examples == []


def test_sketches_merge(spark):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=rng.randrange(48)), rng.choice("ab"), rng.randrange(3_000), rng.random()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, who int, value double")
    hours = rollups.sketched(df, "ts", "hour", ["kind"], "who", "value")
    days = rollups.estimated(rollups.merged(rollups.merged(hours, "hour", []), "day", []), {"half": 0.5, "p99": 0.99}).collect()
    assert sum(r.n for r in days) == 20_000 and len(days) == 2
    for r in days:
        users = len({w for t, _, w, _ in rows if t.date() == r.start.date()})
        assert abs(r.n_users - users) < 0.05 * users and abs(r.half - 0.5) < 0.04 and r.p99 > 0.96
    none = rollups.estimated(rollups.sketched(df.limit(3).withColumn("value", F.lit(None).cast("double")), "ts", "day", [], "who", "value"), {"half": 0.5}).collect()
    assert all(r.half is None and r.n_users >= 1 for r in none)


def test_alerts_do_not_pass_through_the_driver(spark):
    assert "memory" not in plan(spark, "hourly_alerts").lower().split("scan")[0]
    assert queries.queries()["hourly_alerts"](spark, DIR).count() > 0


def test_all_weightings_read_the_rows_once(spark):
    rng = random.Random(8)
    rows = [(i % 3, i, rng.choice([None, float("nan"), 0.0]) if i % 50 == 49 else rng.uniform(1, 9), rng.uniform(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, k int, price double, cover double")
    criteria = {"price": (0.6, False), "cover": (0.4, True)}
    for kept in (df, df.filter("k % 50 <> 49")):
        found = ranking.topsis_sensitivity(kept, ["s"], "k", criteria)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # one for the ends of the sets, one for all weightings
        first = lambda weighted: {r.s: r.k for r in ranking.topsis(kept, ["s"], "k", weighted).filter("rank = 1").collect()}
        base = first(criteria)
        changed = [first(criteria | {c: (max(0.0, w + step), more)}) for c, (w, more) in criteria.items() for step in (-0.1, -0.05, 0.05, 0.1)]
        want = {(s, k, 8, sum(c[s] != k for c in changed)) for s, k in base.items()}
        assert {(r.s, r.winner, r.n_scenarios, r.n_flips) for r in found.collect()} == want


def test_gap_scores_do_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(9)
    rows = [(k, i, float(rng.randrange(100)), rng.choice(["critical", "high", "medium", "low"]), rng.choice([1.0, 1.2])) for k in range(2_000) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, score double, severity string, weight double")
    want = {}
    for k, _, score, severity, weight in rows:
        w = weight * scoring.SEVERITY[severity] / 100
        s, t = want.get(k, (0.0, 0.0))
        want[k] = (s + score * w, t + w)
    want = {k: float(int(s / t + 0.5)) for k, (s, t) in want.items()}
    for dealt in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("i")), df.repartitionByRange(11, "score")):
        assert {r.k: r.gap_score for r in scoring.gap_score(dealt, "k", "score", "severity", F.col("weight"), "i").collect()} == want
