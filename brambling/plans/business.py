"""Joins, ranks, diffs, scores and losses over the order tables, read as policies: a part is an exposure, an order a policy, a customer its owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import numbers
from brambling.operators import collections, joins, losses, ranking, rollups, scoring
from brambling.plans.registry import Registry
from brambling.sources.tables import comparison, spread, table

Q = Registry()

BENCHMARKS = "(VALUES (1, 'ECONOMY', CAST(NULL AS VARCHAR), 950.0, 1300.0, 1700.0, true), (2, 'ECONOMY', '10', 1000.0, 1350.0, 1750.0, true), (3, 'PROMO', CAST(NULL AS VARCHAR), 900.0, 1250.0, 1600.0, false), (4, 'STANDARD', '20', 1000.0, 1400.0, 1800.0, true)) AS b(pos, kind, sub, low, mean, high, trusted)"
VERSIONS = "(VALUES (DATE '1993-01-01', DATE '1995-06-30', 100000.0), (DATE '1995-07-01', DATE '1997-12-31', 150000.0), (DATE '1998-01-01', CAST(NULL AS DATE), 200000.0)) AS v(valid_from, valid_to, most)"


def values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + sql.replace("VARCHAR", "STRING"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


@Q.query("""
SELECT o_orderkey, c_custkey, n_name, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'""")
def expiring_like(spark: SparkSession, d: str) -> DataFrame:
    due = orders(spark, d).filter(F.col("day").between("1996-01-01", "1996-01-31"))
    owners = table(spark, d, "customer").join(joins.small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return due.join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "n_name", "o_totalprice", "day")


@Q.query("""SELECT c_custkey, count(o_orderkey) AS n_files, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,4))), 0) AS DOUBLE) AS bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def per_user_storage(spark: SparkSession, d: str) -> DataFrame:
    used = orders(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("b"))
    return table(spark, d, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce(F.col("b").cast("double"), F.lit(0.0)).alias("bytes"))


@Q.query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    owners = orders(spark, d).join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(owners, "c_custkey", "left_semi").select("c_custkey", "c_name")


@Q.query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 2)
SELECT coalesce(a.k, b.k) AS k, a.s AS before_s, a.p AS before_p, b.s AS after_s, b.p AS after_p, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s OR a.p <> b.p""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    after = rows.filter("k % 10 <> 2").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))
    return joins.changes(rows.filter("k % 10 <> 1"), after, ["k"], ["s", "p"])


@Q.query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN 1.05 ELSE 1.01 END AS q, o_orderpriority AS t, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE upper(o_orderpriority) END AS u FROM orders)
SELECT k, 'price' AS field FROM o WHERE abs(p - q) / greatest(p, q) > 0.02 UNION ALL SELECT k, 'priority' FROM o WHERE u = 'none'""")
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    after = rows.select("k", (F.col("price") * F.when(F.col("k") % 5 == 0, 1.05).otherwise(1.01)).alias("price"), F.when(F.col("k") % 9 == 0, "none").otherwise(F.upper("priority")).alias("priority"))
    return collections.field_diff(rows, after, ["k"], {"price": "number", "priority": "text"}).select("k", "field")


@Q.query(f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(coalesce((SELECT max_by(most, valid_from) FROM {VERSIONS} WHERE valid_from <= CAST(o_orderdate AS DATE) AND (valid_to IS NULL OR CAST(o_orderdate AS DATE) <= valid_to)), 100000.0) AS DOUBLE) AS most FROM orders""")
def asof_limits(spark: SparkSession, d: str) -> DataFrame:
    facts = orders(spark, d).select("o_orderkey", "day")
    return joins.asof(facts, values(spark, VERSIONS), [], "day", "valid_from", "valid_to", "o_orderkey", ["most"]).select("o_orderkey", "day", F.col("most").cast("double").alias("most"))


@Q.query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return rollups.latest(orders(spark, d), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@Q.query(f"""
WITH p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS kind, CAST(p_size AS VARCHAR) AS sub FROM part), m AS (SELECT p.*, b.pos, b.mean, CASE WHEN b.sub = p.sub THEN 1 WHEN b.sub IS NULL THEN 2 ELSE 3 END AS lvl FROM p LEFT JOIN {BENCHMARKS} ON b.kind = p.kind)
SELECT p_partkey, kind, sub, CAST(mean AS DOUBLE) AS mean, CASE WHEN pos IS NULL THEN NULL WHEN lvl = 1 THEN 'exact' WHEN lvl = 2 THEN 'kind' ELSE 'any' END AS match_level FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY lvl, pos) AS k FROM m) WHERE k = 1""")
def benchmark_match(spark: SparkSession, d: str) -> DataFrame:
    return _benchmarked(spark, d).select("p_partkey", "kind", "sub", F.col("mean").cast("double").alias("mean"), "match_level")


def _benchmarked(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("kind"), F.col("p_size").cast("string").alias("sub"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    bench = values(spark, BENCHMARKS)
    kinds = joins.small(bench)
    return joins.best_match(facts, kinds, "kind", "sub", "pos", ["low", "mean", "high", "trusted"])


@Q.query(f"""
WITH p AS (SELECT p_partkey, p_retailprice AS price, split_part(p_type, ' ', 1) AS kind, CAST(p_size AS VARCHAR) AS sub FROM part), m AS (SELECT p.*, b.pos, b.low, b.mean, b.high, b.trusted, CASE WHEN b.sub = p.sub THEN 1 WHEN b.sub IS NULL THEN 2 ELSE 3 END AS lvl FROM p LEFT JOIN {BENCHMARKS} ON b.kind = p.kind),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY lvl, pos) AS k FROM m) WHERE k = 1),
s AS (SELECT p_partkey, CAST(CASE WHEN price <= 0 THEN -1 WHEN trusted IS NOT TRUE THEN 70 WHEN price < low THEN 60 WHEN price <= mean THEN least(75, 90 + floor((mean - price) / mean * 10 + 0.5)) WHEN price <= high THEN 90 - floor((price - mean) / (high - mean) * 30 + 0.5) ELSE 40 END AS DOUBLE) AS premium_score FROM o)
SELECT *, CASE WHEN premium_score >= 90 THEN 'A' WHEN premium_score >= 80 THEN 'B' WHEN premium_score >= 70 THEN 'C' WHEN premium_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def premium_scores(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score = scoring.premium_score(c("price"), c("low"), c("mean"), c("high"), c("trusted")).cast("double")
    return _benchmarked(spark, d).select("p_partkey", score.alias("premium_score")).withColumn("grade", numbers.grade("premium_score"))


@Q.query("""
WITH r AS (SELECT p_partkey, p_retailprice / (p_size * 10000.0) AS rate FROM part)
SELECT p_partkey, floor(rate * 1000000 + 0.5) / 1000000 AS rate, CASE WHEN rate < 0.00125 THEN 60.0 WHEN rate <= 0.0025 THEN 95.0 WHEN rate <= 0.006 THEN 80 + floor((0.006 - rate) / 0.0035 * 15 + 0.5) WHEN rate <= 0.02 THEN 80 - floor((rate - 0.006) / 0.014 * 30 + 0.5) ELSE 40.0 END AS score,
 CASE WHEN rate < 0.00125 THEN 'average' WHEN rate <= 0.0025 THEN 'excellent' WHEN rate <= 0.006 THEN CASE WHEN 80 + floor((0.006 - rate) / 0.0035 * 15 + 0.5) >= 90 THEN 'excellent' ELSE 'good' END WHEN rate <= 0.02 THEN CASE WHEN (rate - 0.006) / 0.014 < 0.5 THEN 'average' ELSE 'high' END ELSE 'very_high' END AS position FROM r""")
def value_premiums(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.value_premium(F.col("p_retailprice"), F.col("p_size") * 10_000.0, F.lit(0.0025), F.lit(0.006), F.lit(0.02))
    return table(spark, d, "part").select("p_partkey", found.alias("v")).select("p_partkey", numbers.half_up("v.rate", 6).alias("rate"), F.col("v.score").cast("double").alias("score"), "v.position")


PLACES = "SELECT s_suppkey, 36.0 + (s_suppkey * 37 % 600) / 100.0 AS lat, 26.0 + (s_suppkey * 101 % 1800) / 100.0 AS lon FROM supplier"


@Q.query(f"""
WITH p AS ({PLACES}), d AS (SELECT a.s_suppkey AS key, b.s_suppkey AS other, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM p a, p b WHERE a.s_suppkey <> b.s_suppkey),
k AS (SELECT key, other, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM d)
SELECT key, other, round(km, 4) AS km, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km, other) AS "rank" FROM k WHERE km <= 300) WHERE "rank" <= 5""")
def nearest_k(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    places = s.select("s_suppkey", (F.lit(36.0) + (F.col("s_suppkey") * 37 % 600) / 100.0).alias("lat"), (F.lit(26.0) + (F.col("s_suppkey") * 101 % 1800) / 100.0).alias("lon"))
    out = joins.nearest(places, places, "s_suppkey", "lat", "lon", 300, 5)
    return out.withColumn("km", F.round("km", 4)).withColumn("rank", F.col("rank").cast("long"))


@Q.query("""
SELECT r_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance, round(count(*) / sum(CASE WHEN grouping(r_name) = 0 AND grouping(c_mktsegment) = 0 THEN count(*) END) OVER (), 4) AS share
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""")
def regional_rollup(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(joins.small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(joins.small(places), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.rollup("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double").alias("balance"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    return sums.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_t"), 4)).drop("_t")


@Q.query("""
WITH v AS (SELECT n_regionkey AS region, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS by_balance, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_name, s_suppkey) AS by_name,
  floor((1 - (rank() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC) - 1) / greatest(count(*) OVER (PARTITION BY n_regionkey) - 1, 1)) * 100 + 0.5) AS percentile,
  s_acctbal = max(s_acctbal) OVER (PARTITION BY n_regionkey) AS is_best, s_acctbal = min(s_acctbal) OVER (PARTITION BY n_regionkey) AS is_worst FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT * FROM v""")
def supplier_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = _suppliers(spark, d)
    out = ranking.ranks(rows, ["region"], {"by_balance": F.desc("s_acctbal"), "by_name": F.asc("s_name")}, "s_suppkey")
    out = ranking.extremes(out.withColumn("percentile", ranking.set_percentile(["region"], F.desc("s_acctbal")).cast("double")), ["region"], "s_acctbal")
    return out.withColumns({k: F.col(k).cast("long") for k in ("by_balance", "by_name")}).drop("s_name")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(joins.small(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_regionkey").alias("region"), "s_suppkey", "s_name", "s_acctbal")


CRITERIA = {"price": (0.5, False), "size": (0.3, True), "name_length": (0.2, True)}


@Q.query("""
WITH p AS (SELECT p_brand AS brand, p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, CAST(length(p_name) AS DOUBLE) AS name_length FROM part),
n AS (SELECT brand, sqrt(sum(price * price)) AS a, sqrt(sum(size * size)) AS b, sqrt(sum(name_length * name_length)) AS c FROM p GROUP BY 1),
v AS (SELECT brand, p_partkey, price / a * 0.5 AS x, size / b * 0.3 AS y, name_length / c * 0.2 AS z FROM p JOIN n USING (brand)),
e AS (SELECT brand, min(x) AS xi, max(x) AS xa, max(y) AS yi, min(y) AS ya, max(z) AS zi, min(z) AS za FROM v GROUP BY 1),
f AS (SELECT brand, p_partkey, sqrt(pow(x - xi, 2) + pow(y - yi, 2) + pow(z - zi, 2)) AS p, sqrt(pow(x - xa, 2) + pow(y - ya, 2) + pow(z - za, 2)) AS m FROM v JOIN e USING (brand)),
g AS (SELECT brand, p_partkey, round(CASE WHEN p + m = 0 THEN 0.5 ELSE m / (p + m) END, 4) AS closeness FROM f)
SELECT *, row_number() OVER (PARTITION BY brand ORDER BY closeness DESC, p_partkey) AS "rank" FROM g""")
def topsis_parts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.topsis(_part_set(spark, d), ["brand"], "p_partkey", CRITERIA).withColumn("rank", F.col("rank").cast("long"))


def _part_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name_length"))


#: The weightings of the three criteria: the one in use, then each changed by each step.
WEIGHTINGS = "SELECT 0 AS w, 0.5::DOUBLE AS a, 0.3::DOUBLE AS b, 0.2::DOUBLE AS c UNION ALL SELECT 1 + 4 * k + s, greatest(0, 0.5 + CASE WHEN k = 0 THEN d ELSE 0 END), greatest(0, 0.3 + CASE WHEN k = 1 THEN d ELSE 0 END), greatest(0, 0.2 + CASE WHEN k = 2 THEN d ELSE 0 END) FROM range(3) k(k), (VALUES (0, -0.1), (1, -0.05), (2, 0.05), (3, 0.1)) t(s, d)"


@Q.query(f"""
WITH p AS (SELECT p_brand AS brand, p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, CAST(length(p_name) AS DOUBLE) AS name_length FROM part),
n AS (SELECT brand, sqrt(sum(price * price)) AS a, sqrt(sum(size * size)) AS b, sqrt(sum(name_length * name_length)) AS c FROM p GROUP BY 1), w AS ({WEIGHTINGS}),
v AS (SELECT w, brand, p_partkey, price / n.a * (w.a / (w.a + w.b + w.c)) AS x, size / n.b * (w.b / (w.a + w.b + w.c)) AS y, name_length / n.c * (w.c / (w.a + w.b + w.c)) AS z FROM p JOIN n USING (brand), w),
e AS (SELECT w, brand, min(x) AS xi, max(x) AS xa, max(y) AS yi, min(y) AS ya, max(z) AS zi, min(z) AS za FROM v GROUP BY 1, 2),
f AS (SELECT w, brand, p_partkey, sqrt(pow(x - xi, 2) + pow(y - yi, 2) + pow(z - zi, 2)) AS p, sqrt(pow(x - xa, 2) + pow(y - ya, 2) + pow(z - za, 2)) AS m FROM v JOIN e USING (w, brand)),
g AS (SELECT w, brand, p_partkey, row_number() OVER (PARTITION BY w, brand ORDER BY round(CASE WHEN p + m = 0 THEN 0.5 ELSE m / (p + m) END, 4) DESC, p_partkey) AS r FROM f), b AS (SELECT brand, p_partkey AS winner FROM g WHERE w = 0 AND r = 1)
SELECT brand, winner, count(*) AS n_scenarios, count(*) FILTER (p_partkey <> winner) AS n_flips, round(1 - count(*) FILTER (p_partkey <> winner) / count(*), 4) AS stability FROM g JOIN b USING (brand) WHERE w > 0 AND r = 1 GROUP BY 1, 2""")
def topsis_stability(spark: SparkSession, d: str) -> DataFrame:
    return ranking.topsis_sensitivity(_part_set(spark, d), ["brand"], "p_partkey", CRITERIA)


@Q.query("""
SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lag(o_orderstatus) OVER w AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.versions(orders(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return out.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), "previous", "is_latest")


@Q.query("""
SELECT p_partkey, CASE WHEN hi <= lo THEN 50.0 ELSE round((p_retailprice - lo) / (hi - lo) * 100, 4) END AS position FROM (SELECT p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part)""")
def range_position(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ends = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(ends, "p_brand").select("p_partkey", F.round(ranking.range_position(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 4).alias("position"))


@Q.query("""
WITH g AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, CAST(o_orderkey % 100 AS DOUBLE) AS score, CASE WHEN o_orderstatus = 'F' THEN 1.2 ELSE 1.0 END AS cw FROM orders),
w AS (SELECT *, cw * CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END / 100 AS w FROM g)
SELECT o_custkey, count(*) AS n_gaps, CAST(least(100, floor(sum(score * w) / sum(w) * (0.7 + 0.3 * least(1.0, count(*) / 10)) + 0.5)) AS DOUBLE) AS gap_score FROM w GROUP BY 1""")
def gap_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gap_score(_gaps(spark, d), "o_custkey", "score", "severity", F.when(F.col("o_orderstatus") == "F", F.lit(1.2)).otherwise(1.0), "o_orderkey")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return orders(spark, d).withColumn("severity", severity).withColumn("score", (F.col("o_orderkey") % 100).cast("double"))


@Q.query("""
WITH g AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey % 100 AS score FROM orders) SELECT o_custkey, o_orderstatus, o_orderkey, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY score DESC, o_orderkey) AS k FROM g) WHERE k = 1""")
def strongest_gaps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.strongest(_gaps(spark, d), ["o_custkey", "o_orderstatus"], "score", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey", "score")


@Q.query("""
WITH s AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 50 ELSE 25 END AS sev, o_totalprice / 100 AS loss, (o_orderkey % 10) / 10.0 AS conf, CASE o_orderstatus WHEN 'O' THEN 30 WHEN 'P' THEN 20 ELSE 10 END AS ease FROM orders),
p AS (SELECT o_orderkey, floor(least(100.0, CAST(sev AS DOUBLE) * 0.4::DOUBLE + least(100.0::DOUBLE, loss / 10000 * 50) * 0.3::DOUBLE + conf * 20 * 0.15::DOUBLE + ease * 0.15::DOUBLE) * 100 + 0.5) / 100 AS priority FROM s)
SELECT *, CASE WHEN priority >= 80 THEN 'immediate' WHEN priority >= 60 THEN 'soon' WHEN priority >= 40 THEN 'planned' ELSE 'monitor' END AS urgency FROM p""")
def gap_priorities(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    difficulty = F.when(status == "O", "easy").when(status == "P", "moderate").otherwise("hard")
    priority = scoring.gap_priority(F.col("severity"), F.col("o_totalprice") / 100, (F.col("o_orderkey") % 10) / 10, difficulty)
    return _gaps(spark, d).select("o_orderkey", numbers.half_up(priority, 2).alias("priority")).withColumn("urgency", scoring.urgency("priority"))


@Q.query("""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(300 + o_orderkey % 130 AS INTEGER) END AS e FROM orders), l AS (SELECT *, date_diff('day', DATE '1997-03-01', e) AS n FROM t)
SELECT o_orderkey, kind, severity, score FROM (SELECT o_orderkey, CASE WHEN e IS NULL THEN 'no_expiry' WHEN n < 0 THEN 'expired' WHEN n <= 7 THEN 'expiring_now' WHEN n <= 30 THEN 'expiring' WHEN e - s < 365 THEN 'short_term' END AS kind, CASE WHEN e IS NULL THEN 'medium' WHEN n < 0 THEN 'info' WHEN n <= 7 THEN 'critical' WHEN n <= 30 THEN 'high' WHEN e - s < 365 THEN 'low' END AS severity, CASE WHEN e IS NULL THEN 50 WHEN n < 0 THEN 20 WHEN n <= 7 THEN 90 WHEN n <= 30 THEN 70 WHEN e - s < 365 THEN 30 END AS score FROM l) WHERE kind IS NOT NULL""")
def temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    expiry = F.when(F.col("o_orderkey") % 11 != 0, F.date_add("day", (F.lit(300) + F.col("o_orderkey") % 130).cast("int")))
    return orders(spark, d).select("o_orderkey", scoring.temporal_gap(F.col("day"), expiry, F.lit("1997-03-01").cast("date")).alias("g")).filter("g is not null").select("o_orderkey", "g.*")


@Q.query("""
SELECT l_orderkey, l_linenumber, floor(floor(l_extendedprice / (40000.0::DOUBLE * (1 + (l_suppkey % 3) / 10.0::DOUBLE)) * 100 * 100 + 0.5) / 100 * 10 + 0.5) / 10 AS percent, CASE WHEN l_extendedprice / (40000.0 * (1 + l_suppkey % 3 / 10.0)) * 100 < 30 THEN 'critical' WHEN l_extendedprice / (40000.0 * (1 + l_suppkey % 3 / 10.0)) * 100 < 50 THEN 'high' WHEN l_extendedprice / (40000.0 * (1 + l_suppkey % 3 / 10.0)) * 100 < 75 THEN 'medium' WHEN l_extendedprice / (40000.0 * (1 + l_suppkey % 3 / 10.0)) * 100 < 100 THEN 'low' END AS severity FROM lineitem""")
def limit_gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = scoring.limit_gap(F.col("l_extendedprice"), F.lit(40_000.0), 1 + (F.col("l_suppkey") % 3) / 10.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gap.alias("g")).select("l_orderkey", "l_linenumber", numbers.half_up("g.percent", 1).alias("percent"), "g.severity")


@Q.query("""
WITH need(status, priority, importance) AS (VALUES ('F', '1-URGENT', 'critical'), ('F', '5-LOW', 'optional'), ('O', '2-HIGH', 'recommended')), k AS (SELECT DISTINCT o_custkey, o_orderstatus AS status FROM orders)
SELECT k.o_custkey, k.status, n.priority, n.importance FROM k JOIN need n USING (status) WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k.o_custkey AND o.o_orderpriority = n.priority)""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    have = orders(spark, d).select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    need = spark.createDataFrame([("F", "1-URGENT", "critical"), ("F", "5-LOW", "optional"), ("O", "2-HIGH", "recommended")], "status string, priority string, importance string")
    return scoring.missing_coverages(have, F.broadcast(need), "o_custkey", "status", "priority", "importance")


@Q.query("""
WITH a AS (SELECT l_partkey AS part, lower(l_returnflag) AS k, max(l_quantity) AS x FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_partkey AS part, lower(l_returnflag) AS k, max(l_quantity) AS x FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.part, b.part) AS part, coalesce(a.k, b.k) AS name_key, greatest(a.x, b.x) AS "limit", CASE WHEN a.x IS NULL OR b.x IS NULL THEN true ELSE abs(a.x - b.x) > 0.2 * greatest(a.x, b.x) END AS disputed FROM a FULL JOIN b ON a.part = b.part AND a.k = b.k""")
def merged_coverages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("limit"), "l_suppkey")
    return joins.merged_limits(rows.filter("l_suppkey % 2 = 0"), rows.filter("l_suppkey % 2 = 1"), ["part"], "name", "limit").drop("name")


@Q.query("""
WITH n(pos, other) AS (VALUES (1, 'burnished'), (2, 'steel'), (3, 'anodized copper plated'), (4, 'tin'))
SELECT p_partkey, (SELECT min_by(other, pos) FROM n WHERE contains(lower(p_type), other) OR contains(other, lower(p_type))) AS matched FROM part""")
def fuzzy_coverage(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(1, "Burnished"), (2, "STEEL"), (3, "Anodized  copper plated"), (4, "tin")], "pos int, other string")
    return joins.contains_match(table(spark, d, "part").select("p_partkey", "p_type"), names, "p_type", "other", "pos").select("p_partkey", "matched")


@Q.query("""
SELECT a.key, b.key AS other, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 4) AS similarity
FROM (SELECT b, t, min(k) AS key FROM (SELECT c_custkey AS k, translate(lower(c_name), '01lıi5', 'oiiiis') AS t0, regexp_replace(translate(lower(c_name), '01lıi5', 'oiiiis'), '[^a-z0-9]', '', 'g') AS t, c_nationkey * 10 + length(c_mktsegment) AS b FROM customer) GROUP BY b, t) a
JOIN (SELECT b, t, min(k) AS key FROM (SELECT c_custkey AS k, regexp_replace(translate(lower(c_name), '01lıi5', 'oiiiis'), '[^a-z0-9]', '', 'g') AS t, c_nationkey * 10 + length(c_mktsegment) AS b FROM customer) GROUP BY b, t) b
ON a.b = b.b AND a.key < b.key WHERE round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 4) >= 0.9""")
def similar_customers(spark: SparkSession, d: str) -> DataFrame:
    block = F.col("c_nationkey") * 10 + F.length("c_mktsegment")
    return joins.similar_pairs(table(spark, d, "customer"), "c_custkey", "c_name", block, 0.9)


@Q.query("""
WITH l(custkey, pos, code) AS (SELECT c_custkey, 1, '1-URGENT' FROM customer UNION ALL SELECT c_custkey, 2, '5-LOW' FROM customer UNION ALL SELECT c_custkey, 3, '3-MEDIUM' FROM customer),
i AS (SELECT o_orderpriority AS code, max(o_totalprice) AS value FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT custkey AS c_custkey, min_by(code, pos) AS code, min_by(value, pos) AS value FROM l JOIN i USING (code) GROUP BY 1""")
def first_included(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "customer").select("c_custkey", F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("3-MEDIUM")).alias("codes"))
    items = orders(spark, d).filter("o_orderpriority <> '1-URGENT'").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    return joins.first_listed(lists, "c_custkey", "codes", joins.small(items), "o_orderpriority", "v")


@Q.query("""SELECT n_name AS metric_of, o_orderstatus, max(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
UNION ALL SELECT n.n_name, s.o_orderstatus, NULL FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) n CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation x ON c_nationkey = n_nationkey WHERE x.n_name = n.n_name AND o_orderstatus = s.o_orderstatus)""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").join(joins.small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = orders(spark, d).join(owners, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("metric_of"), "o_orderstatus", F.col("o_totalprice").alias("price"))
    return joins.matrix(rows, "metric_of", "o_orderstatus", "price")


@Q.query("""
WITH m AS (SELECT o_orderstatus AS k, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY 1), s AS (SELECT k, 'n' AS metric, CAST(n AS VARCHAR) AS v FROM m)
SELECT metric, max(v) FILTER (k = 'F') AS "F", max(v) FILTER (k = 'O') AS "O", max(v) FILTER (k = 'P') AS "P" FROM s GROUP BY 1""")
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    stats = orders(spark, d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return comparison(stats, "o_orderstatus", ["n"], ["F", "O", "P"])


@Q.query("""
WITH f AS (SELECT 'status' AS field, o_custkey % 2 AS h, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_custkey % 2, o_orderpriority FROM orders)
SELECT field, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS most FROM f GROUP BY 1 HAVING count(DISTINCT value) > 1""")
def field_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return collections.disagreements(rows, "o_orderkey", ["status", "priority"])


@Q.query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), n AS (SELECT o_orderkey AS k, 'N' AS s FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0)
SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    old = orders(spark, d).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = old.filter("k % 3 = 0").select("k", F.lit("N").alias("s")).unionByName(old.filter("k % 50 = 0").select((-F.col("k")).alias("k"), F.lit("N").alias("s")))
    return collections.latest_per_key(new, old, ["k"])


@Q.query("""
SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS premium, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""")
def policy_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("premium"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@Q.query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY 1, 2""")
def premium_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-09-03").cast("timestamp_ntz"))
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_base"), F.count(F.lit(1)).alias("n"))


@Q.query("""
WITH r(code, rate) AS (VALUES ('TRY', 1.0), ('USD', 32.5), ('EUR', 35.25)), o AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN 'TRY' WHEN 1 THEN 'USD' ELSE 'EUR' END AS code FROM orders)
SELECT o_orderkey, code, round(o_totalprice * rate / 35.25, 4) AS euros FROM o JOIN r USING (code)""")
def converted(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 3 == 0, "TRY").when(F.col("o_orderkey") % 3 == 1, "USD").otherwise("EUR")
    rates = F.create_map(*[F.lit(x) for kv in {"TRY": 1.0, "USD": 32.5, "EUR": 35.25}.items() for x in kv])
    return orders(spark, d).select("o_orderkey", code.alias("code"), F.round(F.col("o_totalprice") * rates[code] / 35.25, 4).alias("euros"))


@Q.query("""
WITH u AS (SELECT 'user' AS applies_to, CAST(user_id AS VARCHAR) AS target, round(sum(value), 2) AS used FROM events WHERE event_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'type', event_type, round(sum(value), 2) FROM events WHERE event_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'all', '', round(sum(value), 2) FROM events WHERE event_id % 2 = 0),
b AS (SELECT *, CASE applies_to WHEN 'user' THEN used * 1.05 WHEN 'type' THEN used * 1.0005 ELSE used * 1.4 END AS most, CASE applies_to WHEN 'user' THEN 'block' WHEN 'type' THEN 'notify' ELSE 'block' END AS action FROM u),
r AS (SELECT event_id, value, 'user' AS applies_to, CAST(user_id AS VARCHAR) AS target FROM events WHERE event_id % 2 = 1 AND value IS NOT NULL UNION ALL SELECT event_id, value, 'type', event_type FROM events WHERE event_id % 2 = 1 AND value IS NOT NULL UNION ALL SELECT event_id, value, 'all', '' FROM events WHERE event_id % 2 = 1 AND value IS NOT NULL),
v AS (SELECT event_id, CASE WHEN round(used + value, 4) > most THEN action WHEN round(used + value, 4) > most * 0.8 THEN 'warn' ELSE 'pass' END AS verdict FROM r JOIN b ON r.applies_to = b.applies_to AND r.target = b.target)
SELECT event_id, count(*) AS n_budgets, count(*) FILTER (verdict = 'warn') AS n_warn, count(*) FILTER (verdict = 'notify') AS n_notify, count(*) FILTER (verdict = 'block') = 0 AS allowed FROM v GROUP BY 1""")
def budgets(spark: SparkSession, d: str) -> DataFrame:
    """Odd events as requests against budgets of their user, their type and of all, of which the even events used up a part."""
    rows = table(spark, d, "events").withColumn("user", F.col("user_id").cast("string"))
    spent = rows.filter("event_id % 2 = 0")
    used = lambda kind, c: spent.groupBy(c.alias("target")).agg(F.round(F.sum("value"), 2).alias("used")).select(F.lit(kind).alias("applies_to"), "target", "used")
    every = used("user", F.col("user")).unionByName(used("type", F.col("event_type"))).unionByName(used("all", F.lit("")))
    table_of = every.withColumns({"limit": F.col("used") * F.when(F.col("applies_to") == "user", 1.05).when(F.col("applies_to") == "type", 1.0005).otherwise(1.4), "warn_at": F.lit(0.8), "action": F.when(F.col("applies_to") == "type", "notify").otherwise("block")})
    requests = rows.filter("event_id % 2 = 1 AND value IS NOT NULL")
    return scoring.budget_checks(requests, "event_id", {"user": "user", "type": "event_type"}, "value", table_of)


@Q.query("""
WITH s AS (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS score FROM part), m(level, middle) AS (VALUES ('very_low', 10.0), ('low', 27.5), ('moderate', 45.0), ('high', 65.0), ('very_high', 87.5)), w AS (SELECT p_partkey, score, level, exp(-pow((score - middle) / 15, 2) / 2) AS w FROM s, m)
SELECT p_partkey, score, level, round(w / sum(w) OVER (PARTITION BY p_partkey), 6) AS probability FROM w""")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).cast("double").alias("score"))
    return scoring.level_probabilities(rows, "p_partkey", "score")


SCENARIOS = [("theft", 0.3, "lognormal", 5.0, 0.8, None, None, None), ("fire", 0.05, "pareto", None, None, 2.5, 300.0, None), ("glass", 0.5, "uniform", None, None, None, 20.0, 200.0)]


@Q.query()
def expected_losses(spark: SparkSession, d: str) -> DataFrame:
    """Simulated own losses of every part as an exposure."""
    exposures = spread(table(spark, d, "part")).select("p_partkey", (F.col("p_retailprice") * 2).alias("limit"), (F.col("p_size") * 10.0).alias("deductible"))
    scenarios = spark.createDataFrame(SCENARIOS, "code string, frequency double, kind string, mu double, sigma double, alpha double, low double, high double")
    return losses.simulate(exposures, scenarios, "p_partkey", 10_000)


@Q.query("""
WITH f AS (SELECT o_orderkey, o_totalprice <= 0 AS bad_price, o_totalprice > 400000 AS high_price, o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AS stale FROM orders)
SELECT o_orderkey, CAST(bad_price AS INTEGER) AS n_critical, CAST(high_price AS INTEGER) AS n_warning, CAST(stale AS INTEGER) AS n_info, CASE WHEN bad_price THEN 'human_review' WHEN high_price THEN 'restricted' ELSE 'full' END AS mode, CAST(greatest(0, least(100, 100 - 15 * CAST(bad_price AS INTEGER) - 5 * CAST(high_price AS INTEGER) - CAST(stale AS INTEGER))) AS INTEGER) AS score FROM f""")
def findings(spark: SparkSession, d: str) -> DataFrame:
    rules = {"price": ("critical", F.col("o_totalprice") <= 0), "high": ("warning", F.col("o_totalprice") > 400_000), "stale": ("info", (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"))}
    found = scoring.rule_findings(orders(spark, d), "o_orderkey", rules).drop("findings")
    n = [F.col(f"n_{k}") for k in ("critical", "warning", "info")]
    return found.withColumn("mode", scoring.display_mode(n[0], n[1])).withColumn("score", scoring.validation_score(*n, F.lit(0)).cast("int"))


@Q.query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, length(p_name) % 4 AS n FROM part)
SELECT p_partkey, CAST(least(100, greatest(0, 70 + CASE WHEN size * 1000 / price > 20 THEN 15 WHEN size * 1000 / price < 10 THEN -10 ELSE 0 END + CASE WHEN n + 1 < 3 THEN -15 ELSE 0 END - CASE WHEN n >= 1 THEN 0 ELSE 10 END)) AS DOUBLE) AS score FROM p""")
def coverage_scores(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import COVERAGES, coverage_score

    names = F.slice(F.array(F.lit("Fire"), F.lit("Theft"), F.lit("Glass"), F.lit("Flood")), F.lit(1), F.length("p_name") % 4 + 1)
    made = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(60_000.0).alias("limit"), F.lit(0.0).alias("deductible"), F.lit(True).alias("included"), F.lit(False).alias("is_unlimited"), F.lit(False).alias("is_market_value"))).cast(COVERAGES)
    score = coverage_score(made, F.col("p_retailprice"), F.col("p_size") * 1000.0, F.lit(False), ["theft"])
    return table(spark, d, "part").select("p_partkey", score.alias("score"))


LIMITS = "(VALUES (DATE '1993-01-01', DATE '1995-06-30', 50000.0, 100.0), (DATE '1995-07-01', CAST(NULL AS DATE), 150000.0, 200.0)) AS v(valid_from, valid_to, price, key_no)"


@Q.query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS DOUBLE) END AS key_no FROM orders), m AS (SELECT *, CASE WHEN day >= DATE '1995-07-01' THEN 150000.0::DOUBLE ELSE 50000.0::DOUBLE END AS mp, CASE WHEN day >= DATE '1995-07-01' THEN 200.0::DOUBLE ELSE 100.0::DOUBLE END AS mk FROM o)
SELECT o_orderkey, 'price' AS code, 'blocking' AS level, price AS value, mp AS minimum FROM m WHERE price < mp UNION ALL SELECT o_orderkey, 'key_no', CASE WHEN key_no IS NULL THEN 'warning' ELSE 'blocking' END, key_no, mk FROM m WHERE key_no IS NULL OR key_no < mk""")
def limit_compliance(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import limit_check

    rows = orders(spark, d).select("o_orderkey", "day", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 300).cast("double")).alias("key_no"))
    return limit_check(rows, values(spark, LIMITS), "o_orderkey", "day", ["price", "key_no"])


@Q.query("""
WITH c AS (SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS k, l_quantity FROM lineitem), l AS (SELECT *, CASE WHEN k = 'r' THEN 'returned' WHEN k IN ('a', 'n') THEN 'kept' END AS label FROM c)
SELECT l_orderkey, label, l_quantity, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, label ORDER BY l_quantity DESC, l_linenumber) AS n FROM l) WHERE n = 1""")
def canonical_coverages(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import canonical

    rules = spark.createDataFrame([(1, "r", "returned"), (2, "a", "kept"), (3, "n", "kept")], "pos int, part string, label string")
    return canonical(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", "l_linenumber", rules).select("l_orderkey", "label", "l_quantity", "l_linenumber")


CATEGORY_SQL = "SELECT p_partkey, 'size' AS category, p_size / 50.0 AS score FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice / 2500.0 FROM part UNION ALL SELECT p_partkey, 'age', (p_partkey % 100) / 100.0 FROM part"


def _categories(spark: SparkSession, d: str) -> DataFrame:
    pairs = {"size": F.col("p_size") / 50.0, "price": F.col("p_retailprice") / 2500.0, "age": (F.col("p_partkey") % 100) / 100.0}
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.cast("double").alias("score")) for k, v in pairs.items()])).alias("c")).select("p_partkey", "c.*")


@Q.query(f"""WITH c AS ({CATEGORY_SQL}), r AS (SELECT p_partkey, CAST(greatest(0, least(100, floor(sum(score * CASE category WHEN 'size' THEN 0.5 ELSE 0.25 END) / 1.0 * 100 + 0.5))) AS DOUBLE) AS risk FROM c GROUP BY 1)
SELECT p_partkey, risk, CASE WHEN risk <= 20 THEN 'very_low' WHEN risk <= 35 THEN 'low' WHEN risk <= 55 THEN 'moderate' WHEN risk <= 75 THEN 'high' ELSE 'very_high' END AS level FROM r""")
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import risk_score

    return risk_score(_categories(spark, d), "p_partkey", {"size": 0.5, "price": 0.25, "age": 0.25}).withColumn("level", numbers.risk_level("risk"))


@Q.query(f"""
WITH c AS ({CATEGORY_SQL}), n AS (SELECT count(DISTINCT p_partkey) AS n FROM c)
SELECT category, count(DISTINCT p_partkey) FILTER (score >= 0.5) AS n_high FROM c GROUP BY 1 HAVING count(DISTINCT p_partkey) FILTER (score >= 0.5) >= (SELECT ceil(n / 2) FROM n)""")
def portfolio_risks(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import common_risks

    return common_risks(_categories(spark, d), "p_partkey", 0.5).select("category", "n_high")


TEMPLATES = [("size", 0.6, "high", 12, "easy", "split"), ("size", 0.9, "critical", 30, "hard", "rebuild"), ("price", 0.5, "medium", 10, "easy", "negotiate"), ("age", 0.5, "low", 5, "easy", "renew")]


@Q.query(f"""
WITH c AS ({CATEGORY_SQL}), t(category, trigger, priority, p, impact, text) AS (VALUES ('size', 0.6, 'high', 1, 12, 'split'), ('size', 0.9, 'critical', 0, 30, 'rebuild'), ('price', 0.5, 'medium', 2, 10, 'negotiate'), ('age', 0.5, 'low', 3, 5, 'renew'))
SELECT p_partkey, text, row_number() OVER (PARTITION BY p_partkey ORDER BY p, impact DESC, text) AS position FROM c JOIN t USING (category) WHERE score >= trigger""")
def mitigations(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import mitigations as recommend

    templates = spark.createDataFrame(TEMPLATES, "category string, trigger double, priority string, impact int, difficulty string, text string")
    return recommend(_categories(spark, d), "p_partkey", templates).select("p_partkey", "text", F.col("position").cast("long").alias("position"))


@Q.query("""
WITH s AS (SELECT p_partkey, least(6, greatest(1, p_size % 9)) AS s FROM part), t(s, x) AS (VALUES (1, 0.0), (2, 0.1), (3, 0.2), (4, 0.3), (5, 0.4), (6, 0.5))
SELECT p_partkey, s.s AS step, CAST(t.x AS DOUBLE) AS discount, CAST(u.x AS DOUBLE) AS next_discount, CAST(w.x AS DOUBLE) AS after_claim FROM s JOIN t ON t.s = s.s JOIN t u ON u.s = least(6, s.s + 1) JOIN t w ON w.s = greatest(1, s.s - 2)""")
def ncd_steps(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import ncd_projection

    p = ncd_projection(F.col("p_size") % 9, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5])
    return table(spark, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", F.col("p.now.step").alias("step"), F.col("p.now.discount").alias("discount"), F.col("p.next_year.discount").alias("next_discount"), F.col("p.after_claim.discount").alias("after_claim"))


@Q.query("""
WITH e AS (SELECT l_orderkey AS k, l_returnflag AS t, CASE l_linestatus WHEN 'O' THEN 'excludes' ELSE 'limits' END AS kind FROM lineitem), n AS (SELECT k, t, count(*) AS n, max(CASE kind WHEN 'excludes' THEN 100 ELSE 50 END) AS top FROM e GROUP BY 1, 2)
SELECT o_orderkey, flag, coalesce(n, 0) AS n_annotations, top FROM (SELECT o_orderkey, f.flag FROM orders, (VALUES ('R'), ('A')) f(flag)) c LEFT JOIN n ON n.k = o_orderkey AND n.t = flag""")
def annotated_coverages(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import annotated

    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("target"), F.when(F.col("l_linestatus") == "O", "excludes").otherwise("limits").alias("kind"), F.lit("").alias("description"))
    rows = orders(spark, d).select("o_orderkey", F.explode(F.array(F.lit("R"), F.lit("A"))).alias("flag"))
    out = annotated(rows, edges, "o_orderkey", "flag", {"excludes": 100, "limits": 50})
    return out.select("o_orderkey", "flag", F.size("annotations").cast("long").alias("n_annotations"), F.get("annotations", 0)["w"].alias("top"))


@Q.query("""
SELECT c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE)) AS days_left FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1996-07-01' AND c_custkey % 2 = 0""")
def expiring_policies(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import expiring

    users = table(spark, d, "customer").select("c_custkey")
    wishes = users.select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("remind"))
    due = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "day")
    out = expiring(due, users, wishes, "c_custkey", "day", F.lit("1996-06-01").cast("date"), 30)
    return out.select("c_custkey", "o_orderkey", "day", F.col("days_left").cast("long").alias("days_left"))


@Q.query("""
WITH d AS (SELECT o_orderkey, least(1, o_orderkey % 7 / 50.0) AS share, o_orderkey % 11 = 0 AS cond, o_orderkey % 13 <> 0 AS sure FROM orders)
SELECT o_orderkey, CAST(CASE WHEN NOT sure THEN -1 WHEN cond THEN 80 WHEN share = 0 THEN 95 WHEN share <= 0.01 THEN 90 WHEN share <= 0.02 THEN 80 WHEN share <= 0.05 THEN 65 WHEN share <= 0.1 THEN 50 ELSE 30 END AS DOUBLE) AS score FROM d""")
def deductible_scores(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import deductible_score

    k = F.col("o_orderkey")
    return orders(spark, d).select("o_orderkey", deductible_score((k % 7) / 50.0, k % 11 == 0, k % 13 != 0).cast("double").alias("score"))
