"""Market and region queries: nations as regions, brands as providers, parts as products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions.numbers import half_up
from brambling.operators import joins, market, rollups
from brambling.plans.registry import Registry
from brambling.sources.tables import table

Q = Registry()
MONEY = "decimal(18,4)"


def nations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal").cast(MONEY)).cast("double").alias("premium"), F.count(F.lit(1)).alias("n"))
    return rows.join(joins.small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("n_regionkey").alias("region"), "premium", "n")


NATIONS = "(SELECT n_name, n_regionkey AS region, CAST(avg(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS premium, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


@Q.query(f"""
WITH v AS {NATIONS}, m AS (SELECT region, avg(n) AS m FROM v GROUP BY 1)
SELECT v.region, n_name, n AS value, floor((n - m) / m * 100 * 10 + 0.5) / 10 AS vs_mean, row_number() OVER (PARTITION BY v.region ORDER BY n DESC, n_name) AS "rank" FROM v JOIN m USING (region)""")
def regional_ranking(spark: SparkSession, d: str) -> DataFrame:
    return market.ranked(nations(spark, d), ["region"], "n_name", F.col("n"), False).withColumn("rank", F.col("rank").cast("long"))


@Q.query(f"""
WITH v AS {NATIONS}, o AS (SELECT n AS own FROM v WHERE n_name = (SELECT min(n_name) FROM v))
SELECT n_name, n, n - own AS delta, floor((n - own) / own * 100 * 10 + 0.5) / 10 AS percent FROM v, o WHERE n_name <> (SELECT min(n_name) FROM v)""")
def region_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = nations(spark, d)
    first = rows.agg(F.min("n_name")).first()[0]
    return market.region_deltas(rows, first, "n_name", "n")


@Q.query("""
WITH s AS (SELECT p_brand, count(*) AS total FROM part GROUP BY 1) SELECT p_brand, total, floor(total / sum(total) OVER () * 10000 + 0.5) / 10000 AS share, row_number() OVER (ORDER BY total DESC, p_brand) AS "rank" FROM s""")
def market_share(spark: SparkSession, d: str) -> DataFrame:
    out = market.shares(table(spark, d, "part"), "p_brand", F.lit(1))
    return out.withColumn("share", half_up("share", 4)).withColumn("rank", F.col("rank").cast("long"))


@Q.query("""
SELECT s_suppkey, CAST(floor(least(100.0, (6 - (1 + s_suppkey % 5)) * 15 + (s_suppkey % 20) * 1.5 + (s_suppkey % 250) / 250 * 20 + (s_suppkey % 900) / 900 * 15) + 0.5) AS DOUBLE) AS risk FROM supplier""")
def regional_risk(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", market.regional_risk(1 + k % 5, k % 20, k % 250, k % 900).alias("risk"))


@Q.query("""
WITH p AS (SELECT p_partkey, p_retailprice AS price, p_size * 1000.0 AS cover FROM part)
SELECT p_partkey, floor(least(100.0, greatest(0.0, 100 - (price - 900) / 900 * 100)) + 0.5) AS premium_percentile, floor(CASE WHEN cover > 0 THEN least(100.0, cover / (price * 20) * 50) ELSE 50 END + 0.5) AS coverage_percentile FROM p""")
def market_positions(spark: SparkSession, d: str) -> DataFrame:
    m = market.market_position(F.col("p_retailprice"), F.lit(900.0), F.lit(1800.0), F.col("p_size") * 1000.0)
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


@Q.query("""
WITH e AS (SELECT event_id, event_type AS model, user_id % 1000 AS tin, CAST(value AS INTEGER) AS tout FROM (SELECT event_id, event_type, user_id, floor(value) AS value FROM events)), p(model, pi, po) AS (VALUES ('click', 0.5, 1.5), ('purchase', 2.0, 6.0))
SELECT event_id, CAST(CAST((tin * coalesce(pi, 1.0) + tout * coalesce(po, 3.0)) / 1000.0 AS DECIMAL(18,6)) AS DOUBLE) AS cost FROM e LEFT JOIN p USING (model)""")
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("purchase", 2.0, 6.0), (None, 1.0, 3.0)], "model string, price_in double, price_out double")
    logs = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 1000).alias("tin"), F.floor("value").cast("int").alias("tout"))
    return market.token_cost(logs, prices, "model", "tin", "tout").select("event_id", F.col("cost").cast("double").alias("cost"))


@Q.query("""
WITH v AS (SELECT p_brand AS template, p_size AS version, count(*) AS uses, min(p_size) * 1.0 AS mean_time FROM part GROUP BY 1, 2)
SELECT template, CAST(sum(uses) AS BIGINT) AS total_usage, floor(sum(mean_time * uses) / sum(uses) * 1000 + 0.5) / 1000 AS mean_time FROM v GROUP BY 1""")
def template_usage(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").groupBy(F.col("p_brand").alias("template"), F.col("p_size").alias("version")).agg(F.count(F.lit(1)).alias("uses"), (F.min("p_size") * 1.0).cast("double").alias("mean_time"))
    return market.usage_weighted(v, "template", "uses", ["mean_time"]).withColumn("mean_time", half_up("mean_time", 3))


@Q.query("""
WITH g AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS loss, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DECIMAL(18,2)) END AS cost FROM orders)
SELECT o_custkey, CAST(sum(loss) AS DOUBLE) AS potential_loss, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost FROM g GROUP BY 1""")
def financial_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    gaps = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("loss"), F.when(k % 3 != 0, (k % 100).cast("decimal(18,2)")).alias("cost"))
    out = market.financial_summary(gaps, "o_custkey", "loss", "loss", "cost")
    return out.select("o_custkey", F.col("potential_loss").cast("double").alias("potential_loss"), F.col("cost").cast("double").alias("cost"))


@Q.query("""
SELECT l_orderkey, lower(l_shipmode) AS name_key, max(l_quantity) AS l_quantity, min_by(l_returnflag, l_partkey * 1000 + l_suppkey * 10 + l_linenumber) AS l_returnflag FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2""")
def merged_limits(spark: SparkSession, d: str) -> DataFrame:
    return market.merged_coverages(table(spark, d, "lineitem").withColumn("at", F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")), ["l_orderkey"], "l_linestatus", "l_quantity", "at", ["l_returnflag"])


@Q.query("""
WITH p(name, pattern, severity, scenarios) AS (VALUES ('water', 'STEEL|TIN', 'medium', ['flood']), ('fire', 'COPPER|TIN', 'high', ['fire', 'smoke'])), t AS (SELECT p_partkey, upper(p_type) AS text FROM part), h AS (SELECT p_partkey, severity, unnest(scenarios) AS s, CASE severity WHEN 'high' THEN 75 ELSE 50 END AS w FROM t, p WHERE regexp_matches(text, pattern))
SELECT t.p_partkey, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS scenarios, coalesce(max_by(severity, w), 'info') AS severity, count(s) = 0 AS needs_review FROM t LEFT JOIN h USING (p_partkey) GROUP BY 1""")
def exclusion_impacts(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("water", "STEEL|TIN", "medium", ["flood"]), ("fire", "COPPER|TIN", "high", ["fire", "smoke"])], "name string, pattern string, severity string, scenarios array<string>")
    texts = table(spark, d, "part").select("p_partkey", F.upper("p_type").alias("text"))
    out = market.exclusion_impacts(texts, "p_partkey", "text", patterns)
    return out.select("p_partkey", F.array_join("scenarios", ",").alias("scenarios"), "severity", "needs_review")


@Q.query("""
WITH s(kind, v) AS (SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_orderstatus AS kind, -o_orderkey AS v FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM s WHERE kind NOT IN (SELECT kind FROM t) UNION ALL SELECT * FROM t""")
def replaced_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("v"))
    stored = rows.filter("kind = 'P'").select("kind", (-F.col("v")).alias("v"))
    return market.replaced_wholesale(rows.filter("v % 2 = 0"), stored, "kind")


@Q.query("""
WITH a AS (SELECT o_custkey AS k, 'limit' AS category, o_orderpriority AS name, o_totalprice AS loss, o_orderkey % 100 AS score FROM orders WHERE o_totalprice > 150000), b AS (SELECT o_custkey, 'status', o_orderstatus, 1000.0, o_orderkey % 50 FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT k, category, name, max(score) AS score FROM u GROUP BY 1, 2, 3""")
def gap_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    shape = lambda rows, category, name, loss, score, severity: rows.select(F.col("o_custkey").alias("k"), F.lit(category).alias("category"), F.col(name).alias("name"), F.lit(severity).alias("severity"), score.alias("score"), loss.cast("double").alias("loss"), F.lit(0.5).alias("confidence"), F.lit("easy").alias("difficulty"))
    k = F.col("o_orderkey")
    parts = [shape(o.filter("o_totalprice > 150000"), "limit", "o_orderpriority", F.col("o_totalprice"), k % 100, "high"), shape(o.filter("o_orderstatus = 'O'"), "status", "o_orderstatus", F.lit(1000.0), k % 50, "low")]
    return market.gap_run(parts, "k").select("k", "category", "name", "score")


@Q.query("""SELECT c_custkey, CAST(floor((coalesce(c_acctbal / 100, 0) + c_nationkey + 50) / 3 + 0.5) AS DOUBLE) AS overall FROM customer""")
def score_bundle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", market.score_bundle(F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double"), F.lit(50.0)).alias("overall"))


@Q.query("""SELECT c_custkey, regexp_replace(lower(c_name), '\\s+ltd\\.?$', '') AS insurer FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' LTD.' ELSE '' END AS c_name FROM customer)""")
def insurer_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " LTD.").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", market.insurer_key(name).alias("insurer"))


@Q.query("""
WITH f AS (SELECT o_custkey, o_orderstatus AS v, o_totalprice AS c FROM orders)
SELECT o_custkey, count(DISTINCT v) = 1 AS agreed, max_by(v, c) AS value, count(*) AS n FROM f GROUP BY 1""")
def provider_consensus(spark: SparkSession, d: str) -> DataFrame:
    return rollups.consensus(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus"), "o_totalprice")


def _covered(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.policies import COVERAGES

    line = F.struct(F.col("l_returnflag").alias("name"), F.when(F.col("l_linestatus") == "O", F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("limit"), F.lit(0.0).alias("deductible"), (F.col("l_quantity") > 10).alias("included"), (F.col("l_linestatus") == "O").alias("is_unlimited"), F.lit(False).alias("is_market_value"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).cast(COVERAGES).alias("coverages")).withColumn("kind", F.when(F.col("l_orderkey") % 2 == 0, "home").otherwise("auto"))


@Q.query("""
WITH s(kind, scenario, needs) AS (VALUES ('home', 'fire', 'R'), ('home', 'flood', 'A'), ('auto', 'theft', 'N')), p AS (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'home' ELSE 'auto' END AS kind FROM lineitem),
f AS (SELECT p.l_orderkey, scenario, count(i.l_orderkey) AS n, bool_or(i.l_linestatus = 'O') AS u, max(CASE WHEN i.l_linestatus = 'O' THEN 0 ELSE i.l_extendedprice END) AS m FROM p JOIN s USING (kind) LEFT JOIN lineitem i ON i.l_orderkey = p.l_orderkey AND i.l_returnflag = s.needs AND i.l_quantity > 10 GROUP BY 1, 2)
SELECT l_orderkey, scenario, CASE WHEN n = 0 THEN 'open' WHEN u THEN 'covered' ELSE 'limited' END AS status, CASE WHEN n > 0 AND NOT u THEN m END AS insurer_pays FROM f""")
def scenario_cards(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.reports import scenario_cards as cards

    scenarios = spark.createDataFrame([("home", "fire", "R"), ("home", "flood", "A"), ("auto", "theft", "N")], "kind string, scenario string, needs string")
    return cards(_covered(spark, d), "l_orderkey", "kind", "coverages", scenarios)


@Q.query("""
SELECT l_orderkey, l_returnflag AS name, CASE WHEN l_linestatus <> 'O' AND l_extendedprice > 0 THEN format('{:,.2f} TRY', l_extendedprice) WHEN l_linestatus = 'O' THEN 'Unlimited' WHEN l_quantity > 10 THEN 'Included' ELSE 'Not specified' END AS "limit", l_quantity > 10 AS included FROM lineitem""")
def reviewer_rows(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.reports import reviewer_rows as shown

    return shown(_covered(spark, d), "l_orderkey", "coverages").select("l_orderkey", "name", "limit", "included")


@Q.query("""
SELECT o_orderkey, 'large' AS rule, 'caution' AS kind, 'medium' AS severity FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'open_urgent', 'gap', 'high' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.reports import insights as found

    rules = {"large": ("caution", "medium", F.col("o_totalprice") > 300_000), "open_urgent": ("gap", "high", (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))}
    return found(table(spark, d, "orders"), "o_orderkey", rules)


@Q.query("""
WITH s AS (SELECT user_id, event_type, max_by(value > 40, event_id) AS passed, max(event_id) AS at_ FROM events GROUP BY 1, 2), p AS (SELECT *, CASE WHEN passed THEN CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END END AS p FROM s)
SELECT user_id, CASE max(p) WHEN 1 THEN 'signup' WHEN 2 THEN 'view' WHEN 3 THEN 'purchase' END AS stage, CASE WHEN max(p) = 3 THEN 'done' WHEN NOT max_by(passed, at_) THEN 'failed' ELSE 'running' END AS state FROM p GROUP BY 1""")
def workflow_states(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.reports import workflow_states as states

    return states(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 40, "event_id", ["signup", "view", "purchase"])
