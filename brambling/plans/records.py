"""Operators on records: projections, merges, diffs, alerts, rule packs, reports. The order tables stand in for policies and their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import numbers
from brambling.operators import collections, extraction, jobs, lifecycle, policies, ranking, reports, rollups
from brambling.plans.business import CATEGORY_SQL, _categories
from brambling.plans.fields import alike_sql, by_case
from brambling.plans.registry import Registry
from brambling.sources import tables
from brambling.sources.tables import table

Q = Registry()


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))


def joined(c) -> F.Column:
    return F.array_join(c, ",")


@Q.query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.by_key(table(spark, d, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_mktsegment")


@Q.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' AND floor(o_totalprice / 1000 + 0.5) BETWEEN 100 AND 200")
def exact_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.scan(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ("o_orderdate", "1996-01-01"), ("o_orderdate", "1997-01-01"))
    return rows.filter(numbers.half_up(F.col("o_totalprice") / 1000).between(100, 200)).select("o_orderkey")


@Q.query(f"""
WITH t AS (SELECT c_custkey, c_name AS a, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '0', 'O') WHEN 1 THEN c_name || '99' ELSE 'other' END AS b, c_mktsegment AS s, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || 'XX' ELSE c_mktsegment END AS t FROM customer)
SELECT c_custkey, {alike_sql("a", "b", 0.85)} AND {alike_sql("s", "t", 0.8)} AND (c_custkey % 5 = 0 OR {alike_sql("a", "a", 0.8)}) AS same FROM t""")
def same_policies(spark: SparkSession, d: str) -> DataFrame:
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    person = F.when(k % 5 != 0, name)
    a = {"number": name, "insurer": seg, "person": person}
    b = {"number": by_case(k % 3, F.replace(name, F.lit("0"), F.lit("O")), F.concat(name, F.lit("99")), F.lit("other")), "insurer": F.when(k % 4 == 0, F.concat(seg, F.lit("XX"))).otherwise(seg), "person": name}
    return table(spark, d, "customer").select("c_custkey", policies.same_policy(a, b).alias("same"))


@Q.query("SELECT event_id AS id, event_type AS kind, CAST(props->>'k' AS DOUBLE) AS premium, floor(CAST(props->>'k' AS DOUBLE) / 12 + 0.5) AS monthly_premium FROM events")
def stored_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("props", F.regexp_replace("props", '"k"', '"premium"'))
    out = policies.projected(rows, {"event_id": "id", "event_type": "kind"}, "props", "premium double")
    return out.withColumn("monthly_premium", F.col("monthly_premium").cast("double"))


@Q.query('SELECT o_orderkey AS id, o_orderstatus AS "policy.status", o_totalprice AS "policy.sum.amount", o_orderpriority AS "policy.sum.unit" FROM orders')
def flattened(spark: SparkSession, d: str) -> DataFrame:
    nested = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("unit")).alias("sum"))
    return collections.flatten(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), nested.alias("policy")))


@Q.query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN CASE WHEN p_size > 25 THEN 'price,size' ELSE 'price' END WHEN 'PROMO' THEN CASE WHEN p_size > 25 THEN 'big' ELSE '' END ELSE '' END AS names,
  CASE p_type WHEN 'ECONOMY' THEN p_retailprice + CASE WHEN p_size > 25 THEN p_size ELSE 0 END WHEN 'PROMO' THEN CASE WHEN p_size > 25 THEN p_size ELSE 0 END ELSE 0 END AS total FROM part""")
def branch_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("large", F.when(F.col("p_size") > 25, F.col("p_size")))
    out = policies.branch_coverages(rows, "p_type", {"ECONOMY": [("price", "p_retailprice"), ("size", "large")], "PROMO": [("big", "large")]})
    return out.select("p_partkey", joined(F.transform("coverages", lambda c: c["name"])).alias("names"), F.aggregate("coverages", F.lit(0.0), lambda a, c: a + c["limit"]).alias("total"))


@Q.query("""
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ' Alpha ' WHEN 1 THEN 'beta' END AS insurer, unnest(['prim', 'limit', 'other']) AS field, o_totalprice AS value FROM orders)
SELECT k, insurer, CASE WHEN field = 'prim' AND insurer = ' Alpha ' THEN 'premium_alpha' WHEN field = 'prim' THEN 'premium' WHEN field = 'limit' AND insurer = 'beta' THEN 'limit_beta' ELSE field END AS field, value FROM r""")
def insurer_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("k", F.when(F.col("k") % 3 == 0, " Alpha ").when(F.col("k") % 3 == 1, "beta").alias("insurer"), F.explode(F.array(F.lit("prim"), F.lit("limit"), F.lit("other"))).alias("field"), F.col("o_totalprice").alias("value"))
    mapping = spark.createDataFrame([("Alpha", "prim", "premium_alpha"), ("BETA", "limit", "limit_beta"), (None, "prim", "premium")], "insurer string, field string, canonical string")
    return policies.renamed_by_insurer(rows, "insurer", mapping).select("k", "insurer", "field", "value")


@Q.query("""SELECT o_orderkey AS k, 'a=' || o_orderstatus || ';b=' || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderpriority END || ';c=1' || CASE WHEN o_orderkey % 3 = 0 THEN ';d=new' ELSE '' END AS merged, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderpriority END AS allowed FROM orders""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("o_orderpriority"), F.lit("c"), F.lit("1"))
    entry = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    change = F.map_from_entries(F.array_compact(F.array(entry("a", F.col("o_orderstatus")), F.when(k % 2 == 0, entry("b", F.lit("x"))), F.when(k % 3 == 0, entry("d", F.lit("new"))))))
    merged = collections.deep_merge([base, change])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return orders(spark, d).select("k", shown.alias("merged"), collections.preferred(base, change, ["b"])["b"].alias("allowed"))


@Q.query("""
SELECT 'orders' AS store, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","user":' || o_custkey || '}' AS record FROM orders WHERE o_custkey = 7
UNION ALL SELECT 'events', '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user":' || user_id || '}' FROM events WHERE user_id = 7""")
def user_records(spark: SparkSession, d: str) -> DataFrame:
    stores = {
        "orders": table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("user")),
        "events": table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("user")),
    }
    return tables.portable(stores, "user", 7)


@Q.query("""SELECT event_id, CAST(CASE WHEN event_id % 9 > 0 THEN props->>'k' END AS BIGINT) AS k, CASE WHEN event_id % 9 = 0 THEN 'broken ' || event_id END AS broken FROM events""")
def traced_events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import LongType, StructType

    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.col("props")).alias("line"))
    out = tables.from_json_rows(rows, "line", StructType().add("k", LongType()))
    return out.select("event_id", "k", F.col("_corrupt").alias("broken"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'late' END AS s FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """Written, appended without the keys that are there, read again."""
    rows = orders(spark, d)
    path = tables.scratch(spark, "appended")
    rows.filter("k % 2 = 0").select("k", F.col("o_orderstatus").alias("s")).write.parquet(path)
    tables.append_absent(spark, rows.filter("k % 3 = 0").select("k", F.lit("late").alias("s")), path, ["k"])
    return spark.read.parquet(path)


@Q.query("""SELECT o_orderkey AS k, 'say "' || o_orderstatus || '", ' || o_orderpriority AS words, o_totalprice AS price FROM orders""")
def csv_copy(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    rows = orders(spark, d).select("k", F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('", '), F.col("o_orderpriority")).alias("words"), F.col("o_totalprice").alias("price"))
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@Q.query("""SELECT 'Order ' || o_orderkey || ' of ' || o_custkey || ': ' || o_orderstatus || ' (-)' AS value FROM orders""")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).withColumn("none", F.lit(None).cast("string"))
    return reports.summary_lines(rows, "Order %s of %s: %s (%s)", "k", "o_custkey", "o_orderstatus", "none")


@Q.query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY AND value IS NOT NULL""")
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    return tables.retained(table(spark, d, "events").filter("value is not null"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 5).select("event_id")


@Q.query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0""")
def subscribed(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("kinds"), F.count(F.lit(1)).alias("n"))
    return tables.scan(lists, member=("kinds", "1-URGENT")).select("o_custkey", "n")


@Q.query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'fire' END, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Theft' END) AS missing FROM part WHERE p_size % 2 <> 0 OR p_size % 3 <> 0""")
def non_compliant(spark: SparkSession, d: str) -> DataFrame:
    cover = lambda n, ok: F.struct(F.lit(n).alias("name"), ok.alias("included"))
    coverages = F.array(cover("Fire, all risks", F.col("p_size") % 2 == 0), cover("THEFT of parts", F.col("p_size") % 3 == 0), cover("glass", F.lit(None).cast("boolean")))
    out = table(spark, d, "part").select("p_partkey", policies.missing_names(coverages, ["fire", "Theft", "Glass"]).alias("m"))
    return out.filter(F.size("m") > 0).select("p_partkey", joined("m").alias("missing"))


@Q.query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Fire,theft,GLASS' WHEN 1 THEN 'Fire,theft' ELSE ' fire ,Theft,hail' END AS names FROM orders""")
def spelled_once(spark: SparkSession, d: str) -> DataFrame:
    a = by_case(F.col("k") % 3, F.array(F.lit("Fire"), F.lit("theft")), F.array(F.lit("Fire")), F.array(F.lit(" fire "), F.lit("Theft")))
    b = by_case(F.col("k") % 3, F.array(F.lit("FIRE"), F.lit("GLASS"), F.lit("glass ")), F.array(F.lit("theft"), F.lit("fire")), F.array(F.lit("hail"), F.lit("FIRE")))
    return orders(spark, d).select("k", joined(collections.union_first_spelling(a, F.lit(None).cast("array<string>"), b)).alias("names"))


@Q.query("""
SELECT o_custkey, count(*)::INTEGER AS coverages, count(*) FILTER (o_orderstatus = 'F')::INTEGER AS exclusions, 0 AS conditional_deductibles, 2 AS ai_insights, count(*) FILTER (o_orderpriority = '5-LOW')::INTEGER AS supplementary_count, 0 AS bundle_products FROM orders GROUP BY 1""")
def extraction_sizes(spark: SparkSession, d: str) -> DataFrame:
    coverage = F.struct(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderpriority") == "5-LOW", "supplementary").otherwise("main").alias("category"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(coverage).alias("c"), F.collect_list(F.when(F.col("o_orderstatus") == "F", "x")).alias("e"))
    m = lifecycle.trend_metrics(F.col("c"), F.col("e"), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))
    return rows.select("o_custkey", *[v.alias(k) for k, v in m.items()])


@Q.query("""SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS most_urgent FROM orders GROUP BY 1""")
def most_urgent(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).withColumn("days", F.unix_date(F.to_date("o_orderdate")))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), ranking.winner("k", "days", "k", most=False).alias("most_urgent"))


@Q.query("""SELECT conv_id, '[' || string_agg('{"at":' || turn || ',"stage":"' || role || '"}', ',' ORDER BY turn, role) || ']' AS stages, count(*)::INTEGER AS n_stages FROM conversations GROUP BY 1""")
def stage_lists(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stage_logs(table(spark, d, "conversations"), "conv_id", "role", "turn")


PATTERNS = "SELECT user_id AS pattern, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(least(1.0, 0.3 + 0.01 * count(*)), 4) AS confidence FROM events GROUP BY 1"


def patterns(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"))
    return counts.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + 0.01 * F.col("n")), 4))


@Q.query(f"SELECT pattern, n, n_failed, round(n_failed / n, 6) AS failure_rate FROM ({PATTERNS}) WHERE n >= 2 ORDER BY n_failed / n DESC, pattern LIMIT 10")
def failing_patterns(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.top_failing(patterns(spark, d), "pattern", "n_failed", "n").drop("confidence")


@Q.query(f"SELECT pattern, n, confidence FROM ({PATTERNS}) WHERE pattern % 10 = 0 OR confidence >= 0.5 OR n >= 12")
def pruned_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns(spark, d).withColumn("promoted", F.when(F.col("pattern") % 10 == 0, True))
    return lifecycle.pruned(rows, "n", "confidence", "promoted", 12).select("pattern", "n", "confidence")


@Q.query(f"SELECT pattern AS id, 'a\\.b\\*\\(' || pattern || '\\)\\$' AS rule FROM ({PATTERNS}) WHERE confidence >= 0.45 AND n >= 3")
def learned_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns(spark, d).withColumn("text", F.concat(F.lit("a.b*("), F.col("pattern").cast("string"), F.lit(")$")))
    return lifecycle.pattern_rules(rows, "text", "confidence", "n", 0.45, 3).select(F.col("pattern").alias("id"), "rule")


@Q.query(f"""WITH c AS ({CATEGORY_SQL}) SELECT p_partkey, category, "rank" FROM (SELECT p_partkey, category, row_number() OVER (PARTITION BY p_partkey ORDER BY score * CASE category WHEN 'size' THEN 0.5 ELSE 0.25 END DESC, category) AS "rank" FROM c) WHERE "rank" <= 2""")
def top_factors(spark: SparkSession, d: str) -> DataFrame:
    weighed = F.col("score") * F.when(F.col("category") == "size", 0.5).otherwise(0.25)
    return ranking.top_per_key(_categories(spark, d), ["p_partkey"], [weighed.desc(), F.col("category")], 2).select("p_partkey", "category", F.col("rank").cast("long").alias("rank"))


@Q.query("""
SELECT o_custkey, text FROM (SELECT o_custkey, o_orderkey AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 25 >= 10) WHERE r <= 3""")
def quick_wins(spark: SparkSession, d: str) -> DataFrame:
    found = orders(spark, d).select("o_custkey", F.col("k").alias("text"), F.when(F.col("o_orderstatus") == "F", "easy").otherwise("hard").alias("difficulty"), (F.col("k") % 25).alias("impact"), F.col("k").alias("position"))
    return policies.quick_wins(found, "o_custkey", 3).select("o_custkey", "text")


@Q.query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_partkey % 500 / 50.0), l_suppkey % 97, l_partkey % 500, l_linenumber) AS position FROM lineitem""")
def reading_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.struct(F.col("l_suppkey") % 97, F.col("l_partkey") % 500, "l_linenumber")).alias("x"), (F.col("l_partkey") % 500).alias("y"))
    return reports.reading_order(rows, ["l_orderkey"], "x", "y").select("l_orderkey", "l_linenumber", F.col("position").cast("long").alias("position"))


@Q.query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@Q.query("""WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 17, o_orderkey) AS r FROM orders), n WHERE r > ceil(n * 20 / 100)""")
def cache_left(spark: SparkSession, d: str) -> DataFrame:
    return ranking.evict(orders(spark, d).select("k", (F.col("o_custkey") % 17).alias("hits")), "hits", "k", 1_000).select("k")


@Q.query("""
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 4 THEN 'exact' WHEN 3 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'low' END AS verdict, o_orderkey % 3 <> 2 AS lists, o_orderkey % 4 <> 3 AS coverages FROM orders""")
def similarity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    a = F.array(F.lit("Glass breakage"), F.lit("FIRE"))
    b = by_case(k % 3, F.array(F.lit("fire"), F.lit("g1ass breakage")), F.array(F.lit("Fire!"), F.lit("Glass breakages")), F.array(F.lit("fire")))
    cover = lambda n, x: F.struct(F.lit(n).alias("name"), F.lit(x).alias("limit"))
    one = F.array(cover("Fire", 100.0), cover("Theft", 50.0))
    two = by_case(k % 4, F.array(cover("theft", 52.0), cover("F1re", 100.0)), one, F.array(cover("FIRE", 95.0), cover("thefT", 50.0)), F.array(cover("Fire", 100.0), cover("Theft", 80.0)))
    return orders(spark, d).select("k", collections.match_verdict((k % 5).cast("double"), 4).alias("verdict"), collections.arrays_alike(a, b).alias("lists"), policies.coverages_alike(one, two).alias("coverages"))


@Q.query("""SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS value, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN o_custkey || '.0' WHEN o_orderkey % 4 = 2 THEN 'x' END END AS current FROM orders WHERE o_orderkey % 4 <> 1""")
def template_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    own = F.col("o_custkey").cast("string")
    now = rows.filter("k % 4 > 0").select("k", by_case(F.col("k") % 4, F.lit(None).cast("string"), F.concat(own, F.lit(".0")), F.lit("x"), F.lit(None).cast("string")).alias("value"))
    return collections.overrides(rows.select("k", own.alias("value")), now, ["k"], "value")


@Q.query("""
WITH b AS (SELECT o_orderkey AS k, unnest(['Fire', 'Theft']) AS name, o_totalprice AS "limit" FROM orders), t AS (SELECT o_orderkey AS k, unnest([' fire ', 'Hail']) AS name, 7.0 AS "limit" FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(b.k, t.k) AS k, coalesce(b.name, t.name) AS name, coalesce(t."limit", b."limit") AS "limit" FROM b FULL JOIN t ON b.k = t.k AND lower(trim(b.name)) = lower(trim(t.name))""")
def table_coverages(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    names = lambda *n: F.explode(F.array(*[F.lit(x) for x in n])).alias("name")
    base = rows.select("k", names("Fire", "Theft"), F.col("o_totalprice").alias("limit"))
    read = rows.select("k", names(" fire ", "Hail"), F.lit(7.0).alias("limit"), F.when(F.col("k") % 2 == 0, 0.9).otherwise(0.5).alias("sure"))
    return collections.merge_by_name(base, read, ["k"], "name", ["limit"], F.col("sure") >= 0.7)


@Q.query("""SELECT k, claim, severity FROM (SELECT o_orderkey AS k, 'premium' AS claim, 'critical' AS severity FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'plate', 'warning' FROM orders WHERE o_orderkey % 5 = 0)""")
def contradicted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(F.lit("premium 1.234 TL or "), F.when(k % 3 == 0, "999").otherwise(k.cast("string")), F.lit(" TL, plate "), F.when(k % 5 == 0, "34ZZ1").otherwise("34 AB 1"))
    rows = orders(spark, d).select("k", text.alias("text"), (k + F.when(k % 3 == 0, 10_000_000).otherwise(0)).alias("premium"), F.lit("34AB1").alias("plate"))
    return extraction.contradictions(rows, "k", "text", {"premium": ("premium", r"([\d.]+) TL", "critical"), "plate": ("plate", r"plate (\w+(?: \w+)*)", "warning")})


@Q.query("""SELECT o_orderkey AS k, 'This may be covered, may pay; guaranteed' || o_orderstatus AS safe FROM orders""")
def guarded_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat(F.lit("This is always covered, Always pay; guaranteed"), F.col("o_orderstatus"))
    return orders(spark, d).select("k", reports.safe_wording(words, {"is always": "may be", "always": "may", "guaranteed": "expected"}).alias("safe"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END AS attempt, o_orderkey % 3 = 0 AS failed FROM orders""")
def retried_rows(spark: SparkSession, d: str) -> DataFrame:
    work = lambda rows: rows.withColumn("failed", F.col("k") % 3 == 0)
    return jobs.retried(orders(spark, d).select("k"), work, F.col("failed"), "k", 3, lambda rows: rows)


@Q.query("""
WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey AS pos, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN 'trigger' WHEN o_orderkey % 7 IN (3, 4) THEN 'acknowledge' ELSE 'resolve' END AS a FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS r FROM s),
w AS (SELECT o_custkey, pos, a, r, CASE WHEN a = 'trigger' THEN 1 ELSE 0 END AS alert, a = 'trigger' AS is_open, a = 'trigger' AS live FROM n WHERE r = 1
UNION ALL SELECT n.o_custkey, n.pos, n.a, n.r, w.alert + CASE WHEN n.a = 'trigger' AND NOT w.is_open THEN 1 ELSE 0 END, CASE n.a WHEN 'trigger' THEN true WHEN 'resolve' THEN false ELSE w.is_open END, n.a = 'trigger' OR w.is_open FROM w JOIN n ON n.o_custkey = w.o_custkey AND n.r = w.r + 1)
SELECT o_custkey, alert, min(pos) AS opened, max(pos) FILTER (a = 'resolve') AS closed, count(*) FILTER (a = 'trigger') AS n_triggers, CASE WHEN count(*) FILTER (a = 'resolve') > 0 THEN 'resolved' WHEN count(*) FILTER (a = 'acknowledge') > 0 THEN 'acknowledged' ELSE 'active' END AS state FROM w WHERE live GROUP BY 1, 2""")
def alert_states(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("k") % 7
    steps = orders(spark, d).select("o_custkey", F.col("k").alias("at"), F.when(m < 3, "trigger").when(m < 5, "acknowledge").otherwise("resolve").alias("a"))
    return lifecycle.alert_states(steps, "o_custkey", "a", "at", "at")


@Q.query("""
WITH s AS (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS start, value FROM events, range(4) t(i)), c AS (SELECT user_id, start, count(*) AS n, count(DISTINCT CAST(floor(value / 5) AS BIGINT)) AS n_resources FROM s GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT user_id, CAST(start AS TIMESTAMP) AS start, n, n_resources, 'scraping' AS finding FROM c WHERE n / 240.0 > 0.025 UNION ALL SELECT user_id, CAST(start AS TIMESTAMP), n, n_resources, 'unusual' FROM c WHERE n_resources > 4""")
def unusual_access(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("thing", F.floor(F.col("value") / 5))
    out = lifecycle.unusual_access(rows, "user_id", "ts", "thing", 240, 60, per_minute=0.025, resources=4)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q.query("""
WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 10 < 6) AS passed, count(*) FILTER (o_orderkey % 10 = 6) AS failed, count(*) FILTER (o_orderkey % 10 IN (7, 8)) AS retried, count(*) FILTER (o_orderkey % 10 = 9) AS review FROM orders GROUP BY 1)
SELECT *, CASE WHEN failed = 0 AND review = 0 THEN 'passed' WHEN passed + retried > 0 THEN 'partial' ELSE 'failed' END AS overall FROM c""")
def document_reports(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("k") % 10
    status = F.when(m < 6, "passed").when(m == 6, "failed").when(m < 9, "passed_after_retry").otherwise("manual_review")
    return lifecycle.document_report(orders(spark, d).select("o_custkey", status.alias("status")), "o_custkey", "status")


@Q.query("""
SELECT count(*) AS n_files, count(*) FILTER (o_orderkey % 11 > 0) AS text_ok, count(*) FILTER (o_orderkey % 11 = 0) AS text_failed, count(*) FILTER (o_orderkey % 7 > 0) AS model_ok, count(*) FILTER (o_orderkey % 7 = 0) AS model_failed, count(*) FILTER (o_orderkey % 50 = 0) AS leaks,
  floor(avg(o_orderkey % 13) FILTER (o_orderkey % 7 > 0) * 10 + 0.5) / 10 AS mean_coverages FROM orders""")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return lifecycle.batch_summary(orders(spark, d), k % 11 > 0, k % 7 > 0, k % 13, k % 50 > 0)


@Q.query("""
SELECT o_orderkey AS k, least((o_orderkey % 9) / 5.0, 1) AS coverage_gap, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS has_minimum, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1 - (o_orderkey % 4 - 1) / 4.0 END AS provider,
  CASE WHEN o_orderkey % 10 = 0 THEN 1.0 WHEN o_orderkey % 10 = 1 THEN 0.7 WHEN o_orderkey % 10 = 2 THEN 0.0 ELSE greatest(0, 1 - (o_orderkey % 500) / 365.0) END AS expiry, abs(o_totalprice / 100000 - 1) AS pricing,
  greatest(0, o_orderkey % 101 - (1 - (o_orderkey % 5) / 4.0) * 20) AS low, least(100, o_orderkey % 101 + (1 - (o_orderkey % 5) / 4.0) * 20) AS high FROM orders""")
def risk_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    no = F.lit(0.0)
    f = lifecycle.normalised_features({
        "coverage_ratio": no, "gaps": k % 9, "has_minimum": k % 2 == 0, "deductible_ratio": no, "rating": F.when(k % 4 > 0, k % 4), "expired": k % 10 == 0, "renewal": k % 10 == 1, "days_left": F.when(k % 10 != 2, k % 500),
        "region": F.lit(1.0), "urban": F.lit(1.0), "high_risk_exclusions": F.lit(False), "conditions": no, "price_ratio": F.col("o_totalprice") / 100_000,
    })
    interval = lifecycle.risk_interval(k % 101, (k % 5) / 4)
    return orders(spark, d).select("k", *[f[n].alias(n) for n in ("coverage_gap", "has_minimum", "provider", "expiry", "pricing")], interval["low"].alias("low"), interval["high"].alias("high"))


@Q.query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'tr' WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'fallback' END AS pack, CASE WHEN o_orderkey % 3 = 0 THEN 'hint' WHEN o_orderkey % 2 = 0 THEN 'auto' ELSE 'fallback' END AS method, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 0.5 END AS pack_confidence FROM orders""")
def rule_packs(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("k", F.when(F.col("k") % 3 == 0, "tr").when(F.col("k") % 3 == 1, "zz").alias("hint"), F.when(F.col("k") % 2 == 0, "de").otherwise("xx").alias("seen"), F.lit(0.8).alias("sure"))
    packs = spark.createDataFrame([("tr",), ("de",), ("fallback",)], "pack string")
    return lifecycle.selected_pack(rows, packs, "hint", "seen", "sure").select("k", "pack", "method", "pack_confidence")


@Q.query("""
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_critical, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS n_error, 0 AS n_warn FROM orders)
SELECT *, n_critical = 0 AS passed, n_critical > 0 OR n_error >= 3 AS read_again, CASE WHEN n_critical > 0 THEN 'premium' END AS quarantine FROM c""")
def validation_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("k", F.when(F.col("k") % 2 == 0, "tr").otherwise("de").alias("pack"))
    rules = spark.createDataFrame([("tr", "premium", "critical", "sum"), ("tr", "dates", "error", "dates"), ("de", "a", "error", "sum"), ("de", "b", "error", "sum"), ("de", "c", "error", "sum")], "pack string, rule string, severity string, check string")
    found = lifecycle.pack_findings(rows, "k", "pack", rules, {"sum": F.col("k") % 5 != 0, "dates": F.col("k") % 3 != 0})
    return lifecycle.gate(rows, "k", found)


# Product names, the coverages that they promise, and other codes of these.
PRODUCTS = [
    (["dar kasko", "mini kasko", "limited kasko"], ["COLLISION", "THEFT"]),
    (["tam kasko", "full kasko", "genişletilmiş kasko", "extended kasko"], ["COLLISION", "THEFT", "FIRE", "NATURAL_DISASTER", "FLOOD", "EARTHQUAKE"]),
    (["kasko", "standart kasko", "standard kasko"], ["COLLISION", "THEFT", "FIRE", "NATURAL_DISASTER"]),
]
CODES = {"COLLISION": ["COLLISION", "COLLISION_DAMAGE", "CARPMA", "CARPISMA"], "THEFT": ["THEFT", "HIRSIZLIK", "THEFT_ROBBERY"], "FIRE": ["FIRE", "YANGIN", "FIRE_EXPLOSION"]}


@Q.query("""
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, o_orderkey % 2 = 0 AS fire FROM orders), f AS (SELECT k, CASE WHEN m = 0 THEN 'FLOOD,EARTHQUAKE' WHEN m = 1 THEN CASE WHEN fire THEN '' ELSE 'FIRE' END ELSE '' END AS missing, CASE m WHEN 0 THEN 'blocking' ELSE 'critical' END AS severity FROM p)
SELECT * FROM f WHERE missing <> ''""")
def product_mismatches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    codes = F.array_compact(F.array(F.lit("carpma"), F.lit("theft"), F.lit("natural_disaster"), F.when(k % 2 == 0, "yangin")))
    name = by_case(k % 4, F.lit("Super Tam Kasko"), F.lit("Standart Kasko "), F.lit("Mini Kasko 2"), F.lit("Trafik"))
    out = orders(spark, d).select("k", lifecycle.product_mismatch(name, codes, PRODUCTS, CODES).alias("m")).filter("m is not null")
    return out.select("k", joined("m.missing").alias("missing"), F.col("m.severity").alias("severity"))


@Q.query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 9.5 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE p_size END AS size FROM part""")
def overridden_parameters(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("code"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    change = spark.createDataFrame([(0, 9.5, None), (1, None, 1)], "code long, price double, size int")
    return lifecycle.overridden(base, change, "code", ["price", "size"]).drop("code")


@Q.query("""
WITH f AS (SELECT o_orderkey AS k, CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) + CAST(o_orderkey % 5 > 0 AS INTEGER) + CAST(o_orderstatus = 'F' AS INTEGER) AS known FROM orders)
SELECT k, known, known / 4.0 AS share, CASE WHEN known / 4.0 >= 0.8 THEN 'high' WHEN known / 4.0 >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM f""")
def benchmark_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    found = lifecycle.benchmark_confidence({"age": k % 2 == 0, "sample": k % 3 == 0, "region": k % 5 > 0, "source": F.when(F.col("o_orderstatus") == "F", True)})
    return orders(spark, d).select("k", *[v.alias(n) for n, v in found.items()])


@Q.query("""
WITH c AS (SELECT l_orderkey, count(*) AS n_facts, count(*) FILTER (l_partkey % 3 > 0) AS n_evidence, count(*) FILTER (l_partkey % 3 > 0 AND l_returnflag = 'R') AS n_verified FROM lineitem GROUP BY 1)
SELECT *, floor(100.0 * n_evidence / n_facts + 0.5) AS evidence_percent, floor(100.0 * n_verified / n_facts + 0.5) AS verified_percent FROM c""")
def evidence_reports(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").withColumn("quote", F.when(F.col("l_partkey") % 3 > 0, F.col("l_shipdate")))
    return lifecycle.evidence_report(facts, "l_orderkey", "quote", F.col("l_returnflag") == "R")


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'glass' WHEN o_orderkey % 4 = 1 THEN 'driver' WHEN o_orderkey % 4 = 2 THEN 'glass' ELSE 'general' END AS class FROM orders""")
def deductible_classes(spark: SparkSession, d: str) -> DataFrame:
    name = by_case(F.col("k") % 4, F.lit("Windscreen excess"), F.lit("Young DRIVER excess"), F.lit("Glass, any driver"), F.lit("Excess"))
    return orders(spark, d).select("k", lifecycle.deductible_class(name, [("glass windscreen", "glass"), ("driver", "driver")]).alias("class"))


GATE_SQL = "SELECT o_orderkey AS k, o_totalprice AS price, o_orderkey % 9 = 0 AS no_dates, o_orderkey % 7 = 0 AS no_product, o_totalprice > 400000 AS large, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS old FROM orders"


def _gate(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("k"), F.to_date("o_orderdate")
    start = F.when(k % 9 > 0, F.date_sub(day, 100))
    found = lifecycle.compliance_gate(start, day, F.when(k % 7 > 0, "kasko").otherwise(" "), F.lit("1996-01-01").cast("date"), {"large": ("warning", F.col("o_totalprice") > 400_000), "future": ("info", F.lit(None).cast("boolean"))})
    return orders(spark, d).select("k", F.col("o_totalprice").alias("price"), F.when(start > "1996-01-01", 1).alias("later"), found.alias("found"))


@Q.query(f"""SELECT k, concat_ws(',', CASE WHEN no_dates THEN 'dates_missing' END, CASE WHEN old THEN 'expired' END, CASE WHEN no_product THEN 'product_missing' END, CASE WHEN large THEN 'large' END) AS codes, no_dates OR no_product AS blocked FROM ({GATE_SQL})""")
def compliance_gates(spark: SparkSession, d: str) -> DataFrame:
    codes = F.filter(F.transform("found", lambda f: f["code"]), lambda c: c != "not_started")
    return _gate(spark, d).select("k", joined(codes).alias("codes"), F.exists("found", lambda f: f["level"] == "blocking").alias("blocked"))


@Q.query(f"""
WITH s AS (SELECT k, no_dates OR no_product AS blocked, greatest(0, least(100, k % 101 - least(price / 10 / 1000, 30))) AS final FROM ({GATE_SQL}))
SELECT k, CASE WHEN blocked THEN 'compliance' ELSE 'complete' END AS stage, CASE WHEN blocked THEN 'blocked' WHEN final >= 70 THEN 'good' WHEN final >= 40 THEN 'fair' ELSE 'poor' END AS verdict, CASE WHEN NOT blocked THEN final END AS score FROM s""")
def staged_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.staged_evaluation(_gate(spark, d), "k", F.col("found"), F.col("k") % 101, F.col("price") / 10)


# Words that scans tear apart, letter by letter.
TORN = {"POLİÇE": "P O L [İI] [CÇ] E", "SİGORTA": "S [İI] G O R T A", "KASKO": "K A S K O"}


@Q.query("""SELECT o_orderkey AS k, 'POLİÇE no ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' KASKO' ELSE ' plain' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS passes FROM orders""")
def despaced_words(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.cleaning import despaced

    k = F.col("k")
    third = k % 3 == 0
    t = F.concat(F.when(third, "POLİÇE").otherwise("P O L I C E"), F.lit(" no "), k.cast("string"), F.when(third, F.when(k % 2 == 0, " KASKO").otherwise(" plain")).otherwise(F.when(k % 2 == 0, " K AS K O").otherwise(" plain")))
    t = F.when(third, t).otherwise(F.regexp_replace(t, "P O L I C E", "p o l i ç e"))
    return orders(spark, d).select("k", despaced(t, TORN, 4).alias("r")).select("k", "r.*")


@Q.query("""SELECT o_orderkey AS k, 'SİGORTA of 34 A B ' || (o_orderkey % 900 + 100) || ' and ABC' || chr(10) || 'second line' AS text FROM orders""")
def kept_tokens(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.cleaning import normalised_ocr

    t = F.concat(F.lit("  S I GORTA of   34 A B "), (F.col("k") % 900 + 100).cast("string"), F.lit(" and A B C \n||||!!!!||||\n second line"))
    return tables.spread(orders(spark, d)).select("k", normalised_ocr(t, TORN, r"\b\d{2} [A-Z](?: [A-Z]){0,2} \d{2,4}\b").alias("text"))


@Q.query("""
SELECT o_orderkey AS k, 'POLİÇE No: ' || o_orderkey || chr(10) || '[Page 1/2]' || chr(10) || 'a/b' || chr(10) || chr(10) || 'end' AS text, 2 AS despacing_passes, 1 AS page_marks, 1 AS lines_dropped,
  length(o_orderkey::VARCHAR) + 81 AS n_before, 1 AS dropped, 1 AS control FROM orders""")
def precleaned(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.cleaning import pre_clean, sanitised

    raw = F.concat(F.lit("P O L I Ç E\x01 PoliceNo:"), F.col("k").cast("string"), F.lit("\r\n|||||||||||||\n- Page 1 of 2 -\na  / b\n\n\n\nend |||||||||||  "))
    made = pre_clean(raw, TORN, [(r"POLİÇE PoliceNo:", "POLİÇE No:")], [(r"No:(?=\d)", "No: ")], [])
    clean = sanitised(raw)
    return tables.spread(orders(spark, d)).select("k", made.alias("r"), clean.alias("s")).select("k", "r.*", F.col("s.n_before").alias("n_before"), F.col("s.lines_dropped").alias("dropped"), F.col("s.control_removed").alias("control"))


RULES = [("LEGAL_ADVANCE", ["avans", "advance"], []), ("THIRD_PARTY", ["third party", "üçüncü şahıs"], []), ("THEFT", [], ["hırsızlık", "theft"])]


@Q.query("""SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'LEGAL_ADVANCE' WHEN 1 THEN 'THIRD_PARTY' WHEN 2 THEN 'THEFT' WHEN 3 THEN 'GLASS' WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN 'UNKNOWN' ELSE 'THIRD_PARTY' END AS label FROM orders""")
def coverage_labels(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import canonical_labels

    rules = spark.createDataFrame([(i, part, whole, concept) for i, (concept, parts, wholes) in enumerate(RULES) for part, whole in [*[(p, None) for p in parts], *[(None, w) for w in wholes]]], "pos int, part string, whole string, concept string")
    dictionary = spark.createDataFrame([("cam kırılması", "GLASS")], "label string, concept string")
    name = by_case(F.col("k") % 7, F.lit("Hukuki AVANS"), F.lit("THIRD party Liability"), F.lit(" HIRSIZLIK "), F.lit("Cam  Kırılması"), F.lit("theft of keys"), F.lit(None).cast("string"), F.lit("Üçüncü Şahıs"))
    return canonical_labels(orders(spark, d).select("k", name.alias("name")), "name", rules, dictionary).select("k", "label")


@Q.query("""
SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'MOTOR' WHEN 'O' THEN 'HOME' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS amount, o_orderkey % 5 = 0 AS premium_missing, CASE WHEN o_orderkey % 2 = 0 THEN 'original' ELSE 'unspecified' END AS parts, CASE WHEN o_orderkey % 2 = 0 THEN 'extracted' ELSE 'inferred' END AS source,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) END AS insured, o_orderkey % 3 > 0 AS percentage FROM orders""")
def actuarial_inputs(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import actuarial_input

    k = F.col("k")
    rows = orders(spark, d).select(
        k.alias("id"), F.col("o_orderstatus").alias("kind"), F.lit("p").alias("product"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("premium"), F.lit("TRY").alias("currency"), F.to_date("o_orderdate").alias("start"), F.to_date("o_orderdate").alias("expiry"),
        (k % 4).alias("insured"), F.when(k % 3 > 0, k % 3).alias("deductible_percent"), F.lit(None).cast("int").alias("n_conditional"), F.when(k % 2 == 0, "original").alias("parts"), F.lit("any").alias("network"),
    )
    out = actuarial_input(rows, {"F": "MOTOR", "O": "HOME"})
    return out.select(F.col("id").alias("k"), "kind", "premium.amount", "premium_missing", F.col("parts.value").alias("parts"), "parts.source", F.col("insured_value.amount").alias("insured"), F.col("has_percentage_deductible").alias("percentage"))


@Q.query("""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS premium, CAST(o_orderdate AS DATE) AS expiry FROM orders)
SELECT k, floor(premium / 12 + 0.5) AS monthly_premium, CASE WHEN k % 3 = 0 THEN 'THEFT=' || (50 + k % 10) || '.0' WHEN k % 3 = 1 THEN 'THEFT=50.0,UNKNOWN=0.0' ELSE '' END AS coverages, CAST(CASE WHEN k % 3 = 0 THEN 50 + k % 10 WHEN k % 3 = 1 THEN 50 ELSE 0 END AS DOUBLE) AS total,
  CASE WHEN expiry < DATE '1996-01-01' THEN 'expired' WHEN expiry <= DATE '1996-01-31' THEN 'expiring' ELSE 'active' END AS status, concat_ws(',', CASE WHEN premium IS NULL THEN 'premium' END, CASE WHEN k % 3 = 2 THEN 'coverages' END, CASE WHEN k % 7 = 0 THEN 'dates' END, CASE WHEN k % 3 = 1 THEN 'labels' END) AS warnings FROM o""")
def analysed_policies(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import analysed, canonical_label

    k, day = F.col("k"), F.to_date("o_orderdate")
    cover = lambda n, x: F.struct(F.lit(n).alias("name"), x.cast("double").alias("limit"), F.lit(None).cast("boolean").alias("included"))
    covers = F.when(k % 3 == 0, F.array(cover("Theft", F.lit(50)), cover("hırsızlık", 50 + k % 10))).when(k % 3 == 1, F.array(cover("theft", F.lit(50)), cover("Hail", F.lit(None)))).otherwise(F.array().cast("array<struct<name:string,limit:double,included:boolean>>"))
    rows = orders(spark, d).select(k.alias("id"), F.lit("kasko").alias("kind"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("premium"), F.date_add(day, F.when(k % 7 == 0, 5).otherwise(-300)).alias("start"), day.alias("expiry"), covers.alias("coverages"))
    out = analysed(rows, F.lit("1996-01-01").cast("date"), lambda n: canonical_label(n, RULES, {}))
    shown = joined(F.transform("coverages", lambda c: F.concat(c["label"], F.lit("="), c["limit"].cast("string"))))
    return out.select(F.col("id").alias("k"), "monthly_premium", shown.alias("coverages"), "total", "status", joined("warnings").alias("warnings"))


@Q.query("""
SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'currency' END, CASE WHEN o_orderkey % 5 = 0 THEN 'premium' END, CASE WHEN o_orderkey % 4 = 3 THEN 'coverages' END, CASE WHEN o_orderkey % 4 = 1 THEN 'deductible' END, CASE WHEN o_orderkey % 4 = 2 THEN 'limit' END, CASE WHEN o_orderkey % 2 = 1 THEN 'evidence' END, CASE WHEN o_totalprice > 300000 THEN 'plate' END) AS flags,
  o_orderkey % 11 = 0 OR o_orderkey % 4 = 1 AS blocked FROM orders""")
def unsafe_extractions(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import safety_flags

    k = F.col("k")
    cover = lambda limit, deductible, free: F.struct(F.lit(limit).cast("double").alias("limit"), F.lit(deductible).cast("double").alias("deductible"), F.lit(free).alias("is_unlimited"), F.lit(None).cast("boolean").alias("is_market_value"))
    covers = by_case(k % 4, F.array(cover(1, 0, None), cover(None, None, True)), F.array(cover(1, -5, None)), F.array(cover(None, 1, None)), F.array().cast("array<struct<limit:double,deductible:double,is_unlimited:boolean,is_market_value:boolean>>"))
    flags = safety_flags(F.when(k % 11 > 0, "TRY"), F.when(k % 5 > 0, k), covers, F.when(k % 2 == 0, True), {"plate": ("warning", F.col("o_totalprice") > 300_000)})
    out = orders(spark, d).select("k", flags.alias("f"))
    return out.select("k", joined(F.transform("f", lambda f: f["field"])).alias("flags"), F.exists("f", lambda f: f["level"] == "error").alias("blocked"))


@Q.query("""
WITH p AS (SELECT p_partkey, p_type, p_size FROM part)
SELECT p_partkey, 'liability' AS requirement, 'critical' AS severity, CASE WHEN p_size % 3 = 0 THEN 'missing' ELSE 'too_low' END AS gap, CASE WHEN p_size % 3 = 0 THEN 30.0 ELSE 30.0 - p_size END AS shortfall FROM p WHERE p_type = 'ECONOMY' AND (p_size % 3 = 0 OR p_size < 30)
UNION ALL SELECT p_partkey, 'quake', 'high', 'missing', 0.0 FROM p WHERE p_type = 'PROMO' AND p_size % 2 = 1""")
def regulatory_gaps(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import compliance_gaps

    size = F.col("p_size")
    cover = lambda ok, n: F.when(ok, F.struct(F.lit(n).alias("name"), size.cast("double").alias("limit")))
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.array_compact(F.array(cover(size % 3 != 0, "Third PARTY liability"), cover(size % 2 == 0, "DASK quake"))).alias("covers"))
    needs = spark.createDataFrame([("ECONOMY", "liability", "third party|trafik", 30.0, "critical"), ("PROMO", "quake", "dask|deprem", None, "high")], "kind string, requirement string, pattern string, minimum double, severity string")
    return compliance_gaps(rows, "p_partkey", "p_type", "covers", needs)


@Q.query(f"""SELECT k, CAST(greatest(0, 100 - CASE WHEN no_dates THEN 40 ELSE 0 END - CASE WHEN no_product THEN 40 ELSE 0 END - CASE WHEN old THEN 15 ELSE 0 END - CASE WHEN large THEN 15 ELSE 0 END) AS DOUBLE) AS score, NOT (no_dates OR no_product) AS compliant FROM ({GATE_SQL})""")
def compliance_scores(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import compliance_score

    return _gate(spark, d).select("k", compliance_score(F.col("found"), {"blocking": 40, "warning": 15}).alias("c")).select("k", "c.*")


@Q.query("""
WITH b(kind, low, mean, high, cl, cm, ch, trend) AS (VALUES ('ECONOMY', 900.0, 1300.0, 1700.0, 5.0, 20.0, 40.0, 12.0), ('PROMO', 900.0, 1250.0, 1600.0, 5.0, 25.0, 45.0, -8.0), ('STANDARD', 1000.0, 1400.0, 1800.0, 1.0, 25.0, 50.0, 0.0)),
m AS (SELECT p_partkey, least(100, greatest(0, (p_retailprice - low) / (high - low) * 100)) AS pp, least(100, greatest(0, (p_size - cl) / (ch - cl) * 100)) AS cp, p_size / p_retailprice AS vr, cm / mean AS mr, trend FROM part JOIN b ON kind = p_type)
SELECT p_partkey, CAST(pp AS DOUBLE) AS premium_percentile, CAST(cp AS DOUBLE) AS coverage_percentile, CASE WHEN pp <= 25 THEN 'excellent' WHEN pp <= 50 THEN 'good' WHEN pp <= 75 THEN 'average' ELSE 'high' END AS premium_rating, CASE WHEN cp >= 75 THEN 'excellent' WHEN cp >= 50 THEN 'good' WHEN cp >= 25 THEN 'average' ELSE 'low' END AS coverage_rating,
  CASE WHEN vr / mr >= 1.2 THEN 'excellent' WHEN vr / mr >= 1.0 THEN 'good' WHEN vr / mr >= 0.8 THEN 'average' ELSE 'poor' END AS value_rating, CASE WHEN trend > 5 THEN 'increasing' WHEN trend < -5 THEN 'decreasing' ELSE 'stable' END AS market_trend FROM m""")
def market_comparisons(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.analysis import market_comparison

    rows = [("ECONOMY", 900.0, 1300.0, 1700.0, 5.0, 20.0, 40.0, 12.0), ("PROMO", 900.0, 1250.0, 1600.0, 5.0, 25.0, 45.0, -8.0), ("STANDARD", 1000.0, 1400.0, 1800.0, 1.0, 25.0, 50.0, 0.0)]
    benchmarks = spark.createDataFrame(rows, "kind string, low double, mean double, high double, coverage_low double, coverage_mean double, coverage_high double, trend double")
    out = market_comparison(table(spark, d, "part"), "p_type", "p_retailprice", "p_size", benchmarks)
    return out.select("p_partkey", "premium_percentile", "coverage_percentile", "premium_rating", "coverage_rating", "value_rating", "market_trend")


@Q.query("""
WITH RECURSIVE m AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1),
b AS (SELECT 'errors' AS rule, start, e::DOUBLE AS value, 21600 AS pause FROM m WHERE e >= 4 UNION ALL SELECT 'quiet', start, n::DOUBLE, 7200 FROM m WHERE n < 8),
f AS (SELECT rule, min(start) AS start FROM b GROUP BY 1 UNION ALL SELECT f.rule, (SELECT min(b.start) FROM b WHERE b.rule = f.rule AND b.start >= f.start + to_seconds(b.pause)) FROM f WHERE f.start IS NOT NULL)
SELECT b.rule, CAST(b.start AS TIMESTAMP) AS ts, b.value FROM f JOIN b ON b.rule = f.rule AND b.start = f.start""")
def hourly_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly metrics as a stream: what breaks a rule, at most once per rule and cooldown."""
    from brambling.streaming.metrics import alerts

    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    path, to = tables.scratch(spark, "hours"), tables.scratch(spark, "alerts")
    hours.withColumn("start", F.col("start").cast("timestamp")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("start timestamp, n long, e long").parquet(path)
    found = alerts(stream, [("errors", "e", ">=", 4, 21_600), ("quiet", "n", "<", 8, 7_200)], "start")
    found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", tables.scratch(spark, "alerts-state")).trigger(availableNow=True).start(to).awaitTermination()
    return spark.read.schema(found.schema).parquet(to).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN 'missing' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 17 = 0 AND o_orderkey % 10 <> 2 AND o_orderstatus <> 'X'""")
def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("k", F.col("o_orderstatus").alias("s"))
    after = rows.filter("k % 10 <> 3").withColumn("s", F.when(F.col("k") % 17 == 0, "X").otherwise(F.col("s")))
    return tables.audit_violations(rows.filter("k % 10 <> 2"), after, ["k"], ["s"])
