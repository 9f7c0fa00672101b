"""Roll-ups of ``events`` as a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions.numbers import half_up, rolling_hash, rollout_bucket
from brambling.operators import ranking, rollups
from brambling.plans.registry import Registry
from brambling.sources.tables import any_contains, page, retained, scan, table

Q = Registry()


def failed():
    return F.col("event_type") == "error"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


@Q.query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@Q.query("""
WITH p AS (SELECT date_trunc('day', ts) AS period_start, event_type AS kind, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok,
  sum(CAST(value AS DECIMAL(18,4))) AS total, min(value) AS low, max(value) AS high, count(value) AS known FROM events GROUP BY 1, 2)
SELECT CAST(period_start AS TIMESTAMP) AS period_start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS n_ok, round(sum(ok) / sum(n), 4) AS success_rate,
  CAST(sum(total) AS DOUBLE) AS total, round(CAST(sum(total) AS DOUBLE) / sum(known), 6) AS mean, min(low) AS low, max(high) AS high,
  '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS by_kind
FROM p GROUP BY 1""")
def period_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    out = rollups.period_rollup(rows, "ts", "day", "value", ~failed(), "event_type")
    return out.withColumns({"total": F.col("total").cast("double"), "mean": F.round(F.col("total").cast("double") / F.col("n"), 6), "low": F.col("low").cast("double"), "high": F.col("high").cast("double"), "period_start": F.col("period_start").cast("timestamp_ntz")})


@Q.query("""
SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS dimension,
  coalesce(event_type, day) AS member, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS cost, count(*) FILTER (event_type = 'error') AS n_errors
FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())""")
def usage_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    measures = {"n": F.count(F.lit(1)), "cost": F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), "n_errors": F.count_if(failed())}
    return rollups.grouped_totals(events(spark, d), {"event_type": "event_type", "day": "day"}, measures)


def _ends(spark: SparkSession, d: str, step: str) -> tuple[str, str]:
    low, high = events(spark, d).agg(F.date_trunc(step, F.min("ts")).cast("string"), F.date_trunc(step, F.max("ts")).cast("string")).first()
    return low, high


@Q.query("""
WITH a AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM a)
SELECT CAST(s.bucket AS TIMESTAMP) AS bucket, coalesce(n, 0) AS n, coalesce(n_errors, 0) AS n_errors FROM s LEFT JOIN a USING (bucket)""")
def hourly_health(spark: SparkSession, d: str) -> DataFrame:
    counts = events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed()).alias("n_errors"))
    out = rollups.filled(rollups.spine(spark, *_ends(spark, d, "hour"), "1 HOUR"), counts, "n", "n_errors")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@Q.query("""
WITH a AS (SELECT CAST(ts AS DATE) AS bucket, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS DATE) AS bucket FROM a)
SELECT bucket, coalesce(n_users, 0) AS n_users, coalesce(n, 0) AS n FROM s LEFT JOIN a USING (bucket)""")
def daily_active(spark: SparkSession, d: str) -> DataFrame:
    counts = events(spark, d).groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("bucket")).agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))
    return rollups.filled(rollups.spine(spark, *_ends(spark, d, "day"), "1 DAY"), counts, "n_users", "n").withColumn("bucket", F.to_date("bucket"))


@Q.query("""
SELECT event_type, count(*) AS n, round(avg(CAST(value AS DECIMAL(18,4))), 4) AS mean, quantile_disc(value, 0.95) AS p95, round(100.0 * count(*) FILTER (user_id % 7 = 0) / count(*), 4) AS error_percent
FROM events GROUP BY 1""")
def endpoint_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollups.endpoint_stats(events(spark, d), ["event_type"], "value", F.col("user_id") % 7 == 0)


@Q.query("""
SELECT event_type, count(value) AS n, round(min(value), 2) AS low, round(max(value), 2) AS high, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS deviation,
  round(quantile_cont(value, 0.1), 2) AS p10, round(quantile_cont(value, 0.25), 2) AS p25, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.75), 2) AS p75, round(quantile_cont(value, 0.9), 2) AS p90
FROM events GROUP BY 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rollups.score_distribution(events(spark, d), "value", "event_type")


@Q.query("""
SELECT floor(quantile_cont(value, 0.9) + 0.5) AS grade_a, floor(quantile_cont(value, 0.75) + 0.5) AS grade_b, floor(quantile_cont(value, 0.5) + 0.5) AS grade_c, floor(quantile_cont(value, 0.25) + 0.5) AS grade_d FROM events""")
def grade_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rollups.grade_thresholds(events(spark, d), "value")


@Q.query("""
SELECT event_type, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))] AS value FROM events GROUP BY 1""")
def usage_p95(spark: SparkSession, d: str) -> DataFrame:
    return rollups.floor_index_percentile(events(spark, d), ["event_type"], "value", 0.95)


@Q.query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def top_users(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top_counts(events(spark, d), "user_id", 10)


@Q.query("""
SELECT * FROM (SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS in_window, CASE WHEN count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) >= 3 THEN 'critical' ELSE 'high' END AS level FROM events)
WHERE in_window >= 2""")
def failed_login_burst(spark: SparkSession, d: str) -> DataFrame:
    return rollups.burst(events(spark, d).select("event_id", "user_id", "event_type", "ts"), ["user_id"], "ts", 900, 2, 3).drop("ts")


@Q.query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollups.sessions(events(spark, d), ["user_id"], "ts", "30 minutes")


@Q.query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, tm, k, tm AS opened, 1 AS used, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.tm, e.k, CASE WHEN e.tm >= r.opened + 86400000000 THEN e.tm ELSE r.opened END,
   CASE WHEN e.tm >= r.opened + 86400000000 THEN 1 WHEN r.used < 2 THEN r.used + 1 ELSE r.used END, e.tm >= r.opened + 86400000000 OR r.used < 2
 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, allowed FROM r""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return rollups.anchored_limit(events(spark, d).select("user_id", "event_id", "ts"), ["user_id"], "ts", 86_400, 2).drop("ts")


@Q.query("""
WITH v AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS w FROM events GROUP BY 1, 2),
t AS (SELECT day, sum(w) AS total FROM v GROUP BY 1), b AS (SELECT day, event_type, w, row_number() OVER (PARTITION BY day ORDER BY w DESC, event_type) AS k FROM v)
SELECT b.day, event_type AS winner, round(w / total, 4) AS share, w / total < 0.3 AS disputed FROM b JOIN t USING (day) WHERE k = 1""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    return rollups.weighted_vote(events(spark, d), ["day"], "event_type", F.lit(1), 0.3)


@Q.query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM c)
SELECT day, event_type, n, previous, n - previous AS delta, round(n / previous, 4) AS ratio,
  CASE WHEN previous IS NULL OR n >= previous THEN 'none' WHEN n / previous < 0.5 THEN 'critical' WHEN n / previous < 0.8 THEN 'warning' ELSE 'info' END AS severity FROM l""")
def trend_delta(spark: SparkSession, d: str) -> DataFrame:
    counts = events(spark, d).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rollups.period_change(counts, ["event_type"], "day", "n")


@Q.query("""SELECT event_type, CAST(sum(value * w) / sum(w) AS DECIMAL(18,6))::DOUBLE AS mean FROM (SELECT event_type, CAST(value AS DECIMAL(18,4)) AS value, 1 + user_id % 3 AS w FROM events WHERE value >= 0) GROUP BY 1""")
def weighted_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("w", (1 + F.col("user_id") % 3)).withColumn("v", F.when(F.col("value") >= 0, F.col("value").cast("decimal(18,4)")).otherwise(F.lit(-1).cast("decimal(18,4)")))
    return rows.groupBy("event_type").agg(rollups.weighted_mean(F.col("v").cast("double"), F.col("w")).cast("decimal(18,6)").cast("double").alias("mean"))


@Q.query("""SELECT event_id, event_type, user_id, value FROM events WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY event_id DESC LIMIT 50 OFFSET 20""")
def log_page(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    latest = rows.agg(F.max("ts").alias("m")).first()["m"]
    found = scan(retained(rows, "ts", F.lit(latest), 10), equal={"event_type": "purchase", "user_id": None})
    return page(found, [F.desc("event_id")], 20, 50).select("event_id", "event_type", "user_id", "value")


@Q.query("""SELECT event_id, event_type, props FROM events WHERE contains(lower(event_type), 'sign') OR contains(lower(props), '7')""")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return any_contains(events(spark, d), {"event_type": "sign", "props": "7"}).select("event_id", "event_type", "props")


@Q.query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(json_extract_string(props, '$.k')) AS n_k, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least_k FROM events GROUP BY 1""")
def json_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(k).alias("n_k"), F.min(k).alias("least_k"))


@Q.query("""
WITH c AS (SELECT date_trunc('month', ts) AS period, user_id % 5 AS budget, event_id, ts, CAST(value AS DECIMAL(18,4)) AS value FROM events)
SELECT event_id, budget, CAST(period AS DATE) AS period, CAST(sum(value) OVER w AS DOUBLE) AS spent, sum(value) OVER w > 1000 AS "over" FROM c WINDOW w AS (PARTITION BY budget, period ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.scoring import running_budget as budget

    rows = events(spark, d).select("event_id", (F.col("user_id") % 5).alias("budget"), F.struct("ts", "event_id").alias("at"), F.col("value").cast("decimal(18,4)").alias("cost"))
    out = budget(rows, "budget", F.to_date(F.date_trunc("month", "at.ts")), "at", "cost", 1000)
    return out.select("event_id", "budget", "period", F.col("spent").cast("double").alias("spent"), "over")


@Q.query("""
WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, CAST(user_id AS VARCHAR) || 'new_parser' AS s FROM u),
h AS (SELECT user_id, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)) AS h FROM s)
SELECT user_id, h % 100 AS bucket, h % 100 < 25 AS enabled FROM h""")
def rollout(spark: SparkSession, d: str) -> DataFrame:
    users = events(spark, d).select("user_id").distinct()
    return users.withColumn("bucket", rollout_bucket(F.col("user_id").cast("string"), F.lit("new_parser"))).withColumn("enabled", F.col("bucket") < 25)


@Q.query("""
WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split('exp' || CAST(user_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)) % 100 AS p FROM u)
SELECT CASE WHEN p < 50 THEN 'control' WHEN p < 80 THEN 'a' ELSE 'b' END AS variant, count(*) AS participants FROM h GROUP BY 1""")
def experiment(spark: SparkSession, d: str) -> DataFrame:
    users = events(spark, d).select("user_id").distinct()
    place = rolling_hash(F.concat(F.lit("exp"), F.col("user_id").cast("string"))) % 100
    variant = F.when(place < 50, "control").when(place < 80, "a").otherwise("b")
    return users.groupBy(variant.alias("variant")).agg(F.count(F.lit(1)).alias("participants"))


@Q.query("""
WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, value, event_id FROM events)
SELECT event_type, day, event_id, value, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY value DESC, event_id) AS "rank" FROM m) WHERE "rank" <= 3""")
def slowest_per_day(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_key(events(spark, d).select("event_type", "day", "event_id", "value"), ["event_type", "day"], [F.desc("value"), F.col("event_id")], 3).withColumn("rank", F.col("rank").cast("long"))


@Q.query("""
WITH r AS (SELECT user_id % 3 AS version, event_type <> 'error' AS ok, value FROM events), v AS (SELECT version, count(*) AS n, round(count(*) FILTER (ok) / count(*), 4) AS success_rate, floor(avg(CAST(value AS DECIMAL(18,4))) * 100 + 0.5) / 100 AS mean_value FROM r GROUP BY 1)
SELECT *, n >= 100 AS meets_sample_rule, version = (SELECT version FROM v ORDER BY success_rate DESC, version LIMIT 1) AS is_winner FROM v""")
def version_test(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("version", F.col("user_id") % 3)
    stats = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"), rollups.rate(F.count_if(~failed()), F.count(F.lit(1))).alias("success_rate"), half_up(F.avg(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("mean_value"))
    best = stats.agg(ranking.winner("version", "success_rate", "version").alias("best"))
    return stats.crossJoin(F.broadcast(best)).select("version", "n", "success_rate", "mean_value", (F.col("n") >= 100).alias("meets_sample_rule"), (F.col("version") == F.col("best")).alias("is_winner"))


@Q.query("""
SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses, count(*) FILTER (user_id % 5 = 0) AS errors, floor(count(*) FILTER (event_id % 3 <> 0) / count(*) * 100 + 0.5) / 100 AS hit_rate FROM events GROUP BY 1""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import cache_stats as stats

    out = stats(events(spark, d), ["event_type"], F.col("event_id") % 3 != 0, F.col("user_id") % 5 == 0, [(0.9, 3600), (0.5, 600)])
    return out.select("event_type", "hits", "misses", "errors", half_up(F.col("hits") / (F.col("hits") + F.col("misses")), 2).alias("hit_rate"))


@Q.query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_ok, round(count(*) FILTER (value > 50) / count(*), 4) AS success_rate FROM events GROUP BY 1""")
def recent_health(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import recent_health as health

    return health(events(spark, d), "ts", "event_type", F.col("value") > 50)


@Q.query("""
SELECT m.kind AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('view'), ('refund'), ('chargeback')) m(kind) LEFT JOIN events ON event_type = kind GROUP BY 1""")
def zero_filled_kinds(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import zero_filled

    return zero_filled(events(spark, d), "event_type", ["click", "view", "refund", "chargeback"])


@Q.query("""
SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_type)) / 1000000 AS seconds FROM events QUALIFY count(*) OVER (PARTITION BY user_id, ts) = 1""")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import stage_timings as timings

    out = timings(events(spark, d), "user_id", "event_type", "ts")
    same = F.count(F.lit(1)).over(ranking.Window.partitionBy("user_id", "ts"))
    return out.withColumn("_n", same).filter("_n = 1").select("user_id", "event_id", "seconds")


@Q.query("""
WITH k AS (SELECT DISTINCT user_id FROM events), n AS (SELECT count(*) AS n FROM k) SELECT event_type, count(DISTINCT user_id) AS n, floor(100.0 * count(DISTINCT user_id) / (SELECT n FROM n) * 10 + 0.5) / 10 AS percent FROM events GROUP BY 1""")
def reach(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import translation_coverage

    rows = events(spark, d)
    total = rows.agg(F.count_distinct("user_id").alias("t"))
    return translation_coverage(rows, rows, "user_id", "event_type").drop("percent").crossJoin(F.broadcast(total)).select("event_type", "n", half_up(100.0 * F.col("n") / F.col("t"), 1).alias("percent"))


@Q.query("""
SELECT count(value) AS n, floor((quantile_cont(value, 0.9) - 90) * 1000 + 0.5) / 1000 AS a, floor((quantile_cont(value, 0.5) - 50) * 1000 + 0.5) / 1000 AS c FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def calibration_drift(spark: SparkSession, d: str) -> DataFrame:
    from brambling.functions.numbers import percentiles

    rows = events(spark, d)
    latest = rows.agg(F.max("ts").alias("m")).first()["m"]
    p = retained(rows, "ts", F.lit(latest), 7).agg(F.count("value").alias("n"), percentiles("value", 0.9, 0.5).alias("p"))
    return p.select("n", half_up(F.col("p")[0] - 90, 3).alias("a"), half_up(F.col("p")[1] - 50, 3).alias("c"))


@Q.query("""SELECT event_type AS pattern, count(*) AS occurrences, floor(least(1.0, 0.5 + 0.05 * count(*)) * 1000 + 0.5) / 1000 AS confidence FROM events GROUP BY 1""")
def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    from brambling.streaming.metrics import learned_patterns as learn

    rows = events(spark, d).select(F.col("event_type").alias("pattern"), F.lit("event").alias("kind"), F.col("props").alias("example"), F.col("user_id").cast("string").alias("source"))
    return learn(rows, "pattern", "kind", "example", "source").select("pattern", "occurrences", half_up("confidence", 3).alias("confidence"))


@Q.query("""SELECT CAST(time_bucket(INTERVAL 1 MINUTE, ts) AS TIMESTAMP) AS "start", event_type, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 2""")
def minute_metrics(spark: SparkSession, d: str) -> DataFrame:
    from brambling.streaming.metrics import minute_metrics as minutes

    return minutes(events(spark, d), "ts", ["event_type"], "value", failed()).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "high")


@Q.query("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, true AS users_near, true AS p95_near FROM events GROUP BY 1, 2
UNION ALL SELECT CAST(date_trunc('month', ts) AS TIMESTAMP), 'all', count(*), true, true FROM events GROUP BY 1""")
def sketched_days(spark: SparkSession, d: str) -> DataFrame:
    """Days by type, and months, from hourly sketches alone; their numbers lie within the stated error of the exact ones."""
    from brambling.operators import rollups

    rows = events(spark, d).select("ts", "event_type", "user_id", F.col("value").cast("double").alias("value"))
    hours = rollups.sketched(rows, "ts", "hour", ["event_type"], "user_id", "value")
    days = rollups.merged(hours, "day", ["event_type"])
    months = rollups.merged(days, "month", []).select("start", F.lit("all").alias("event_type"), "n", "total", "users", "spread")
    found = None
    for sketches, period, kind in ((days, "day", F.col("event_type")), (months, "month", F.lit("all"))):
        near = rollups.estimated(sketches, {"p95": 0.95}).select(F.col("start").alias("s"), F.col("event_type").alias("e"), "n", "n_users", "p95")
        logs = rows.select(F.date_trunc(period, "ts").alias("start"), kind.alias("event_type"), "user_id", "value")
        exact = logs.join(F.broadcast(near), (F.col("start") == F.col("s")) & (F.col("event_type") == F.col("e"))).groupBy("start", "event_type").agg(
            F.max("n").alias("n"),
            (F.abs(F.max("n_users") - F.count_distinct("user_id")) <= 0.05 * F.count_distinct("user_id") + 1).alias("users_near"),
            # as many values lie below the estimate as should, within the error of ranks and one row
            (F.coalesce(F.count_if(F.col("value") < F.col("p95")), F.lit(0)) <= 0.97 * F.count("value") + 1).alias("below"),
            (F.coalesce(F.count_if(F.col("value") <= F.col("p95")), F.lit(0)) >= 0.93 * F.count("value") - 1).alias("above"),
        )
        part = exact.select("start", "event_type", "n", "users_near", (F.col("below") & F.col("above")).alias("p95_near"))
        found = part if found is None else found.unionByName(part)
    return found


@Q.query("""
WITH p AS (SELECT p_partkey, p_retailprice AS price, p_size AS size FROM part), n AS (SELECT sqrt(sum(price * price)) AS a, sqrt(sum(size::DOUBLE * size)) AS b FROM p),
v AS (SELECT p_partkey, price, price / a * 0.6 AS x, size / b * 0.4 AS y FROM p, n), e AS (SELECT min(x) AS xi, max(x) AS xa, max(y) AS yi, min(y) AS ya FROM v),
f AS (SELECT p_partkey, price, sqrt(pow(x - xi, 2) + pow(y - yi, 2)) AS p, sqrt(pow(x - xa, 2) + pow(y - ya, 2)) AS m FROM v, e),
g AS (SELECT p_partkey, price, round(CASE WHEN p + m = 0 THEN 0.5 ELSE m / (p + m) END, 4) AS closeness FROM f)
SELECT p_partkey, closeness, row_number() OVER (ORDER BY closeness DESC, p_partkey) AS "rank", row_number() OVER (ORDER BY price, p_partkey) AS by_price FROM g""")
def global_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All parts as one set: closeness to the ideal and two ranks, without a task that holds all of them."""
    from brambling.operators import ranking

    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    best = ranking.topsis(rows, [], "p_partkey", {"price": (0.6, False), "size": (0.4, True)})
    priced = ranking.ranks(rows, [], {"by_price": F.col("price")}, "p_partkey").select("p_partkey", F.col("by_price").cast("long").alias("by_price"))
    return best.withColumn("rank", F.col("rank").cast("long")).join(priced, "p_partkey")
