"""Streams with timed state and exact sinks, and change capture, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.plans.registry import Registry
from brambling.sources.change_log import ChangeLog, differing
from brambling.sources.tables import scratch, table
from brambling.streaming.alerting import alert_life
from brambling.streaming.sinks import Ledger, absent_sink, events_sink

Q = Registry()


def in_parts(rows: DataFrame, by: str, n: int = 3) -> tuple[str, str]:
    """``rows`` as files of a stream source that grows by ``n`` appends, and the schema."""
    path = scratch(rows.sparkSession, "stream")
    for i in range(n):
        rows.filter(F.pmod(F.xxhash64(by), F.lit(n)) == i).write.mode("append").parquet(path)
    return path, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 7
    steps = table(spark, d, "orders").select(F.concat(F.lit("rule "), F.col("o_custkey") % 40).alias("rule"), F.when(m < 3, "trigger").when(m < 5, "acknowledge").otherwise("resolve").alias("action"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") * 60).alias("ts"), F.col("o_orderkey").alias("tie"), F.col("o_totalprice").cast("double").alias("value"))
    last = steps.agg(F.max("ts").alias("t")).select(F.lit("clock").alias("rule"), F.lit("tick").alias("action"), (F.col("t") + F.expr("INTERVAL 40000 DAYS")).alias("ts"), F.lit(0).cast("long").alias("tie"), F.lit(0.0).alias("value"))
    return steps.unionByName(last)


@Q.query("""
WITH RECURSIVE s AS (SELECT 'rule ' || (o_custkey % 40) AS key, 1700000000 + o_orderkey * 60 AS t, o_totalprice::DOUBLE AS value, CASE WHEN o_orderkey % 7 < 3 THEN 'trigger' WHEN o_orderkey % 7 < 5 THEN 'acknowledge' ELSE 'resolve' END AS a FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS r FROM s),
w AS (SELECT key, 0::BIGINT AS r, NULL::BIGINT AS alert, false AS ack, -1::BIGINT AS until, NULL::VARCHAR AS event, NULL::BIGINT AS t, NULL::DOUBLE AS value, NULL::BIGINT AS shown FROM (SELECT DISTINCT key FROM s)
UNION ALL SELECT n.key, n.r,
  CASE WHEN n.a = 'trigger' AND w.alert IS NULL AND n.t >= w.until THEN n.t WHEN n.a = 'resolve' THEN NULL ELSE w.alert END,
  CASE WHEN n.a = 'trigger' AND w.alert IS NULL AND n.t >= w.until THEN false WHEN n.a = 'acknowledge' AND w.alert IS NOT NULL THEN true WHEN n.a = 'resolve' THEN false ELSE w.ack END,
  CASE WHEN n.a = 'trigger' AND w.alert IS NULL AND n.t >= w.until THEN n.t + 7200 ELSE w.until END,
  CASE WHEN n.a = 'trigger' THEN CASE WHEN w.alert IS NULL AND n.t >= w.until THEN 'opened' ELSE 'suppressed' END WHEN w.alert IS NULL THEN NULL WHEN n.a = 'resolve' THEN 'resolved' WHEN n.a = 'acknowledge' AND NOT w.ack THEN 'acknowledged' END,
  n.t, n.value, CASE WHEN n.a = 'trigger' AND w.alert IS NULL AND n.t >= w.until THEN n.t ELSE w.alert END
  FROM w JOIN n ON n.key = w.key AND n.r = w.r + 1)
SELECT key, shown AS alert_s, event, t AS ts_s, value FROM w WHERE event IS NOT NULL""")
def alert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The life of alerts as a stream in three parts, each with steps of all times; a last step moves the clock past all of them."""
    path, kinds = in_parts(_steps(spark, d), "tie")
    steps = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 8).parquet(path)
    to = scratch(spark, "alerts")
    life = alert_life(steps, "rule", "action", "ts", "tie", "value", cooldown="2 HOURS", late="30000 days")
    life.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "alerts-state")).outputMode("append").trigger(availableNow=True).start(to).awaitTermination()
    found = spark.read.schema("key string, alert timestamp, event string, ts timestamp, value double").parquet(to)
    return found.select("key", F.unix_seconds("alert").alias("alert_s"), "event", F.unix_seconds("ts").alias("ts_s"), "value")


@Q.query("SELECT event_id, user_id, event_type FROM events")
def streamed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events through a stream into a sink that holds each once."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    path, kinds = in_parts(rows, "event_id")
    ledger = Ledger(spark, scratch(spark, "events"))
    spark.readStream.schema(kinds).option("maxFilesPerTrigger", 4).parquet(path).writeStream.foreachBatch(events_sink(ledger)).option("checkpointLocation", scratch(spark, "events-state")).trigger(availableNow=True).start().awaitTermination()
    ledger.append(rows, 0)  # a repetition of a batch, which changes nothing
    return ledger.read(kinds).drop("batch")


@Q.query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha, length(coalesce(text, '')) AS n FROM documents")
def text_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of texts by the hash of their content: what is there already is not written again."""
    t = F.coalesce("text", F.lit(""))
    path, kinds = in_parts(table(spark, d, "documents").select(F.sha2(t, 256).alias("sha"), F.length(t).alias("n"), "doc_id"), "doc_id")
    ledger = Ledger(spark, scratch(spark, "cache"))
    spark.readStream.schema(kinds).option("maxFilesPerTrigger", 4).parquet(path).writeStream.foreachBatch(absent_sink(ledger, ["sha"], "doc_id")).option("checkpointLocation", scratch(spark, "cache-state")).trigger(availableNow=True).start().awaitTermination()
    return ledger.read(kinds).select("sha", F.col("n").cast("long").alias("n"))


COLUMNS = "k long, status string, price double"


def _log(spark: SparkSession, d: str) -> ChangeLog:
    """Orders in four versions: even ones; all; some with a new price or status; some gone and none new."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    log = ChangeLog(spark, scratch(spark, "changes"), ("k",), COLUMNS)
    second = rows.withColumn("price", F.when(F.col("k") % 5 == 0, F.lit(0.0)).otherwise(F.col("price"))).withColumn("status", F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("status")))
    for version in (rows.filter("k % 2 = 0"), rows, second, second.filter("k % 3 > 0")):
        log.record(version)
    return log


@Q.query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice <> 0 AS priced FROM orders)
SELECT k, 1 AS version, 'insert' AS op, '' AS fields FROM o WHERE k % 2 = 0 UNION ALL SELECT k, 2, 'insert', '' FROM o WHERE k % 2 = 1
UNION ALL SELECT k, 3, 'update', concat_ws(',', CASE WHEN k % 11 = 0 THEN 'status' END, CASE WHEN k % 5 = 0 AND priced THEN 'price' END) FROM o WHERE k % 11 = 0 OR k % 5 = 0 AND priced UNION ALL SELECT k, 4, 'delete', '' FROM o WHERE k % 3 = 0""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    changes = _log(spark, d).changes()
    fields = F.when(F.col("op") == "update", F.array_join(differing(F.col("before"), F.col("after"), ["status", "price"]), ",")).otherwise("")
    return changes.select("k", "version", "op", fields.alias("fields"))


@Q.query("""
SELECT 2 AS version, o_orderkey AS k, o_orderstatus AS status, o_totalprice::DOUBLE AS price FROM orders
UNION ALL SELECT 4, o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice::DOUBLE END FROM orders WHERE o_orderkey % 3 > 0""")
def state_at_version(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return log.state(2).select(F.lit(2).alias("version"), "*").unionByName(log.state(4).select(F.lit(4).alias("version"), "*"))
