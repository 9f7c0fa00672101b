"""Nulls, ties and empty tables of the lifecycle, cleaning and analysis operators; their usual results are held by SQL."""

import datetime

from pyspark.sql import functions as F

from brambling.functions import numbers, text
from brambling.operators import analysis, cleaning, collections, extraction, lifecycle
from brambling.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_alert_states(spark):
    steps = [("a", 1, "resolve"), ("a", 2, "trigger"), ("a", 3, "acknowledge"), ("a", 4, "trigger"), ("a", 5, "resolve"), ("a", 6, "acknowledge"), ("a", 7, "trigger"), ("b", 1, "acknowledge"), (None, 1, "trigger")]
    got = lifecycle.alert_states(spark.createDataFrame(steps, "k string, t int, act string"), "k", "act", "t", "t").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, 2, 5, 2, "resolved"), ("a", 2, 7, None, 1, "active"), (None, 1, 1, None, 1, "active")], key=str)
    assert lifecycle.alert_states(spark.createDataFrame([], "k string, t int, act string"), "k", "act", "t", "t").count() == 0


def test_unusual_access(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("u", t0 + datetime.timedelta(seconds=s), s % 30) for s in range(60)] + [("v", t0, 1)] * 4
    found = lifecycle.unusual_access(spark.createDataFrame(rows, "k string, ts timestamp_ntz, r int"), "k", "ts", "r", 5, 5, per_minute=11, resources=20).collect()
    assert sorted((r.k, r.n, r.n_resources, r.finding) for r in found) == [("u", 60, 30, "scraping"), ("u", 60, 30, "unusual")]


def test_product_mismatch(spark):
    products = [(["full"], ["A", "B"]), (["basic"], ["A"])]
    check = lambda name, *codes: one(spark, lifecycle.product_mismatch(F.lit(name).cast("string"), F.array(*[F.lit(c) for c in codes]) if codes else F.array().cast("array<string>"), products, {"A": ["A", "ALPHA"]}).alias("m")).m
    assert check("My FULL cover", "alpha") == (["B"], "blocking")
    assert check("basic") == (["A"], "critical") and check("basic", "a") is None and check(None, "a") is None and check(" ", "a") is None and check("else") is None


def test_gate_counts_rows_without_findings(spark):
    rows, none = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([], "k int, rule string, severity string")
    assert sorted(map(tuple, lifecycle.gate(rows, "k", none).collect())) == [(1, 0, 0, 0, True, False, None), (2, 0, 0, 0, True, False, None)]


def test_cleaning(spark):
    words = {"POLICY": "P O L I C Y"}
    r = one(spark, cleaning.despaced(F.lit("P O LICY and A B C"), words).alias("a"), cleaning.despaced(F.lit(None).cast("string"), words).alias("b"), cleaning.normalised_ocr(F.lit(None).cast("string"), words, r"\d+").alias("c"), cleaning.keeping(F.lit("A 1 B 22"), r"\d+", lambda t: F.lower(t)).alias("d"), cleaning.pre_clean(F.lit(None).cast("string"), words, [], [], []).alias("e"))
    assert r.a == ("POLICY and ABC", 2) and r.b.text is None and r.c == "" and r.d == "a 1 b 22" and r.e.text == ""


def test_labels_and_numbers(spark):
    rules = [("X", ["axe"], []), ("Y", [], ["saw"])]
    label = lambda s: one(spark, analysis.canonical_label(F.lit(s).cast("string"), rules, {"saw blade": "Z"}).alias("v")).v
    assert [label(s) for s in ("An AXE", " Saw ", "saw  blade", "sawn", "", None)] == ["X", "Y", "Z", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    pairs = [(300_000.0, 600_000.0)]
    same = lambda a, b: one(spark, numbers.equivalent(F.lit(a).cast("double"), F.lit(b).cast("double"), pairs).alias("v")).v
    assert same(610_000, 295_000) and same(1, 1) and not same(None, None) and not same(300_000, 700_000)
    assert [one(spark, text.entity_type(F.lit(s)).alias("v")).v for s in ("12345678901", "123 456 78 90", "x")] == ["individual", "corporate", None]
    assert one(spark, extraction.province(F.lit("Road 99, 06100 or 35."), [("izmir", "35")]).alias("v")).v == "35"


def test_preferences_and_versions(spark, tmp_path):
    m = one(spark, collections.preferred(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"), ["a"]).alias("v")).v
    assert m == {"a": "1"}
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string").write.parquet(path)
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    first = tables.upsert(spark, new, path, ["k"])
    second = tables.upsert(spark, new.filter("k = 3").withColumn("v", F.lit("newer")), first, ["k"])
    assert first != second and sorted(map(tuple, spark.read.parquet(second).collect())) == [(1, "old"), (2, "new"), (3, "newer")]
