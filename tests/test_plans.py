"""What the plans must look like, and that results depend on neither the number of partitions nor the order of rows."""

import re

import pytest

from brambling import queries
from tests.oracle import rows

DIR = "/root/testdata/sf0.001"
PYTHON = {"rate_limit", "chunked", "rejoined", "insurer_keys", "expected_losses", "aligned_tokens", "fuzzy_coverage", "canonical_coverages", "coverage_labels", "pattern_findings", "exclusion_impacts", "phrase_hits", "classified", "merged_chunks"}


def plan(spark, name):
    return queries.queries()[name](spark, DIR)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - PYTHON))
def test_stays_in_the_jvm_without_pairs(spark, name):
    text = plan(spark, name)
    assert not re.search("EvalPython|InPandas|InArrow|PythonUDF", text)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize(
    "name, table, columns, pushed",
    [
        ("premium_summary", "lineitem", {"l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"}, "LessThan(l_shipdate"),
        ("exists_semi", "lineitem", {"l_orderkey", "l_returnflag", "l_quantity"}, "EqualTo(l_returnflag,R)"),
        ("log_page", "events", {"event_id", "ts", "event_type", "user_id", "value"}, "EqualTo(event_type,purchase)"),
        ("letter_ratio", "documents", {"doc_id", "text"}, ""),
        ("version_history", "orders", {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"}, ""),
    ],
)
def test_scans_are_narrow(spark, name, table, columns, pushed):
    text = plan(spark, name)
    scans = [s for s in text.split("Scan parquet")[1:] if f"/{table}.parquet" in s]
    assert scans and any(pushed in s for s in scans)
    for s in scans:
        read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", s)[1]))
        assert read <= columns, read


@pytest.mark.parametrize("name", ["period_stats", "usage_by_dimension", "rate_limit", "weighted_vote", "snapshot_diff", "benchmark_match", "topsis_parts", "nearest_k", "gap_scores", "expected_losses", "near_dup_pairs", "redaction_vault", "exclusion_impacts"])
def test_partitions_do_not_matter(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = queries.queries()[name](spark, DIR)
            found.append(rows(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
