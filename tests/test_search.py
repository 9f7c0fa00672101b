import re

import pytest
from pyspark.sql import functions as F

from brambling.operators import search
from brambling.operators.search import SearchIndex
from brambling.sources.tables import scratch

KIND = "id long, at int, name string, body string"
ROWS = [(1, 10, "Axa-Sigorta 77", "Car car policy of the year"), (2, 20, "axa", "the policy is void"), (3, 30, "Allianz", "nothing; of THE sea"), (4, 40, None, None), (None, 50, "axa", "policy")]


def made(spark):
    return SearchIndex.create(spark.createDataFrame(ROWS, KIND), scratch(spark, "index"), "id", "at", {"name": "A", "body": "C"}, ("name",))


@pytest.fixture(scope="module")
def index(spark):
    return made(spark)


def found(df):
    return sorted((r.id, r.rank) for r in df.collect())


def test_ranked_words(index):
    assert found(index.search("policy")) == [(1, 0.1), (2, 0.1)]
    assert found(index.search("CAR policy")) == [(1, round(0.2 * 2 / 3 + 0.1, 6))]
    assert found(index.search("car void", every=False)) == [(1, round(0.4 / 3, 6)), (2, 0.1)]
    assert found(index.search("of the", phrase=True)) == [(1, 0.2), (3, 0.2)]
    assert found(index.search("the of", phrase=True)) == []
    assert found(index.search("axa")) == [(1, 0.5), (2, 0.5)]
    assert [r.id for r in index.best("policy", 1).collect()] == [2]


def test_parts_of_short_fields(index):
    assert found(index.search("a-sig")) == [(1, 0.0)]
    assert found(index.search("lianz")) == [(3, 0.0)]
    assert found(index.search("gorta 77")) == [(1, 0.0)]
    assert found(index.search("polic")) == [] and found(index.search("?")) == [] and found(index.search("")) == []


def test_append_replace_remove_compact(spark):
    index = made(spark)
    index.append(spark.createDataFrame([(2, 21, "axa", "a cat"), (7, 70, "Neo", "policy")], KIND))
    assert found(index.search("policy")) == [(1, 0.1), (7, 0.1)] and found(index.search("cat")) == [(2, 0.1)]
    index.remove(spark.createDataFrame([(7,), (99,)], "id long"))
    assert found(index.search("policy")) == [(1, 0.1)] and found(index.search("neo")) == []
    index.append(spark.createDataFrame([(7, 71, "Neo", "new policy")], KIND))
    assert found(index.search("neo policy")) == [(7, 0.6)]
    again = SearchIndex.open(spark, index.path)
    small = again.compact(scratch(spark, "index"))
    for q in ("policy", "cat", "the", "lianz", "neo policy", "a-sig"):
        assert found(small.search(q)) == found(again.search(q))
    assert small._table("gone").count() == 0 and len(small._segments()) == 1
    small.append(spark.createDataFrame([(1, 11, "x", "y")], KIND))
    assert found(small.search("car")) == []


def test_a_failed_append_is_not_seen(spark):
    index = made(spark)
    rows = spark.createDataFrame([(2, 21, "axa", "a cat")], KIND)
    broken = SearchIndex.open(spark, index.path)
    object.__setattr__(broken, "_commit", lambda no, segment: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.append(rows)
    assert found(index.search("cat")) == [] and found(index.search("void")) == [(2, 0.1)]
    index.append(rows)
    assert found(index.search("cat")) == [(2, 0.1)] and found(index.search("void")) == []


def test_only_postings_of_the_terms_are_read(spark, index):
    text = index.search("policy")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [s for s in text.split("Scan parquet")[1:] if "/postings" in s]
    assert scans
    for s in scans:
        assert re.search(r"PartitionFilters: \[.*bucket", s) and re.search(r"PushedFilters: \[.*term", s)
        assert not re.search(r"ReadSchema: .*body", s)


def test_empty_index(spark):
    index = SearchIndex.create(spark.createDataFrame([], KIND), scratch(spark, "index"), "id", "at", {"body": "A"}, ())
    assert index.search("policy").count() == 0
    index.append(spark.createDataFrame(ROWS, KIND).withColumn("doc", F.lit(1)))
    assert found(index.search("policy")) == [(1, 0.5), (2, 0.5)]


def test_tokens_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, 5, "t", ["b", "a", "b"]), (2, 6, "t", []), (3, 7, "t", ["a"]), (3, 7, "s", ["a", "a"])], "doc int, recency int, field string, words array<string>")
    found = search._postings(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.field, r.term, r.positions, r.recency) for r in found.collect()) == [(1, "t", "a", [1], 5), (1, "t", "b", [0, 2], 5), (3, "s", "a", [0, 1], 7), (3, "t", "a", [0], 7)]
