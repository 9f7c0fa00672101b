import datetime
import random

import pytest
from pyspark.sql import functions as F

from brambling.functions import text as text_functions
from brambling.operators import collections, documents, joins, losses, ranking, rollups, scoring
from brambling.sources import tables
from brambling.streaming import metrics


def test_asof_falls_back_to_the_earliest(spark):
    d = datetime.date
    facts = spark.createDataFrame([("a", d(2020, 1, 1)), ("a", d(2021, 6, 1)), ("a", d(2023, 1, 1)), ("b", d(2022, 1, 1))], "k string, at date")
    versions = spark.createDataFrame([("a", d(2021, 1, 1), d(2021, 12, 31), 1.0), ("a", d(2022, 1, 1), None, 2.0)], "k string, s date, e date, v double")
    got = {(r.k, r["at"].year): (r.v, r.in_force) for r in joins.asof(facts, versions, ["k"], "at", "s", "e", "k", ["v"]).collect()}
    assert got[("a", 2020)] == (1.0, False) and got[("a", 2021)] == (1.0, True) and got[("a", 2023)] == (2.0, True) and got[("b", 2022)][0] is None


def test_boxes(spark):
    t = "doc int, engine string, id string, text string, box struct<x:double,y:double,width:double,height:double>"
    rows = [(1, "a", "a1", "x", (0.0, 0.0, 10.0, 10.0)), (1, "b", "b1", "x", (1.0, 0.0, 10.0, 10.0)), (1, "b", "b2", "y", (50.0, 0.0, 10.0, 10.0)), (2, "b", "b3", "x", (0.0, 0.0, 10.0, 10.0))]
    got = {r.id: r.group_id for r in joins.align_boxes(spark.createDataFrame(rows, t), ["doc"], "engine", "id", "text", "box").collect()}
    assert got == {"a1": "a1", "b1": "a1", "b2": "b2", "b3": "b3"}


def test_topsis(spark):
    df = spark.createDataFrame([(1, "a", 100.0, 5.0), (1, "b", 200.0, 5.0), (1, "c", 150.0, 1.0)], "s int, k string, price double, cover double")
    got = {r.k: (r["rank"], r.closeness) for r in ranking.topsis(df, ["s"], "k", {"price": (0.5, False), "cover": (0.5, True)}).collect()}
    assert got["a"] == (1, 1.0) and got["c"][0] == 3
    stable = ranking.topsis_sensitivity(df, ["s"], "k", {"price": (0.5, False), "cover": (0.5, True)}).first()
    assert (stable.winner, stable.n_flips, stable.stability) == ("a", 0, 1.0)


def test_eviction(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(20)], "id int, hits int")
    left = ranking.evict(df, "hits", "id", 10)
    assert left.count() == 16 and left.agg(F.min("hits")).first()[0] == 1
    assert ranking.evict(df, "hits", "id", 30).count() == 20


def test_paraphrases(spark):
    rows = [("p", 1, "Glass damage covered"), ("p", 2, "glass damages are covered fully"), ("p", 3, "Theft of the vehicle"), ("q", 1, "theft vehicle")]
    got = {r.g: r.texts for r in collections.paraphrase_groups(spark.createDataFrame(rows, "g string, n int, t string"), "g", "n", "t", ["the", "of", "are"], 0.6).collect()}
    assert got == {"p": ["glass damages are covered fully", "Theft of the vehicle"], "q": ["theft vehicle"]}


def test_collections(spark):
    one = spark.createDataFrame([(["A", "b"], ["B", "c", "a"])], "x array<string>, y array<string>")
    assert one.select(collections.union_first_spelling(F.col("x"), F.col("y"))).first()[0] == ["A", "b", "c"]
    assert one.select(collections.arrays_alike(F.array(F.lit("Kasko 01")), F.array(F.lit("kasko o1")))).first()[0] is True
    nested = spark.createDataFrame([((1, ("x",)), 2)], "a struct<b:int,c:struct<d:string>>, e int")
    assert collections.flatten(nested).columns == ["a.b", "a.c.d", "e"]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert maps.select(collections.deep_merge([F.col("x"), F.col("y")])).first()[0] == {"a": "1", "b": "3"}
    template = spark.createDataFrame([("a", "1.0"), ("b", "x"), ("c", "y")], "k string, v string")
    now = spark.createDataFrame([("a", "1"), ("b", "z")], "k string, v string")
    assert sorted(r.k for r in collections.overrides(template, now, ["k"], "v").collect()) == ["b", "c"]


def test_chunks_join_again(spark):
    text = "".join(f"Sentence number {i} of a long text. " for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "a\nPage 1\nx\nPage 2\n" + "y" * 13_000)], "id int, t string")
    parts = documents.chunks(docs, "id", "t")
    got = {(r.id, r.kind) for r in parts.collect()}
    assert {(1, "size"), (2, "whole"), (3, "whole"), (4, "page")} == got
    again = {r.id: r.text for r in documents.join_chunks(parts.filter("id < 4"), "id", "chunk").collect()}
    assert again == {1: text, 2: "short", 3: ""}
    repeated = spark.createDataFrame([(1, "ab " * 6_000), (2, "x" * 30_000)], "id int, t string")
    pieces = documents.chunks(repeated, "id", "t")
    want = {1: "ab " * 6_000, 2: "x" * 30_000}
    assert {r.id: r.text for r in documents.join_chunks(pieces, "id", "chunk").collect()} == want
    assert {r.id: r.text for r in documents.join_overlapping(pieces, "id", "chunk_no", "chunk").collect()} == want


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org or c@d.org or a@b.org, call +90 532 123 45 67")], "id int, t string")
    assert docs.select(documents.redact("t")).first()[0] == "mail [EMAIL] or [EMAIL] or [EMAIL], call [PHONE]"
    got = {(r.token, r.value, r.n) for r in documents.vault(docs, "id", "t").collect()}
    assert {("[EMAIL_1]", "a@b.org", 2), ("[EMAIL_2]", "c@d.org", 1)} <= got


def test_sections_and_quality(spark):
    docs = spark.createDataFrame([(1, "intro\nCOVERAGE\nfire\ntheft\nEXCLUSIONS\nwar")], "id int, t string")
    got = {r.section: r.n_lines for r in documents.sections(docs, "id", "t", [("^COVERAGE", "coverage"), ("^EXCL", "exclusions")]).collect()}
    assert got == {"none": 1, "coverage": 3, "exclusions": 2}
    texts = ["a policy of words that are long enough", "p o l i c y", "", None, " \n ", "ab"]
    rows = documents.text_quality(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", ["policy"]).orderBy("k").collect()
    assert rows[0].ok and not rows[1].ok and rows[2].score == rows[3].score == 0 and rows[1].single_ratio == 1 and rows[0].terms_found == 1
    assert abs(rows[0].word_length - 30 / 7) < 1e-9  # the one-letter word does not count
    gates = spark.createDataFrame([("sum 100 and 200 and 300", "sum"), ("x y", "x y")], "a string, b string").select(documents.qa_gates("a", "b")).collect()
    assert "numbers_lost" in gates[0][0] and gates[1][0] == []


def test_losses_approach_the_mean(spark):
    scenarios = spark.createDataFrame([("u", 0.5, "uniform", None, None, None, 100.0, 300.0), ("l", 0.2, "lognormal", 3.0, 0.5, None, None, None)], "code string, frequency double, kind string, mu double, sigma double, alpha double, low double, high double")
    exposures = spark.createDataFrame([(1, 0.0, 0.0)], "id int, limit double, deductible double")
    got = losses.simulate(exposures, scenarios, "id", 20_000).first()
    c = F.col
    want = scenarios.agg(F.sum(c("frequency") * losses.expected_mean(c("kind"), c("mu"), c("sigma"), c("alpha"), c("low"), c("high")))).first()[0]
    assert abs(got["mean"] - want) < 4 * got["error"]
    assert losses.simulate(exposures.repartition(3), scenarios, "id", 500).collect() == losses.simulate(exposures, scenarios, "id", 500).collect()


def test_evaluation_caps(spark):
    df = spark.createDataFrame([(95.0, 90.0, False, False), (95.0, 90.0, True, False), (95.0, 90.0, False, True), (-1.0, 50.0, False, False)], "a double, b double, c boolean, u boolean")
    out = scoring.evaluation(df, {"a": 0.6, "b": 0.4}, F.col("c"), F.col("u")).collect()
    assert [(r.score, r.grade) for r in out] == [(93.0, "A"), (60.0, "D"), (85.0, "B"), (50.0, "F")]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("u", t0 + datetime.timedelta(seconds=s)) for s in (0, 10, 20, 65, 70, 75)] + [("v", t0)]
    events = spark.createDataFrame(rows, "k string, ts timestamp")
    want = sorted((r.k, r.ts, r.allowed) for r in rollups.anchored_limit(events, ["k"], "ts", 60, 2).collect())
    assert [w[2] for w in want if w[0] == "u"] == [True, True, False, True, True, False]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = metrics.rate_limited(stream, "k", "ts", 60, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.ts, r.allowed) for r in spark.table("limited").collect()) == want


def test_alerts_and_minutes(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(t0 + datetime.timedelta(seconds=s), 10.0) for s in (0, 30, 90, 400)]
    data = spark.createDataFrame(rows, "ts timestamp, errors double")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = metrics.alerts(stream, [("many", "errors", ">", 5.0, 60), ("few", "errors", "<", 1.0, 60)], "ts").writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.ts - t0).seconds for r in spark.table("alerts").collect()) == [0, 90, 400]
    per_minute = {r.start: r.n for r in metrics.minute_metrics(data.withColumn("k", F.lit(1)), "ts", ["k"], "errors", F.col("errors") > 5).collect()}
    assert per_minute == {t0: 2, t0 + datetime.timedelta(minutes=1): 1, t0 + datetime.timedelta(minutes=6): 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, name string")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted((r.id, r.name) for r in back.collect()) == [("1", 'a "b", c'), ("2", None)]
    df.write.parquet(str(tmp_path / "t"))
    tables.append_absent(spark, spark.createDataFrame([(2, "x"), (3, "y")], df.schema), str(tmp_path / "t"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
    to = tables.upsert(spark, spark.createDataFrame([(1, "new")], df.schema), str(tmp_path / "t"), ["id"])
    assert {r.id: r.name for r in spark.read.parquet(to).collect()} == {1: "new", 2: None, 3: "y"}
    assert tables.by_key(df, "id", 1).count() == 1
    with pytest.raises(Exception, match="more than one"):
        tables.by_key(df.union(df), "id", 1).collect()
    out = tables.portable({"a": df, "b": df}, "id", 1)
    assert sorted((r.store, r.record) for r in out.collect())[0] == ("a", '{"id":1,"name":"a \\"b\\", c"}')


def test_search(spark):
    docs = spark.createDataFrame([(1, "fire policy", "x"), (2, "theft", "a policy"), (3, "none", "none")], "id int, title string, body string")
    assert [r.id for r in documents.search(docs, {"title": 1.0, "body": 0.4}, "policy", "id").collect()] == [1, 2]


def test_contains_match_beyond_the_small_size(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    rows = [(i, word(5)) for i in range(120)] + [(500, None)]
    names = [(i, word(4)) for i in range(60)]
    a, b = spark.createDataFrame(rows, "k int, name string"), spark.createDataFrame(names, "o int, other string")
    want = {k: next((x for _, x in names if n and x and (x in n or n in x)), None) for k, n in rows}
    assert {r.k: r.matched for r in joins.contains_match(a, b, "name", "other", "o").collect()} == want
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    assert {r.k: r.matched for r in joins.contains_match(a, b, "name", "other", "o").collect()} == want


def test_asof_with_many_versions(spark, monkeypatch):
    rng = random.Random(5)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    versions = [(day(s), None if rng.random() < 0.2 else day(s + rng.randint(0, 90)), i, None if i % 7 == 0 else i * 2) for i, s in enumerate(rng.randint(0, 400) for _ in range(40))]
    facts = spark.createDataFrame([(i, day(rng.randint(-50, 500))) for i in range(200)], "k int, at date")
    v = spark.createDataFrame(versions, "a date, b date, no int, twice int")
    one = joins.asof(facts, v, [], "at", "a", "b", "k", ["no", "twice"]).collect()
    monkeypatch.setattr(joins, "MANY_VERSIONS", 5)
    assert sorted(one) == sorted(joins.asof(facts, v, [], "at", "a", "b", "k", ["no", "twice"]).collect())


def test_similar_pairs_like_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for base in range(12):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 24)))
        for _ in range(6):
            t = list(text)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 1)
            rows.append((len(rows), "".join(t), base % 2))
    df = spark.createDataFrame(rows, "k int, t string, b int")
    for least in (0.6, 0.85, 1.0):
        got = {(r.key, r.other) for r in joins.similar_pairs(df, "k", "t", F.col("b"), least).collect()}
        first = {}
        for k, t, b in rows:
            first.setdefault((b, t), k)
        reps = [(b, t, k) for (b, t), k in first.items() if t]
        pairs = spark.createDataFrame([(min(k, m), max(k, m), t, u) for i, (b, t, k) in enumerate(reps) for c, u, m in reps[:i] if b == c], "k int, m int, t string, u string")
        want = {(r.k, r.m) for r in pairs.filter(F.round(text_functions.similarity("t", "u"), 4) >= least).collect()}
        assert got == want
