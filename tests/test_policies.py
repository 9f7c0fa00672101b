import datetime

from pyspark.sql import functions as F

from brambling.operators import extraction, jobs, policies


def test_projection(spark):
    rows = spark.createDataFrame([("p1", "ACME", '{"premium": 1206.0, "type": "kasko"}')], "id string, insurer string, raw string")
    out = policies.projected(rows, {"id": "policy_id", "insurer": "provider"}, "raw", "premium double, type string").first()
    assert (out.policy_id, out.provider, out.premium, out.type, out.monthly_premium) == ("p1", "ACME", 1206.0, "kasko", 101)
    b = spark.createDataFrame([("home", 5.0, None, None), ("auto", None, 1.0, 2.0), ("ship", 1.0, 1.0, 1.0)], "kind string, fire double, theft double, glass double")
    got = policies.branch_coverages(b, "kind", {"home": [("Fire", "fire")], "auto": [("Theft", "theft"), ("Glass", "glass")]})
    assert [[c.name for c in r.coverages] for r in got.collect()] == [["Fire"], ["Theft", "Glass"], []]


def test_insurer_mapping(spark):
    rows = spark.createDataFrame([(1, "Acme ", "sum", "5"), (1, "Other", "sum", "6"), (1, "Other", "odd", "7")], "id int, insurer string, field string, value string")
    mapping = spark.createDataFrame([("acme", "sum", "premium"), (None, "sum", "total")], "insurer string, field string, canonical string")
    assert sorted((r.value, r.field) for r in policies.renamed_by_insurer(rows, "insurer", mapping).collect()) == [("5", "premium"), ("6", "total"), ("7", "odd")]


def test_verdicts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    assert [get(policies.parity(F.lit(a), F.lit(b))) for a, b in ((2, 0), (10, 9), (10, 4), (10, 7))] == ["pass", "pass", "critical", "warn"]
    a = {"number": F.lit("P-0123"), "insurer": F.lit("Acme"), "person": F.lit("Ada L")}
    b = {"number": F.lit("p o123"), "insurer": F.lit("ACME"), "person": F.lit(None).cast("string")}
    assert get(policies.same_policy(a, b)) is True
    assert get(policies.known_share(F.lit("glass damage cover"), F.array(F.lit("Glass damage")))) is True
    assert get(policies.qa_score({"a": (F.lit(True), 60), "b": (F.lit(None).cast("boolean"), 40)}, F.lit(10), F.lit(0), [(F.lit(False), 50)])) == 50
    x = F.array(F.struct(F.lit("Fire").alias("name"), F.lit(100.0).alias("limit")))
    y = F.array(F.struct(F.lit("F1RE").alias("name"), F.lit(105.0).alias("limit")))
    assert get(policies.coverages_alike(x, y)) is True and get(policies.coverages_alike(x, y, 0.01)) is False
    assert get(extraction.integrity(F.array(F.lit("info"), F.lit("critical")))) == "broken"


def test_fields(spark):
    text = "Policy No: AB-12\nInsured | Ada L\nPremium\n1.234,56\nplate 34 ABC 123, made 2019"
    docs = spark.createDataFrame([(1, text)], "id int, t string")
    one = lambda c: docs.select(c.alias("x")).first()[0]
    assert one(extraction.labelled("t", ["Police No", "Policy No"])) == "AB-12"
    assert one(extraction.labelled("t", ["Insured"])) == "Ada L" and one(extraction.labelled("t", ["Premium"])) == "1.234,56"
    assert one(extraction.labelled("t", ["Nothing"])) is None
    v = one(extraction.vehicle("t"))
    assert (v.plate, v.vin, v.year) == ("34ABC123", None, 2019)
    got = extraction.fields(docs, "id", "t", {"plate": (r"(\d{2} [A-Z]{3} \d{3})", "plate", 0.9), "none": ("(zzz)", None, 1.0)}).collect()
    assert [(r.field, r.value, r.confidence, r.valid) for r in got] == [("plate", "34 ABC 123", 0.9, True)]
    assert one(extraction.place("t", [("Ada", "north"), ("Insured", "south")], "none")) == "north"
    rows = extraction.table_rows(spark.createDataFrame([(1, "Fire | x | 1.000\nno table\nTheft | 2,5")], "id int, t string"), "id", "t").collect()
    assert [(r["row"], r.name, r.amount) for r in rows] == [(0, "Fire", 1000.0), (2, "Theft", 2.5)]
    claims = spark.createDataFrame([(1, "Premium: 1.200 and Premium: 1,200", 1300), (2, "Premium: 1.300", 1300), (3, "none", 5)], "id int, t string, premium int")
    assert [r.id for r in extraction.contradictions(claims, "id", "t", {"premium": ("premium", r"Premium: ([\d.,]+)", "critical")}).collect()] == [1]


def test_retries(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "k int")
    passes = []

    def work(df):
        passes.append(1)
        return df.withColumn("ok", F.col("k") < 2 * len(passes))

    out = jobs.retried(rows, work, ~F.col("ok"), "k", 2, lambda df: df.cache()).collect()
    assert len(passes) == 2 and {r.k: (r.ok, r.attempt) for r in out} == {0: (True, 1), 1: (True, 1), 2: (True, 2), 3: (True, 2), 4: (False, 2), 5: (False, 2)}


def test_choice_and_logs(spark):
    df = spark.createDataFrame([(0.0,), (49.0,), (50.0,), (99.0,)], "p double")
    assert [r[0] for r in df.select(jobs.cumulative_choice(F.col("p"), {"a": 50.0, "b": 50.0})).collect()] == ["a", "a", "b", "b"]
    t = datetime.datetime(2024, 1, 1)
    logs = jobs.stage_logs(spark.createDataFrame([("d", "b", t.replace(hour=2)), ("d", "a", t)], "k string, s string, ts timestamp"), "k", "s", "ts").first()
    assert logs.n_stages == 2 and logs.stages.index('"a"') < logs.stages.index('"b"')
