import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brambling.functions import dictionaries as dc
from brambling.operators import analysis, scoring


def test_like_plain_search(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abç") for _ in range(rng.randrange(n)))
    terms, texts = [word(5) for _ in range(80)], [word(12) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", dc.terms_inside(F.col("t"), terms).alias("all"), dc.first_inside(F.col("t"), terms, terms).alias("first"), dc.first_either_way(F.col("t"), terms, [f"{k}" for k in range(80)]).alias("either"))
    for r in found.collect():
        t = texts[r.i]
        inside = None if t is None else [k for k, x in enumerate(terms) if x and x in t]
        assert r["all"] == (None if t is None else [k for k in inside if terms.index(terms[k]) == k])
        assert r["first"] == (terms[inside[0]] if inside else None)
        either = [k for k, x in enumerate(terms) if t and x and (x in t or t in x)]
        assert r["either"] == (str(either[0]) if either else None)
    assert rows.select(dc.terms_inside(F.col("t"), []).alias("x")).filter("size(x) > 0").count() == 0


@pytest.mark.parametrize(
    "pattern, run",
    [("(?i)License", "license"), ("a|b", ""), (r"x\d+yz", "yz"), (r"foo\.bar", "foo.bar"), ("(ab|cd)efg?", "ef"), ("ab{2,3}cd", "cd"), ("[abc]de", "de"), (r"\Qa\E", ""), ("(?x)a b", ""), ("ışık ab", "k ab"), ("a*b?", ""), ("(abc)?", ""), (r"a\pLb", "")],
)
def test_what_a_match_must_hold(pattern, run):
    assert dc.needed(pattern) == run


def test_a_match_holds_its_run():
    rng = random.Random(5)
    parts = ["a", "b", "ab", "(a|b)", "[ab]", "a?", "b+", "(ab)*", r"\.", ".", "b{1,2}", "c"]
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        text = "".join(rng.choice("abc.") for _ in range(8))
        if re.search(pattern, text):
            assert dc.needed(pattern) in text, (pattern, text)


def test_patterns_meet_texts_without_a_cross_join(spark):
    patterns = [("a", "lic[e]nse", "x"), ("b", "@|#", "y"), ("c", r"\d{4}", "x"), ("d", "(?i)LICENSE", "z"), ("e", "sea", "y")]
    texts = [(1, "a license of 2020"), (2, "License #"), (3, None), (4, ""), (5, "by the sea 123"), (1, "sea")]
    table = spark.createDataFrame(patterns, "name string, pattern string, severity string")
    found = scoring.pattern_findings(spark.createDataFrame(texts, "k int, t string"), "k", "t", table)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = sorted((k, n, s) for k, t in texts if t is not None for n, p, s in patterns if re.search(p, t))
    assert sorted(map(tuple, found.collect())) == want


def test_labels_from_tables(spark):
    rules = [("LEGAL", ["avans", "yardım"], []), ("THIRD", ["third party"], ["üçüncü şahıs"]), ("THEFT", [], ["hırsızlık", "theft"])]
    dictionary = {"cam kırılması": "GLASS", "deprem": "QUAKE"}
    names = ["Hukuki AVANS", "THIRD party avans", "HIRSIZLIK", " cam  kırılması", "theft of", "theft", "DEPREM", "", None, "  ", "Üçüncü Şahıs", "x"]
    rows = spark.createDataFrame(list(enumerate(names)) + [(99, "theft")], "k int, name string")
    table = spark.createDataFrame([(i, p, w, c) for i, (c, ps, ws) in enumerate(rules) for p, w in [*[(x, None) for x in ps], *[(None, x) for x in ws]]], "pos int, part string, whole string, concept string")
    got = analysis.canonical_labels(rows, "name", table, spark.createDataFrame(list(dictionary.items()), "label string, concept string"))
    want = rows.select("k", analysis.canonical_label("name", rules, dictionary).alias("label"))
    assert sorted(map(tuple, got.select("k", "label").collect())) == sorted(map(tuple, want.collect()))


def test_many_terms_cost_as_few():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 14)))
    text = " ".join(word() for _ in range(60_000))

    def seconds(n):
        made = dc.automaton([word() for _ in range(n)])
        best = []
        for _ in range(5):
            began = time.perf_counter()
            sum(1 for _ in made.iter(text))
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(10_000) < 8 * seconds(10)


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        dc.rules_of(spark.range(3).selectExpr("cast(id AS string) AS t"), "t")
