import random
import re

from brambling.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for s in range(len(w)):
            for n in {len(x) for x in wins}:
                if s + n <= len(w) and tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    who |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), sorted(str(x) for x in who if x is not None)))
    return sorted(out, key=str)


def test_like_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é2", "d-e", "\tf."]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(7, None), (8, ""), (8, ""), (9, "lone")]
    items = [(i, text(rng.randint(3, 9))) for i in range(8)] + [(20, "lone"), (21, ""), (22, None), (20, "lone"), (None, "a b C a"), (30, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS items", "2 AS spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    for chars in (8_000_000, 40):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        got = decontam.find_matches(d, b, window=5).withColumn("n_hit", decontam.words_hit(decontam.F.col("spans"))).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want
        kept = decontam.remove_contaminated(d, b, window=5)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[2])


def longest_match(a, b, least):
    """(words, place in a, place in b) of the longest common run of at least ``least`` words, the first in a, then in b."""
    runs = [(n, i, j) for i in range(len(a)) for j in range(len(b)) if (n := next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))) >= least]
    return max(runs, key=lambda r: (r[0], -r[1], -r[2]), default=None)


def test_longest_matches(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    docs = [(i, " ".join(rng.choice([text(rng.randint(0, 9)), " ".join(rng.choice(items)[1].split()[rng.randint(0, 5) : rng.randint(6, 30)])]) for _ in range(rng.randint(1, 5)))) for i in range(50)] + [(99, "word " * 200_000 + items[0][1])]
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {m["item"]: (m.n_words, m.doc_word, m.item_word) for m in r.longest} for r in decontam.find_matches(d, b, window=4).collect()}
    for k, t in docs[:-1]:
        want = {str(i): longest_match(words(t), words(x), min(4, len(words(x)))) for i, x in items}
        assert got[k] == {i: m for i, m in want.items() if m}
    assert got[99]["0"] == (len(words(items[0][1])), 200_000, 0)


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_matches(d, b).count() == 0
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert decontam.find_matches(one, b).select("n_words", "items").collect() == [(2, [])]
