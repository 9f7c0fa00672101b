import hashlib
import random
from collections import Counter

import numpy as np

from brambling.llm import weighted_sampling as w


def terms(text: str) -> Counter:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_are_generalised_jaccard():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        pool = [" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6)]
        one = " ".join(rng.choice(pool) for _ in range(30))
        two = one[: rng.randint(0, len(one))] + " " + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        want = jaccard(terms(one), terms(two))
        errors.append(w.likeness(w.fingerprint(one.encode()), w.fingerprint(two.encode())) - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprint_term_by_term():
    """The signature against the plain rule: per sample the term with the least value of c * exp(-r * (t - b + 1))."""
    rng = random.Random(4)
    for n in (1, 4, 5, 9, 300):
        text = " ".join(rng.choice("abc") + rng.choice("de") for _ in range(n)).encode()
        h = w.term_hashes(text)
        names, counts = np.unique(h, return_counts=True)
        got = w.fingerprint(text)
        for k in range(0, w.SAMPLES, 9):
            best = None
            for name, count in zip(names, counts):
                x = w._drawn(np.array([name], np.uint64))[:, k : k + 1]
                e, f, g = -np.log(1 - w._uniform(x)), -np.log(w._uniform(w._mixed(x + w.C))), -np.log(w._uniform(w._mixed(x ^ w.B)))
                c, s = e + f, np.log((e + f) / e)
                r = s + g
                t = np.floor(np.log(count) / r + 1 - s / r)
                value = float((c * np.exp(-r * (t - (1 - s / r) + 1)))[0, 0])
                if best is None or value < best[0]:
                    best = value, name, int(t[0, 0])
            sample = w._mixed(np.array([best[1]], np.uint64) + np.array([best[2]], np.int64).astype(np.uint64) * w.C + w.SEEDS[k]) >> np.uint64(48)
            assert got[k] == sample[0]


def test_variates():
    x = w._drawn(w._mixed(np.arange(1, 2001, dtype=np.uint64)))
    e, f, g = -np.log(1 - w._uniform(x)), -np.log(w._uniform(w._mixed(x + w.C))), -np.log(w._uniform(w._mixed(x ^ w.B)))
    c = e + f
    s = np.log(c / e)
    r = s + g
    assert abs(r.mean() - 2) < 0.02 and abs(c.mean() - 2) < 0.02 and abs((s / r).mean() - 0.5) < 0.01
    assert abs(np.corrcoef(r.ravel(), c.ravel())[0, 1]) < 0.01


def test_long_words_and_empty():
    assert not w.fingerprint(b"").any() and not w.fingerprint(" -- ".encode()).any()
    assert w.likeness(w.fingerprint(b"x" * 100_000), w.fingerprint(b"X" * 100_000)) == 1
    words = "lorem " * 30_000
    assert len(w.word_hashes(words.encode())) == 30_000 and len(set(w.word_hashes(words.encode()).tolist())) == 1


def test_next(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE", 300)
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(500, "same"), (500, "same"), (501, None), (None, "none at all")]
    rows += [(77, f"hot {i} text of one id") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = w.with_next(docs).collect()
    assert len(got) == len(rows)
    known = [r for r in rows if r[0] is not None and r[0] < 180 and r[0] != 77]
    order = sorted(known, reverse=True)
    table = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:]):
        if b[0] < 77 < a[0]:
            continue
        text = a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3]
        assert table[a[0]].edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and table[a[0]].n_chars == len(a[1])
    assert table[None].near_edited >= 0 and table[501].n_chars == 0
    top = "none at all"[:8] + ""[:3]
    assert table[None].edited_sha256 == hashlib.sha256(top.encode()).hexdigest()
    one = w.with_next(docs.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert w.with_next(docs.filter("doc_id = -1")).count() == 0
