import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambling.llm import pii, queries

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, s):
    d = [int(c) for c in s if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == 0 or 9 <= len(d) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.ASCII) if holds(k, m[0]))


CARD, PHONE = "4539578763621486", "+1 (509) 555-6973"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: rng.choice("the of and ander ouver cióna thent lyon weisst".split())

    def datum(kind):
        if kind == 0:
            return f"{word()}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com".encode("ascii", "ignore").decode()
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 2:
            d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
            return next(d + c for c in "0123456789" if pii.luhn(d + c))
        return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"

    out = []
    for i in range(1200):
        text = " ".join(word() for _ in range(rng.randrange(5, 40)))
        for kind in range(4):
            if rng.random() < 0.5:
                text += f" {datum(kind)} " + " ".join(word() for _ in range(rng.randrange(12, 20)))
        if rng.random() < 0.3:
            text += f' key = "{rng.getrandbits(160):040x}" {word()} {rng.randrange(100)} {word()}'
        out.append((i, text))
    return out


@pytest.fixture(scope="module")
def net(rows):
    windows = [(w, s) for i, t in rows if i % 5 for base in [pii.base_spans(t)] for at, near in pii.stretches(t) for _, w, s in pii.candidates(near, [(a - at, k, e - at) for a, k, e in base if a >= at and e <= at + len(near)])]
    return pii.train(windows[:1500])


def test_base_spans_are_leftmost_matches():
    rng = random.Random(1)
    for n in range(4000):
        text = "".join(rng.choice(["a", "é", "@", "@", ".", "1", "23", "256", "+", " ", "-", "(", "_", CARD, PHONE, "a@b.c"]) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_read_once():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 150_000, "+1" + " " * 300_000):
        assert isinstance(pii.base_spans(text), list)


def test_gradient():
    rng = np.random.default_rng(0)
    net = pii.Net(1, units=3)
    net.p = [p.astype(np.float64) for p in net.p]
    net.p[-1] = rng.standard_normal(net.p[-1].shape)
    chars, want = rng.integers(0, pii.LETTERS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, gradient = net.loss(chars, want)
    for p, g in zip(net.p, gradient):
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p.shape)
            i = (int(chars[0, 0]), i[1]) if p is net.p[0] else i
            old, ends = p[i], []
            for step in (1e-5, -1e-5):
                p[i] = old + step
                ends.append(net.loss(chars, want)[0])
            p[i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[i]) < 1e-6


def test_viterbi_is_the_best_allowed_path():
    import itertools

    net = pii.Net(2, units=2)
    net.p[-1] = np.random.default_rng(3).standard_normal(net.p[-1].shape).astype(np.float32)
    chars = np.random.default_rng(4).integers(0, pii.LETTERS, (3, 4))
    found, _ = net.decode(chars)
    score = net.emissions(chars)
    for row, got in zip(score, found):
        paths = [p for p in itertools.product(range(pii.TAGS), repeat=4) if pii.STARTS[p[0]] and all(pii.ALLOWED[a, b] for a, b in zip(p, p[1:]))]
        best = max(paths, key=lambda p: sum(row[t, k] for t, k in enumerate(p)) + sum(net.p[-1][a, b] for a, b in zip(p, p[1:])))
        assert tuple(got) == best


def test_finds_what_the_rules_miss(net, rows):
    held = [t for i, t in rows if i % 5 == 0]
    want = [pii.base_spans(t) for t in held]
    got = [[(s + at, k, e + at) for (at, near), own in zip(pii.stretches(t), pii.tagged(net, [x for _, x in pii.stretches(t)])) for s, k, e in own] for t in held]
    hits = sum(len(set(a) & set(b)) for a, b in zip(want, got))
    assert hits / sum(map(len, want)) > 0.97 and hits / sum(map(len, got)) > 0.97
    text = f"the of ander {PHONE} 190.137.223.204 and thent 555 {CARD} the of"
    assert [k for _, k, _ in pii.base_spans(text)] == [1]
    near = pii.stretches(text)
    more = pii.added(pii.base_spans(text), [(s + at, k, e + at) for (at, x), own in zip(near, pii.tagged(net, [x for _, x in near])) for s, k, e in own])
    assert [text[s:e] for s, _, e in more] == [PHONE, CARD]


def test_windows_agree_wherever_they_are(net, rows):
    """A long stretch: every card in it is found once, whole, whichever windows it falls into."""
    text = " und ".join([CARD] * 120)
    assert len(pii.stretches(text)) == 1
    found = pii.tagged(net, [text])[0]
    assert found == [(i * 21, 2, i * 21 + 16) for i in range(120)]
    assert pii.tagged(net, ["a 1", text, "b@c.de"])[1] == found


def test_find_and_redact(spark, rows):
    odd = [(None, None), (7, ""), (7, "no data"), (8, "1" * 200_000), (9, "x@y.zz " * 20_000), (10, f"😀 é {CARD}".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"id": F.lit(1), "base": F.lit("x"), "near": F.lit(2), "kind": F.lit(None).cast("int")})
    found = pii.find(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows[20:] + odd[4:]:
        if i not in (7, 8, 9, 10):
            assert [tuple(x) for x in got[i][0].base] == [tuple(x) for x in ((s, k, e) for s, k, e in plain(t))]
    assert {(r.doc_id, len(r.base)) for r in got[None]} == {(None, 0)}
    assert sorted(len(r.base) for r in got[9]) == sorted([20_000, len(plain(rows[9][1]))])
    assert any([tuple(x) for x in r.base] == [(4, 2, 20)] for r in got[10])
    plain_net = pii.train(pii.learning_windows(pii.scanned(docs)), steps=3)
    clean = pii.redact(docs, plain_net)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r.text for r in clean.filter("text LIKE '%[card]'").collect()} >= {"\U0001f600 é [card]"}


def test_nothing_to_learn(spark):
    for data in ([], [(1, "plain words"), (2, None)]):
        found = pii.find(spark.createDataFrame(data, "doc_id long, text string"))
        assert [(len(r.base), len(r.more)) for r in found.collect()] == [(0, 0)] * len(data)


def test_query_keeps_the_base(spark):
    import hashlib

    where = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    out = queries.op13_pii(spark, where).collect()
    assert len(out) == len(texts)
    for r in out:
        base = plain(texts[r.doc_id])
        said = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(said) <= set(r.spans.split(",")) | {""}
