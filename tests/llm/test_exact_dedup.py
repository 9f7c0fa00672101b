import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brambling.llm import exact_dedup as x
from brambling.llm.suffix_sort import Shard


def brute_flags(pieces, width):
    seen = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
    return [[seen[p[i : i + width]] > 1 for i in range(len(p) - width + 1)] for p in pieces]


@pytest.mark.parametrize("held", [1 << 24, 50])
def test_shard(held):
    rng = random.Random(1)
    for trial in range(150):
        width = rng.choice([8, 16, 40])
        alphabet = rng.choice([b"ab", b"a\0b", bytes(range(200)), b"abc d\xc3"])
        pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(1, 12))]
        pieces += [rng.choice([p, p[3:], p[:-2] + b"zz", b"a" * 100, p + p]) for p in pieces]
        shard = Shard(pieces, width)
        twice = shard.duplicated(held)
        for p, first, want in zip(pieces, shard.first, brute_flags(pieces, width)):
            assert twice[first : first + len(want)].tolist() == want, (trial, width, pieces)


def brute(rows, width):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), d, flags in zip(rows, data, brute_flags(data, width)):
        gone = np.zeros(len(d) + 1, bool)
        for k, f in enumerate(flags):
            if f:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group, segment, run, shard", [(2_000, 1 << 21, 1024, 3_000_000), (2, 150, 7, 2_000)])
def test_like_brute_force(spark, monkeypatch, group, segment, run, shard):
    for k, v in {"GROUP": group, "SEGMENT": segment, "RUN": run, "SHARD": shard}.items():
        monkeypatch.setattr(x, k, v)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(50, 120)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(60, "ab" * 90), (61, "x" * 130), (62, "xy" + "x" * 99), (3, rows[3][1]), (None, rows[5][1]), (70, None), (71, ""), (72, "short"), (73, "short"), (74, shared[0] + "\0" * 80), (75, "\0" * 70 + "q")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = x.digest_repeats(docs, width=48).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 48)


def test_remove(spark):
    one, two = "12é345é678é90é" + "the quick brown fox jumps over the lazy dog", "!é" + "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, "k", one), (2, "k", two), (3, None, None)], "doc_id long, k1 string, text string")
    out = x.remove_repeats(docs, width=40)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "12é345é678é90", 2: "!", 3: None}
    assert x.find_repeats(docs.limit(0)).count() == 0
    assert {r.doc_id: r.kept for r in x.find_repeats(docs, width=40).collect()}[3] == b""


def test_wide_strings_and_small_memory(spark, monkeypatch):
    """Values above a byte, and a shard of over ten times what the queues hold in memory."""
    from brambling.llm import suffix_sort

    monkeypatch.setattr(suffix_sort.Shard.duplicated, "__defaults__", (300,))
    spilled = []
    push = suffix_sort.BucketQueue.push
    rng = random.Random(8)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(250, 700))).encode() for _ in range(12)]
    pieces += [pieces[0][20:] + b"a", b"x" + pieces[3], b"ab" * 400]
    monkeypatch.setattr(suffix_sort.BucketQueue, "push", lambda self, *a: (push(self, *a), spilled.append(self.file is not None)))
    for width in (200, 300):
        shard = suffix_sort.Shard(pieces, width)
        assert shard.n > 3_000
        flags = shard.duplicated()
        want = brute_flags(pieces, width)
        for first, piece, w in zip(shard.first.tolist(), pieces, want):
            assert flags[first : first + max(0, len(piece) - width + 1)].tolist() == [bool(x) for x in w][: max(0, len(piece) - width + 1)]
    assert sum(spilled) > len(spilled) / 4
    rows = [(i, p.decode()) for i, p in enumerate(pieces)]
    got = x.digest_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=300).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 300)
    with pytest.raises(ValueError):
        x.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=20)
