import random

from brambling.operators.documents import longest_common, merge_rewritten, merged


def plain_common(a, b, least, most):
    for n in range(min(most, len(a), len(b)), least - 1, -1):
        for i in range(len(a) - n + 1):
            if (j := b.find(a[i : i + n])) >= 0:
                return n, i, j
    return 0, 0, 0


def plain(chunks, overlap, least, most, widest=1_000):
    if len(chunks) < 2:
        return chunks[0] if chunks else ""
    out = chunks[0]
    for c in chunks[1:]:
        w = min(2 * overlap, len(out), widest)
        n, at, to = plain_common(out[-w:], c[:w], least, most) if w else (0, 0, 0)
        out = out[: len(out) - w + at] + c[to:] if n else out.rstrip() + "\n\n" + c.lstrip()
    return out.strip()


def test_longest_common():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(2))
        least = rng.randrange(1, 4)
        assert longest_common(a, b, least, 6) == plain_common(a, b, least, 6)


def test_like_the_plain_fold():
    rng = random.Random(2)
    for _ in range(3000):
        chunks = ["".join(rng.choice("ab  \n") for _ in range(rng.choice([0, 1, 3, 9, 30]))) for _ in range(rng.randrange(6))]
        overlap, widest = rng.choice([0, 2, 5]), rng.choice([6, 1000])
        assert merged(chunks, overlap, 2, 5, widest) == plain(chunks, overlap, 2, 5, widest), (chunks, overlap, widest)


def test_rewritten_edges_are_mended(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(30_000)).strip()
    cut = [text[i : i + 1300] for i in range(0, 30_000 - 300, 1000)]
    changed = [("XX" if i else "") + c[2 if i else 0 : len(c) - 3 if i + 1 < len(cut) else None] + ("YYY" if i + 1 < len(cut) else "") for i, c in enumerate(cut)]
    rows = [(1, i, c) for i, c in enumerate(changed)] + [(2, 0, " one "), (3, 0, None), (3, 1, "two"), (None, 1, "x")]
    rng.shuffle(rows)
    found = dict(map(tuple, merge_rewritten(spark.createDataFrame(rows, "d int, n int, c string"), "d", "n", "c", 300).collect()))
    assert found == {1: text, 2: " one ", 3: "two", None: "x"}


def test_long_documents_in_linear_time():
    chunk = "".join(chr(97 + i * 7 % 26) for i in range(1040))
    assert len(merged([chunk + str(i) for i in range(5_000)], 40, 20, 100)) > 1_000_000
