import random

import numpy as np
import pytest
import xxhash

from brambling.llm import simhash


def plain(text: str, shingle=4) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 254, 258, 259, 700):
        text = " ".join(rng.choice(["a", "B", "cc", "dÉ", "E\t"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("tile, frontier", [(65_536, 1 << 17), (4, 50), (2, 1 << 17)])
def test_components(spark, monkeypatch, tile, frontier):
    monkeypatch.setattr(simhash, "SUBTREE", tile)
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(1)
    values = {0, 1, 2**64 - 1}
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64).tolist() + [12345] * 3:
        for _ in range(10):
            x = base
            for k in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(k)
            values.add(x)
    fp = sorted(values, key=signed)
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame([(signed(x),) for x in fp], "fp long"))).collect()}
    assert [got.get(signed(x), signed(x)) for x in fp] == [signed(fp[find(i)]) for i in range(len(fp))]


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(simhash, "written", lambda df, what, write=simhash.written: tables.append(what) or write(df, what))
    for links, roots, rounds in (
        ([], {}, 0),
        ([(3, 3)], {}, 0),
        ([(2, 1), (4, 3), (3, 4), (1, 5)], {2: 1, 5: 1, 4: 3}, 0),
        ([(1, 2), (2, 3)], {2: 1, 3: 1}, 1),
        ([(1, 3), (2, 3)], {2: 1, 3: 1}, 1),
        ([(-1, 2), (2, 0), (7, 8)], {2: -1, 0: -1, 8: 7}, 1),
    ):
        tables.clear()
        found = simhash.components(spark.createDataFrame(links, "src long, dst long"))
        assert {r.node: r.root for r in found.collect()} == roots
        assert len(tables) == 1 + rounds


def test_documents(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, 0), (3, text.upper(), 0), (9, None, 0), (7, " \n", 0), (7, " \n", 0), (8, "quite another text here", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a: str, b: str, shingle=5) -> float:
    x, y = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_views_bring_near_bits_together():
    rng = random.Random(3)
    for width, budget, n in ((64, 4, 10), (64, 4, 1 << 33), (24, 2, 10**5), (40, 3, 10**10)):
        depth, views = simhash._views(width, budget, n)
        assert all(sorted(v) == sorted(views[0]) and sum(w for _, w in v) == width for v in views)
        for _ in range(200):
            off = set(rng.sample(range(width), budget))
            assert any(not off & {b for first, bits in v for b in range(first, first + bits)} for v in [_front(v, depth) for v in views])


def _front(view, depth):
    out, at = [], 0
    for first, bits in view:
        if at < depth:
            out.append((first, min(bits, depth - at)))
            at += bits
    return out


def test_large_leaves_keep_all_links():
    rng = np.random.default_rng(5)
    value = rng.integers(0, 400, 300)
    near = lambda i, j: (abs(value[i] - value[j]) <= 1) * 2
    for pairs, both in (([[0, 300, 0, 300]], False), ([[0, 120, 120, 300]], True), ([[i, i + 30, j, j + 30] for i in range(0, 300, 30) for j in range(i, 300, 30)], False)):
        forest = simhash.Forest(300)
        simhash._leaves(np.array(pairs), near, forest)
        forest.fold()
        parent = list(range(300))
        for i in range(300):
            for j in range(i):
                if near(i, j) and not (both and (i < 120) == (j < 120)):
                    a, b = i, j
                    while parent[a] != a:
                        a = parent[a]
                    while parent[b] != b:
                        b = parent[b]
                    parent[max(a, b)] = min(a, b)
        root = []
        for i in range(300):
            while parent[i] != i:
                i = parent[i]
            root.append(i)
        assert forest.root.tolist() == root


def test_near_copies_are_found_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 40)  # subtrees are cut into tiles
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    texts, wanted = [], []
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for share in (0.8, 0.85, 0.9, 0.5, 0.6):
            other = list(base)
            while jaccard(" ".join(other), texts[-1]) > share + 0.01:
                k = rng.randrange(len(other))
                other = other[:k] + [rng.choice(vocabulary) for _ in range(3)] + other[k + rng.randint(1, 4) :]
            wanted.append((jaccard(" ".join(other), " ".join(base)) >= 0.8, share <= 0.6, len(texts), " ".join(other)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1_000 + i, w[3]) for i, w in enumerate(wanted)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(1_000 + i in kept or jaccard(w[3], texts[i // 5]) >= 0.75 for i, w in enumerate(wanted))
    near = [1_000 + i not in kept for i, w in enumerate(wanted) if w[0]]
    far = [1_000 + i in kept for i, w in enumerate(wanted) if w[1]]
    assert len(near) > 250 and sum(near) >= 0.9 * len(near), sum(near) / len(near)
    assert len(far) > 250 and sum(far) >= 0.99 * len(far), sum(far) / len(far)
    assert set(range(len(texts))) <= kept


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)) for _ in range(7)]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 2), (4, texts[2], 3), (4, texts[3], 4), (4, texts[3], 4), (3, texts[3].upper(), 5), (6, texts[4], 6), (None, texts[4], 7), (7, texts[5], 8), (7, texts[6], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.mark for r in out.collect()) == [1, 2, 3, 5, 6, 8, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    # Of texts that share an id in one component the choice does not depend on the partitions.
    near = spark.createDataFrame([(1, texts[0], 1), (1, texts[0].upper(), 2)], "doc_id long, text string, mark int")
    assert simhash.keep_one(near.repartition(2, "mark")).collect() == simhash.keep_one(near.orderBy("mark", ascending=False).coalesce(1)).collect()


def test_possible_pairs_join_nothing():
    one = lambda *pairs: [np.array(x) for x in zip(*pairs)]
    forest = simhash.Forest(3)
    forest.add(*one((0, 1), (0, 2), (1, 2), (0, 1)), np.ones(4, int))
    assert sorted(map(tuple, forest.links().T)) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]
    forest.add(*one((0, 1)), np.array([2]))
    assert sorted(map(tuple, forest.links().T)) == [(0, 1, 2), (0, 2, 1), (1, 2, 1)]
    forest.add(*one((1, 2)), np.array([3]))
    assert sorted(map(tuple, forest.links().T)) == [(0, 1, 2), (1, 2, 3)]


def test_pairs_of_one_template(spark):
    """Sixty pairs, each a near copy, whose texts all stem from one template and are nearly near copies of each other."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    template = [word() for _ in range(2_000)]
    texts = []
    for _ in range(60):
        own = edited(template, 9)
        texts += [" ".join(edited(own, 18)), " ".join(edited(own, 18))]
    within = [jaccard(texts[i], texts[i + 1]) for i in range(0, 120, 2)]
    across = [jaccard(texts[0], t) for t in texts[2:]]
    assert min(within) > 0.8 and 0.72 < min(across) < max(across) < 0.8
    order = list(range(120))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    wrong = [i for i in kept if i % 2]
    assert len(wrong) <= 6  # of pairs that meet in no band
    assert {i // 2 for i in kept} == set(range(60))


def _template_pairs(rng, pairs: int) -> list[str]:
    """Texts 2 i and 2 i + 1 are near copies; all others are nearly ones, as all stem from one template."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    template = [word() for _ in range(400)]
    texts = []
    for _ in range(pairs):
        own = edited(template, 6)
        texts += [" ".join(edited(own, 3)), " ".join(edited(own, 3))]
    return texts


@pytest.mark.parametrize("tile", [1 << 17, 3_000])
def test_rows_grow_with_a_template_group_not_with_its_square(spark, monkeypatch, tile):
    made = {}

    def counting(df, what, write=simhash.written):
        table = write(df, what)
        made[what] = made.get(what, 0) + table.count()
        return table

    monkeypatch.setattr(simhash, "written", counting)
    monkeypatch.setattr(simhash, "TILE", tile)
    asked = []
    for pairs in (50, 200):
        texts = _template_pairs(random.Random(4), pairs)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        assert len(texts) / 2 * 0.8 < len(set(root)) < len(texts) * 0.6
        made.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
        assert kept == sorted(set(root))
        asked.append((made["links"], made["unsure"]))
    assert all(large <= 6 * max(small, 100) for small, large in zip(*asked)), asked


@pytest.mark.parametrize("second", [0, 25])
def test_met_joins_all_groups_that_link(second):
    rng = np.random.default_rng(7)
    for _ in range(20):
        base = rng.integers(-(1 << 62), 1 << 62, 40)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 62, 40), base)) for _ in range(59)] + [base[:0]]
        group = rng.integers(0, 45, 60)

        def joined(links):
            root = list(range(45))
            for x, y in links:
                a, b = sorted((root[x], root[y]))
                root = [a if r == b else r for r in root]
            return root

        links = []
        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (not second or j < second <= i) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    links.append((group[i], group[j]))
        got = simhash._met(group, np.array([len(s) for s in sets]), np.concatenate(sets), second, 0.8)
        assert len(got) < 60 and joined(got) == joined(links)


def test_pairs_of_busy_rows_become_a_crowd():
    i, j = np.triu_indices(300, 1)
    forest = simhash.Forest(400)
    forest.add(i, j, np.ones(len(i), int))
    forest.fold()
    forest.add(np.array([299, 350]), np.array([350, 351]), np.ones(2, int))
    assert sorted(map(tuple, forest.links().T)) == [(299, 350, 1), (350, 351, 1)]
    inside, cell = forest.crowds()
    assert inside.tolist() == list(range(300)) and len(set(cell)) == 1
