import random
import zlib

import pytest
from pyspark.sql import functions as F

from brambling.llm import merkle, queries
from tests.oracle import connection, difference

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def fold(at, path):
    for t in path:
        at = merkle.digest(t[1:] + at if t[0] == "<" else at + t[1:] if t[0] == ">" else at)
    return at


def levels(row):
    out = [row]
    while len(row) > 1:
        row = [merkle.digest("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
        out.append(row)
    return out


def siblings(tree, i):
    return [row[i >> h ^ 1] for h, row in enumerate(tree[:-1]) if i >> h ^ 1 < len(row)]


def plain(rows):
    """What op11 returns, from whole trees in memory."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: merkle.digest("".join(map(said, (d, s, g, n, t))))
    groups = {}
    for d, t, g, s, n in rows:
        tampered = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(g, []).append((d, leaf(d, s, g, n, t), leaf(d, s, g, n + 1, t) if tampered else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(levels([r[1] for r in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (d, own, changed) in enumerate(groups[g]):
            proof = siblings(trees[k], i) + siblings(top, k)
            at = changed or own
            for tree, j in ((trees[k], i), (top, k)):
                for h, row in enumerate(tree[:-1]):
                    other = row[j >> h ^ 1] if j >> h ^ 1 < len(row) else ""
                    at = merkle.digest(other + at if j >> h & 1 else at + other)
            out.append((d, own, trees[k][-1][0], top[-1][0], merkle.digest("".join(proof)), at, at == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21, 255, 256])
def test_traversal(n):
    leaves = [merkle.digest(str(i)) for i in range(n)]
    for height in {(n - 1).bit_length(), 8}:
        paths = list(merkle.traverse(leaves, height))
        assert len(paths) == n and {fold(x, p) for x, p in zip(leaves, paths)} == {merkle.root_of(leaves, height)}


def test_stacks_stay_small():
    leaves = [merkle.digest(str(i)) for i in range(256)]
    most, step = 0, merkle.Treehash.step

    def counted(self, x):
        nonlocal most
        step(self, x)
        most = max(most, len(self.nodes))

    merkle.Treehash.step = counted
    try:
        assert sum(1 for _ in merkle.traverse(leaves, 8)) == 256
    finally:
        merkle.Treehash.step = step
    assert most <= 9


def test_like_whole_trees(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "straße", "x" * 50_000, None, "a:b"]), rng.choice(["en", "en", "en", "de", "é", None, ""]), rng.choice(["web", None]), rng.choice([3, 2**63 - 1, None])) for i in range(700)]
    rows += rows[:40] + [(None, "t", "en", None, 1)] * 3 + [(9, "other", "en", "web", 2), (1, None, "zz", None, None)]
    docs = spark.createDataFrame(rows, KIND)
    found = merkle.document_proofs(docs.withColumns({"grp": F.lit(1), "index": F.lit(2), "leaf": F.lit("x")}), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


@pytest.mark.parametrize("sizes", [[75], [1, 4, 17, 1, 1, 3]])
def test_several_tiers(spark, sizes):
    leaves = [merkle.digest(str(i)) for i in range(75)]
    rows = [(f"g{g}", i, leaves[i], (i,)) for g, n in enumerate(sizes) for i in range(n)]
    made = merkle.build(spark.createDataFrame(rows, "grp string, ord int, leaf string, row struct<i:int>"), levels=2)
    roots = {r.grp: (r.n_leaves, r.subroot) for r in made.groups.collect()}
    assert roots == {f"g{g}": (n, levels(leaves[:n])[-1][0]) for g, n in enumerate(sizes)}
    root, found = made.root(), made.proofs.collect()
    assert root == levels([roots[g][1] for g in sorted(roots)])[-1][0]
    assert len(found) == sum(sizes) and all(fold(r.node, r.path) == root and r.node == leaves[r["index"]] and r.row.i == r["index"] for r in found)


def test_manifest_and_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle.document_proofs(empty, F.lit(False)).count() == 0
    kind = "grp string, ord int, leaf string, row struct<i:int>"
    assert merkle.build(spark.createDataFrame([], kind)).root() is None
    one = merkle.build(spark.createDataFrame([("g", 1, "ab", (7,))], kind))
    assert one.root() == "ab" and [tuple(r) for r in one.groups.collect()] == [("g", 1, "ab", "ab")]
    assert [(r.path, r.node, r.row.i) for r in one.proofs.collect()] == [([], "ab", 7)]


def test_same_as_sql(spark):
    where = "/root/testdata/sf0.001"
    assert difference(spark, queries.op11_merkle, queries.OP11_SQL, where, connection(where)) == ""
