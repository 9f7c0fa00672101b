import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambling.llm import hard_negatives as hn
from brambling.llm import queries
from tests.oracle import connection, difference

KIND = "vec_id long, label int, embedding array<float>"


def plain(rows, anchor):
    """By scoring every pair."""
    whole = []
    for i, label, v in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, label, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v]))
    out = []
    for i, label, v in whole:
        if not anchor(i):
            continue
        best = lambda keep: sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, other, w in whole if keep(j, other)))  # noqa: B023, E731
        negatives = best(lambda j, other: other != label)  # noqa: B023
        for score, j in best(lambda j, other: other == label and j != i)[:5]:  # noqa: B023
            inside = [(s, k) for s, k in negatives if 80 * -score <= 100 * -s <= 100 * -score]
            out += [(i, j, r + 1, k, -score, -s) for r, (s, k) in enumerate(inside[:5])]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    found = hn.mine(spark.createDataFrame(rows, KIND).withColumns({"no": F.lit("x"), "anchor": F.lit(1), "id": F.lit(2)}), anchor, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_like_all_pairs(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(6)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(900)]
    rows += [(900 + i, i % 3, centres[0]) for i in range(300)]  # one vector for a quarter of all rows
    rows += rows[:20]
    rng.shuffle(rows)
    got = mined(spark, rows, F.col("vec_id") % 25 == 0)
    assert got == plain(rows, lambda i: i % 25 == 0) and len(got) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.9, 0.4]), (3, 2, []), (4, 2, [nan, 1.0]), (5, 2, [inf]), (6, 2, [None, 1.0]), (7, None, [1.0]), (None, 2, [1.0]), (8, 2, None), (9, 1, [-1.0, 0.0]), (10, 2, [0.0, 0.0]), (11, 1, [1e30, -1e30]), (12, 2, [1e30]), (13, 2, [0.85]), (14, -3, [1.0, 0.1, 9.0])]
    assert mined(spark, rows, F.lit(True)) == plain(rows, lambda i: True)
    assert mined(spark, rows, F.lit(None).cast("boolean")) == []
    assert mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(1, 1, []), (2, 1, []), (3, 2, [])], F.lit(True)) == [(1, 2, 1, 3, 0, 0), (2, 1, 1, 3, 0, 0)]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    codes, anchors = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (7, 16))
    cells = hn.Cells.fitted(codes[:100], codes.min(0), codes.max(0))
    where = cells.of(codes)
    low, high = hn.bounds(where, *hn.tables(anchors, cells))
    exact = codes @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.2 * exact.std() * 4
    scored = []
    before, hn.scores = hn.scores, lambda c, a, rows, at: scored.append(len(rows)) or before(c, a, rows, at)
    try:
        a = hn.Anchors(np.arange(7), np.arange(7) - 10, np.zeros(7, np.int64), anchors, None, None)
        best = hn.Best(7, 5)
        hn.positives_of((np.arange(500), np.zeros(500, np.int64), where, codes), a, cells, best)
    finally:
        hn.scores = before
    assert (np.sort(exact, 0)[-5:][::-1].T == best.score).all()
    assert scored[0] < 0.1 * exact.size


def test_wide_values_use_wide_tables():
    a = np.full((1, 3), 1 << 24)
    cells = hn.Cells.fitted(np.array([[0, 0, 0], [1 << 24, 5, -(1 << 24)]]), np.array([0, 0, -(1 << 24)]), np.array([1 << 24, 5, 0]))
    low, high = hn.tables(a, cells)
    assert low.dtype == np.int64 and high.max() >= 1 << 48


@pytest.mark.parametrize("n", [2, 7])
def test_same_as_sql(spark, n):
    where = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        assert difference(spark, queries.op12_hard_negatives, queries.OP12_SQL, where, connection(where)) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
