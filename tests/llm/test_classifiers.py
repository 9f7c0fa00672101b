import random
import weakref
import zlib

import numpy as np
import pytest

from brambling.llm import labelled, quality, toxicity

BAD = ["zorkly", "blegh", "vonks"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.8)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        text = " ".join(w + ("" if good else "***") for w in words)
        rows.append((i, text, rng.choice(["x", "y"]), good, toxic))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [(1000, None, None), (1001, "", "x"), (None, "plain words", "x"), (5, "plain words", "x")], "doc_id long, text string, lang string").selectExpr("*", "0.5D AS score")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(1001, None, None), (99_999, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_folds(spark):
    ids = [(i,) for i in range(50)] + [(None,)]
    got = spark.createDataFrame(ids, "i long").select("i", labelled.held_out(labelled.F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 5 == 0) for r in got)


def test_toxicity(frames):
    rows, docs, labels = frames
    net, thresholds = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, net).collect()}
    held = [r for r in rows if got[r[0]].held_out and r[0] != 5]
    right = np.mean([(got[r[0]].score >= 0.5) == (r[4] == 1) for r in held])
    assert len(held) > 30 and right > 0.93
    assert got[1000].score == got[1001].score < 0.5 and got[None].held_out is False
    kept = toxicity.reject_toxic(docs, net, thresholds)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1000").count() == 1
    assert kept.count() < docs.count()


def test_quality(frames):
    rows, docs, labels = frames
    net = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, net).collect()}
    held = [r for r in rows if got[r[0]].held_out and r[0] != 5]
    assert np.mean([(got[r[0]].score >= 0.3) == (r[3] == 1) for r in held]) > 0.93
    assert got[1000].score == got[1001].score


def test_nothing_to_learn(frames):
    _, docs, labels = frames
    for module in (toxicity, quality):
        net = module.train(docs, labels.limit(0))
        net = net[0] if isinstance(net, tuple) else net
        out = module.score_documents(docs, net).collect()
        assert len(out) == docs.count() and len({r.score for r in out}) == 1
        assert module.score_documents(docs.limit(0), net).count() == 0


def test_gradient():
    rng = np.random.default_rng(3)
    used = np.zeros(1 << toxicity.SPACE_BITS, bool)
    texts = [b"one two three four", b"five six", b""]
    for t in texts:
        used[np.unique(toxicity.features([t])[0])] = True
    used[0] = False
    net = toxicity.TextCnn(used)
    y, weight = np.array([1.0, 0.0, 0.0]), np.ones(3)
    grads = []

    class Spy:
        def step(self, g):
            grads.extend(g)

    net.b += rng.normal(0, 0.5, net.b.shape).astype(np.float32)
    net.e, net.w, net.v, net.b, net.c = net.e.astype(np.float64), [w.astype(np.float64) for w in net.w], net.v.astype(np.float64), net.b.astype(np.float64), net.c.astype(np.float64)
    net._step(Spy(), [toxicity.features([t])[0] for t in texts], y, weight)

    def loss():
        z = net.logits(texts)
        return np.mean(np.logaddexp(0, z) - y * z)

    for p, g in ((net.v, grads[5]), (net.b, grads[4]), (net.w[1], grads[2] - toxicity.DECAY * net.w[1])):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for k in rng.choice(len(flat), 5, replace=False):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - gf[k]) < 1e-4


def test_many_texts_are_one_by_one():
    texts = [r[1].encode() for r in corpus(40, 5)] + [b"", b"  ", b"!!!"]
    assert np.allclose(quality.features(texts), np.concatenate([quality.features([t]) for t in texts]))
    used = np.ones(1 << toxicity.SPACE_BITS, bool)
    used[0] = False
    net = toxicity.TextCnn(used)
    assert np.allclose(net.scores(texts), np.concatenate([net.scores([t]) for t in texts]), atol=1e-5)


def test_labels_count_once(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(30)] * 5 + [(i, 0) for i in range(20, 50)] + [(None, 1), (60, None), (61, 7)], "doc_id long, toxic int")
    got = {r.doc_id: r.y for r in labelled.learning_rows(labels, "toxic", 100).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert got == {i: int(i < 20) for i in [*range(20), *range(30, 50)] if not fold(i)}
    assert labelled.learning_rows(labels, "toxic", 3).count() == 6


def test_learning_texts_are_bounded(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:10]
    docs = spark.createDataFrame([(i, f"{i} {k} " + "word " * 20, "x") for i in ids for k in range(50)] + [(ids[0], None, None), (ids[1], "x" * 5_000_000, "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 400, "doc_id long, toxic int")
    rows = labelled.texts_of(docs, labelled.learning_rows(labels, "toxic", 100), 1_000_000, "doc_id", "text", "lang")
    assert len(rows) in (9, 10) and all(len(r[1]) < 200 and len(r) == 3 for r in rows)
    few = labelled.texts_of(docs, labelled.learning_rows(labels, "toxic", 100), 250, "doc_id", "text")
    assert 2 <= len(few) <= 6 and all(sum(len(r[1]) for r in few if r[0] == y) <= 250 for y in (0, 1))


@pytest.mark.parametrize("name, module, limit, scale", [("quality", quality, 0.3, 0.01), ("toxic", toxicity, 0.5, 0.1)])
def test_held_out_documents(spark, name, module, limit, scale):
    """Held-out accuracy on the tables themselves (the small ones have six toxic documents), with columns whose names clash."""
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet").selectExpr("*", "1 AS row", "2 AS score", "3 AS x", "4 AS data", "5 AS id", "6 AS y")
    labels = spark.read.parquet(f"/root/testdata/sf{scale}/labels.parquet")
    net = module.train(docs, labels)
    net = net[0] if isinstance(net, tuple) else net
    got = {r.doc_id: r for r in module.score_documents(docs, net).collect()}
    rows = [(got[r.doc_id].score, r[name]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r[name] is not None]
    ones, zeros = (np.array([s for s, y in rows if y == v]) for v in (1, 0))
    assert len(rows) > 40 and (ones[:, None] > zeros).mean() >= 0.98, ((ones[:, None] > zeros).mean(), len(rows))
    assert np.mean([(s >= limit) == (y == 1) for s, y in rows]) >= 0.95


def test_quality_does_not_depend_on_partitions(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    found = []
    for n in (2, 7, 32):
        rows = quality.written(quality.surface(docs.repartition(n)), "surface")
        net = quality.fit(rows, labels)
        found.append({r.doc_id: r.score for r in quality.score_surface(rows, net).collect()})
        assert max(abs(quality.POINT * x * x).max() for x in [quality._matrix(quality.pa.array([r.x for r in rows.select("x").collect()]))]) < 2**44
    assert found[0] == found[1] == found[2]


def test_quality_shards_like_a_plain_loop(spark):
    """One round by hand: every shard in the order of its hash, averaged by rows."""
    where = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = quality.written(quality.surface(docs), "surface")
    dealt = quality._dealt(rows, "doc_id", rows.count())
    shards = {}
    for r in dealt.collect():
        shards.setdefault(r.shard, []).append(r.x)
    net = quality.PuNet(np.zeros(len(r.x)), np.ones(len(r.x)), 0.5)
    positive = net.scaled(np.array([x for xs in shards.values() for x in xs][:30]))
    total = quality._summed(dealt, ["shard", "x"], quality._round(net, positive, 0))
    want = np.zeros(len(net.parameters()))
    for shard, xs in shards.items():
        own = net.with_parameters(net.parameters())
        own.learn(labelled.Adam([own.w, own.b, own.v, own.c], quality.RATE), positive, net.scaled(np.array(xs, np.float64)), quality.STEPS, np.random.default_rng([0, shard]))
        want += own.parameters() * len(xs)
    assert total[-1] == rows.count() and np.allclose(total[:-1] / quality.POINT, want, atol=1e-4)


def test_training_keeps_no_texts(spark, monkeypatch):
    """The driver gives their memory back, after nothing holds them any more."""

    class Rows(list):
        pass

    def texts_of(*_):
        rows = Rows((y, f"{'good bad'.split()[y]} words {i % 7}".encode(), "en") for i in range(60) for y in (0, 1))
        held.append(weakref.ref(rows))
        return rows

    held, alive = [], []
    monkeypatch.setattr(toxicity.labelled, "texts_of", texts_of)
    monkeypatch.setattr(toxicity, "give_back", lambda: alive.append(held[0]() is not None))
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    net, _ = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert alive == [False]
    assert net.scores([b"bad words 1"])[0] > 0.5 > net.scores([b"good words 1"])[0]
