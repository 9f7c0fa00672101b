import hashlib

import corpus_pipeline
from brambling.llm import bpe, decontam, exact_dedup, simhash, toxicity
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_exact_dedup import brute_flags

DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    net, limits = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    want = {i: r.text for i, r in rows.items() if net.scores([r.text.encode()])[0] < limits.get(r.lang, 0.5)}

    mark = {i: (t.lower().split(), 5) for i, t in want.items()}
    mark = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else {()} for i, (w, n) in mark.items()}

    def near(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    root = {i: i for i in want}
    for i in sorted(want):
        for j in sorted(want):
            if i < j and near(mark[i], mark[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    want = {i: t for i, t in want.items() if root[i] == i}

    ids = sorted(want)
    for i, data, flags in zip(ids, [want[i].encode() for i in ids], brute_flags([want[i].encode() for i in ids], 200)):
        gone = bytearray(len(data))
        for k, f in enumerate(flags):
            if f:
                gone[k : k + 200] = b"\1" * 200
        want[i] = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in leaks(list(want.items()), items, 10) if not hit}
    want = {i: t for i, t in want.items() if i in clean}

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, DIR)
        assert out.columns == columns, name
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    coder = bpe.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert {i: list(r.ids) for i, r in last.items()} == {i: coder.encode(t).tolist() for i, t in want.items()}
    assert all(hashlib.sha256(r.decoded.encode()).digest() and r.n_tokens == len(r.ids) for r in last.values())


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
