from brambling.llm import chat


def test_maximal(spark):
    rows = [
        (1, 0, "user", "hi", 0), (2, 0, "user", "hi", 0), (2, 1, "bot", "yes", 0),
        (3, 0, "user", "hi", 0), (3, 1, "bot", "yes", 0), (4, 0, "user", "hi", 0), (4, 1, "bot", "no", 0),
        (5, 0, None, None, 0), (6, 0, "us", "erhi", 0), (7, 1, "b", "2", 0), (7, 0, "a", "1", 0), (None, 0, "z", "z", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, prefixes int")
    out = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(chat.maximal_conversations(df)).collect()}
    assert set(out) == {2, 4, 5, 6, 7, None}
    assert out[2] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>\n")
    assert out[7][2].index("1") < out[7][2].index("2")
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_null_ids_and_long_conversations(spark):
    rows = [(None, 0, "user", f"q{i % 40}") for i in range(400)] + [(1, 0, "user", "q1"), (1, 1, "bot", "a")]
    rows += [(c, k, "user", f"turn {k}") for c, n in ((7, 20_000), (8, 19_999), (9, 20_000)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS digest", "3 AS whole")
    out = chat.render(chat.maximal_conversations(df)).collect()
    assert sorted((r.conv_id, r.n_turns, r.n_copies) for r in out if r.conv_id is not None) == [(1, 2, 1), (7, 20_000, 2)]
    assert sorted((r.rendered, r.n_copies) for r in out if r.conv_id is None) == sorted((f"<|im_start|>user\nq{i}<|im_end|>\n", 10) for i in range(40) if i != 1)
