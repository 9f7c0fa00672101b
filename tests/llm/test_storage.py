from brambling.llm import exact_dedup, storage


def test_clear(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (2, "a" * 300)], "doc_id long, text string")
    assert exact_dedup.digest_repeats(docs).count() == 2
    storage.written(docs, "some")
    assert storage.clear(spark, older_than_seconds=3_600) == 0
    assert [t for t in spark.catalog.listTables() if t.name.startswith("brambling_texts_")]
    assert storage.clear(spark) >= 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("brambling_texts_")]
    assert storage.written(docs, "again").count() == 2
