"""A training corpus from ``documents``: toxic rows, near duplicates, repeated passages and benchmark leaks go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as Parquet
into the shared folder and reads it again. Null texts count as empty; rows with a null or repeated id pass like any other
(a near copy goes only for another row of its group, which has the smaller id; null is the largest).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.llm import bpe, decontam, exact_dedup, simhash, toxicity
from brambling.llm.storage import MADE, drop_unread, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage before.
_left: list[str] = []


def tidied(stage: Stage) -> Stage:
    """``stage``, which first deletes the intermediate tables of the stage before, whose result is written by now, but for those that ``docs`` still reads."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(spark, _left, docs)
        _left.clear()
        before = len(MADE)
        found = stage(spark, docs, sf_dir)
        _left.extend(MADE[before:])
        return found

    return run_stage


@tidied
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the toxicity threshold of their language go."""
    net, thresholds = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, net, thresholds)


@tidied
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


@tidied
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of the texts; n_chars follows."""
    return exact_dedup.remove_repeats(docs, width=200).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


@tidied
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


@tidied
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(docs, path, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontaminate", drop_leaks), ("bpe", encode)]
#: SQL cannot express the trained classifier; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
