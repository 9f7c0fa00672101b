"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.llm import bpe, chat, decontam, exact_dedup, extract, hard_negatives, merkle, pii, quality, simhash, toxicity, warc, weighted_sampling
from brambling.llm.storage import new_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.with_next(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.surface(table(spark, sf_dir, "documents")), "surface")
    found = quality.score_surface(rows, quality.fit(rows, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest_repeats(table(spark, sf_dir, "documents"), width=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = decontam.words_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("longest", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.capture_history(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, _ = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, net).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id, count(*) OVER (PARTITION BY h) AS n FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m
"""


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal_conversations(table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH numbered AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
), t AS (
  SELECT conv_id, own, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM numbered
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id, own) AS n_turns FROM t
), p AS (
  SELECT conv_id, k, n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
      OVER (PARTITION BY conv_id, own ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said,
    string_agg(length(role)::VARCHAR || ':' || role || chr(31) || length(text)::VARCHAR || ':' || text, chr(30))
      OVER (PARTITION BY conv_id, own ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM n
), whole AS (
  SELECT path, min(conv_id) AS conv_id, count(*) AS n_copies, min(said) AS said, min(n_turns) AS n_turns FROM p WHERE k = n_turns GROUP BY path
)
SELECT conv_id, n_turns, n_copies, said AS rendered FROM whole
WHERE path NOT IN (SELECT path FROM p WHERE k < n_turns)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_proofs(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), d AS (
  SELECT doc_id, lang, n_chars, source, text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
), f AS (
  SELECT doc_id, lang, n_chars IS NOT NULL AND coalesce(tampered, false) AS changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), l AS (
  SELECT doc_id, lang, sha256(head || own || tail) AS leaf, CASE WHEN changed THEN sha256(head || more || tail) ELSE sha256(head || own || tail) END AS held FROM f
), n AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l
), tree AS (
  SELECT lang, 0 AS lev, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM n
  UNION ALL
  SELECT lang, any_value(lev) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, idx // 2
), sub AS (
  SELECT lang, h, lev AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM tree WHERE n = 1
), head AS (
  SELECT 0 AS lev, idx, h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT any_value(lev) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM head WHERE n > 1 GROUP BY idx // 2
), nodes AS (
  SELECT t.lang, t.lev, t.idx, t.h, t.n FROM tree t WHERE t.n > 1
  UNION ALL
  SELECT s.lang, s.top + e.lev, e.idx, e.h, e.n FROM sub s, head e WHERE e.n > 1
), walk AS (
  SELECT n.doc_id, n.lang, n.idx AS leaf_idx, n.leaf, s.idx AS sub_idx, s.top, 0 AS lev, n.held AS node, '' AS said FROM n JOIN sub s ON n.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf_idx, w.leaf, w.sub_idx, w.top, w.lev + 1,
    sha256(CASE WHEN p.here % 2 = 1 THEN coalesce(p.h, '') || w.node ELSE w.node || coalesce(p.h, '') END), w.said || coalesce(p.h, '')
  FROM walk w JOIN (
    SELECT o.lang, o.lev, o.idx AS here, x.h FROM nodes o LEFT JOIN nodes x ON o.lang IS NOT DISTINCT FROM x.lang AND o.lev = x.lev AND x.idx = xor(o.idx, 1)
  ) p ON w.lang IS NOT DISTINCT FROM p.lang AND w.lev = p.lev AND p.here = CASE WHEN w.lev < w.top THEN w.leaf_idx >> w.lev ELSE w.sub_idx >> (w.lev - w.top) END
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(said) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM walk w JOIN sub s ON w.lang IS NOT DISTINCT FROM s.lang, (SELECT lev, h FROM head WHERE n = 1) r
WHERE w.lev = w.top + r.lev
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=changed)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "more")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_weighted_sampling": op2_weighted_sampling, "op3_quality": op3_quality, "op4_simhash": op4_simhash, "op5_suffix_dedup": op5_suffix_dedup, "op6_decontaminate": op6_decontaminate, "op7_warc": op7_warc, "op8_extract": op8_extract, "op9_toxicity": op9_toxicity, "op10_chat": op10_chat, "op11_merkle": op11_merkle, "op12_hard_negatives": op12_hard_negatives, "op13_pii": op13_pii}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op10_chat": OP10_SQL, "op11_merkle": OP11_SQL, "op12_hard_negatives": OP12_SQL}
