"""Text operators over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import checks, numbers, text
from brambling.operators import collections, documents, ranking, scoring
from brambling.plans.registry import Registry
from brambling.sources.tables import spread, table

Q = Registry()


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


LETTER = f"[^{text.LETTERS}]"


@Q.query(f"""
SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 1.0 ELSE length(regexp_replace(s, '{LETTER}', '', 'g')) / length(s) END, 6) AS letters FROM (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g') AS s FROM documents)""")
def letter_ratio(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.round(text.letter_ratio("text"), 6).alias("letters"))


TERMS = {"en": ["the", "of", "and", "for", "with"], "de": ["der", "die", "und", "das", "von"], "fr": ["le", "la", "des", "et", "pour"], "es": ["el", "los", "que", "las", "por"]}


@Q.query("""
WITH w AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS t FROM documents), s AS (SELECT doc_id,
""" + ", ".join("round(0.7 * (" + " + ".join(f"CASE WHEN contains(t, ' {w} ') THEN 1 ELSE 0 END" for w in ws) + f") / {len(ws)}, 6) AS {k}" for k, ws in TERMS.items()) + """ FROM w)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) <= 0 THEN NULL WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS language, greatest(en, de, fr, es) AS score FROM s""")
def language(spark: SparkSession, d: str) -> DataFrame:
    words = docs(spark, d).select("doc_id", text.padded_words("text").alias("words"))
    scores = words.select("doc_id", *[F.round(text.term_score("words", ws, padded="words"), 6).alias(k) for k, ws in TERMS.items()])
    columns = {k: F.col(k) for k in TERMS}
    return scores.select("doc_id", text.best_label(columns).alias("language"), F.greatest(*columns.values()).alias("score"))


@Q.query("""SELECT conv_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title, n, last_turn FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS t, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1)""")
def conv_title(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy("conv_id").agg(text.excerpt(first).alias("title"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


@Q.query("""SELECT role, count(*) AS n, sum(length(text))::BIGINT AS characters, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY 1""")
def conversation_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"), F.count_distinct("conv_id").alias("n_conversations"))


@Q.query("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(url, '\\?.*$', ''), '^https?://[^/]+', ''), '/\\d+(/|$)', '/:id\\1') AS route FROM pages""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), r"^https?://[^/]+", "")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("host"), text.route_template(path).alias("route"))


@Q.query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM benchmark""")
def escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.escape_html("text").alias("safe"))


@Q.query("""SELECT doc_id, sha256(concat_ws('|', lang, source, CAST(n_chars // 2 * 2 AS VARCHAR))) AS key FROM documents""")
def typology(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", numbers.typology_key("lang", "source", numbers.two_year_bucket("n_chars")).alias("key"))


@Q.query("""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ?([:/,.]) ?', '\\1', 'g')  AS normal FROM documents""")
def tolerant_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.tolerant_key("text").alias("normal"))


@Q.query("""
WITH t AS (SELECT doc_id, text, greatest(length(text), 1) AS n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS words FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
m AS (SELECT doc_id, text, len(list_filter(words, lambda w: regexp_full_match(w, '[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]'))) / greatest(len(words), 1) AS single_ratio, (length(text) - length(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g'))) / n AS control_ratio,
  (length(text) - length(regexp_replace(text, '[\\x{80}-\\x{c6}\\x{c8}-\\x{d5}\\x{d7}-\\x{db}\\x{dd}-\\x{e6}\\x{e8}-\\x{f5}\\x{f7}-\\x{fb}\\x{fd}-\\x{ff}]', '', 'g'))) / n AS high_ratio,
  coalesce(list_avg(list_transform(list_filter(words, lambda w: length(w) > 1), lambda w: length(w))), 0) AS word_length, CAST(contains(lower(text), 'insurance') AS INTEGER) + CAST(contains(lower(text), 'policy') AS INTEGER) AS terms_found FROM t),
s AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(0, least(100, 100 - least(40, single_ratio * 200) - least(20, control_ratio * 500) - least(15, high_ratio * 200) + least(10, terms_found * 2) - CASE WHEN word_length < 4 THEN least(10, (4 - word_length) * 5) ELSE 0 END)) END AS score FROM m)
SELECT doc_id, single_ratio, control_ratio, high_ratio, word_length, terms_found, CAST(score AS DOUBLE) AS score, score >= 60 AND single_ratio < 0.15 AND control_ratio < 0.05 AS ok FROM s""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return documents.text_quality(docs(spark, d), "doc_id", "text", ["insurance", "policy"])


def noise_sql(x: str) -> str:
    """Is the line ``x`` noise?"""
    t = f"trim({x}, ' ')"
    gone = lambda c: f"(length({t}) - length(regexp_replace({t}, '[{c}]', '', 'g')))"
    high, control, solid = gone("\\x{80}-\\x{ff}"), gone("\\x00-\\x1f\\x7f-\\x{9f}\\x{fffd}"), f"regexp_replace({t}, '\\s', '', 'g')"
    few = f"length({solid}) > 40 AND length(regexp_replace({solid}, '{LETTER}', '', 'g')) / length({solid}) < 0.15"
    return f"(length({t}) > 0 AND (regexp_matches({t}, '^[|!Il1\\s]{{10,}}$') OR regexp_matches({t}, '^[^\\p{{L}}\\p{{N}}\\s]{{6,}}$') OR {high} > 10 OR {high} / length({t}) > 0.3 OR {control} > 5 OR {control} / length({t}) > 0.2 OR ({few})))"


NUMBERS = "list_distinct(regexp_extract_all({0}, '(\\d[\\d.,]*\\d|\\d)', 1))"


@Q.query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS a, string_split(regexp_replace(regexp_replace(text, '\r\n?', '\n', 'g'), '[\\x{{a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{3000}}]', ' ', 'g'), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, a, trim(regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: NOT {noise_sql("x")}), lambda x: rtrim(regexp_replace(regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' ')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS b FROM t)
SELECT doc_id, b AS clean, concat_ws(',', CASE WHEN length(trim(b, ' ')) = 0 THEN 'empty' END, CASE WHEN length(b) / greatest(length(a), 1) < 0.3 THEN 'too_short' END, CASE WHEN length(b) / greatest(length(a), 1) > 1.2 THEN 'too_long' END, CASE WHEN length(b) > 20000 THEN 'size' END,
  CASE WHEN len(list_filter({NUMBERS.format("a")}, lambda x: NOT list_contains({NUMBERS.format("b")}, x))) > 0.1 * greatest(len({NUMBERS.format("a")}), 1) THEN 'numbers_lost' END, CASE WHEN len(list_filter(string_split(b, chr(10)), lambda x: {noise_sql("x")})) > 0 THEN 'noise_left' END,
  CASE WHEN regexp_matches(b, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control_left' END) AS failed_gates FROM c""")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    out = docs(spark, d).select("doc_id", "text", text.clean_lines("text").alias("clean"))
    return out.select("doc_id", "clean", F.array_join(documents.qa_gates("text", "clean"), ",").alias("failed_gates"))


@Q.query()
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunks(docs(spark, d), "doc_id", "text")


@Q.query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def rejoined(spark: SparkSession, d: str) -> DataFrame:
    return documents.join_chunks(documents.chunks(docs(spark, d), "doc_id", "text"), "doc_id", "chunk")


@Q.query("""SELECT doc_id, regexp_replace(text, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+', '[EMAIL]', 'g') AS redacted FROM documents""")
def redacted_mail(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", documents.redact("text", documents.PII[:1]).alias("redacted"))


@Q.query()
def redaction_vault(spark: SparkSession, d: str) -> DataFrame:
    return documents.vault(docs(spark, d), "doc_id", "text")


@Q.query("""SELECT doc_id, round(s, 4) AS score FROM (SELECT doc_id, least(1.0, CASE WHEN regexp_matches(text, '(?i)license') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(text, '\\d{4}') THEN 0.3 ELSE 0 END + CASE WHEN contains(text, '@') THEN 0.4 ELSE 0 END) AS s FROM documents)""")
def signals(spark: SparkSession, d: str) -> DataFrame:
    score = text.signal_score("text", [(r"(?i)license", 0.5), (r"[0-9]{4}", 0.3), ("@", 0.4)])
    return docs(spark, d).select("doc_id", F.round(score, 4).alias("score"))


@Q.query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)copyright|license') THEN 'legal' WHEN regexp_matches(text, '\\|') THEN 'table' WHEN regexp_matches(text, '!!') THEN 'shout' ELSE 'prose' END AS kind FROM documents""")
def document_kind(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.first_rule("text", [("(?i)copyright|license", "legal"), (r"\|", "table"), ("!!", "shout")], "prose").alias("kind"))


@Q.query("""
WITH t AS (SELECT doc_id, lower(source) AS s, lower(text) AS t, ' ' || regexp_replace(lower(source), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ' AS ps, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ' AS pt FROM documents),
r AS (SELECT doc_id, round(CAST(contains(ps, ' copyright ') AS INTEGER) + CAST(contains(ps, ' license ') AS INTEGER) + 0.4 * CAST(contains(pt, ' copyright ') AS INTEGER) + 0.4 * CAST(contains(pt, ' license ') AS INTEGER), 4) AS search_rank, contains(s, 'copyright license') OR contains(t, 'copyright license') AS hit FROM t)
SELECT doc_id, CAST(search_rank AS DOUBLE) AS search_rank FROM r WHERE hit OR search_rank > 0""")
def document_search(spark: SparkSession, d: str) -> DataFrame:
    return documents.search(docs(spark, d), {"source": 1.0, "text": 0.4}, "copyright license", "doc_id").select("doc_id", "search_rank")


@Q.query("""
WITH RECURSIVE i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, text, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0 AND w NOT IN ('the', 'of', 'and', 'a')), lambda w: left(w, 4))) AS stems FROM conversations),
f AS (SELECT conv_id, 1::BIGINT AS k, [{'text': text, 'stems': stems}] AS kept FROM i WHERE k = 1
UNION ALL SELECT f.conv_id, i.k, CASE WHEN len(list_filter(kept, lambda e: len(list_distinct(list_concat(e.stems, i.stems))) = 0 OR len(list_intersect(e.stems, i.stems)) / len(list_distinct(list_concat(e.stems, i.stems))) >= 0.3)) = 0 THEN list_append(kept, {'text': i.text, 'stems': i.stems})
  ELSE list_transform(kept, lambda e, n: CASE WHEN n = list_position(list_transform(kept, lambda g: len(list_distinct(list_concat(g.stems, i.stems))) = 0 OR len(list_intersect(g.stems, i.stems)) / len(list_distinct(list_concat(g.stems, i.stems))) >= 0.3), true) AND length(i.text) > length(e.text) THEN {'text': i.text, 'stems': i.stems} ELSE e END) END FROM f JOIN i ON i.conv_id = f.conv_id AND i.k = f.k + 1)
SELECT conv_id, max(k)::INTEGER AS n_before, max_by(len(kept), k)::INTEGER AS n_after FROM f GROUP BY 1""")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as the items of one record: paraphrases fold together."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return collections.paraphrase_groups(lines, "conv_id", "turn", "text", ["the", "of", "and", "a"], 0.3).drop("texts")


@Q.query("""
WITH p(name, pattern, severity) AS (VALUES ('license', '(?i)license', 'warning'), ('mail', '@', 'critical'), ('digits', '\\d{8}', 'info')) SELECT doc_id, name, severity FROM documents, p WHERE regexp_matches(text, pattern)""")
def pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("license", "(?i)license", "warning"), ("mail", "@", "critical"), ("digits", r"\d{8}", "info")], "name string, pattern string, severity string")
    return scoring.pattern_findings(docs(spark, d), "doc_id", "text", patterns)


@Q.query("""SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1""")
def language_share(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("lang", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("percent"), "least", "most")


@Q.query("""SELECT source, doc_id, n_chars, "rank" FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS "rank" FROM documents) WHERE "rank" <= 5""")
def longest_per_source(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.top_per_key(docs(spark, d).select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@Q.query("""
WITH n AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 13) % 100000000000 AS VARCHAR), 11, '1') AS id FROM orders), g AS (SELECT o_orderkey, id, list_transform(string_split(id, ''), lambda c: CAST(c AS INTEGER)) AS d FROM n)
SELECT o_orderkey, d[1] <> 0 AND ((((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10) + 10) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS valid_id FROM g""")
def id_checks(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad(((F.col("o_orderkey") * 7919 + 13) % 100_000_000_000).cast("string"), 11, "1")
    return table(spark, d, "orders").select("o_orderkey", checks.national_id(number).alias("valid_id"))


@Q.query("""
WITH f AS (SELECT doc_id, 'mail' AS field, regexp_extract(text, '([\\w.+-]+@[\\w-]+\\.[\\w.-]+)', 1) AS value, 0.9 AS c FROM documents UNION ALL SELECT doc_id, 'iban', regexp_extract(text, '([A-Z]{2}[0-9]{22,26})', 1), 0.8 FROM documents UNION ALL SELECT doc_id, 'phone', regexp_extract(text, '(\\+?[0-9][0-9 ()-]{8,}[0-9])', 1), 0.7 FROM documents),
v AS (SELECT *, field <> 'iban' OR (regexp_full_match(value, 'TR[0-9]{24}') AND coalesce(TRY_CAST(substr(value, 5) || '2927' || substr(value, 3, 2) AS HUGEINT) % 97 = 1, false)) AS valid FROM f WHERE value <> '')
SELECT doc_id, field, value, round(CASE WHEN valid THEN c ELSE c / 3 END, 4) AS confidence, valid FROM v""")
def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.extraction import fields

    patterns = {"mail": (r"([\w.+-]+@[\w-]+\.[\w.-]+)", None, 0.9), "iban": (r"([A-Z]{2}[0-9]{22,26})", "iban", 0.8), "phone": (r"(\+?[0-9][0-9 ()-]{8,}[0-9])", None, 0.7)}
    return fields(docs(spark, d), "doc_id", "text", patterns)


@Q.query("""
WITH t(pos, label, term, weight) AS (VALUES (1, 'legal', 'license', 2.0), (2, 'legal', 'copyright', 1.0), (3, 'contact', '@', 2.0), (4, 'table', '|', 0.5)), h AS (SELECT doc_id, label, sum(weight) AS s, min(pos) AS p FROM documents, t WHERE contains(lower(text), term) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, p) AS k FROM h)
SELECT d.doc_id, b.label, CAST(coalesce(b.s, 0) AS DOUBLE) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1""")
def classified(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.extraction import classified as classify

    terms = spark.createDataFrame([(1, "legal", "license", 2.0), (2, "legal", "copyright", 1.0), (3, "contact", "@", 2.0), (4, "table", "|", 0.5)], "pos int, label string, term string, weight double")
    return classify(docs(spark, d), "doc_id", "text", terms)


@Q.query("""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '!+', '!', 'g') AS clean, list_filter([CASE WHEN regexp_matches(text, '[ \\t]{2,}|\\t') THEN 'blanks' END, CASE WHEN regexp_matches(text, '!!') THEN 'marks' END], lambda x: x IS NOT NULL)::VARCHAR AS applied FROM documents""")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.extraction import normalised as normalise

    n = normalise("text", [("blanks", r"[ \t]+", " "), ("marks", "!+", "!")])
    return docs(spark, d).select("doc_id", n.alias("n")).select("doc_id", F.col("n.text").alias("clean"), F.concat(F.lit("["), F.array_join("n.applied", ", "), F.lit("]")).alias("applied"))


@Q.query("""
SELECT o_custkey, CAST(r * 2 + 1 AS INTEGER) AS "row", o_orderpriority AS name, CAST(o_orderkey AS DOUBLE) AS amount FROM (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)""")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.extraction import table_rows

    line = F.concat(F.lit("plain words\n| "), F.col("o_orderpriority"), F.lit(" | x | "), F.col("o_orderkey").cast("string"), F.lit(" TL |"))
    sorted_lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    texts = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("text"))
    return table_rows(texts, "o_custkey", "text")


@Q.query("""
WITH s AS (SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn, role) AS path FROM conversations GROUP BY 1) SELECT conv_id, n, path FROM s""")
def conversation_paths(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.jobs import stage_logs

    c = table(spark, d, "conversations")
    listed = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return listed.select("conv_id", "n", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("path")).join(stage_logs(c, "conv_id", "role", "turn").select("conv_id"), "conv_id")


@Q.query("""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, lower(trim(coalesce(source, ''))) IN ('', 'unknown', 'sigorta', 'insurance') AS generic FROM documents)
SELECT doc_id, CASE WHEN n < 100 THEN 'reject' WHEN n < 500 OR generic OR doc_id IS NULL THEN 'review' ELSE 'admit' END AS decision, concat_ws(',', CASE WHEN n < 100 THEN 'no_text' END, CASE WHEN n >= 100 AND n < 500 THEN 'little_text' END, CASE WHEN generic THEN 'no_provider' END, CASE WHEN doc_id IS NULL THEN 'no_number' END) AS reasons FROM n""")
def admissions(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.extraction import admission

    a = admission(F.col("text"), F.col("source"), F.col("doc_id").cast("string"), F.lit(1))
    return docs(spark, d).select("doc_id", a.alias("a")).select("doc_id", "a.decision", F.array_join("a.reasons", ",").alias("reasons"))
