"""Documents: chunks, redaction, sections, quality, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.functions.numbers import banded, clamp, half_up
from brambling.functions.text import col, count_of, garbage_reason, once, without

PAGE_MARK = r"(?im)^[ \t]*(?:-+[ \t]*)?(?:page|sayfa|seite|página)[ \t]*:?[ \t]*\d+(?:[ \t]*(?:/|of)[ \t]*\d+)?[ \t]*(?:-+)?[ \t]*$"


def cut_points(text: str, target: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open pieces of about ``target`` characters, cut at a paragraph, line, sentence or word end after ``least``; each begins ``overlap`` before the end of the last."""
    out, at = [], 0
    while len(text) - at > target:
        window = text[at + least : at + target]
        for mark in ("\n\n", "\n", ". ", " "):
            found = window.rfind(mark)
            if found >= 0:
                end = at + least + found + len(mark)
                break
        else:
            end = at + target
        out.append((at, end))
        at = max(end - overlap, at + 1)
    return [*out, (at, len(text))]


def chunks(docs: DataFrame, id_col: str, text_col: str, largest: int = 12_000, target: int = 8_000, least: int = 6_000, overlap: int = 300) -> DataFrame:
    """id_col, chunk_no, start, end, kind, chunk: whole if short, by page marks if there are two or more, else by size."""
    import re

    mark = re.compile(PAGE_MARK)
    kept = docs.select(id_col, F.col(text_col).cast("string"))

    def pieces(text: str) -> list[tuple[int, int, str]]:
        if len(text) <= largest:
            return [(0, len(text), "whole")]
        starts = [m.start() for m in mark.finditer(text)]
        if len(starts) < 2:
            return [(a, b, "size") for a, b in cut_points(text, target, least, overlap)]
        edges = [0, *[s for s in starts if s > 0], len(text)]
        out: list[tuple[int, int, str]] = []
        for a, b in zip(edges, edges[1:]):
            out += [(a, b, "page")] if b - a <= 1.5 * largest else [(a + x, a + y, "page_part") for x, y in cut_points(text[a:b], target, least, overlap)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                found = pieces(text)
                rows = [pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int32())]
                a, b, kind = zip(*found)
                yield pa.RecordBatch.from_arrays([*rows, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind), pa.array([text[x:y] for x, y in zip(a, b)], pa.string())], names=[id_col, "chunk_no", "start", "end", "kind", "chunk"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, chunk_no int, start long, end long, kind string, chunk string")


def join_chunks(parts: DataFrame, id_col: str, chunk: str, start: str = "start", end: str = "end") -> DataFrame:
    """The text of each document again: of each chunk, by its place, what no chunk before it held."""
    listed = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(start, end, chunk))).alias("_c"))
    seen = lambda i: F.when(i > 0, F.element_at("_c", i)[end]).otherwise(F.lit(0))  # noqa: E731  element_at counts from one
    own = F.transform("_c", lambda c, i: F.substr(c[chunk], (F.greatest(seen(i) - c[start], F.lit(0)) + 1).cast("int")))
    return listed.select(id_col, F.array_join(own, "").alias("text"))


def join_overlapping(parts: DataFrame, id_col: str, no: str, chunk: str, least: int = 20, most: int = 300) -> DataFrame:
    """As ``join_chunks`` where the places are gone, as a model rewrote the chunks: the end of one chunk that is the start of the next stays once.

    The longest overlap of at most ``most`` characters counts, which must be the overlap that the chunks were cut with.
    """
    listed = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(no, chunk))).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for items in batch.column(1).to_pylist():
                out: list[str] = []
                last = ""
                for c in items:
                    new = c[chunk] or ""
                    size = next((k for k in range(min(most, len(last), len(new)), least - 1, -1) if last[-k:] == new[:k]), 0)
                    out.append(new[size:])
                    last = (last + new[size:])[-most:]
                texts.append("".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return listed.mapInArrow(run, f"`{id_col}` {listed.schema[0].dataType.simpleString()}, text string")


def longest_common(a: str, b: str, least: int, most: int) -> tuple[int, int, int]:
    """(length, place in a, place in b) of the longest string of ``least`` to ``most`` characters in both: the first in a, then in b; (0, 0, 0) without one.

    If two texts share a string they share its parts, so the length is found by halving, each time over sets of pieces.
    """
    pieces = lambda s, n: (s[i : i + n] for i in range(len(s) - n + 1))

    def shared(n: int) -> str | None:
        of_b = set(pieces(b, n))
        return next((p for p in pieces(a, n) if p in of_b), None)

    low, high, found = least, min(most, len(a), len(b)), None
    while low <= high:
        n = (low + high) // 2
        piece = shared(n)
        if piece is None:
            high = n - 1
        else:
            low, found = n + 1, piece
    return (len(found), a.find(found), b.find(found)) if found else (0, 0, 0)


def merged(chunks: list[str], overlap: int, least: int, most: int, widest: int = 1_000) -> str:
    """One text of chunks that were cut with an overlap and rewritten since.

    Of two neighbours the longest string that the end of the first and the start of the second share (both of twice the
    overlap at most) is where the second takes over; without one, and without overlap, they are paragraphs.
    """
    done: list[str] = []
    tail = chunks[0] if chunks else ""
    if len(chunks) < 2:
        return tail
    for c in chunks[1:]:
        window = min(2 * overlap, len(tail) + sum(map(len, done[-1:])), widest)
        if len(tail) < window:  # a short chunk: what stands before it is part of the end
            tail = done.pop() + tail
        n, at, to = longest_common(tail[-window:], c[:window], least, most) if window else (0, 0, 0)
        if n:
            done.append(tail[: len(tail) - window + at])
            tail = c[to:]
        else:
            tail = tail.rstrip()
            while done and not tail:
                tail = done.pop().rstrip()
            done += [tail, "\n\n"]
            tail = c.lstrip()
        while len(done) > 1 and len(done[-1]) < widest and len(tail) < widest:
            tail = done.pop() + tail
    return "".join([*done, tail]).strip()


def merge_rewritten(parts: DataFrame, id_col: str, no: str, chunk: str, overlap: int, least: int = 20, most: int = 100) -> DataFrame:
    """id_col, text: the chunks of each document, in the order of ``no``, as ``merged`` joins them. A document's chunks are one row; null chunks are empty."""
    listed = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(no, chunk))).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                texts = [c[chunk] or "" for c in row.column(1)[0].as_py()]
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([merged(texts, overlap, least, most)], pa.string())], names=[id_col, "text"])

    return listed.mapInArrow(run, f"`{id_col}` {listed.schema[0].dataType.simpleString()}, text string")


# What is redacted, in this order.
PII = [
    ("EMAIL", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("PHONE", r"(?<![\w.])\+?\d[\d ()/-]{7,}\d(?![\w.])"),
    ("ID", r"\b\d{11}\b"),
]


def redact(c: Column | str, kinds: list[tuple[str, str]] = PII) -> Column:
    """Every find as ``[KIND]``."""
    out = col(c)
    for name, pattern in kinds:
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return out


def _entry(kind: str):
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), v.alias("value"))


def vault(docs: DataFrame, id_col: str, text_col: str, kinds: list[tuple[str, str]] = PII) -> DataFrame:
    """id_col, kind, token, value: what ``redact`` takes out, numbered per document and kind in order of the text; equal values share a token."""

    def finds(rest: Column, kinds: list[tuple[str, str]]) -> Column:
        (name, pattern), *others = kinds
        here = F.transform(F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1)), _entry(name))
        return once(F.regexp_replace(rest, pattern, f"[{name}]"), lambda text: F.concat(here, finds(text, others))) if others else here

    hits = docs.select(id_col, F.explode(finds(F.col(text_col), kinds)).alias("h")).select(id_col, "h.*")
    first = hits.groupBy(id_col, "kind", "value").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    no = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("pos"))
    return first.select(id_col, "kind", F.concat(F.lit("["), F.col("kind"), F.lit("_"), no.cast("string"), F.lit("]")).alias("token"), "value", "n")


def sections(docs: DataFrame, id_col: str, text_col: str, headings: list[tuple[str, str]]) -> DataFrame:
    """id_col, section, n_lines, n_chars: lines belong to the last heading above them. headings: (pattern of the line, section)."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    label = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(s)) for p, s in headings])
    kind = "struct<now: string, made: array<struct<section: string, size: int>>>"
    start = F.struct(F.lit("none").alias("now"), F.array().cast("array<struct<section: string, size: int>>").alias("made")).cast(kind)

    def step(state: Column, line: Column) -> Column:
        now = F.coalesce(label(line), state["now"])
        return F.struct(now.alias("now"), F.concat(state["made"], F.array(F.struct(now.alias("section"), F.length(line).alias("size")))).alias("made")).cast(kind)

    rows = docs.select(id_col, F.explode(F.aggregate(lines, start, step)["made"]).alias("l"))
    return rows.groupBy(id_col, F.col("l.section").alias("section")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l.size").alias("n_chars"))


# Control characters, and the upper half of the first 256 less Turkish letters.
CONTROL = "".join(map(chr, [*range(32), *range(127, 160)]))
HIGH = "".join(c for c in map(chr, range(128, 256)) if c not in "çğıöşüÇĞİÖŞÜ")


def text_quality(docs: DataFrame, key: str, text: str, terms: list[str] = ()) -> DataFrame:
    """key, ratios of split glyphs, control and high bytes, word length, terms found, a score from 0 to 100 and a verdict.

    Each pass over the text is a column of its own, so none is made twice: the text with single blanks, the same with
    double ones (so that neighbouring words share none), and that without its one-character words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tidy = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(" "))
    rows = docs.select(F.col(key), F.length(t).alias("_all"), *[F.contains(F.lower(t), F.lit(x)).cast("int").alias(f"_t{i}") for i, x in enumerate(terms)], F.length(without(t, CONTROL)).alias("_c"), F.length(without(t, HIGH)).alias("_h"), tidy.alias("_tidy"))
    rows = rows.withColumn("_wide", F.replace("_tidy", F.lit(" "), F.lit("  "))).withColumn("_solid", F.length(without("_tidy", " ")))
    rows = rows.withColumn("_long", F.regexp_replace("_wide", " [a-zA-ZçğıöşüÇĞİÖŞÜ0-9] ", "")).withColumn("_longer", F.length(F.regexp_replace("_wide", r" [^ ] ", "")))
    words = F.when(F.col("_solid") == 0, 0).otherwise(F.length("_tidy") - F.col("_solid") - 1)
    n, count = F.greatest("_all", F.lit(1)), F.greatest("_words", F.lit(1))
    ones = ((F.length("_wide") - F.col("_longer")) / 3).cast("int")
    rows = rows.select(key, "_all", "_c", "_h", "_solid", *[f"_t{i}" for i in range(len(terms))], words.alias("_words"), ((F.length("_wide") - F.length("_long")) / 3).alias("_single"), ones.alias("_ones"))
    found = sum((F.col(f"_t{i}") for i in range(len(terms))), F.lit(0))
    longer = F.col("_words") - F.col("_ones")
    mean = F.when(longer > 0, (F.col("_solid") - F.col("_ones")) / longer).otherwise(0.0)
    out = rows.select(key, "_all", (F.col("_single") / count).alias("single_ratio"), ((F.col("_all") - F.col("_c")) / n).alias("control_ratio"), ((F.col("_all") - F.col("_h")) / n).alias("high_ratio"), mean.alias("word_length"), found.alias("terms_found"))
    score = 100 - F.least(F.lit(40.0), F.col("single_ratio") * 200) - F.least(F.lit(20.0), F.col("control_ratio") * 500) - F.least(F.lit(15.0), F.col("high_ratio") * 200) + F.least(F.lit(10), F.col("terms_found") * 2)
    score = clamp(score - F.when(F.col("word_length") < 4, F.least(F.lit(10.0), (4 - F.col("word_length")) * 5)).otherwise(0.0), 0, 100)
    out = out.withColumn("score", F.when(F.col("_all") == 0, 0.0).otherwise(score)).drop("_all")
    return out.withColumn("ok", (F.col("score") >= 60) & (F.col("single_ratio") < 0.15) & (F.col("control_ratio") < 0.05))


def error_rate_estimate(garbage: Column, letters: Column, spacing: Column, numbers: Column, structure: Column) -> Column:
    """Estimated share of wrong characters: weighted shortfalls of five shares."""
    return F.least(F.lit(1.0), garbage * 0.3 + (1 - letters) * 0.25 + (1 - spacing) * 0.2 + (1 - numbers) * 0.15 + (1 - structure) * 0.1)


def ocr_decision(density: Column, quality: Column, language: Column, terms: Column, structure: Column, skip: float = 0.7, partly: float = 0.4) -> Column:
    """skip, selective or full, by a weighted mean of five scores from 0 to 1."""
    return banded(density * 0.25 + quality * 0.30 + language * 0.15 + terms * 0.15 + structure * 0.15, [(skip, "skip"), (partly, "selective")], "full")


def qa_gates(before: Column | str, after: Column | str, longest: int = 20_000) -> Column:
    """Names of the gates that a cleaned chunk fails."""
    a, b = F.coalesce(col(before), F.lit("")), F.coalesce(col(after), F.lit(""))
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d[\d.,]*\d|\d)"), F.lit(1))))
    share = F.length(b) / F.greatest(F.length(a), F.lit(1))
    lines = F.split(b, "\n")
    gates = [
        ("empty", F.length(F.trim(b)) == 0), ("too_short", share < 0.3), ("too_long", share > 1.2), ("size", F.length(b) > longest),
        ("numbers_lost", F.size(F.array_except(numbers(a), numbers(b))) > 0.1 * F.greatest(F.size(numbers(a)), F.lit(1))),
        ("noise_left", F.exists(lines, lambda x: garbage_reason(x).isNotNull())), ("control_left", count_of(b, r"\x00-\x08\x0b\x0c\x0e-\x1f") > 0),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in gates]))


def confidence(gate_pass: Column, kept: Column, artifacts: Column, content: Column, speed: Column) -> dict[str, Column]:
    """Five shares from 0 to 1 weighted 40/25/15/10/10 as a score to 100 with one digit, and its grade."""
    score = half_up(clamp(100 * (gate_pass * 0.40 + kept * 0.25 + (1 - artifacts) * 0.15 + content * 0.10 + speed * 0.10), 0, 100), 1)
    return {"score": score, "grade": banded(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")}


def search(docs: DataFrame, fields: dict[str, float], query: str, recency: str) -> DataFrame:
    """Rows that hold a word of the query (whole) or the query itself (as a part), by weighted word hits, then recency."""
    import re

    wanted = [w for w in re.split(r"[^\w]+", query.lower()) if w]
    rank, hit = F.lit(0.0), F.lit(False)
    for f, weight in fields.items():
        text = F.coalesce(F.lower(F.col(f).cast("string")), F.lit(""))
        padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
        for w in wanted:
            rank = rank + F.when(F.contains(padded, F.lit(f" {w} ")), weight).otherwise(0.0)
        hit = hit | F.contains(text, F.lit(query.lower()))
    return docs.withColumn("search_rank", F.round(rank, 4)).filter(hit | (F.col("search_rank") > 0)).orderBy(F.desc("search_rank"), F.desc(recency))
