"""Removal of repeated byte strings by suffix sorting of shards.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. Every such string (window) belongs
to one group, named by the least hash of its ``GRAM``-byte pieces, so equal windows always meet in one group. Runs of
windows of one group (spans of about ``1.4 * width`` bytes) are the units:

1. Equal texts are one text with a count; texts lie bucketed in the shared folder, so they are shuffled once.
2. A span that occurs twice settles all of its windows; this needs only hashes, summed before the shuffle.
3. What is left are spans that stand alone in a group with other spans (the edges of repeated passages) or that hold
   the piece which names the group twice (periodic text). Groups are dealt over the tasks, each task sorts the suffixes of its spans by external induced sorting (``suffix_sort``), and
   neighbours that share ``width`` bytes are repeats.
4. A group of more than ``GROUP`` different spans is salted. Its windows are first tried in blocks: those that hold the
   group's piece at one of ``BLOCK`` neighbouring offsets share a core, and a core that is nowhere else settles the
   block. What is left is sorted part by part; a part hands on one row per different window that its blocks still
   leave open, and equal windows of several parts meet by their hash.

Hashes of spans and windows have 128 bits. Nothing is capped; a text of any length is worked on in segments.

Cases: null text is empty; texts shorter than ``width`` lose nothing; of equal texts of at least ``width`` bytes every
one is removed whole, as each repeats the other (null and repeated ids do not matter, a row is a row); an empty table
gives an empty result; other columns are ignored by ``find_repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm.storage import bounded_batches, new_folder, trimmed, written
from brambling.llm.suffix_sort import Shard

GRAM = 32
#: Windows of a span, bytes of text that a task hashes at once, spans of a group that are sorted together, bytes that a task sorts at once.
RUN, SEGMENT, GROUP, SHARD = 1024, 1 << 20, 2_000, 2_000_000
#: Neighbouring offsets whose windows are settled together.
BLOCK = 16


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place: neighbouring hashes are joined, then those two apart, and so on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of h[i : i + n] for each i."""
    step = 1
    while 2 * step <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (n - step)], h[n - step :]) if n > step else h


def spans_of(texts: list[bytes], width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, start, windows with marks, group, content): runs of windows with the same least hash."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - width + 1), SEGMENT):
            part = t[at : at + SEGMENT + width - 1] if len(t) > SEGMENT else t
            held.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield from _spans(held, width)
                held, size = [], 0
    if held:
        yield from _spans(held, width)


def _spans(parts: list[tuple[int, int, bytes]], width: int) -> Iterator[tuple[int, int, int, int, int]]:
    data = b"".join(p for _, _, p in parts)
    lengths = np.fromiter((len(p) for _, _, p in parts), np.int64, len(parts))
    first = np.cumsum(lengths) - lengths
    grams, wide = _gram_hashes(np.frombuffer(data, np.uint8)), width - GRAM + 1
    least = _least(grams, wide)
    good = np.zeros(len(data) + 1, np.int8)
    good[first] += 1
    good[first + lengths - width + 1] -= 1
    at = np.nonzero(np.cumsum(good[:-1]) > 0)[0]
    value = least[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])])
    start = np.nonzero(new)[0]
    new |= (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % RUN == 0
    start = np.nonzero(new)[0]
    n = np.diff(np.append(start, len(at)))
    place = at[start]
    n = n * 2 + _recurs(grams, least, wide, place, n, value[start]) * RECURS
    part = np.searchsorted(first, place, "right") - 1
    content = xxhash.xxh3_64_intdigest
    view = memoryview(data)
    for k, p, m, g in zip(part.tolist(), place.tolist(), n.tolist(), value[start].tolist()):
        i, offset, _ = parts[k]
        yield i, p - int(first[k]) + offset, m, g, content(view[p : p + (m >> 1 & 2047) - 1 + width])


def _recurs(grams: np.ndarray, least: np.ndarray, wide: int, place: np.ndarray, n: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True for spans that hold their least piece twice: only there two windows of one span can be equal."""
    edge = np.zeros(wide - 1, least.dtype)
    seen = np.nonzero(~_least(~np.concatenate([edge, least, edge]), wide)[: len(grams)] == grams)[0]
    names, name = np.unique(grams[seen], return_inverse=True)
    keys = np.sort(name * len(grams) + seen)
    base = np.searchsorted(names, value) * len(grams)
    return np.searchsorted(keys, base + place + n + wide - 1) - np.searchsorted(keys, base + place) > 1


#: A span in one number: where it starts, whether its least piece recurs, how many windows it has, whether its text has copies.
RECURS = 4096


def pack(start: int, windows: int) -> int:
    return start * (2 * RECURS) + windows * 2


def _start(at: Column) -> Column:
    return F.shiftright(at, 13)


def _windows(at: Column) -> Column:
    return F.shiftright(at, 1).bitwiseAND(F.lit(2047))


def _hash_spans(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copies = (batch.column(i).to_numpy() for i in (0, 1, 3))
            rows = list(spans_of(batch.column(2).to_pylist(), width))
            if not rows:
                continue
            text, start, n, group, content = (np.array(x, np.uint64) for x in zip(*rows))
            text = text.astype(np.int64)
            at = start.astype(np.int64) * (2 * RECURS) + n.astype(np.int64) + (copies[text] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group.view(np.int64), content.view(np.int64), k1[text], k2[text], at)], names=["h", "c", "k1", "k2", "at"])

    return texts.select("k1", "k2", "bytes", "copies").mapInArrow(trimmed(run), "h long, c long, k1 long, k2 long, at long")


def _blocks(piece: bytes, h: int, windows: int) -> np.ndarray:
    """The block of each window of a span: where its core starts, and which offsets it stands for, in one number."""
    place = np.nonzero(_gram_hashes(np.frombuffer(piece, np.uint8)).view(np.int64) == h)[0]
    start = np.arange(windows)
    first = place[np.searchsorted(place, start)]
    block = (first - start) // BLOCK
    return (first - block * BLOCK) * 256 + block


def _cores(pieces: DataFrame, width: int) -> DataFrame:
    """k1, k2, at, block, w1, w2, m: a hash of the core of each block of each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, k1, k2, at, m, piece in zip(*(c.to_pylist() for c in batch.columns)):
                for b in np.unique(_blocks(piece, h, at >> 1 & 2047)).tolist():
                    digest = xxhash.xxh3_128_digest(piece[b >> 8 : (b >> 8) + width - BLOCK + 1] + bytes([b & 255]))
                    out.append((k1, k2, at, b, *_halves(digest), min(m, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=["k1", "k2", "at", "block", "w1", "w2", "m"])

    return pieces.select("h", "k1", "k2", "at", "m", "piece").mapInArrow(trimmed(run), "k1 long, k2 long, at long, block long, w1 long, w2 long, m long")


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _open_blocks(pieces: DataFrame, width: int) -> DataFrame:
    """k1, k2, at, blocks: per span the blocks whose core occurs elsewhere too."""
    cores = written(_cores(pieces, width), "cores")
    again = cores.groupBy("w1", "w2").agg(F.sum("m").alias("n")).filter("n > 1").select("w1", "w2")
    return cores.join(again, ["w1", "w2"], "left_semi").groupBy("k1", "k2", "at").agg(F.collect_set("block").alias("blocks"))


def _sort_shards(pieces: DataFrame, width: int) -> DataFrame:
    """kind 0: settled spans (k1, k2, at). kind 1: open windows of salted groups (w1, w2), with a place if they are single here; kind 2 without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD and row[:2] != held[-1][:2]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield sort(held)

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        """rows: h, salt, k1, k2, at, m, piece, blocks (null if the group is whole). Whole groups or parts."""
        shard = Shard([r[6] for r in rows], width)
        twice = shard.duplicated()
        out: list[tuple] = []
        seen: set[bytes] = set()
        for (h, _, k1, k2, at, m, piece, blocks), first in zip(rows, shard.first.tolist()):
            start, n = at >> 13, at >> 1 & 2047
            flags = twice[first : first + n]
            if m < 2:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
                out += [(0, k1, k2, pack(start + int(a), int(b - a)), None, None) for a, b in zip(edge[::2], edge[1::2])]
            if blocks is not None:
                for j in np.nonzero(np.isin(_blocks(piece, h, n), blocks))[0].tolist():
                    digest = xxhash.xxh3_128_digest(piece[j : j + width])
                    many = flags[j] or m > 1
                    if many and digest in seen:
                        continue
                    seen.add(digest)
                    out.append((2, None, None, None, *_halves(digest)) if many else (1, k1, k2, pack(start + j, 1), *_halves(digest)))
        kinds = [pa.int32()] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=["kind", "k1", "k2", "at", "w1", "w2"])

    ordered = pieces.repartition("h", "salt").sortWithinPartitions("h", "salt")
    return ordered.select("h", "salt", "k1", "k2", "at", "m", "piece", "blocks").mapInArrow(trimmed(run), "kind int, k1 long, k2 long, at long, w1 long, w2 long")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns, and bytes, k1, k2: two hashes of the text."""
    data = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), data.alias("bytes")).withColumns({"k1": F.xxhash64("bytes"), "k2": F.xxhash64(F.lit(1), "bytes")})


def kept_texts(docs: DataFrame, text_col: str = "text", width: int = 200) -> DataFrame:
    """k1, k2, n_bytes, spans (removed, half-open), kept binary: one row per different text."""
    if width < GRAM:
        raise ValueError(f"strings of {width} bytes are shorter than the pieces of {GRAM} bytes that group them")
    spark = bounded_batches(docs).sparkSession
    name = f"brambling_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = _keyed(docs, text_col).groupBy("k1", "k2").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    distinct.write.bucketBy(n, "k1", "k2").option("path", new_folder(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)

    spans = written(_hash_spans(texts, width), "spans")
    weight = F.sum(F.col("at").bitwiseAND(F.lit(1)) + 1)
    contents = written(spans.groupBy("h", "c").agg(weight.alias("m"), *[F.first(x).alias(x) for x in ("k1", "k2", "at")]), "contents")
    whole = spans.filter(F.col("at").bitwiseAND(F.lit(1)) == 0).join(contents.filter("m > 1").select("h", "c"), ["h", "c"], "left_semi").select("k1", "k2", "at")

    unsettled = contents.groupBy("h").agg(F.count(F.lit(1)).alias("g"), F.min("m").alias("least"), F.max(F.col("at").bitwiseAND(F.lit(RECURS))).alias("recurs")).filter("(g > 1 or recurs > 0) and least = 1")
    parts = F.ceil(F.col("g") / GROUP).cast("long")
    edges = contents.join(unsettled.select("h", "g"), "h").select("h", F.pmod("c", parts).alias("salt"), (parts > 1).alias("salted"), "k1", "k2", "at", "m")
    pieces = edges.join(texts.select("k1", "k2", "bytes"), ["k1", "k2"]).withColumn(
        "piece", F.substr("bytes", (_start(F.col("at")) + 1).cast("int"), (_windows(F.col("at")) + (width - 1)).cast("int"))
    ).drop("bytes")
    pieces = written(pieces, "pieces")
    salted = pieces.filter("salted")
    left = salted.join(_open_blocks(salted, width), ["k1", "k2", "at"])
    sorted_ = _sort_shards(pieces.filter("not salted").withColumn("blocks", F.lit(None).cast("array<long>")).unionByName(left), width)
    found = written(sorted_, "shards")
    windows = found.filter("kind > 0").groupBy("w1", "w2").agg(F.sum("kind").alias("m"), F.collect_list(F.when(F.col("kind") == 1, F.struct("k1", "k2", "at"))).alias("places"))
    apart = windows.filter("m > 1").select(F.explode("places").alias("p")).select("p.*")

    settled = whole.unionByName(found.filter("kind = 0").select("k1", "k2", "at")).unionByName(apart)
    per_text = settled.groupBy("k1", "k2").agg(F.collect_list("at").alias("found"))
    return texts.join(per_text, ["k1", "k2"], "left").select("k1", "k2", "bytes", "copies", "found").mapInArrow(trimmed(_cut(width)), "k1 long, k2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def covered(found: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Packed spans as merged runs of bytes."""
    start = found >> 13
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + (found >> 1 & 2047) - 1 + width)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist())) if len(first) else []


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept, size = [], [], []
            for text, copies, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                runs = [(0, len(text))] if copies > 1 and len(text) >= width else covered(np.array(found or [], np.int64), width)
                edges = [0, *[x for r in runs for x in r], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in runs])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["k1", "k2", "n_bytes", "spans", "kept"])

    return run


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """id_col, n_bytes, spans, kept: per document what goes (half-open runs of bytes) and what stays."""
    keys = _keyed(docs, text_col).select(F.col("row")[id_col].alias(id_col), "k1", "k2")
    return keys.join(kept_texts(docs, text_col, width), ["k1", "k2"]).drop("k1", "k2")


def digest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256: as ``find_repeats``, but no text is shuffled again."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digests = kept_texts(docs, text_col, width).select("k1", "k2", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return _keyed(docs, text_col).select(F.col("row")[id_col].alias(id_col), "k1", "k2").join(digests, ["k1", "k2"]).drop("k1", "k2")


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = 200) -> DataFrame:
    """``docs`` with the repeats taken out of the text; all columns stay. A code point that a cut splits goes whole."""
    kept = kept_texts(docs, text_col, width).select("k1", "k2", F.when(F.size("spans") > 0, _valid(F.col("kept"))).otherwise(F.col("kept").cast("string")).alias("kept_text"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c != text_col]
    # The texts themselves come from the kept ones only, so no row is shuffled with its old text.
    rows = _keyed(docs, text_col).select(F.struct(*others).alias("others") if others else F.lit(0).alias("others"), F.col("row")[text_col].isNull().alias("none"), "k1", "k2").join(kept, ["k1", "k2"])
    text = F.when(~F.col("none"), F.col("kept_text")).cast(docs.schema[text_col].dataType)
    return rows.select(*[(text if c == text_col else F.col("others")[c]).alias(c) for c in docs.columns])


def _valid(data: Column) -> Column:
    """Bytes as a string without what is no UTF-8."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "�", "")
