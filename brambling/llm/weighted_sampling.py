"""Document fingerprints by consistent weighted sampling.

The terms of a text are its word shingles, weighted by how often they occur. For each of ``SAMPLES`` samples a term with
weight w gets, from hashes of the term alone, gamma variates r and c and a uniform b; with t = floor(ln w / r + b) its
value is c * exp(-r * (t - b + 1)), and the term with the least value, together with t, is the sample. Two texts agree on
a sample with the probability of their generalised Jaccard similarity, sum of least weights over sum of greatest.

The variates are made from three independent exponentials e, f, g: c = e + f, s = ln(c / e), r = s + g, b = 1 - s / r,
which have just the distributions asked for. At weight one the value is then e itself, so terms that occur once (nearly
all) are compared by one hash, and only repeated ones need the formula.

Fingerprints are compared by the share of equal samples; 16 bits of each are kept.

Cases: null and empty texts, and texts without words, have no terms and the fingerprint of zeros, which is like itself
only; fewer words than a shingle are one term; texts of any length are taken whole. For ``with_next``: repeated ids are
ordered by a hash of the text, a null id comes last, one row is its own next document, extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm import labelled
from brambling.llm.storage import bounded_batches, trimmed

SAMPLES, SHINGLE = 128, 5
ROWS = 2_000
#: Bytes of text that one range of ids should hold.
RANGE = 24_000_000
A, B, C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
SEEDS = (np.arange(1, SAMPLES + 1, dtype=np.uint64) * C) ^ (np.arange(1, SAMPLES + 1, dtype=np.uint64) * B >> np.uint64(7))
#: Powers of an odd number and of its inverse, so that the hash of any run of bytes comes from two prefix sums.
BASE = 0x5851F42D4C957F2D
SPAN = 1 << 16


def _powers(x: int) -> np.ndarray:
    out = np.ones(SPAN, np.uint64)
    step = 1
    while step < SPAN:
        out[step : 2 * step] = out[:step] * np.uint64(pow(x, step, 1 << 64))
        step *= 2
    return out


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each lower-cased word."""
    out = []
    data = np.frombuffer(text, np.uint8)
    start, end = labelled.letter_words(data)
    at = 0
    while at < len(start):  # pieces of SPAN bytes, or one longer word
        stop = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, "right")))
        lo, hi = int(start[at]), int(end[stop - 1])
        if hi - lo > SPAN:
            out.append(np.array([int.from_bytes(hashlib.sha1(text[lo:hi].lower()).digest()[:8], "big")], np.uint64))
        else:
            low = labelled._LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * UP[: hi - lo])])
            s, e = start[at:stop] - lo, end[at:stop] - lo
            out.append((sums[e] - sums[s]) * DOWN[s])
        at = stop
    return _mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def term_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = word_hashes(text)
    n = len(words) - shingle + 1
    if n < 1:
        if not len(words):
            return words
        shingle, n = len(words), 1
    h = words[:n].copy()
    for k in range(1, shingle):
        h = h * A + words[k : n + k]
    return _mixed(h + np.uint64(shingle))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """SAMPLES numbers of 16 bits."""
    h = np.sort(term_hashes(text, shingle))
    if not len(h):
        return np.zeros(SAMPLES, np.uint16)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    best = np.full(SAMPLES, np.inf)
    term, step = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    single, many, weight = h, h[:0], None
    if not first.all():
        at = np.nonzero(first)[0]
        count = np.diff(np.append(at, len(h)))
        single, many, weight = h[at[count == 1]], h[at[count > 1]], count[count > 1]
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(single), ROWS):
        part = single[i : i + ROWS]
        x = _drawn(part)
        k = x.argmin(axis=0)
        value = x[k, range(SAMPLES)]
        less = value < least
        least = np.where(less, value, least)
        term = np.where(less, part[k], term)
    if len(single):
        best = -np.log(1 - _uniform(least))
    for i in range(0, len(many), ROWS):
        part, w = many[i : i + ROWS], weight[i : i + ROWS, None]
        x = _drawn(part)
        e = -np.log(1 - _uniform(x))
        f, g = -np.log(_uniform(_mixed(x + C))), -np.log(_uniform(_mixed(x ^ B)))
        c = e + f
        s = np.log(c / e)
        r = s + g
        b = 1 - s / r
        t = np.floor(np.log(w) / r + b)
        a = c * np.exp(-r * (t - b + 1))
        k = a.argmin(axis=0)
        value = a[k, range(SAMPLES)]
        less = value < best
        best = np.where(less, value, best)
        term = np.where(less, part[k], term)
        step = np.where(less, t[k, range(SAMPLES)].astype(np.int64), step)
    return (_mixed(term + step.astype(np.uint64) * C + SEEDS) >> np.uint64(48)).astype(np.uint16)


def _drawn(terms: np.ndarray) -> np.ndarray:
    x = (terms[:, None] ^ SEEDS) * A
    x ^= x >> np.uint64(31)
    x *= B
    return x


def hexadecimal(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col, fingerprint string of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hexadecimal(fingerprint((t.as_py() or "").encode(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    kept = bounded_batches(docs.select(id_col, text_col))
    return kept.mapInArrow(trimmed(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, fingerprint string")


def in_ranges(rows: DataFrame, size: Column, per_range: int) -> DataFrame:
    """``rows`` (id long, h long, ...) dealt by ranges of descending (id, h), with the columns ``deal`` and ``extra``.

    Each range also has, behind its own rows (extra = 1), the first row of the range that follows; the last range has
    that of the first. Only ids, one per range, come to the driver. An id with very many rows is cut by ``h``.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, min(100_000, int(total // per_range)))
    cuts = rows.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    hot: dict[float, int] = {}
    for c in cuts:
        hot[c] = hot.get(c, 0) + 1
    edges = [-float("inf"), *sorted(hot), float("inf")]
    numbered = rows.withColumn("_x", F.col("id").cast("double"))
    if len(edges) > 2:
        numbered = Bucketizer(splits=edges, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(numbered)
        numbered = numbered.withColumn("_b", F.when(F.col("id").isNull(), -1).otherwise(F.col("_b").cast("int")))
    else:
        numbered = numbered.withColumn("_b", F.when(F.col("id").isNull(), -1).otherwise(0))
    wide = {edges.index(c): (c, k) for c, k in hot.items() if k > 1}
    if wide:  # the rows of the hot id, the least of its bucket, are cut by h; the other ids of the bucket come before them
        of_bucket = lambda j: F.create_map(*[F.lit(x) for b, v in wide.items() for x in (b, v[j])])[F.col("_b")]
        share = (F.shiftrightunsigned(F.col("h"), 40).cast("double") + F.when(F.col("h") < 0, -(1 << 23)).otherwise(1 << 23)) / (1 << 24)
        part = F.when(F.col("_x") == of_bucket(0), F.floor(share * of_bucket(1)).cast("int")).otherwise(of_bucket(1))
        numbered = numbered.withColumn("_s", F.coalesce(part, F.lit(0)))
    else:
        numbered = numbered.withColumn("_s", F.lit(0))
    numbered = numbered.drop("_x")
    # One row per range.
    tops = [r[:2] + tuple(r[2]) for r in numbered.groupBy("_b", "_s").agg(F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("i"), "h", "id"))).collect()]
    tops.sort(key=lambda r: (r[0], r[1]), reverse=True)
    # Each row of these two tables stands for one range, so both are small; n bounds them.
    numbers = spark.createDataFrame([(b, s, k) for k, (b, s, *_) in enumerate(tops)], "_b int, _s int, deal int")
    again = spark.createDataFrame([(i, h, (k - 1) % len(tops)) for k, (_, _, _, h, i) in enumerate(tops)], "i long, j long, deal int")
    own = numbered.join(F.broadcast(numbers), ["_b", "_s"]).drop("_b", "_s").withColumn("extra", F.lit(0))
    more = rows.join(F.broadcast(again), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).withColumn("extra", F.lit(1)).select(own.columns)
    dealt = own.unionByName(more).repartitionById(max(1, len(tops)), F.col("deal"))
    return dealt.sortWithinPartitions("deal", "extra", F.col("id").desc_nulls_last(), F.col("h").desc())


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the other text."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, both fingerprints and their likeness, and that to the next document by descending id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = in_ranges(rows, F.octet_length("text"), RANGE).select("deal", "extra", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                deal, extra, key, t = (c[i].as_py() for c in batch.columns)
                if last is not None and last[1] and extra and last[0] == deal:
                    continue
                data = t.encode()
                mark = fingerprint(data)
                if last is not None and last[0] == deal and not last[1]:
                    out.append(_compared(last, t, mark))
                last = (deal, extra, key, t, mark)
            yield _table(out)

    def _compared(row: tuple, other: str, other_mark: np.ndarray) -> tuple:
        _, _, key, t, mark = row
        data = edited(t, other).encode()
        again = fingerprint(data)
        return key, len(t), hashlib.sha256(data).hexdigest(), hexadecimal(mark), hexadecimal(again), likeness(mark, again), likeness(mark, other_mark)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def _table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=names)

    return dealt.mapInArrow(trimmed(run), f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
