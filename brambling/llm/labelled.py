"""What both classifiers share: which rows they may learn from, words of many texts as arrays, and Adam."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm.bpe import portions
from brambling.llm.storage import bounded_batches, trimmed, written

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """True where the fold of the id is 0. A null id is never learnt from, and not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def learning_rows(labels: DataFrame, label: str, each: int, id_col: str = "doc_id", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """id_col, y: at most ``each`` ids of either class outside the held-out fold, chosen by a hash of the id.

    An id counts once however often it is labelled; one whose labels contradict each other is left out.
    """
    rows = labels.select(F.col(id_col), F.col(label).cast("int").alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col(id_col)))
    agreed = rows.groupBy(id_col).agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    pick = lambda y: agreed.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(each)
    return reduce(DataFrame.unionByName, map(pick, classes))


def texts_of(docs: DataFrame, chosen: DataFrame, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", *more: str) -> list[tuple]:
    """(y, text in UTF-8, *more): one text of each chosen id (of several, that with the least hash), in the order of ids.

    ``chosen`` has a bounded number of rows, so it is broadcast. Of each class the texts come to the driver in the order
    of a hash of the id until the next one would exceed ``most_bytes``; shorter ones behind it are still taken.
    """
    data = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    others = F.struct(*[F.col(c) for c in more]) if more else F.lit(0)
    found = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(data).alias("h"), data.alias("data"), others.alias("more")).alias("row"))
    texts = written(found.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").groupBy("id", "y").agg(F.min("row").alias("row")), "learning-texts")
    left = {0: most_bytes, 1: most_bytes}
    taken = []
    for key, y, n in texts.select("id", "y", F.octet_length("row.data").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if n <= left[y]:
            left[y] -= n
            taken.append(key)
    wanted = docs.sparkSession.createDataFrame([(k,) for k in taken], f"id {texts.schema['id'].dataType.simpleString()}")
    rows = texts.join(F.broadcast(wanted), "id").collect()
    return [(r.y, bytes(r.row.data), *(r.row.more if more else ())) for r in sorted(rows, key=lambda r: r.id)]


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` without the text, and its score."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    data = F.coalesce(F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = bounded_batches(docs).select(F.struct(*others).alias("row"), data.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(pc.binary_length(batch.column(1)).to_numpy()):
                n = part.stop - part.start
                found = score(batch.column(1).slice(part.start, n).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(found.astype(np.float64))], names=["row", "score"])

    return rows.mapInArrow(trimmed(run), f"row {rows.schema['row'].dataType.simpleString()}, score double")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = _LETTER[48:58] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a line feed after each; the first byte of each text, and the end of all."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, np.concatenate([[0], ends])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]


def letter_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(_LETTER[data])


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], lower: bool = True) -> list[np.ndarray]:
    """For each size, a hash of as many first bytes of the words (zero where a word is shorter; the last size: of at most so many)."""
    text = np.concatenate([_LOWER[data] if lower else data, np.zeros(sizes[-1], np.uint8)])
    length = end - start
    h = np.full(len(start), 2166136261, np.uint32)
    out = []
    for i in range(sizes[-1]):
        h = np.where(i < length, (h ^ text[start + i]) * np.uint32(16777619), h)
        if i + 1 in sizes[:-1]:
            out.append(np.where(length > i, h * np.uint32(2654435761) >> np.uint32(7), 0))
    h ^= h >> np.uint32(15)
    return [*out, h * np.uint32(2246822519)]


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.p, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
