"""Quality by positive-unlabelled learning on the surface of whole texts.

A small network is trained to the non-negative unbiased risk: the risk of trusted positives, and that of unlabelled web
text taken as negative less the positives' own part in it, which may not fall below zero. The class prior is the share
of positives among the labelled rows that may be learnt from, smoothed by one row of either class.

The trusted positives are at most ``EACH`` labelled ids (a documented bound); the unlabelled side is every document of
the table outside the held-out fold, and so are the means and scales of the features. Features are made once, in the
tasks, and written. A round of training is one Spark job over them: rows are dealt by a hash into shards whose number
depends on the rows alone; each shard starts from the network of the round before and takes mini-batches of its rows, in
the order of a hash, against positives; the networks of all shards are averaged, weighted by rows. Sums are of whole
numbers (fixed point). So neither partitions nor the order of rows nor a repeated task change a score. What comes to the
driver is one row per parameter, and one feature row per positive.

Cases: null and empty texts have all features at zero; very long texts are read whole, one at a time; without trusted
positives or unlabelled text every score is the prior; null labels and ids whose labels contradict each other are left
out, repeated labels count once, of several texts with one id one is trusted; repeated rows are kept; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.llm import labelled
from brambling.llm.bpe import portions
from brambling.llm.storage import bounded_batches, trimmed, written

EACH = 3_000
HIDDEN, BATCH, RATE, DECAY = 16, 256, 0.01, 1e-4
#: Rounds of training, and mini-batches that a shard takes in one of them at least.
ROUNDS, STEPS = 6, 150
#: Rows of a shard, about, and rows that its network sees at a time.
SHARD, TOGETHER = 8_192, 8_192
BLOCK = 16
_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 beyond ASCII, 5 symbol, 6 comma or full stop
for _k, _codes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256))):
    _KIND[list(_codes)] = _k
_KIND[[44, 46]] = 6


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of kinds of bytes and of odd words, over the whole text and over its worst block of words."""
    data, first = labelled.joined(texts)
    n = np.maximum(np.diff(first) - 1, 1)
    kind = _KIND[data]
    shares = [np.add.reduceat((kind == k).astype(np.int32), first[:-1]) / n for k in range(7)]
    shares[3] -= 1 / n  # the line feed behind each text
    lines = (np.add.reduceat((data == 10).astype(np.int32), first[:-1]) - 1) / n
    start, end = labelled.runs(~labelled.SPACE[data])
    doc = np.searchsorted(first, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    total = np.maximum(words, 1)
    sums = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (0, 1, 4, 5)]
    lower, upper, beyond, symbol = (s[end] - s[start] for s in sums)
    length = end - start
    word = labelled.prefix_hashes(data, start, end, (24,))[0].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    same = np.zeros(len(start), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    odd = [symbol >= 2, (symbol == length), (upper >= 2) & (lower == 0), same, (symbol > 0) & (symbol < 2)]
    pairs = np.unique(doc * (1 << 32) + word) >> 32
    fresh = np.bincount(pairs, minlength=len(texts)) / total
    top = np.cumsum(words) - words
    block = doc * (1 << 30) + (np.arange(len(start)) - top[doc]) // BLOCK if len(start) else np.zeros(0, np.int64)
    blocks, at, held = np.unique(block, return_index=True, return_counts=True)
    owner = blocks >> 30
    out = [*shares, lines, fresh, np.log1p(words) / 10, np.bincount(doc, length, len(texts)) / total / 10]
    for flag in odd:
        out.append(np.bincount(doc, flag, len(texts)) / total)
        worst = np.zeros(len(texts))
        if len(at):
            np.maximum.at(worst, owner, np.add.reduceat(flag.astype(np.float64), at) / held)
        out.append(worst)
    return np.stack(out, axis=1).astype(np.float64) * (words > 0)[:, None]


class PuNet:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale, self.prior = mean, scale, prior
        self.w, self.b = rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN)
        self.v, self.c = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.w, self.b, self.v, self.c)])

    def with_parameters(self, values: np.ndarray) -> PuNet:
        out = PuNet(self.mean, self.scale, self.prior)
        at = 0
        for x in (out.w, out.b, out.v, out.c):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w + self.b)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return labelled.sigmoid(self._hidden(self.scaled(x)) @ self.v + self.c)

    def learn(self, adam: labelled.Adam, p: np.ndarray, u: np.ndarray, steps: int, rng: np.random.Generator) -> None:
        """Mini-batches over the scaled rows ``u``, all of them at least once."""
        done = 0
        while done == 0 or done < steps:
            order = rng.permutation(len(u))
            for at in range(0, len(order), BATCH):
                self._step(adam, p[rng.integers(0, len(p), BATCH)], u[order[at : at + BATCH]])
                done += 1

    def _step(self, adam: labelled.Adam, p: np.ndarray, u: np.ndarray) -> None:
        x = np.concatenate([p, u])
        h = self._hidden(x)
        score = labelled.sigmoid(h @ self.v + self.c)
        sp, su = score[: len(p)], score[len(p) :]
        loss = lambda s: -np.log(np.maximum(1 - s, 1e-12))  # noqa: E731  of a text taken as negative
        negative = loss(su).mean() - self.prior * loss(sp).mean()
        if negative >= 0:
            g = np.concatenate([self.prior * (sp - 1) - self.prior * sp, np.zeros(len(u))]) / len(p)
            g[len(p) :] = su / len(u)
        else:  # the negative part is below zero: step back from it
            g = np.concatenate([self.prior * sp / len(p), -su / len(u)])
        gh = g[:, None] * self.v * (1 - h * h)
        adam.step([x.T @ gh + DECAY * self.w, gh.sum(axis=0), h.T @ g + DECAY * self.v, g.sum(keepdims=True)])


class Constant:
    def __init__(self, value: float):
        self.value = value

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def surface(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, x array<float>: the features of every text."""
    data = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = bounded_batches(docs.select(F.col(id_col), data.alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(pc.binary_length(batch.column(1)).to_numpy()):
                n = part.stop - part.start
                found = features(batch.column(1).slice(part.start, n).to_pylist()).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), lists], names=[id_col, "x"])

    return rows.mapInArrow(trimmed(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


#: Fixed point: sums of whole numbers are the same in whatever order Spark adds them.
POINT = 1 << 24
WHOLE = pa.decimal128(38, 0)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * POINT).astype(np.int64)


def _summed(rows: DataFrame, columns: list[str], per_task: Callable[[Iterator[pa.RecordBatch]], list[int] | None]) -> np.ndarray | None:
    """The sum over all tasks of the vector of whole numbers that ``per_task`` makes of a task's batches; None if no task has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = per_task(b for b in batches if b.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([Decimal(v) for v in total], WHOLE)], names=["k", "value"])

    sums = rows.select(*columns).mapInArrow(trimmed(run), "k int, value decimal(38,0)").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
    return np.array([float(r.value) for r in sums]) if sums else None


def _moments(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
    """Rows, sums and sums of squares (both in fixed point)."""
    total: list[int] | None = None
    for batch in batches:
        x = _matrix(batch.column(0))
        now = [len(x), *map(int, _whole(x).sum(axis=0)), *map(int, _whole(x * x).sum(axis=0))]
        total = now if total is None else [a + b for a, b in zip(total, now)]
    return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and up to ``TOGETHER`` of its rows, in order, however Arrow cut them."""
    shard, held, n = None, [], 0
    for batch in batches:
        shards, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
        at = 0
        while at < len(x):
            if shards[at] != shard and n:
                yield shard, np.concatenate(held)
                held, n = [], 0
            shard = int(shards[at])
            stop = min(int(np.searchsorted(shards, shard, "right")), at + TOGETHER - n)
            held.append(x[at:stop])
            n, at = n + stop - at, stop
            if n == TOGETHER:
                yield shard, np.concatenate(held)
                held, n = [], 0
    if n:
        yield shard, np.concatenate(held)


def _round(net: PuNet, positive: np.ndarray, number: int) -> Callable[[Iterator[pa.RecordBatch]], list[int] | None]:
    """A task's part of a round: every shard trains a network of its own on its rows; their parameters times their rows, and the rows."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
        total: list[int] | None = None
        here = own = adam = rng = None
        rows = 0

        def ended() -> list[int]:
            now = [int(v) * rows for v in _whole(own.parameters())] + [rows]
            return now if total is None else [a + b for a, b in zip(total, now)]

        for shard, x in _blocks(batches):
            if shard != here:
                total = ended() if rows else total
                here, rows = shard, 0
                own = net.with_parameters(net.parameters())
                adam = labelled.Adam([own.w, own.b, own.v, own.c], RATE / (1 + number / 2))
                rng = np.random.default_rng([number, shard])
            own.learn(adam, positive, net.scaled(x), 0 if rows else STEPS, rng)
            rows += len(x)
        return ended() if rows else total

    return per_task


def _dealt(web: DataFrame, id_col: str, n: int) -> DataFrame:
    """shard, x: rows dealt by a hash of the id and their features into shards whose number depends on the rows alone, each in the order of a hash."""
    shards = max(8, 1 << (n // SHARD).bit_length())
    keyed = web.select(F.pmod(F.xxhash64(id_col, "x"), F.lit(shards)).cast("int").alias("shard"), F.hash("x", id_col).alias("h"), "x")
    return keyed.repartition("shard").sortWithinPartitions("shard", "h", "x").select("shard", "x")


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> PuNet | Constant:
    """The network for the written rows of ``surface``."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~labelled.held_out(F.col(id_col)))
    ones, n = known.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, 1)), F.lit(0)), F.count(F.lit(1))).first()
    prior = (ones + 1) / (n + 2)
    trusted = labelled.learning_rows(labels, label, EACH, id_col, classes=(1,))
    found = rows.join(F.broadcast(trusted.select(id_col)), id_col).groupBy(id_col).agg(F.min("x").alias("x")).orderBy(id_col).collect()
    web = rows.filter(F.col(id_col).isNotNull() & ~labelled.held_out(F.col(id_col)))
    sums = _summed(web, ["x"], _moments)
    if not found or sums is None:
        return Constant(prior)
    mean, square = np.split(sums[1:] / sums[0] / POINT, 2)
    net = PuNet(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3, prior)
    positive = net.scaled(np.array([r.x for r in found], np.float64))
    for number in range(ROUNDS):
        total = _summed(_dealt(web, id_col, int(sums[0])), ["shard", "x"], _round(net, positive, number))
        net = net.with_parameters(total[:-1] / total[-1] / POINT)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> PuNet | Constant:
    return fit(written(surface(docs, id_col, text_col), "surface"), labels, id_col, label)


def score_surface(rows: DataFrame, net: PuNet | Constant, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score: how likely label 1 is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(_matrix(batch.column(1))))], names=[id_col, "score"])

    scored = rows.select(id_col, "x").mapInArrow(trimmed(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(id_col, labelled.held_out(F.col(id_col)).alias("held_out"), "score")


def score_documents(docs: DataFrame, net: PuNet | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score: how likely label 1 is."""
    return score_surface(surface(docs, id_col, text_col), net, id_col)
