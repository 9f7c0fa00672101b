"""Hard negatives by a vector-approximation file.

The file holds every vector twice: as cells (``BITS`` bits a dimension) and as exact codes, in blocks of ``ROWS`` vectors.
For a block of anchors a table says what each cell of each dimension adds to a score at least and at most, so bounds of the
score of any pair are sums of looked-up values. Only pairs whose bounds may enter the answer are scored exactly: for
positives, those whose upper bound reaches the least score among the best found so far (or among the best lower bounds of
the block); for negatives, those whose bounds meet a window and whose upper bound reaches its worst kept score. The answer
is exact whatever the cells are.

The anchors are a stated query set against all rows. Slices of the file (about the square root of its rows) meet chunks of
at most ``CHUNK`` anchors; a task streams the blocks of its slice past its chunk and keeps the few best rows per anchor, which
are merged by anchor. No task holds a slice, and many copies of one vector are only many exact scores.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. Components are
``floor(256 * x)`` as integers, of at most 2**24 either way (larger ones count as that, so scores fit a long); where vectors
have different lengths, what is missing counts as zero. Rows of the anchor's own id are not its positives. Repeated rows
count as often as they occur; an anchor that occurs twice is two anchors. An empty table gives no rows. Other columns take
no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.llm.storage import bounded_batches, trimmed, written

BITS = 6
ROWS = 2048
#: Anchors whose tables are made at a time, and anchors that a task holds.
TABLES, CHUNK = 256, 16_384
#: Vectors, by a hash of their ids, whose quantiles are the borders of the cells. All vectors are filed, and none is beyond them.
SAMPLE = 20_000
SCALE, MOST = 256, 1 << 24
#: Pairs scored exactly at a time.
PAIRS = 16_384
NONE = np.iinfo(np.int64).min


def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """id, label, anchor, codes (int32) of the rows of id, label, anchor, vector that take part."""
    lists = batch.column(3)
    values, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    ends = ends - ends[0]
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.nonzero(bad[ends[1:]] == bad[ends[:-1]])[0]
    with np.errstate(invalid="ignore", over="ignore"):
        codes = np.clip(np.floor(np.where(np.isfinite(flat), flat, 0) * SCALE), -MOST, MOST).astype(np.int32)
    own = batch.take(pa.array(kept))
    return pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([codes[ends[i] : ends[i + 1]].tobytes() for i in kept], pa.binary())], names=["id", "label", "anchor", "codes"])


def matrix(codes: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(codes), dims), np.int64)
    for row, c in zip(out, codes):
        own = np.frombuffer(c, np.int32)
        row[: len(own)] = own
    return out


@dataclass(frozen=True)
class Cells:
    """Of each dimension and cell the least and the greatest code in it: arrays of (dims, cells)."""

    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fitted(sample: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> Cells:
        """Cells of about as many vectors of the sample each, from the least code of all vectors to the greatest."""
        n, parts = len(least), 1 << BITS
        low, high = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        for d in range(n):
            inner = np.unique(np.quantile(sample[:, d], np.arange(1, parts) / parts, method="higher")) if len(sample) else np.zeros(0, np.int64)
            inner = inner[(inner > least[d]) & (inner <= greatest[d])].astype(np.int64)
            first = np.concatenate([[least[d]], inner])
            low[d], high[d] = greatest[d] + 1, greatest[d] + 1  # cells that no code falls into
            low[d, : len(first)] = first
            high[d, : len(first)] = np.concatenate([inner - 1, [greatest[d]]])
        return Cells(low, high)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """(dims, rows)."""
        return np.array([np.searchsorted(low, c, "right") - 1 for low, c in zip(self.low, codes.T)], np.uint8).reshape(len(self.low), len(codes))


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors): the sums of the tables' entries; ``low`` and ``high``: (dims, cells, anchors)."""
    shape = (cells.shape[1], low.shape[2])
    least, most, part = np.zeros(shape, low.dtype), np.zeros(shape, low.dtype), np.empty(shape, low.dtype)
    for c, lo, hi in zip(cells, low, high):
        np.take(lo, c, axis=0, out=part, mode="clip")
        least += part
        np.take(hi, c, axis=0, out=part, mode="clip")
        most += part
    return least, most


def tables(anchors: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """What each cell of each dimension adds to the score of each anchor, at least and at most."""
    a = anchors.T[:, None, :]
    x, y = cells.low[:, :, None] * a, cells.high[:, :, None] * a
    low, high = np.minimum(x, y), np.maximum(x, y)
    wide = np.maximum(abs(low), abs(high)).max(axis=(1, 2)).sum() if low.size else 0
    kind = np.int32 if wide < 2**31 else np.int64
    return low.astype(kind), high.astype(kind)


def scores(codes: np.ndarray, anchors: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", codes[rows[i : i + PAIRS]], anchors[at[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Best:
    """The ``k`` best (score, id) of each of ``n`` lists: higher scores first, then smaller ids."""

    n: int
    k: int
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)
    used: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score = np.full((self.n, self.k), NONE)
        self.id = np.zeros((self.n, self.k), np.int64)
        self.used = np.zeros(self.n, np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        old, slot = np.nonzero(np.arange(self.k) < self.used[touched][:, None])
        old = touched[old]
        lists, score, ids = np.concatenate([old, lists]), np.concatenate([self.score[old, slot], score]), np.concatenate([self.id[old, slot], ids])
        order = np.lexsort((ids, -score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        top = rank < self.k
        self.score[lists[top], rank[top]], self.id[lists[top], rank[top]] = score[top], ids[top]
        self.used[touched] = np.minimum(self.k, np.searchsorted(lists, touched, "right") - np.searchsorted(lists, touched))

    def least(self) -> np.ndarray:
        """The last kept score of full lists, else the least integer."""
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, slot = np.nonzero(np.arange(self.k) < self.used[:, None])
        return at, self.score[at, slot], self.id[at, slot]


@dataclass
class Anchors:
    """Up to ``TABLES`` anchors: their numbers, ids, labels, codes, and the scores and ids of their positives (NONE where there are fewer)."""

    no: np.ndarray
    id: np.ndarray
    label: np.ndarray
    codes: np.ndarray
    positive_score: np.ndarray
    positive_id: np.ndarray


def positives_of(block: tuple[np.ndarray, ...], a: Anchors, cells: Cells, best: Best) -> None:
    ids, labels, where, codes = block
    low, high = bounds(where, *tables(a.codes, cells))
    same = (labels[:, None] == a.label) & (ids[:, None] != a.id)
    need = best.least()
    if len(ids) > best.k:
        own = np.where(same, low, np.iinfo(low.dtype).min)
        sure = np.partition(own, len(ids) - best.k, axis=0)[len(ids) - best.k].astype(np.int64)
        need = np.maximum(need, np.where(sure == np.iinfo(low.dtype).min, NONE, sure))
    rows, at = np.nonzero(same & (high >= need))
    best.add(at, scores(codes, a.codes, rows, at), ids[rows])


def negatives_of(block: tuple[np.ndarray, ...], a: Anchors, cells: Cells, best: list[Best], share: tuple[int, int]) -> None:
    ids, labels, where, codes = block
    low, high = bounds(where, *tables(a.codes, cells))
    other = labels[:, None] != a.label
    windows = []
    wanted = np.zeros(low.shape, bool)
    for p, kept in enumerate(best):
        top = a.positive_score[:, p]
        from_, to = np.where(top == NONE, 1, -(-top * share[0] // share[1])), np.where(top == NONE, 0, top)
        windows.append((from_, to))
        wanted |= (high >= np.maximum(from_, kept.least())) & (low <= to) & (from_ <= to)
    rows, at = np.nonzero(wanted & other)
    found = scores(codes, a.codes, rows, at)
    for (from_, to), kept in zip(windows, best):
        inside = (found >= from_[at]) & (found <= to[at])
        kept.add(at[inside], found[inside], ids[rows[inside]])


def _array(cell, kind, *shape) -> np.ndarray:
    return np.frombuffer(cell, kind).reshape(*shape) if shape else np.frombuffer(cell, kind)


def _row(**values: int | np.ndarray) -> pa.RecordBatch:
    """One row: numbers, and arrays as their bytes."""
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for v in values.values()], names=list(values))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: rows, anchors, and the least and greatest code of every dimension (a shorter vector has zeros)."""
    n = anchors = 0
    low = high = np.zeros(0, np.int64)
    whole = None
    for batch in batches:
        if not len(batch):
            continue
        codes = batch.column("codes").to_pylist()
        lengths = [len(c) // 4 for c in codes]
        dims = max(len(low), *lengths)
        low, high = (np.pad(x, (0, dims - len(x))) for x in (low, high))
        for i in range(0, len(codes), ROWS):
            x = matrix(codes[i : i + ROWS], dims)
            low, high = (x.min(0), x.max(0)) if whole is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
            whole = True
        n, anchors = n + len(batch), anchors + int(np.count_nonzero(batch.column("anchor").to_numpy(zero_copy_only=False)))
    if n:
        yield pa.RecordBatch.from_pylist([{"n": n, "anchors": anchors, "low": low.tobytes(), "high": high.tobytes()}])


FILE = "slice int, ids binary, labels binary, cells binary, codes binary"
QUERY = "chunk int, ids binary, labels binary, nos binary, codes binary, scores binary, positives binary"


@dataclass(frozen=True)
class File:
    """The vector-approximation file of a table: ``blocks`` (a row per block of vectors), the vectors one by one, and the cells."""

    blocks: DataFrame
    vectors: DataFrame
    cells: Cells
    n: int
    n_anchors: int
    slices: int


def build(table: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, label: Column | None = None) -> File:
    """Codes of all vectors, the borders of the cells, and the blocks. ``label``: what counts as the label, if not the column itself."""
    col = lambda c: F.col(f"`{c}`")
    rows = table.select(col(id_col).cast("long").alias("id"), (col(label_col) if label is None else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), col(vector_col).cast("array<double>").alias("vector")).dropna(subset=["id", "label", "vector"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(encoded, batches)

    coded = written(bounded_batches(rows).mapInArrow(trimmed(encode), "id long, label long, anchor boolean, codes binary"), "vectors")
    stats = coded.mapInArrow(_stats, "n long, anchors long, low binary, high binary").collect()
    dims = max((len(s.low) // 8 for s in stats), default=0)
    wide = lambda x: np.pad(_array(x, np.int64), (0, dims - len(x) // 8))
    least, greatest = (np.min([wide(s.low) for s in stats], 0), np.max([wide(s.high) for s in stats], 0)) if stats else (np.zeros(0, np.int64),) * 2
    sample = matrix([r.codes for r in coded.select("codes", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("codes").collect()], dims)
    cells = Cells.fitted(sample, least, greatest)
    n, slices = sum(s.n for s in stats), max(1, math.isqrt(sum(s.n for s in stats) // 128))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                codes = matrix(part.column("codes").to_pylist(), dims)
                yield _row(slice=at % slices, ids=part.column("id").to_numpy(), labels=part.column("label").to_numpy(), cells=cells.of(codes), codes=codes.astype(np.int32))
                at += 1

    blocks = written(coded.mapInArrow(trimmed(pack), FILE), "va-file")
    return File(blocks, coded, cells, n, sum(s.anchors for s in stats), slices)


def _searched(file: File, anchors: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over every slice and chunk: gets the anchors, takes blocks one by one, and gives rows at the end.

    ``anchors`` has no, id, label, codes, scores, positives.
    """
    chunks = max(1, -(-file.n_anchors // CHUNK))
    dims, cells, slices = len(file.cells.low), file.cells, file.slices

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for i in range(0, len(batch), TABLES):
                part = batch.slice(i, TABLES)
                flat = lambda c: part.column(c).flatten().to_numpy()  # noqa: B023, E731
                yield _row(chunk=at % chunks, ids=part.column("id").to_numpy(), labels=part.column("label").to_numpy(), nos=part.column("no").to_numpy(), codes=matrix(part.column("codes").to_pylist(), dims), scores=flat("scores"), positives=flat("positives"))
                at += 1

    queries = anchors.select("no", "id", "label", "codes", "scores", "positives").mapInArrow(pack, QUERY)
    nothing = F.lit(None).cast("binary")
    left = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("slice", "chunk", F.lit(0).alias("kind"), "ids", "labels", "nos", "codes", "scores", "positives", nothing.alias("cells"))
    right = file.blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("slice", "chunk", F.lit(1).alias("kind"), "ids", "labels", nothing.alias("nos"), "codes", nothing.alias("scores"), nothing.alias("positives"), "cells")
    dealt = left.unionByName(right).repartition("slice", "chunk").sortWithinPartitions("slice", "chunk", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (r["slice"], r["chunk"]) != here:
                    if state is not None:
                        yield from state.results()
                    here, state = (r["slice"], r["chunk"]), run(cells)
                ids, labels = _array(r["ids"], np.int64), _array(r["labels"], np.int64)
                if r["kind"] == 0:
                    state.meet(Anchors(_array(r["nos"], np.int64), ids, labels, _array(r["codes"], np.int64, len(ids), dims), _array(r["scores"], np.int64, len(ids), -1), _array(r["positives"], np.int64, len(ids), -1)))
                else:
                    state.take((ids, labels, _array(r["cells"], np.uint8, dims, len(ids)), _array(r["codes"], np.int32, len(ids), dims).astype(np.int64)))
        if state is not None:
            yield from state.results()

    return dealt.mapInArrow(trimmed(search), schema)


class Positives:
    """The best rows of the anchor's label."""

    def __init__(self, cells: Cells, k: int):
        self.cells, self.k = cells, k
        self.held: list[tuple[Anchors, Best]] = []

    def meet(self, anchors: Anchors) -> None:
        self.held.append((anchors, Best(len(anchors.no), self.k)))

    def take(self, block: tuple[np.ndarray, ...]) -> None:
        for a, best in self.held:
            positives_of(block, a, self.cells, best)

    def results(self) -> Iterator[pa.RecordBatch]:
        for a, best in self.held:
            at, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(a.no[at]), pa.array(score), pa.array(ids)], names=["no", "score", "id"])


class Negatives:
    """The best rows of other labels in the window of each positive."""

    def __init__(self, cells: Cells, positives: int, k: int, share: tuple[int, int]):
        self.cells, self.positives, self.k, self.share = cells, positives, k, share
        self.held: list[tuple[Anchors, list[Best]]] = []

    def meet(self, anchors: Anchors) -> None:
        self.held.append((anchors, [Best(len(anchors.no), self.k) for _ in range(self.positives)]))

    def take(self, block: tuple[np.ndarray, ...]) -> None:
        for a, best in self.held:
            negatives_of(block, a, self.cells, best, self.share)

    def results(self) -> Iterator[pa.RecordBatch]:
        for a, best in self.held:
            for p, kept in enumerate(best):
                at, score, ids = kept.rows()
                columns = {"no": a.no[at], "p": np.full(len(at), p, np.int64), "anchor_id": a.id[at], "positive_id": a.positive_id[at, p], "positive_score": a.positive_score[at, p], "negative_score": score, "negative_id": ids}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def mine(table: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score is at most that of the positive and at least ``share`` of it (a fraction: numerator, denominator). Ties go to
    smaller ids.
    """
    file = build(table, anchor, id_col, label_col, vector_col, label)
    best_first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    empty = F.array(*[F.lit(int(NONE)).cast("long")] * positives)
    anchors = written(file.vectors.filter("anchor").withColumn("no", F.monotonically_increasing_id()), "anchors")
    found = _searched(file, anchors.withColumns({"scores": empty, "positives": empty}), lambda cells: Positives(cells, positives), "no long, score long, id long")
    kept = found.withColumn("rank", best_first("no")).filter(F.col("rank") <= positives)
    chosen = kept.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("_p"))
    filled = lambda c: F.slice(F.concat(F.transform("_p", lambda p: p[c]), empty), 1, positives)
    asked = written(anchors.join(chosen, "no").withColumns({"scores": filled("score"), "positives": filled("id")}).drop("_p"), "anchors")
    hard = _searched(file, asked, lambda cells: Negatives(cells, positives, negatives, share), "no long, p long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    rank = F.row_number().over(Window.partitionBy("no", "p").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
