"""Benchmark decontamination by suffix arrays of the training text.

Every batch of documents is a shard: its words become numbers (words that no item has are all zero), a suffix array
orders the suffixes of the shard by their next words, and every test suffix is found in it by binary search. The run
of equal suffixes gives all verbatim places of the window; places are merged into spans of words, and each place where
a match begins is followed to its end, which gives the longest verbatim match of a document with an item and where it
lies in both.

A suffix whose first two words do not follow each other in any item cannot match and is left out of the array (but for
items of one word). The items are a stated query set: they are read in blocks of at most ``BLOCK_CHARS`` characters,
each block is sent to the tasks, and all documents are searched for it; the blocks are chained, so any number of items
works. A longer item is a block of its own.

Cases: null text has no words; an item without words matches nothing; an item shorter than the window is one window;
repeated rows (documents or items) are kept or harmless; ids of items are returned as strings; a null item id is left
out of the lists but its words still hit; texts of any length are taken whole, with the batch that they come in; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm.storage import bounded_batches, trimmed

BLOCK_CHARS = 8_000_000
#: Lower-cases A-Z and turns every other ASCII character than digits and letters into a space.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
PAIR_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TestSuffixes:
    """The windows of a block of items, numbered and packed for comparison with suffixes of a shard."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        split = [(i, words_of((t or "").encode())) for i, t in items]
        self.window = window
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        bits = max(1, len(self.ids).bit_length())
        self.per, self.bits = 63 // bits, bits
        self.keys = -(-window // self.per)
        found: dict[tuple[int, ...], set[str]] = {}
        places: dict[tuple[int, ...], list[int]] = {}
        flat: list[int] = []
        self.names, self.begins = [i for i, _ in split], np.zeros(len(split) + 1, np.int64)
        for k, (item, ws) in enumerate(split):
            n = [self.ids[w] for w in ws]
            for s in range(max(1, len(n) - window + 1) if n else 0):
                found.setdefault(tuple(n[s : s + window]), set()).update([item] if item is not None else [])
                places.setdefault(tuple(n[s : s + window]), []).append(len(flat) + s)
            flat += [*n, -1]
            self.begins[k + 1] = len(flat)
        self.items = [sorted(x) for x in found.values()]
        # The words of all items in a row (-1 apart) and, window after window, where each one begins in it.
        self.flat = np.array([*flat, -1], np.int64)
        self.at_window = np.cumsum([0, *map(len, places.values())])
        self.at_flat = np.array([x for p in places.values() for x in p], np.int64)
        self.lengths = np.array([len(w) for w in found], np.int64)
        pad = lambda fill: np.array([w + (fill,) * (window - len(w)) for w in found], np.int64).reshape(len(found), window)
        self.low, self.high = self.pack(pad(0)), self.pack(pad((1 << bits) - 1))
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.single = np.zeros(len(self.ids) + 1, bool)
        for w in found:
            if len(w) > 1:
                self.pairs[self.pair(np.int64(w[0]), np.int64(w[1]))] = True
            else:
                self.single[w[0]] = True

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & ((1 << PAIR_BITS) - 1)

    def pack(self, words: np.ndarray) -> list[np.ndarray]:
        """Keys of ``per`` words each, whose order is that of the words."""
        out = []
        for k in range(self.keys):
            key = np.zeros(len(words), np.int64)
            for j in range(k * self.per, (k + 1) * self.per):
                key = (key << self.bits) | (words[:, j] if j < words.shape[1] else 0)
            out.append(key)
        return out

    def suffix_array(self, shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of the shard in the order of the words that begin there, and their keys."""
        ids = np.concatenate([shard, np.zeros(self.window + 1, np.int64)])
        a, b = ids[: len(shard)], ids[1 : len(shard) + 1]
        at = np.nonzero((a > 0) & (self.single[a] | (self.pairs[self.pair(a, b)] & (b > 0))))[0]
        keys = self.pack(ids[at[:, None] + np.arange(self.window)])
        order = np.lexsort(keys[::-1])
        return at[order], [k[order] for k in keys]

    @staticmethod
    def search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search of all wanted suffixes at once."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted):
                v = k[mid]
                less |= same & (v < w)
                same &= v == w
            step = open_ & (less | (same & right))
            lo, hi = np.where(step, mid + 1, lo), np.where(open_ & ~step, mid, hi)
        return lo

    def places(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every verbatim occurrence."""
        array, keys = self.suffix_array(shard)
        if not len(array) or not len(self.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.search(keys, self.low, False), self.search(keys, self.high, True)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        at = array[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return at, window


    def longest(self, shard: np.ndarray, doc: np.ndarray, at: np.ndarray, window: np.ndarray) -> dict[int, list[tuple]]:
        """Per document of the matches: (item, length, place in the shard, place in the item) of the longest one of each item."""
        n = self.at_window[window + 1] - self.at_window[window]
        of = np.repeat(np.arange(len(at)), n)
        item_at = self.at_flat[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at_window[window], n)]
        place, length = at[of], self.lengths[window[of]]
        ids = np.concatenate([shard, np.zeros(1, np.int64)])
        first = (place == 0) | (ids[place - 1] != self.flat[item_at - 1])  # no match goes on to the left of it
        of, item_at, place, length = of[first], item_at[first], place[first], length[first].copy()
        live = np.arange(len(of))
        while len(live):
            word = self.flat[item_at[live] + length[live]]
            live = live[(word > 0) & (ids[np.minimum(place[live] + length[live], len(shard))] == word)]
            length[live] += 1
        item = np.searchsorted(self.begins, item_at, "right") - 1
        order = np.lexsort((item_at, place, -length, item, doc[of]))
        keys = np.stack([doc[of], item])[:, order]
        head = order[np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])] if len(order) else order
        out: dict[int, list[tuple]] = {}
        for k in head.tolist():
            out.setdefault(int(doc[of[k]]), []).append((self.names[item[k]], int(length[k]), int(place[k]), int(item_at[k] - self.begins[item[k]])))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    kept = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    n = 1 + int((kept.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK_CHARS)
    for k in range(n):
        yield [tuple(r) for r in kept.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def _search(tests: TestSuffixes, texts: list[bytes | None], follow: bool = False) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[tuple]]]:
    """Words per document, its first place in the shard, the covered places, (document, window) of all matches, and the longest ones."""
    get, shard, counts = tests.ids.get, [], []
    for t in texts:
        ws = words_of(t or b"")
        counts.append(len(ws))
        shard += [np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)), np.zeros(1, np.int64)]
    ids = np.concatenate(shard) if shard else np.zeros(0, np.int64)
    first = np.cumsum([0] + [c + 1 for c in counts[:-1]]) if counts else np.zeros(0, np.int64)
    at, window = tests.places(ids)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.lengths[window] if len(at) else at, -1)
    doc = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(np.stack([doc, window], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return counts, first, np.cumsum(edge)[:-1] > 0, pairs[:, 0], pairs[:, 1], tests.longest(ids, doc, at, window) if follow and len(at) else {}


SPANS = "array<struct<start: int, end: int>>"
LONGEST = "array<struct<item: string, n_words: int, doc_word: int, item_word: int>>"


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """id_col, n_words long, spans (half-open, in words, merged), items array<string>: items with an occurring window, longest: per item the longest verbatim match and where it begins."""
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.encode(text_col, "UTF-8").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"), F.array().cast(LONGEST).alias("longest"))
    for block in _blocks(items, item_id, item_text):
        rows = rows.mapInArrow(trimmed(_matcher(TestSuffixes(block, window), id_col)), f"`{id_col}` {kind}, text binary, n_words long, spans {SPANS}, items array<string>, longest {LONGEST}")
    return rows.drop("text")


def _matcher(tests: TestSuffixes, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, had, longest = (batch.column(k).to_pylist() for k in (3, 4, 5))
            counts, first, covered, doc, win, found = _search(tests, batch.column(1).to_pylist(), follow=True)
            for k, matches in found.items():
                longest[k] += [{"item": i, "n_words": n, "doc_word": at - int(first[k]), "item_word": p} for i, n, at, p in matches]
            for k, old in enumerate(before):
                for s in old:
                    covered[first[k] + s["start"] : first[k] + s["end"]] = True
            step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
            owner = np.searchsorted(first, starts, "right") - 1
            spans: list[list[dict]] = [[] for _ in counts]
            for k, a, b in zip(owner.tolist(), (starts - first[owner]).tolist(), (ends - first[owner]).tolist()):
                spans[k].append({"start": a, "end": b})
            items = [set(x) for x in had]
            for k, w in zip(doc.tolist(), win.tolist()):
                items[k].update(tests.items[w])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field(3).type), pa.array([sorted(x) for x in items], batch.schema.field(4).type), pa.array(longest, batch.schema.field(5).type)],
                names=[id_col, "text", "n_words", "spans", "items", "longest"],
            )

    return run


def words_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; all columns stay."""
    bounded_batches(docs)
    place = docs.columns.index(text_col)

    def filtered(tests: TestSuffixes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[_search(tests, [None if t is None else t.encode() for t in batch.column(place).to_pylist()])[3]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(trimmed(filtered(TestSuffixes(block, window))), docs.schema)
    return docs
