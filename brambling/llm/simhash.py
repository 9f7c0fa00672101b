"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves by a binary trie.

Bits that differ in few places agree on several blocks. So the trie is laid out once per choice of blocks (a view), with
the bits of these blocks on top: whoever differs there lies in another subtree, and the subtrees are dealt over the
tasks. The more fingerprints there are, the more blocks are put on top, so that subtrees stay small (``_views``). In a
subtree node pairs are walked together from the first free bit down; a pair carries the number of bits that already
differ and is dropped as soon as it exceeds the budget. What meets at the leaves is kept as a spanning forest, never as
all pairs, so a group of many near copies gives as many links as it has members.

``near_duplicates`` links 64-bit fingerprints by a budget of differing bits. ``keep_one`` asks for a similarity instead:
64 bits are too few to tell 0.8 from less, so it takes wide fingerprints of distinct shingles, walks the trie over bands
of them (``_bands`` picks their width from the number of documents and their number from the share of pairs at the
similarity that must meet). What the whole width estimates to be ``CERTAIN`` above the similarity links at once. What is
``MARGIN`` above it makes a spanning forest, whose links are then settled by the texts. What is nearer to the similarity,
on either side, is settled by the texts too, unless its ends hang together by better links. Where a document has more
than ``BUSY`` such pairs in a subtree, they are no rows: who hangs together by them is a crowd, whose members are rows, and
crowds of all subtrees that share a member are one. The shingles of a crowd are compared whole, all its groups with each
other, in tiles (``_met``). Other pairs stay: first one pair of every group, then, of what these joined no group of, all.

Copies share a fingerprint and take part once. A subtree that holds more than ``SUBTREE`` fingerprints is cut into
tiles; every pair of tiles is walked in its own task, so nothing is lost and nothing grows past a task.

Cases: null text is an empty one; texts without words have fingerprint zero and link like any other; fewer words than
the shingle give one shingle; texts of any length are taken whole; repeated rows are kept (each with the same
component); a null id is kept with a component like any other but never names one unless all ids of it are null; an
empty table gives an empty result; ``near_duplicates`` drops other columns, ``keep_one`` keeps them, whatever their
names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm.storage import bounded_batches, trimmed, written

SEED = 42
#: Fingerprints of one subtree that a task walks at once, of small ones that it walks together, node pairs that it holds, and links before it folds them.
SUBTREE, TOGETHER, FRONTIER, LINKS = 65_536, 16_384, 1 << 16, 1 << 17
#: Wide fingerprints: words of 64 bits that are compared whole, the share of pairs at the similarity that bands must bring together, how far from it an estimate (its standard deviation is below 0.04) says little, and how far above it is as good as certain.
WORDS, MEETING, MARGIN, CERTAIN = 8, 0.97, 0.08, 0.14
#: Possible pairs that a document has in a subtree before it and its partners are a crowd, and shingles of a tile of a crowd.
BUSY, TILE = 4, 1 << 17
#: Eight lanes of one byte: the bits of a byte, spread, so that up to 255 of them add up side by side.
#: Shingles whose bits are counted at once.
PORTION = 255 << 4
#: What sets the mixings of a hash apart.
STEPS = np.arange(1 << 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & 1) @ (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64))


def _shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n)


def _majority(hashes: np.ndarray, words: int = 0) -> np.ndarray:
    """The bits that are set in over half the hashes, or in over half of what ``words`` mixings make of them."""
    columns = max(1, words)
    counts = np.zeros(64 * columns, np.int64)
    for at in range(0, len(hashes), PORTION):
        part = hashes[at : at + PORTION, None]
        lanes = SPREAD[np.ascontiguousarray(_mixed(part + STEPS[:words]) if words else part).view(np.uint8)]
        full = len(lanes) // 255 * 255
        sums = np.concatenate([lanes[:full].reshape(-1, 255, 8 * columns).sum(axis=1), lanes[full:].sum(axis=0, keepdims=True)])
        counts += np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64 * columns).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    return int(_majority(_shingle_hashes(text, shingle, seed))[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: bytes, shingle: int, words: int, seed: int = SEED) -> tuple[int, np.ndarray]:
    """How many different shingles there are, and ``words`` times 64 bits of them."""
    hashes = np.unique(_shingle_hashes(text, shingle, seed))
    return len(hashes), _majority(hashes, words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id_col, fp long: the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kept = bounded_batches(docs.select(id_col, F.encode(text_col, "UTF-8").alias("text")))
    return kept.mapInArrow(trimmed(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, fp long")


class Forest:
    """Links among n rows, folded now and then into a spanning forest: certain links (3) first, then likely ones (2).

    Pairs that are only possible (1) join nothing: each stays, unless better links connect its ends. A row with more than
    ``BUSY`` of them gives them up and is in one ``cell`` with its partners, so no more than BUSY pairs a row ever stay.
    """

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.cell = np.arange(n)
        self.held: dict[int, list[np.ndarray]] = {3: [], 2: [], 1: []}
        self.kept: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, grade: np.ndarray) -> None:
        for g in self.held:
            mine = grade == g
            if mine.any():
                self.held[g].append(np.stack([a[mine], b[mine]]))
                self.size += int(mine.sum())
        if self.size >= LINKS:
            self.fold()

    def fold(self) -> None:
        root = self.root
        for g, held in self.held.items():
            if not held:
                continue
            a, b = np.concatenate(held, axis=1)
            if g == 1:
                apart = (root[a] != root[b]) & (self.cell[a] != self.cell[b])
                a, b = a[apart], b[apart]
                one = np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b))
                a, b = one // len(root), one % len(root)
                busy = np.bincount(np.concatenate([a, b]), minlength=len(root)) > BUSY
                crowded = busy[a] | busy[b]
                self.cell, _ = _spanned(self.cell, a[crowded], b[crowded])
                apart = self.cell[a] != self.cell[b]
                held[:] = [np.stack([a[apart], b[apart]])]
                continue
            root, span = _spanned(root, a, b)
            self.kept.append(np.concatenate([span, np.full((1, span.shape[1]), g)]))
            held.clear()
        self.root, self.size = root, 0

    def links(self) -> np.ndarray:
        """Rows a, b, grade of the links that span what hangs together, and of the possible pairs."""
        self.fold()
        possible = [np.stack([a, b, np.ones(len(a), np.int64)]) for a, b in self.held[1]]
        return np.concatenate([*self.kept, *possible], axis=1) if self.kept or possible else np.zeros((3, 0), np.int64)

    def crowds(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share a cell with others, and their cells."""
        self.fold()
        inside = np.nonzero(np.bincount(self.cell)[self.cell] > 1)[0]
        return inside, self.cell[inside]


def _spanned(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots once the links a, b have joined them, and rows a, b of those links that did."""
    span = [np.zeros((2, 0), np.int64)]
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root, np.concatenate(span, axis=1)
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        root[high[first]] = low[first]
        span.append(np.stack([a[first], b[first]]))
        while not np.array_equal(up := root[root], root):
            root = up


#: For two arrays of places: 0 where they do not link, 3 or 2 where they do for certain or likely, 1 where they may.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def walk(keys: np.ndarray, pairs: np.ndarray, depth: int, width: int, budget: int, near: Near, forest: Forest) -> None:
    """Walks pairs of nodes of the trie over the first ``width`` bits of the sorted ``keys`` and links the leaves that are ``near``.

    pairs: rows (a from, a to, b from, b to) of nodes of one depth.
    """
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, pairs, np.zeros(len(pairs), np.int8))]
    while todo:
        d, p, off = todo.pop()
        if len(p) > FRONTIER:
            half = len(p) // 2
            todo += [(d, p[:half], off[:half]), (d, p[half:], off[half:])]
            continue
        alone = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        if alone.any():
            i, j = p[alone, 0], p[alone, 2]
            i, j = i[i != j], j[i != j]
            forest.add(i, j, near(i, j))
            p, off = p[~alone], off[~alone]
        if not len(p):
            continue
        if d == width:
            _leaves(p, near, forest)
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
        c = ones[d]
        a0, a1, b0, b1 = p.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        below = [((a0, am, b0, bm), off), ((am, a1, bm, b1), off), ((a0, am, bm, b1), off + 1), ((am, a1, b0, bm), np.where(same, budget + 1, off + 1))]
        nodes = np.concatenate([np.stack(x, axis=1) for x, _ in below])
        off = np.concatenate([y for _, y in below]).astype(np.int8)
        live = (off <= budget) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])
        todo.append((d + 1, nodes[live], off[live]))


def _leaves(pairs: np.ndarray, near: Near, forest: Forest) -> None:
    """Links within pairs of nodes whose walked bits say nothing more: small ones at once, large ones leader by leader."""
    many = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    size = many[0] * many[1]
    for a0, a1, b0, b1 in pairs[size > 4096].tolist():
        rows = np.arange(a0, a1) if a0 == b0 else np.concatenate([np.arange(a0, a1), np.arange(b0, b1)])
        of = np.arange(len(rows))
        second = 0 if a0 == b0 else a1 - a0
        for k in range(a1 - a0):  # what already hangs together needs no more looks
            apart = second + np.nonzero(of[second:] != of[k])[0]
            apart = apart[apart > k]
            found = near(np.full(len(apart), rows[k]), rows[apart])
            forest.add(np.full(len(apart), rows[k]), rows[apart], found)
            linked = apart[found == 2]
            if len(linked):
                of[np.isin(of, np.unique(of[linked]))] = of[k]
                if (of == of[0]).all():
                    break
    pairs, size = pairs[size <= 4096], size[size <= 4096]
    ends = np.cumsum(size)
    at = 0
    while at < len(pairs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
        p, n = pairs[at:stop], size[at:stop]
        of = np.repeat(np.arange(len(p)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        wide = (p[:, 3] - p[:, 2])[of]
        i, j = p[of, 0] + k // wide, p[of, 2] + k % wide
        once = (p[of, 0] != p[of, 2]) | (i < j)
        i, j = i[once], j[once]
        forest.add(i, j, near(i, j))
        at = stop


def _views(width: int, budget: int, n: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """How many bits in front must agree, and ways to lay out ``width`` bits with them in front: lists of (first bit, bits).

    Of k blocks at least k - budget agree. With more blocks more bits agree but more choices have to be tried; the
    number of blocks is that which sends the fewest rows, when subtrees of over ``SUBTREE`` are cut into tiles.
    """
    found = []
    for k in range(budget + 1, min(width, budget + 5) + 1):
        edges = [round(width * i / k) for i in range(k + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        top = sum(sorted(w for _, w in blocks)[: k - budget])
        views = [[*c, *[b for b in blocks if b not in c]] for c in itertools.combinations(blocks, k - budget)]
        found.append((len(views) * max(1.0, n / 2**top / (SUBTREE // 2)), top, views))
    return min(found, key=lambda x: x[0])[1:]


def _laid_out(key: Column, view: list[tuple[int, int]]) -> Column:
    """The bits of ``key`` in the order of the view."""
    out, at = F.lit(0).cast("long"), 0
    for first, bits in view:
        part = F.shiftrightunsigned(F.shiftleft(key, first), 64 - bits)
        out = out.bitwiseOR(F.shiftleft(part, 64 - at - bits))
        at += bits
    return out


def _trie_links(nodes: DataFrame, keys: list[tuple[Column, int]], budget: int, n: int, near: Callable[[list[np.ndarray]], Near], payload: list[str]) -> DataFrame:
    """src, dst long, grade int: links among ``nodes`` (node, payload long ...) that connect all pairs which one of the ``keys`` brings together; of grade 0, who is in one crowd.

    keys: columns and how many of their first bits are walked. ``near`` gets the payload of the rows of a task and gives
    the check of pairs of them.
    """
    width = keys[0][1]
    depth, views = _views(width, budget, n)
    laid = [F.struct(F.lit(i * len(views) + k).alias("view"), _laid_out(key, v).alias("key")) for i, (key, _) in enumerate(keys) for k, v in enumerate(views)]
    rows = nodes.select("node", *payload, F.explode(F.array(*laid)).alias("t")).select("t.view", F.shiftrightunsigned("t.key", 64 - depth).alias("top"), "t.key", "node", *payload)
    # A subtree that is cut holds over SUBTREE rows, so this table has at most one row in SUBTREE.
    sizes = rows.groupBy("view", "top").count().filter(F.col("count") > SUBTREE).select("view", "top", F.ceil(F.col("count") / (SUBTREE // 2)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    group = ["view", "top", "low", "high"]
    dealt = (
        rows.join(F.broadcast(sizes), ["view", "top"], "left")
        .withColumn("tile", F.when(F.col("tiles").isNull(), 0).otherwise(tile))
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(other)))
        .select("view", "top", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "key", "node", *payload)
        .repartition(*group)
        .sortWithinPartitions(*group)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= TOGETHER:
                rows = np.concatenate(held, axis=1)
                last = np.nonzero((rows[:4] != rows[:4, -1:]).any(axis=0))[0]
                if len(last):
                    yield links(rows[:, : last[-1] + 1])
                    rows = rows[:, last[-1] + 1 :]
                held, size = [rows], rows.shape[1]
        if size:
            yield links(np.concatenate(held, axis=1))

    def links(rows: np.ndarray) -> pa.RecordBatch:
        """rows: view, top, low, high, tile, key, node, payload. Whole subtrees (or pairs of tiles)."""
        unsigned = rows[5].view(np.uint64)
        order = np.lexsort((unsigned, rows[4], rows[3], rows[2], rows[1], rows[0]))
        rows, walked = rows[:, order], unsigned[order]
        node = np.concatenate([[True], (rows[:5, 1:] != rows[:5, :-1]).any(axis=0)])
        starts = np.nonzero(node)[0]
        ends = np.append(starts[1:], len(walked))
        whole = rows[2, starts] == rows[3, starts]
        pairs = [np.stack([starts[whole], ends[whole]] * 2, axis=1)]
        cut = np.nonzero(~whole)[0]  # pairs of tiles lie side by side, when both have rows
        cut = cut[:-1][(rows[:4, starts[cut[:-1]]] == rows[:4, starts[cut[1:]]]).all(axis=0)] if len(cut) else cut
        pairs.append(np.stack([starts[cut], ends[cut], starts[cut + 1], ends[cut + 1]], axis=1) if len(cut) else np.zeros((0, 4), np.int64))
        forest = Forest(len(walked))
        walk(walked, np.concatenate(pairs), depth, width, budget, near(list(rows[6:])), forest)
        a, b, grade = forest.links()
        inside, cell = forest.crowds()
        first = np.full(len(walked), np.iinfo(np.int64).max)  # the least member names a crowd, so that crowds of many subtrees agree
        np.minimum.at(first, cell, rows[6, inside])
        src, dst = np.concatenate([rows[6, a], rows[6, inside]]), np.concatenate([rows[6, b], first[cell]])
        grade = np.concatenate([grade, np.zeros(len(inside), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(grade, pa.int32())], names=["src", "dst", "grade"]).filter(pa.array(src != dst))

    return dealt.mapInArrow(trimmed(run), "src long, dst long, grade int")


def near_links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """src, dst long: for each group of fingerprints (fp long) within ``budget`` bits in a subtree, links that connect it."""

    def near(payload: list[np.ndarray]) -> Near:
        bits = payload[0].view(np.uint64)
        return lambda i, j: (np.bitwise_count(bits[i] ^ bits[j]) <= budget) * 2

    n = distinct.count()
    return _trie_links(distinct.select(F.col("fp").alias("node")), [(F.col("node"), 64)], budget, n, near, []).select("src", "dst")


def bit_error(similarity: float) -> float:
    """The chance that a bit differs for two sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _bands(similarity: float, n: int) -> tuple[int, int, int]:
    """Bits of a band, budget of differing bits in it, number of bands.

    A band is so wide that a document meets few unlike ones, whatever their number; there are so many that a pair at the
    similarity agrees within the budget on one of them with the chance MEETING.
    """
    width = min(60, 6 + max(10, (max(n, 1) - 1).bit_length()))
    budget = max(1, round(width / 12))
    p = bit_error(similarity)
    meet = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(budget + 1))
    return width, budget, math.ceil(math.log(1 - MEETING) / math.log(1 - meet))


def similar_links(nodes: DataFrame, similarity: float, bands: tuple[int, int, int], n: int) -> DataFrame:
    """src, dst long, grade int: links that span the ``nodes`` (node, n_shingles long, words array<long>) which are likely similar, pairs that may be, and crowds of them."""
    width, budget, number = bands
    per = 64 // width
    keys = [(F.shiftleft(F.element_at("words", i // per + 1), i % per * width), width) for i in range(number)]
    payload = ["n_shingles", *[f"c{k}" for k in range(WORDS)]]

    def near(columns: list[np.ndarray]) -> Near:
        size, bits = columns[1].astype(np.float64), np.stack(columns[2:], axis=1).view(np.uint64)

        def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), np.int8)
            a, b = size[i], size[j]
            may = np.nonzero(np.minimum(a, b) >= similarity * np.maximum(a, b))[0]  # no smaller set can be similar
            i, j, a, b = i[may], j[may], a[may], b[may]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            both = np.cos(np.pi * differ / (64 * WORDS)) * np.sqrt(a * b)
            rest = a + b - both
            out[may] = sum((both >= (similarity + off) * rest).astype(np.int8) for off in (-MARGIN, MARGIN, CERTAIN))
            return out

        return check

    rows = nodes.select("node", "n_shingles", "words", *[F.element_at("words", k + 1).alias(f"c{k}") for k in range(WORDS)])
    return _trie_links(rows, keys, budget, n, near, payload)


def _settled(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``links`` (a, b, x, y) whose texts (node, text) of a and b have the Jaccard similarity; x and y only pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pair in batch.column(2).to_pylist():
                a, b = (np.unique(_shingle_hashes((t or "").encode(), shingle, SEED)) for t in pair)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    ends = links.select("a", "b", "x", "y", F.explode(F.array("a", "b")).alias("node")).join(texts, "node")
    pairs = ends.groupBy("a", "b").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.collect_list("text").alias("pair"))
    return bounded_batches(pairs.select("x", "y", "pair")).mapInArrow(trimmed(run), "x long, y long")


def _met(group: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, second: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of groups that link by the sets of their rows, as many as join them: rows before ``second`` with those from it on, all rows with each other if it is 0.

    sizes: how many of the ``shingles``, which lie row after row, are of each row.
    """
    n = len(group)
    of = np.repeat(np.arange(n), sizes)
    _, number, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count[number] > 1  # what one row has alone is in no intersection
    number = number[shared]
    ends = np.cumsum(np.bincount(of[shared], minlength=n))
    starts = np.append(0, ends[:-1])
    now, mine, pairs = group.copy(), np.zeros(len(count), bool), []
    for k in range(second or n):
        after = max(k + 1, second)
        rest = after + np.nonzero((now[after:] != now[k]) & (np.minimum(sizes[after:], sizes[k]) >= similarity * np.maximum(sizes[after:], sizes[k])))[0]
        if not len(rest):
            continue
        mine[number[starts[k] : ends[k]]] = True
        if 4 * len(rest) > n - after:
            sums = np.append(0, np.cumsum(mine[number[starts[after] :]]))
            both = sums[ends[rest] - starts[after]] - sums[starts[rest] - starts[after]]
        else:
            many = ends[rest] - starts[rest]
            stops = np.cumsum(many)
            sums = np.append(0, np.cumsum(mine[number[np.arange(many.sum()) + np.repeat(starts[rest] - stops + many, many)]]))
            both = sums[stops] - sums[stops - many]
        mine[number[starts[k] : ends[k]]] = False
        found = rest[both >= similarity * (sizes[rest] + sizes[k] - both)]
        if len(found):
            joined, first = np.unique(now[found], return_index=True)
            pairs += [(int(group[k]), int(g)) for g in group[found[first]]]
            now[np.isin(now, joined)] = now[k]
    return pairs


def _members(links: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """cell, node, root long, tiles int: who is in a crowd (``links`` a, b) that more than one group has members in."""
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("node", F.col("root").alias("cell"))
    every = found.unionByName(found.select(F.col("cell").alias("node"), "cell").distinct())
    known = every.join(nodes.select("node", "n_shingles"), "node").join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"), "n_shingles")
    sizes = known.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n_shingles").alias("n")).filter("low <> high")
    return known.join(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int").alias("tiles")), "cell").select("cell", "node", "root", "tiles")


def _crowd_links(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """x, y long: pairs that join the groups (root) of a crowd's ``members`` of which any two texts (node, text) have the Jaccard similarity.

    A crowd is cut into tiles of about ``TILE`` shingles; every pair of tiles is compared in one place, so a member is there
    once for each tile of its crowd.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(t or b"", shingle, SEED)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
            cuts = (np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist()
            if cuts:
                yield links([rows.slice(a, b - a) for a, b in zip([0, *cuts], cuts)])
                held = rows.slice(cuts[-1]).to_batches()
        if held:
            yield links([pa.Table.from_batches(held)])

    def links(parts: list[pa.Table]) -> pa.RecordBatch:
        pairs = []
        for part in parts:
            tile, group, sets = (part.column(k).combine_chunks() for k in (3, 4, 5))
            tile = tile.to_numpy()
            if part.column(1)[0] == part.column(2)[0]:
                second = 0
            elif tile[0] == tile[-1]:  # the other tile has no rows
                continue
            else:
                second = int(np.searchsorted(tile, tile[-1]))
            pairs += _met(group.to_numpy(), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), sets.flatten().to_numpy(), second, similarity)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["x", "y"])

    sets = bounded_batches(texts.select("node", F.encode("text", "UTF-8").alias("text"))).mapInArrow(trimmed(hashed), "node long, shingles array<long>")
    place = ["cell", "low", "high"]
    dealt = (
        members.join(sets, "node")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("cell", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "root", "shingles")
        .repartition(*place)
        .sortWithinPartitions(*place, "tile")
    )
    return dealt.mapInArrow(trimmed(run), "x long, y long")


def _stars(edges: DataFrame) -> bool:
    """Whether the ``edges`` (a, b, all with a > b) are stars: a node has one link down and none up, or links up only."""
    end = lambda node, down: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 or (down = 1 and up = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, root long for every node with a link: root is the least node of its component. It reads a written table.

    Large-star and small-star rounds until all links are stars, which pairs are from the first. A node's links are met by
    an aggregate and a join (which Spark can split), never gathered in one row, so a node with very many links is no hot group.
    """
    edges = written(links.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(marked: DataFrame, id_col: str, budget: int) -> DataFrame:
    """fp, least, root long: per fingerprint the least id and the component."""
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"), budget))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return written(named, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """id_col, fp long, component_id: the smallest id that links of ``budget`` bits or fewer reach."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _classes(marked, id_col, budget)
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(whole, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def wide_fingerprints(rows: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """id_col, n_shingles long, words array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t or b"", shingle, words) for t in batch.column(1).to_pylist()]
            bits = np.concatenate([w for _, w in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, words), pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), lists], names=[id_col, "n_shingles", "words"])

    kept = bounded_batches(rows.select(id_col, F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text")))
    return kept.mapInArrow(trimmed(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_shingles long, words array<long>")


def similar_classes(rows: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """node, least (id), root long: one row per different set of shingles, with its least id (one row each) and its component.

    Sets link if their Jaccard similarity is ``similarity`` or more: by the estimate where it is clear, else by the texts.
    Of pairs just at the similarity, MEETING meet in a band; of more similar ones nearly all do.
    """
    n = rows.count()
    bands = _bands(similarity, n)
    marked = wide_fingerprints(rows, id_col, text_col, shingle, max(WORDS, -(-bands[2] // (64 // bands[0]))))
    different = marked.groupBy("n_shingles", "words").agg(F.min(id_col).alias("least"))
    nodes = written(different.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    found = similar_links(nodes, similarity, bands, n).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "grade")
    links = written(found.groupBy("a", "b").agg(F.max("grade").alias("grade"), (F.min("grade") == 0).alias("crowd")), "links")
    roots = components(links.filter("grade = 3").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    for grade, one_each in ((2, False), (0, False), (1, True), (1, False)):
        if grade == 0:
            asked = written(_members(links.filter("crowd"), nodes, roots), "crowds")
        else:
            open_links = _between(links.filter(F.col("grade") == grade).select("a", "b"), roots)
            if one_each:  # of every group the pair with the group of the least number
                open_links = open_links.groupBy("x").agg(F.min(F.struct("y", "a", "b")).alias("m")).select("m.a", "m.b", "x", "m.y")
            asked = written(open_links, "unsure")
        if asked.isEmpty():
            continue
        wanted = asked.select("node") if grade == 0 else asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = _texts_of(wanted, nodes, rows, id_col, text_col)
        held = (_crowd_links if grade == 0 else _settled)(asked, texts, shingle, similarity)
        roots = _joined(roots, components(held.select(F.col("x").alias("src"), F.col("y").alias("dst"))))
    named = nodes.select("node", "least").join(roots, "node", "left")
    return named.select("node", "least", F.coalesce("root", "node").alias("root"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, x, y: the pairs whose ends are in different groups x < y."""
    of = lambda end, name: roots.select(F.col("node").alias(end), F.col("root").alias(name))
    met = pairs.join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left").select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    return met.filter("p <> q").select("a", "b", F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y"))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root after groups were joined: ``more`` has the new root of a group by its old one."""
    up = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
    whole = roots.join(up, roots["root"] == up["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    own = up.join(roots.select("node"), up["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return written(whole.unionByName(own), "components")


def _texts_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text of all that are ``wanted`` (node). They are written, so that Spark knows their size: where few are asked for, their texts are picked without a shuffle of all."""
    ends = written(nodes.join(wanted, "node", "left_semi").select("node", "least"), "asked")
    return rows.select(F.col(id_col).alias("least"), F.col(text_col).cast("string").alias("text")).join(ends, "least").select("node", "text")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id (null last), of rows that share it the least text hash.

    Rows are told apart by a number of their own, so ids may be null or repeated: a row goes only for another one of
    its component. All columns stay.
    """
    own = "_row"
    while own in docs.columns:
        own += "_"
    rows = written(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(own).alias("row"))
    classes = similar_classes(rows.select(order.alias("order"), F.col(text_col).alias("text")), "order", "text", shingle, similarity)
    kept = classes.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.row").alias(own))
    gone = written(rows.select(own).join(kept, own, "left_anti"), "gone")  # the smaller side, of numbers only
    return rows.join(gone, own, "left_anti").select(*docs.columns)
