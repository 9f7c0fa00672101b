"""External induced sorting of the suffixes of one shard, with common-prefix values.

The leftmost S-type suffixes are ordered first: the substrings between them get names, and the string of names is
sorted by the same question asked again on ever longer runs of names. From that order all other suffixes are induced:
a scan over the order puts each L-type predecessor behind its bucket, a second scan backwards does so for S-type ones.
The buckets are the priority queue (priority: first symbol, then time of entry). Its entries are tuples of a suffix and
the length that it shares with the entry before it; that value is one more than the least value between the two
suffixes that put them there. Chunks of the queue beyond ``held`` entries lie on disk, in a nameless scratch file of the
task.

Orders and values are exact up to ``width`` symbols, which is all that a search for strings of that width needs.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np

BITS, SIDE = 9, 7
#: Queue entries that a task holds in memory (5 bytes each); more lie on disk. A shard of the query has up to 2 million.
HELD = 1 << 19
END = (1 << BITS) - 1
#: A byte that UTF-8 never has. As a symbol it is the smallest.
SEPARATOR = b"\xff"


class BucketQueue:
    """First-in first-out chunks of (place, shared length) per first symbol; all chunks beyond ``held`` entries in memory go to disk."""

    def __init__(self, held: int, kind: np.dtype):
        self.held, self.kind, self.size, self.file = held, np.dtype(kind), 0, None
        self.chunks: dict[int, deque] = defaultdict(deque)
        self.last: dict[int, int] = {}

    def push(self, symbol: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.last[symbol] = int(at[-1])
        if self.size + len(at) > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            place = self.file.tell()
            self.file.write(at.tobytes())
            self.file.write(shared.tobytes())
            self.chunks[symbol].append((place, len(at)))
        else:
            self.size += len(at)
            self.chunks[symbol].append((at, shared))

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches until the bucket is empty; what a caller pushes meanwhile comes last."""
        queue = self.chunks[symbol]
        while queue:
            batch, size = [], 0
            while queue and (not batch or size < self.held):
                at, shared = queue.popleft()
                if isinstance(at, int):
                    self.file.seek(at)
                    n = shared
                    at, shared = np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(self.kind.itemsize * n), self.kind)
                else:
                    self.size -= len(at)
                batch.append((at, shared))
                size += len(at)
            yield tuple(np.concatenate(x) for x in zip(*batch))
        del self.chunks[symbol]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class LeastBetween:
    """Least value of any range, by a table of ranges of doubling length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        levels = [values]
        step = 1
        while 2 * step <= n:
            prev = levels[-1]
            levels.append(np.minimum(prev[: n - 2 * step + 1], prev[step : n - step + 1]))
            step *= 2
        self.start = np.cumsum([0] + [len(x) for x in levels[:-1]])
        self.flat = np.concatenate(levels)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        base = self.start[level]
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (1 << level) + 1])


def shared_lengths(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``width``. words: symbols with padding."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, width, 8):
        x, y = words[a[live] + d], words[b[live] + d]
        same = x == y
        out[live[same]] = d + 8
        off = live[~same]
        if len(off):
            diff = (x ^ y)[~same]
            out[off] = d + (np.log2((diff & (~diff + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, width).astype(np.min_scalar_type(width))


class Shard:
    """The text of a shard: pieces of bytes in UTF-8 (so without the separator), one separator after each."""

    def __init__(self, pieces: Iterable[bytes], width: int):
        pieces = list(pieces)
        size = sum(map(len, pieces)) + len(pieces)
        self.width, self.n, self.small = width, size, np.min_scalar_type(width)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.cumsum(lengths + 1) - lengths - 1
        raw = np.frombuffer(SEPARATOR.join(pieces) + SEPARATOR * (width + 17), np.uint8)
        self.s = raw.astype(np.int16) + 1
        self.s[self.first + lengths] = 0
        self.s[size:] = 0
        # Eight symbols at each place.
        self.words = np.lib.stride_tricks.as_strided(raw[: len(raw) // 8 * 8].view(np.uint64), (len(raw) - 8,), (1,))
        self.kind = self._kinds()

    def _kinds(self) -> np.ndarray:
        """True for S-type: smaller than the suffix that follows."""
        s, n = self.s, self.n
        change = np.nonzero(s[: n - 1] != s[1:n])[0]
        kind = np.ones(n, bool)
        if len(change):
            kind[: change[-1] + 1] = np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1))
        kind[n - 1] = True
        return kind

    def leftmost(self) -> np.ndarray:
        """Places of leftmost S-type suffixes, in the order of their first ``width`` symbols at least."""
        at = 1 + np.nonzero(self.kind[1:] & ~self.kind[:-1])[0]
        until = np.append(at[1:], self.n - 1)
        name, live, done = None, np.arange(len(at)), 0
        while len(live):
            key = np.zeros(len(live), np.int64)
            for k in range(done, done + SIDE):
                place = at[live] + k
                key = (key << BITS) | np.where(place <= until[live], self.s[np.minimum(place, self.n)], END)
            name = _ranks(key) if name is None else _refined(name, live, key)
            done += SIDE
            live = np.nonzero(until - at >= done)[0]
        name = np.zeros(0, np.int64) if name is None else name
        step = 1
        while step < self.width and len(at) and name.max() < len(at):
            follow = np.zeros(len(name), np.int64)
            follow[:-step] = name[step:]
            name = _ranks(name * (len(at) + 1) + follow)
            step *= 2
        return at[np.argsort(name, kind="stable")]

    def duplicated(self, held: int = HELD) -> np.ndarray:
        """True at every place whose ``width`` symbols begin at another place too, within one piece."""
        s, width, kind = self.s, self.width, self.kind
        twice = np.zeros(self.n, bool)
        if self.n <= 2:
            return twice
        star = self.leftmost().astype(np.int32)
        shared = np.zeros(len(star), self.small)
        shared[1:] = shared_lengths(self.words, star[:-1], star[1:], width)
        cut = np.searchsorted(s[star], np.arange(258))
        queue, lower = BucketQueue(held, self.small), BucketQueue(held, self.small)

        def induce(batch: np.ndarray, values: np.ndarray, keep: np.ndarray, into: BucketQueue) -> None:
            index = np.nonzero(keep)[0]
            if not len(index):
                return
            before = batch[index] - 1
            symbol = s[before]
            order = np.argsort(symbol, kind="stable")
            index, before, symbol = index[order], before[order], symbol[order]
            head = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            value = np.zeros(len(index), self.small)
            rest = np.nonzero(~head)[0]
            if len(rest):
                value[rest] = np.minimum(width - 1, LeastBetween(values)(index[rest - 1] + 1, index[rest])) + 1
            starts = np.nonzero(head)[0]
            symbols = symbol[starts].tolist()
            known = np.array([into.last.get(c, -1) for c in symbols], np.int64)
            old = known >= 0
            if old.any():
                value[starts[old]] = shared_lengths(self.words, known[old], before[starts[old]].astype(np.int64), width)
            for c, i, j in zip(symbols, starts.tolist(), [*starts[1:].tolist(), len(before)]):
                into.push(c, before[i:j], value[i:j])

        def mark(batch: np.ndarray, values: np.ndarray, previous: int) -> None:
            same = np.nonzero(values >= width)[0]
            twice[batch[same]] = True
            inner = same[same > 0]
            twice[batch[inner - 1]] = True
            if len(same) and same[0] == 0 and previous >= 0:
                twice[previous] = True

        for c in range(257):
            previous = -1
            for batch, values in queue.take(c):
                mark(batch, values, previous)
                previous = int(batch[-1])
                lower.push(c, batch, values)
                induce(batch, values, (batch > 0) & (s[batch - 1] >= c), queue)
            if cut[c] < cut[c + 1]:
                batch, values = star[cut[c] : cut[c + 1]], shared[cut[c] : cut[c + 1]]
                induce(batch, values, batch > 0, queue)
        upper = BucketQueue(held, self.small)
        for c in range(256, -1, -1):
            previous = -1
            for batch, values in upper.take(c):
                mark(batch, values, previous)
                previous = int(batch[-1])
                induce(batch, values, (batch > 0) & (s[batch - 1] <= c), upper)
            chunks = list(lower.take(c))
            for k in range(len(chunks) - 1, -1, -1):
                batch, values = chunks[k][0][::-1], np.concatenate([np.zeros(1, self.small), chunks[k][1][:0:-1]])
                if k == len(chunks) - 1 and previous >= 0:
                    pair = np.array([previous, batch[0]], np.int64)
                    if shared_lengths(self.words, pair[:1], pair[1:], width)[0] >= width:
                        twice[pair] = True
                induce(batch, values, (batch > 0) & (s[batch - 1] < c), upper)
        for q in (queue, lower, upper):
            q.close()
        return twice


def _ranks(keys: np.ndarray) -> np.ndarray:
    """1 for the least key, and so on; equal keys have equal ranks."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])) if len(keys) else 0
    return rank


def _refined(name: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks by name, then by key (that of ``live``; others have none and come last, as they ended before)."""
    second = np.full(len(name), np.iinfo(np.int64).max)
    second[live] = key
    order = np.lexsort((second, name))
    a, b = name[order], second[order]
    rank = np.empty(len(name), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return rank
