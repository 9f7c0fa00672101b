"""BPE encoding and decoding with a word-end vocabulary, as Spark jobs over whole texts.

Every white-space piece of a text is encoded by the contiguous rank array: the parts of a word lie in one list, the
ranks of adjacent pairs in another; the smallest rank is found by a scan, its boundary is deleted and the two
neighbouring ranks are refreshed. Words above ``SCAN_LIMIT`` parts use a heap over the same ranks, as the scan is
quadratic; the ids are the same. Pieces already seen by a worker come from a cache of bounded size.

Cases: a null text is an empty one (no ids, empty decoded text); a text of one endless word is encoded whole; the
strings of the special tokens in a text become those tokens, as in the tokenizer file; repeated rows are kept; other
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from brambling.llm.storage import bounded_batches, trimmed

SCAN_LIMIT = 64
#: Pieces and words whose ids (as bytes) a worker remembers (twice as many at most), and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 40
#: Bytes or ids that are Python objects at once.
PORTION = 500_000
NEVER = 1 << 60


class Memory(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one, and what was old goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        chars = _byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.known = Memory(self._word)
        self.pieces = Memory(self._piece)

    def merge_word(self, word: bytes) -> list[int]:
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._scan(parts) if len(parts) <= SCAN_LIMIT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        none = (NEVER, -1)
        found = [self.merges.get(p, none) for p in zip(parts, parts[1:])]
        ranks = [r for r, _ in found]
        made = [m for _, m in found]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = made[i]
            del parts[i + 1], ranks[i], made[i]
            if i:
                ranks[i - 1], made[i - 1] = self.merges.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i], made[i] = self.merges.get((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((parts[x], parts[y]))):
                    heapq.heappush(queue, (m[0], x, parts[x], parts[y], m[1]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        return np.array(self.merge_word(word.encode()), np.int32).tobytes()

    def _piece(self, piece: str) -> bytes:
        words = self.words.findall(piece)
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self.known.__getitem__, words))  # the piece itself is remembered

    def _plain(self, text: str) -> list[bytes]:
        # Letters are lower-cased one by one: str.lower alone would write a final sigma by its context.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        pieces = filter(None, regex.split(r"\p{White_Space}+", text)) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return list(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        if self.specials and "<|" in text:
            parts: list[bytes] = []
            for part in self.specials.split(text):
                parts += [np.int32(self.special[part]).tobytes()] if part in self.special else self._plain(part)
        else:
            parts = self._plain(text)
        return np.frombuffer(b"".join(parts), np.int32)



@lru_cache(maxsize=2)
def spelled(path: str) -> dict[int, str]:
    """The token of every id. Decoding joins tokens by one space: the file names no decoder, so word ends stay visible."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of a batch in slices of about ``PORTION`` units, one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield slice(at, stop)
        at = stop


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, ids array<int>, and the text that the ids decode to if ``decoded`` (in the same task, so that no second one holds the vocabulary).

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokens = load(tokenizer), spelled(tokenizer) if decoded else {}
        for batch in batches:
            for rows in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                n = rows.stop - rows.start
                ids = [bpe.encode(t or "") for t in batch.column(1).slice(rows.start, n).to_pylist()]
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                columns = {id_col: batch.column(0).slice(rows.start, n), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))}
                if decoded:
                    columns["decoded"] = pa.array([" ".join(map(tokens.__getitem__, x.tolist())) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = bounded_batches(docs.select(id_col, text_col))
    return kept.mapInArrow(trimmed(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids array<int>{', decoded string' if decoded else ''}")


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids, decoded string. Null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = spelled(tokenizer)
        for batch in batches:
            ids = batch.column(1)
            flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for rows in portions(np.diff(offsets)):
                texts = [" ".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(offsets[rows], offsets[rows.start + 1 : rows.stop + 1])]
                n = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), ids.slice(rows.start, n), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    kept = bounded_batches(encoded.select(id_col, ids_col))
    return kept.mapInArrow(trimmed(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids array<int>, decoded string")
