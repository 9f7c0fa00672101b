"""Toxicity by a convolutional text classifier trained here in numpy.

A word is the sum of hashed embeddings of itself and of its first letters; filters of several widths slide over the
words, their highest values over the whole text go into a logistic output. Only the places of these highest values get
gradients. Hash values that fewer than ``MIN_TEXTS`` learning texts have stay zero, so that unknown words say nothing.

The classes are learnt from at most ``EACH`` labelled ids and ``BYTES`` bytes of text of either class (documented bounds);
every text is scored whole. Thresholds are set by language, on texts that the network did not learn from, where a
language has enough of them. They serve ``reject_toxic`` only; a score never uses the language.

Cases: null and empty texts get the score of no words; labels that are null, of unknown documents or that contradict
each other are left out, repeated ones count once; of several texts with one id one is learnt from; with no labels of
one class all scores are the share of the other (0.5 without any); very long texts are scored in whole, one at a time;
repeated rows are kept; a null or unknown language has the threshold 0.5; ``reject_toxic`` keeps all columns, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.llm import labelled
from brambling.llm.bpe import portions
from brambling.llm.storage import bounded_batches, give_back, trimmed

EACH, BYTES, MIN_TEXTS, CHECKED = 2_500, 16 << 20, 3, 8
SPACE_BITS, SIZE, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
#: Rounds over the learning texts: at most ROUNDS, fewer once VISITS texts were seen, three at least.
ROUNDS, VISITS, BATCH, RATE, DECAY = 16, 16_000, 32, 0.01, 1e-4
PAD = max(WIDTHS) - 1
PREFIXES = (4, 5, 6, 16)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash values of all words (rows of zeros apart the texts), the first row of each text and the row behind its last."""
    data, first = labelled.joined(texts)
    start, end = labelled.letter_words(data)
    count = np.diff(np.searchsorted(start, first))
    hashes = labelled.prefix_hashes(data, start, end, PREFIXES)
    rows = np.maximum(count, 1)
    top = np.cumsum(rows + PAD) - rows - PAD
    ids = np.zeros((int((rows + PAD).sum()), len(PREFIXES)), np.int32)
    at = np.arange(len(start)) + np.repeat(top - (np.cumsum(count) - count), count)
    for k, h in enumerate(hashes):
        ids[at, k] = h & np.uint32((1 << SPACE_BITS) - 1)
    return ids, top, top + rows


class TextCnn:
    def __init__(self, used: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        # Row 0 stays zero and stands for all hash values that are not used.
        self.place = np.where(used, np.cumsum(used), 0).astype(np.int32)
        self.e = rng.normal(0, 0.1, (int(used.sum()) + 1, SIZE)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.4, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.v = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _convolved(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, w in zip(WIDTHS, self.w):
            z = x @ w[0]
            for j in range(1, k):
                z[:-j] += x[j:] @ w[j]
            out.append(z)
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, top, end = features(texts)
        x = self.e[self.place[ids[:, 0]]]
        for k in range(1, ids.shape[1]):
            x += self.e[self.place[ids[:, k]]]
        pairs = np.stack([top, np.minimum(end, len(ids) - 1)], axis=1).ravel()
        best = np.concatenate([np.maximum.reduceat(z, pairs, axis=0)[::2] for z in self._convolved(x)], axis=1)
        return np.maximum(best + self.b, 0) @ self.v + self.c

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return labelled.sigmoid(self.logits(texts).astype(np.float64))

    def learn(self, texts: list[bytes], y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        parts = [features([t]) for t in texts]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        adam = labelled.Adam([self.e, *self.w, self.b, self.v, self.c], RATE)
        for _ in range(min(ROUNDS, max(3, VISITS // len(texts)))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                self._step(adam, [parts[i][0] for i in order[at : at + BATCH]], y[order[at : at + BATCH]], weight[order[at : at + BATCH]])

    def _step(self, adam: labelled.Adam, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        ids = self.place[np.concatenate(batch)]
        sizes = np.array([len(b) for b in batch])
        top = np.cumsum(sizes) - sizes
        x = self.e[ids].sum(axis=1)
        maps = self._convolved(x)
        where = np.stack([np.concatenate([t + z[t : t + n - PAD].argmax(axis=0) for z in maps]) for t, n in zip(top, sizes)])
        best = np.stack([np.concatenate([z[where[i, k * FILTERS : (k + 1) * FILTERS], range(FILTERS)] for k, z in enumerate(maps)]) for i in range(len(batch))])
        hidden = np.maximum(best + self.b, 0)
        out = hidden @ self.v + self.c
        g = ((labelled.sigmoid(out) - y) * weight / len(y)).astype(np.float32)
        gh = g[:, None] * self.v * (hidden > 0)
        gx = np.zeros_like(x)
        gw = []
        for k, (width, w) in enumerate(zip(WIDTHS, self.w)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            at, gz = where[:, cols], gh[:, cols]
            grad = np.zeros_like(w)
            for j in range(width):
                grad[j] = np.einsum("bfd,bf->df", x[at + j], gz)
                np.add.at(gx, (at + j).ravel(), (gz[:, :, None] * w[j].T[None]).reshape(-1, SIZE))
            gw.append(grad + DECAY * w)
        touched = np.nonzero(gx.any(axis=1))[0]
        ge = DECAY * self.e
        np.add.at(ge, ids[touched].ravel(), np.repeat(gx[touched], ids.shape[1], axis=0))
        ge[0] = 0
        adam.step([ge, *gw, gh.sum(axis=0), hidden.T @ g, g.sum(keepdims=True)])


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle between two neighbouring scores with the fewest errors; ties: the one nearest to 0.5."""
    cuts = np.unique(np.concatenate([[0.0], score, [1.0]]))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [0.5]])
    wrong = ((score[:, None] >= cuts) != (y[:, None] == 1)).sum(axis=0)
    best = cuts[wrong == wrong.min()]
    return float(best[np.argmin(abs(best - 0.5))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label: str = "toxic") -> tuple[TextCnn | Constant, dict[str, float]]:
    """A classifier, and thresholds by language. The driver learns it, and keeps nothing of the texts."""
    chosen = labelled.learning_rows(labels, label, EACH, id_col)
    more = [lang_col] if lang_col and lang_col in docs.columns else []
    try:
        return _learnt(labelled.texts_of(docs, chosen, BYTES, id_col, text_col, *more), bool(more))
    finally:
        give_back()


def _learnt(rows: list[tuple], by_lang: bool) -> tuple[TextCnn | Constant, dict[str, float]]:
    """``train`` from rows of y, text and language."""
    y = np.array([r[0] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5), {}
    texts = [r[1] for r in rows]
    kept = np.arange(len(rows)) % CHECKED != 0
    seen = np.zeros(1 << SPACE_BITS, np.int32)
    for t, k in zip(texts, kept):
        if k:
            seen[np.unique(features([t])[0])] += 1
    seen[0] = 0
    net = TextCnn(seen >= MIN_TEXTS)
    net.learn([t for t, k in zip(texts, kept) if k], y[kept])
    checked = np.nonzero(~kept)[0]
    score = np.concatenate([net.scores([texts[i]]) for i in checked])
    thresholds = {}
    if by_lang:
        langs = np.array([str(rows[i][2]) for i in checked])
        for lang in sorted(set(langs)):
            mine = langs == lang
            if min((y[checked][mine] == 1).sum(), (y[checked][mine] == 0).sum()) >= 20:
                thresholds[lang] = best_threshold(score[mine], y[checked][mine])
    return net, thresholds


def score_documents(docs: DataFrame, net: TextCnn | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score: how likely label 1 is."""
    found = labelled.scored(docs.select(id_col, text_col), net.scores, id_col, text_col)
    return found.select(F.col("row")[id_col].alias(id_col), labelled.held_out(F.col("row")[id_col]).alias("held_out"), "score")


def reject_toxic(docs: DataFrame, net: TextCnn | Constant, thresholds: dict[str, float], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that reach the threshold of their language; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            langs = batch.column(lang_place).to_pylist() if lang_place is not None else [None] * batch.num_rows
            for part in portions(pc.fill_null(pc.binary_length(column), 0).to_numpy()):
                n = part.stop - part.start
                score = net.scores([(t or "").encode() for t in column.slice(part.start, n).to_pylist()])
                limit = np.array([thresholds.get(x, 0.5) for x in langs[part]])
                yield batch.slice(part.start, n).filter(pa.array(score < limit))

    place = docs.columns.index(text_col)
    lang_place = docs.columns.index(lang_col) if lang_col in docs.columns else None
    return bounded_batches(docs).mapInArrow(trimmed(run), docs.schema)
