"""Personal data in texts: spans by fixed rules, and more spans by a character-level bidirectional LSTM with CRF transitions.

The rules give the base spans (e-mail and IP addresses, card and phone numbers), which always stay. The network is trained
in numpy on the driver from labelled spans: the base spans of a bounded sample of rows outside the held-out fold, also set
side by side and written in other ways (groups of a card parted by dots, a phone number with 00, spaces about the @), as
rules fail where two numbers meet. Everything that it can mark has a digit or an @, so it reads every stretch of a text
within ``NEAR`` characters of one, whatever the length of the text, in windows of ``WIDTH`` that overlap by half. Each window
is decoded by Viterbi; then spans of one kind that overlap become one, and of those that still overlap the one with the
highest sum of margins stays, over the whole text. A span is added if it holds what its kind must hold (digits, Luhn, parts)
and meets no base span.

Null texts count as empty; empty texts have no spans. Rows with equal texts get equal spans; null or repeated ids are rows
like any other. Where no row has a base span, nothing is learnt and nothing is added. Other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.llm.bpe import portions
from brambling.llm.labelled import Adam, held_out, sigmoid
from brambling.llm.storage import bounded_batches, trimmed, written

KINDS = ("email", "ip", "card", "phone")
NEAR, WIDTH = 24, 64
#: Learning windows of each kind, and without any, by a hash of what they hold; steps and windows of a step.
EACH, STEPS, BATCH = 400, 260, 64
UNITS, LETTERS, EMBEDDED = 16, 129, 10
#: Windows that go through the network together, always as many, so that a window's result does not depend on others.
TOGETHER = 256
#: Stretches whose spans a task remembers, and the longest of them.
REMEMBERED, SHORT = 20_000, 512

TRIGGER = re.compile(r"[0-9@]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 1) % 9 + 1 if d != "0" else 0 for i, d in enumerate(reversed(number)))
    return total % 10 == 0


def ip_parts(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def card_number(s: str) -> bool:
    return 12 <= len(d := digits(s)) <= 19 and luhn(d)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches. Only the characters before an @ can start one, so each is looked at once, however long its run."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    if not TRIGGER.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if ip_parts(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if card_number(m[0])]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def stretches(text: str) -> list[tuple[int, str]]:
    """The parts of a text within NEAR characters of a digit or an @."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(s, text[s:e]) for s, e in out]


def letters(texts: list[str]) -> np.ndarray:
    """(texts, WIDTH): 0 after the end, else the code of the character plus one, all beyond ASCII alike."""
    out = np.zeros((len(texts), WIDTH), np.int64)
    for row, t in zip(out, texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)[:WIDTH]
        row[: len(codes)] = np.minimum(codes, LETTERS - 2) + 1
    return out


TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner of each kind
ALLOWED = np.array([[b % 2 == 1 or b == 0 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
STARTS = np.array([b % 2 == 1 or b == 0 for b in range(TAGS)])


def tags(spans: list[tuple[int, int, int]], width: int = WIDTH) -> np.ndarray:
    """Tags of a window with spans (start, kind, end); what begins before it is inner from its first character on, as first."""
    out = np.zeros(width, np.int64)
    for start, kind, end in spans:
        a, b = max(start, 0), min(end, width)
        if a < b:
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


class Net:
    """Embedded characters, an LSTM in either direction, a layer of tag scores, and scores of tags that follow each other."""

    def __init__(self, seed: int = 13, units: int = UNITS):
        rng = np.random.default_rng(seed)
        n = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.units = units
        bias = np.zeros(4 * units, np.float32)
        bias[units : 2 * units] = 1  # keep at first
        self.p = [n(LETTERS, EMBEDDED), n(EMBEDDED, 4 * units), n(units, 4 * units), bias, n(EMBEDDED, 4 * units), n(units, 4 * units), bias.copy(), n(2 * units, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]

    def _run(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, rows, units) over x (time, rows, inputs), and what going back needs."""
        n = self.units
        inputs = x @ w + b
        h, c, kept, out = np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype), [], np.empty((*x.shape[:2], n), x.dtype)
        for t in range(len(x)):
            z = inputs[t] + h @ u
            gates, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, c = c, gates[:, n : 2 * n] * c + gates[:, :n] * g
            wide = np.tanh(c)
            kept.append((gates, g, before, wide, h))
            h = gates[:, 2 * n :] * wide
            out[t] = h
        return out, kept

    def _back(self, x: np.ndarray, u: np.ndarray, w: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.units
        dz = np.empty((*x.shape[:2], 4 * n), x.dtype)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        du = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            gates, g, before, wide, h = kept[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - wide * wide)
            z = dz[t]
            z[:, :n] = dc * g * i * (1 - i)
            z[:, n : 2 * n] = dc * before * f * (1 - f)
            z[:, 2 * n : 3 * n] = dh * wide * o * (1 - o)
            z[:, 3 * n :] = dc * i * (1 - g * g)
            du += h.T @ z
            dh, dc = z @ u.T, dc * f
        flat = dz.reshape(-1, 4 * n)
        return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """(rows, time, tags)."""
        e, wf, uf, bf, wb, ub, bb, v, a, _ = self.p
        x = e[chars.T]
        forth, back = self._run(x, wf, uf, bf)[0], self._run(x[::-1], wb, ub, bb)[0][::-1]
        return (np.concatenate([forth, back], axis=2) @ v + a).transpose(1, 0, 2)

    def loss(self, chars: np.ndarray, want: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        e, wf, uf, bf, wb, ub, bb, v, a, follow = self.p
        x = e[chars.T]
        forth, kept_f = self._run(x, wf, uf, bf)
        back, kept_b = self._run(x[::-1], wb, ub, bb)
        hidden = np.concatenate([forth, back[::-1]], axis=2)
        score = hidden @ v + a
        value, dscore, dfollow = crf(score, want.T, follow)
        n = self.units
        dhidden = dscore @ v.T
        dxf, dwf, duf, dbf = self._back(x, uf, wf, kept_f, dhidden[:, :, :n])
        dxb, dwb, dub, dbb = self._back(x[::-1], ub, wb, kept_b, dhidden[::-1, :, n:])
        de = np.zeros_like(e)
        np.add.at(de, chars.T, dxf + dxb[::-1])
        return value, [de, dwf, duf, dbf, dwb, dub, dbb, hidden.reshape(-1, 2 * n).T @ dscore.reshape(-1, TAGS), dscore.sum((0, 1)), dfollow]

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best allowed tags, and by how much the score of each exceeds that of being outside: (rows, time)."""
        score = self.emissions(chars).astype(np.float64)
        follow = np.where(ALLOWED, self.p[-1], -np.inf)
        best, from_ = np.where(STARTS, score[:, 0], -np.inf), []
        for t in range(1, score.shape[1]):
            ways = best[:, :, None] + follow
            from_.append(ways.argmax(1))
            best = ways.max(1) + score[:, t]
        at = best.argmax(1)
        path = [at]
        for f in reversed(from_):
            at = np.take_along_axis(f, at[:, None], 1)[:, 0]
            path.append(at)
        found = np.array(path[::-1]).T
        return found, np.take_along_axis(score, found[:, :, None], 2)[:, :, 0] - score[:, :, 0]


def crf(score: np.ndarray, want: np.ndarray, follow: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags (time, rows) under scores (time, rows, tags), and its gradients."""
    steps, rows, _ = score.shape
    top = score.max(2, keepdims=True)
    e, m = np.exp(score - top), np.exp(follow)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((steps, rows, 1), e.dtype)
    for t in range(steps):
        a = e[t] if t == 0 else e[t] * (alpha[t - 1] @ m)
        scale[t] = a.sum(1, keepdims=True)
        alpha[t] = a / scale[t]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = (e[t + 1] * beta[t + 1]) @ m.T / scale[t + 1]
    place = np.arange(rows)
    said = sum(score[t, place, want[t]].sum() for t in range(steps)) + follow[want[:-1], want[1:]].sum()
    value = float(np.log(scale).sum() + top.sum() - said) / rows
    marginal = alpha * beta
    dfollow = m * np.einsum("tri,trj->ij", alpha[:-1], e[1:] * beta[1:] / scale[1:], optimize=True)
    for t in range(steps):
        marginal[t, place, want[t]] -= 1
    np.subtract.at(dfollow, (want[:-1], want[1:]), 1)
    return value, marginal / rows, dfollow / rows


# --- learning ---------------------------------------------------------------------------------------------------------


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(kind or -1, window, its spans) of a stretch; a stretch with a number that the rules gave up says nothing.

    These are runs of over 11 digits that are no card, and signs of a phone number of another length.
    """
    known = [range(s, e) for s, _, e in spans]
    doubtful = [m for pattern in (CARD, PHONE) for m in pattern.finditer(text) if len(digits(m[0])) > 8 and not any(m.start() in r for r in known)]
    if doubtful:
        return
    for start in range(0, max(1, len(text) - WIDTH // 2), WIDTH // 2):
        inside = [(s - start, k, e - start) for s, k, e in spans if s < start + WIDTH and e > start]
        if all(s >= 0 and e <= WIDTH for s, _, e in inside):
            yield (inside[0][1] if inside else -1), text[start : start + WIDTH], inside


def other_way(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same datum as some people write it and the rules do not read it."""
    if kind == 0:
        return s.replace("@", " @ ")
    if kind == 2:
        d, mark = digits(s), rng.choice([".", " ", "-", "/"])
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        return s.replace("+", "00", 1) if rng.random() < 0.5 else s.replace("+", "+ ", 1)
    return s


def varied(windows: list[tuple[str, list[tuple[int, int, int]]]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window as it is, or with its datum written another way, beside that of another window, or at an end of the text."""
    text, spans = windows[rng.integers(len(windows))]
    if not spans or rng.random() < 0.4:
        return text, spans
    start, kind, end = spans[0]
    parts = [(kind, text[start:end])]
    if rng.random() < 0.7:
        more, other = windows[rng.integers(len(windows))]
        if other:
            parts.append((other[0][1], more[other[0][0] : other[0][2]]))
        else:
            parts.append((-1, str(rng.integers(10 ** int(rng.integers(1, 8))))))
        if rng.random() < 0.5:
            parts.reverse()
    mark = [" ", ", ", "; ", " / ", "\n", " - "][rng.integers(6)]
    head = text[:start][max(0, start - int(rng.integers(0, 20))) :]
    out, found = head, []
    for i, (k, s) in enumerate(parts):
        s = other_way(k, s, rng) if rng.random() < 0.3 else s
        out += mark if i else ""
        if k >= 0:
            found.append((len(out), k, len(out) + len(s)))
        out += s
    out += text[end:] if rng.random() < 0.8 else ""
    return out[:WIDTH], [(s, k, min(e, WIDTH)) for s, k, e in found if s < WIDTH]


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS, seed: int = 13) -> Net | None:
    """A network from windows with their spans; None if none has any."""
    if not any(spans for _, spans in windows):
        return None
    rng, net = np.random.default_rng(seed), Net(seed)
    adam = Adam(net.p, 0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - 0.9 * step / steps)
        some = [varied(windows, rng) for _ in range(BATCH)]
        _, gradient = net.loss(letters([t for t, _ in some]), np.array([tags(s) for _, s in some]))
        size = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        adam.step([g * min(1, 5 / size) for g in gradient])
    return net


# --- decoding ---------------------------------------------------------------------------------------------------------


def fits(kind: int, s: str) -> bool:
    """Whether a marked string holds what its kind must hold."""
    close = s.replace(" ", "")
    if kind == 0:
        return s.count(" ") <= 2 and next(emails(close), None) == (0, len(close))
    if kind == 1:
        return bool(IP.fullmatch(close)) and ip_parts(close)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]?[0-9])+", s)) and card_number(s)
    return bool(re.fullmatch(r"(?:\+ ?|00|\()[0-9][ ()./0-9-]*[0-9]", s)) and 9 <= len(digits(s)) <= 15


def tidy(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """A marked span without what cannot begin or end its kind."""
    first = "0123456789" if kind in (1, 2) else "+(0123456789" if kind == 3 else LOCAL
    last = LOCAL - set("._%+-") if kind == 0 else "0123456789"
    while start < end and text[start] not in first:
        start += 1
    while start < end and text[end - 1] not in last:
        end -= 1
    return start, end


def reconciled(text: str, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """The spans of a stretch from the tags and margins of its windows, each with its start."""
    marked: dict[int, list[list]] = {k: [] for k in range(len(KINDS))}
    for at, found, margin in parts:
        t, n = 0, min(WIDTH, len(text) - at)
        while t < n:
            if found[t] == 0:
                t += 1
                continue
            kind, begin = (int(found[t]) - 1) // 2, t
            t += 1
            while t < n and found[t] == 2 + 2 * kind:
                t += 1
            marked[kind].append([at + begin, at + t, float(margin[begin:t].sum())])
    whole = []
    for kind, spans in marked.items():
        merged: list[list] = []
        for s in sorted(spans):
            if merged and s[0] < merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], s[1]), max(merged[-1][2], s[2])]
            else:
                merged.append(s)
        for start, end, weight in merged:
            start, end = tidy(kind, text, start, end)
            if start < end and fits(kind, text[start:end]):
                whole.append((-weight, start, kind, end))
    kept: list[tuple[int, int, int]] = []
    for _, start, kind, end in sorted(whole):
        i = bisect(kept, (start, kind, end))
        if (i == 0 or kept[i - 1][2] <= start) and (i == len(kept) or end <= kept[i][0]):
            kept.insert(i, (start, kind, end))
    return kept


def tagged(net: Net, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The spans that the network marks in each stretch."""
    places = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - WIDTH // 2), WIDTH // 2)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: dict[int, list] = {}
    for b in range(0, len(places), TOGETHER):
        some = places[b : b + TOGETHER]
        chars = letters([texts[i][at : at + WIDTH] for i, at in some] + [""] * (TOGETHER - len(some)))
        found, margin = net.decode(chars)
        for (i, at), f, m in zip(some, found, margin):
            held.setdefault(i, []).append((at, f.astype(np.int8), m.astype(np.float32)))
        for i in [i for i in held if i < some[-1][0] or b + TOGETHER >= len(places)]:
            out[i] = reconciled(texts[i], held.pop(i))
    return out


def added(base: list[tuple[int, int, int]], marked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Marked spans that meet no base span; both in order of their starts."""
    out, i, reach = [], 0, -1
    for start, kind, end in marked:
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= start:
            out.append((start, kind, end))
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(lists: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in lists], pa.list_(SPAN))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base spans, and the stretches that the network reads: the one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                n = rows.stop - rows.start
                texts = [t or "" for t in batch.column(1).slice(rows.start, n).to_pylist()]
                near = pa.array([[{"start": s, "text": t} for s, t in stretches(x)] for x in texts], pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), _spans([base_spans(t) for t in texts]), near], names=["id", "base", "near"])

    kept = bounded_batches(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    return kept.mapInArrow(trimmed(run), f"id {kept.schema[0].dataType.simpleString()}, base {SPANS}, near array<struct<start:int,text:string>>")


def _rows(batch: pa.RecordBatch, name: str) -> list[list[tuple]]:
    return [[tuple(x.values()) for x in row] for row in batch.column(name).to_pylist()]


def learning_windows(found: DataFrame, each: int = EACH, fold: Column | None = None) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``each`` different windows of every kind, and without one, from rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, near in zip(_rows(batch, "base"), _rows(batch, "near")):
                i = 0
                for at, text in near:
                    while i < len(base) and base[i][2] <= at:
                        i += 1
                    own, j = [], i
                    while j < len(base) and base[j][0] < at + len(text):
                        own.append((base[j][0] - at, base[j][1], base[j][2] - at))
                        j += 1
                    if all(s >= 0 and e <= len(text) for s, _, e in own):
                        out += [{"kind": k, "window": w, "spans": ",".join(f"{s}:{q}:{e}" for s, q, e in inside)} for k, w, inside in candidates(text, own)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("kind", pa.int32()), ("window", pa.string()), ("spans", pa.string())]))

    learnt = found.filter(~held_out(F.col("id")) if fold is None else fold)
    windows = written(learnt.mapInArrow(trimmed(run), "kind int, window string, spans string").distinct(), "pii-windows")
    out = []
    for kind in range(-1, len(KINDS)):
        for r in windows.filter(F.col("kind") == kind).orderBy(F.xxhash64("window", "spans"), "window", "spans").limit(each).collect():
            out.append((r.window, [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]))
    return out


def marked(found: DataFrame, net: Net | None) -> DataFrame:
    """id, base, more: the spans by rules, and those that the network adds. ``found`` comes from ``scanned``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int, int]]] = {}
        own: dict[str, list[tuple[int, int, int]]] = {}
        for batch in batches:
            base, near = _rows(batch, "base"), _rows(batch, "near")
            if net is not None:
                new = list(dict.fromkeys(t for row in near for _, t in row if t not in known))
                if len(known) + len(new) > REMEMBERED:
                    known = {}
                    new = list(dict.fromkeys(t for row in near for _, t in row))
                own = dict(zip(new, tagged(net, new)))
                known |= {t: spans for t, spans in own.items() if len(t) <= SHORT}
            more = [added(b, [(s + at, k, e + at) for at, t in row for s, k, e in (own.get(t) or known.get(t, ()))]) for b, row in zip(base, near)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), _spans(more)], names=["id", "base", "more"])

    return found.mapInArrow(trimmed(run), f"id {found.schema['id'].dataType.simpleString()}, base {SPANS}, more {SPANS}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and more (arrays of start, kind, end; kinds by their place in ``KINDS``), all spans in both sorted."""
    found = written(scanned(docs, id_col, text_col), "pii-stretches")
    return marked(found, train(learning_windows(found))).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; where spans overlap, from the first start to the last end, by the first kind."""
    order = docs.columns
    others = [F.col(f"`{c}`") for c in order if c != text_col]
    kept = bounded_batches(docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))) if others else docs.select(F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        near = stretches(text)
        base = base_spans(text)
        more = tagged(net, [t for _, t in near]) if net else [[] for _ in near]
        spans = sorted(base + added(base, [(s + at, k, e + at) for (at, _), own in zip(near, more) for s, k, e in own]))
        out, done = [], 0
        for start, kind, end in spans:
            if start >= done:
                out += [text[done:start], f"[{KINDS[kind]}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                n = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), pa.array([clean(t) for t in batch.column(1).slice(rows.start, n).to_pylist()], pa.string())], names=["row", "text"])

    done = kept.mapInArrow(trimmed(run), f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in order])
