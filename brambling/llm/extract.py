"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tags and text, and its elements as nested groups. Neighbouring groups of one label fold
into a repeated group, text into slots: that is the page's own expression. The expressions of a host are aligned one
after the other; what matches is merged, what only one side has becomes optional, what then lies side by side under one
label becomes repeated. The result is the wrapper of the host, an expression without unions that fits all its pages.

Equal expressions are one row before the alignment, so a host with a third of all pages is small; expressions of a host
are aligned in parts of at most ``PART``, whose wrappers are aligned in turn, round after round. What the slots hold
(how many characters, how many of them links, whether always the same text on different pages) is summed by host and
slot before the shuffle. What one task holds of a host is its wrapper and one short row per slot, never its texts.

From wrapper and sums follow the slots of the article. Under ``article`` or ``main`` these are all but those in groups
that are something else by their element (``nav``, ``aside``, ``form`` ...) or by the whole of a class, id or role
(``ad-box``, ``comments``; ``search-results`` or ``post-header`` are not). A page without such a slot is judged by what
the wrapper shows: text that is the same on ``LEAST_PAGES`` different pages of the host, and repeated groups of links,
are no article; everything else is. Then every page is read once more and its article slots are joined.

Cases: null or empty html gives the empty text; pages without a host (null or relative URL) are not compared with each
other; broken markup is read as far as it goes (text behind an unclosed comment or script belongs to it); elements may
be nested to any depth, siblings be any number; very long pages are read whole; repeated pages are kept and count once;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.llm.storage import bounded_batches, trimmed, written

PART, LEAST_PAGES, SLICE = 1_000, 3, 200
#: Slots of all hosts up to which the chosen ones are broadcast (8 bytes each); pages of a host per part beyond that.
SLOTS_SENT, PAGES = 4_000_000, 50_000
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title template svg math canvas object iframe noscript select option button textarea audio video".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
MARKED = frozenset({"article", "main"})
#: What a class, id or role says that a group is, and words that may stand beside it.
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar copyright contentinfo complementary "
    "search comment comments commentlist reply replies respond responses disqus feedback skip hidden".split()
)
BESIDE = frozenset("area bar block bottom box button buttons container form global group holder inner left link links list outer page primary right secondary section site slot top unit wrap wrapper zone".split())
#: Elements that an opening tag of the same kind ends.
ENDED_BY = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN_MARK = re.compile(r"""(?<![\w-])hidden(?![\w-])(?!\s*=\s*["']?until-found)""", re.I)


class Group:
    """An element: its label, what it holds (groups and texts), the inline tags open in it that are no groups."""

    __slots__ = ("inline", "kids", "label", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids, self.inline = tag, label, [], {}


@lru_cache(1 << 14)
def label_of(tag: str, attributes: str) -> str:
    """tag.word.word of its classes, ids and roles; a ``~`` at the end says that one of these names is no article's."""
    words, aside = set(), False
    for names in NAME.findall(attributes):
        for name in "".join(names).split():
            parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            words.update(parts)
            aside |= bool(NO_ARTICLE.intersection(parts)) and NO_ARTICLE.union(BESIDE).issuperset(parts)
    bare = re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", attributes) if "idden" in attributes.lower() else ""
    return ".".join([tag, *sorted(words)]) + "~" * (aside or HIDDEN_MARK.search(bare) is not None)


def no_article(label: str, inside: bool) -> bool:
    """Is a group of this label something else than (``inside``: a part of) an article?"""
    tag = label.rstrip("~").split(".", 1)[0]
    if tag in ("html", "body"):
        return False
    return label.endswith("~") or (tag in ASIDE and not (inside and tag == "header"))


def read(page: str) -> Group:
    """The page as nested groups; a text is a pair (is it a link's, the text)."""
    root = Group("", "")
    open_, at, links = [root], 0, 0

    def text(piece: str) -> None:
        if piece:
            open_[-1].kids.append((links > 0, entities.unescape(piece)))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if tag in INLINE:
                for k in range(len(open_) - 1, -1, -1):  # inline groups end within their block
                    if open_[k].inline.get(tag):
                        open_[k].inline[tag] -= 1
                        links -= tag == "a" and links > 0
                    elif open_[k].tag == tag:
                        del open_[k:]
                    elif open_[k].tag in INLINE:
                        continue
                    break
            else:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == tag:
                        del open_[k:]
                        links = 0
                        break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        label = label_of(tag, attributes)
        if tag in INLINE and not label.endswith("~"):
            if tag == "a":
                links += 1
            elif tag == "br":
                text(" ")
            if tag not in VOID:
                open_[-1].inline[tag] = open_[-1].inline.get(tag, 0) + 1
            continue
        ends = ENDED_BY.get(tag, frozenset()) | (frozenset({"p"}) if tag in CLOSES_P else frozenset())
        block = len(open_) - 1
        while block and open_[block].tag in INLINE:
            block -= 1
        if open_[block].tag in ends:
            del open_[block:]
        group = Group(tag, label)
        open_[-1].kids.append(group)
        if tag not in VOID and not attributes.endswith("/"):
            open_.append(group)
    return root


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


@lru_cache(1 << 16)
def step(path: int, label: str) -> int:
    """The number of the slot or group ``label`` below ``path`` (the root is 0)."""
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=path) >> 1


def slots(root: Group) -> Iterator[tuple[int, bool, str, int]]:
    """(path, is it a link's, text, number of the block) of all texts that a reader sees."""
    count, open_ = 0, [(root, iter(root.kids), 0)]
    while open_:
        group, kids, path = open_[-1]
        kid = next(kids, None)
        if kid is None:
            open_.pop()
            count += group.tag not in INLINE
        elif isinstance(kid, tuple):
            yield path, *kid, count
        elif kid.tag not in HIDDEN:
            count += kid.tag not in INLINE
            open_.append((kid, iter(kid.kids), step(path, kid.label)))


class Expression:
    """Mark: "" once, "?" optional, "+" repeated, "*" both; the label "#" is a slot, "@" a slot in a link."""

    __slots__ = ("digest", "kids", "label", "mark")

    def __init__(self, label: str, mark: str = "", kids: tuple[Expression, ...] = ()):
        self.label, self.mark, self.kids = label, mark, kids
        self.digest = hash((label, mark, *[k.digest for k in kids]))

    def marked(self, mark: str) -> Expression:
        return self if mark == self.mark else Expression(self.label, mark, self.kids)

    def like(self, other: Expression) -> bool:
        return len(self.kids) == len(other.kids) and all(a.digest == b.digest for a, b in zip(self.kids, other.kids))


def _finished(job: Generator):
    """The result of a generator that yields further ones where a function would call itself: any depth works."""
    jobs, value = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(value))
            value = None
        except StopIteration as done:
            jobs.pop()
            value = done.value
    return value


def _read_as(group: Group) -> Generator:
    kids = []
    for kid in group.kids:
        if isinstance(kid, tuple):
            if kid[1].strip():
                kids.append(Expression("@" if kid[0] else "#"))
        elif kid.tag not in HIDDEN:
            kids.append((yield _read_as(kid)))
    return Expression(group.label, "", (yield _folding(kids)))


def _mark(a: str, b: str, optional: bool = False, repeated: bool = False) -> str:
    some, many = optional or bool({a, b} & {"?", "*"}), repeated or bool({a, b} & {"+", "*"})
    return "*" if some and many else "+" if many else "?" if some else ""


def _folding(kids: list[Expression]) -> Generator:
    """Neighbours of one label become a repeated group."""
    out: list[Expression] = []
    for kid in kids:
        if out and out[-1].label == kid.label:
            optional = {out[-1].mark, kid.mark} <= {"?", "*"}
            out[-1] = (yield _merging(out[-1], kid)).marked(_mark("", "", optional, repeated=True))
        else:
            out.append(kid)
    return tuple(out)


def _merging(a: Expression, b: Expression) -> Generator:
    mark = _mark(a.mark, b.mark)
    if a.like(b):
        return a.marked(mark)
    kids = []
    for i, j in aligned([k.label for k in a.kids], [k.label for k in b.kids]):
        if i is not None and j is not None:
            kids.append((yield _merging(a.kids[i], b.kids[j])))
        else:
            kid = a.kids[i] if j is None else b.kids[j]
            kids.append(kid.marked(_mark(kid.mark, "", optional=True)))
    return Expression(a.label, mark, (yield _folding(kids)))


def expression(group: Group) -> Expression:
    return _finished(_read_as(group))


def merged(a: Expression, b: Expression) -> Expression:
    """Two expressions of one label as one that fits both."""
    return _finished(_merging(a, b))


#: Pairs of labels up to which a gap between anchors is aligned by its longest common subsequence.
GAP = 40_000


def aligned(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of both sides in order, equal labels beside each other: equal ends first, then labels that both sides have once."""
    out: list[tuple[int | None, int | None]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and x[b - tail - 1] == y[d - tail - 1]:
            tail += 1
        if tail:
            todo.append((b - tail, b, d - tail, d))
            b, d = b - tail, d - tail
        if a == b or c == d:
            out += [(i, None) for i in range(a, b)] + [(None, j) for j in range(c, d)]
            continue
        anchors = _anchors(x, y, a, b, c, d)
        if not anchors:
            anchors = _subsequence(x, y, a, b, c, d) if (b - a) * (d - c) <= GAP else _greedy(x, y, a, b, c, d)
            if not anchors:
                out += [(i, None) for i in range(a, b)] + [(None, j) for j in range(c, d)]
                continue
        edges = [(a, c), *[(i + 1, j + 1) for i, j in anchors]]
        ends = [*anchors, (b, d)]
        parts = []
        for (i, j), (k, m), here in zip(edges, ends, [*anchors, None]):
            if (i, j) != (k, m):
                parts.append((i, k, j, m))
            if here:
                parts.append((k, k + 1, m, m + 1))
        todo += reversed(parts)
    return out


def _anchors(x: list[str], y: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """The longest rising run of labels that both sides have once."""
    of_x, of_y = _places(x, a, b), _places(y, c, d)
    pairs = [(p[0], of_y[w][0]) for w, p in of_x.items() if len(p) == 1 and len(of_y.get(w, ())) == 1]
    tops: list[int] = []
    held: list[tuple] = []
    for i, j in pairs:  # in the order of x
        k = bisect_left(tops, j)
        link = (i, j, held[k - 1] if k else None)
        if k == len(tops):
            tops.append(j)
            held.append(link)
        else:
            tops[k], held[k] = j, link
    out, link = [], held[-1] if held else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _places(x: list[str], a: int, b: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in range(a, b):
        out.setdefault(x[i], []).append(i)
    return out


def _subsequence(x: list[str], y: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
    for i in range(b - a - 1, -1, -1):
        for j in range(d - c - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[a + i] == y[c + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < b - a and j < d - c:
        if x[a + i] == y[c + j]:
            out.append((a + i, c + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _greedy(x: list[str], y: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Each label with the next equal one that is no further than the rest is long: not the longest run, but one that fits."""
    of_y, out, j = _places(y, c, d), [], c
    for i in range(a, b):
        there = of_y.get(x[i], [])
        k = bisect_right(there, j - 1)
        if k < len(there) and there[k] - j <= 2 * (b - i):
            out.append((i, there[k]))
            j = there[k] + 1
    return out


def written_as(e: Expression) -> str:
    """The expression as text: label{kids}mark."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        todo.append(x.mark)
        if x.kids:
            todo.append("}")
            for n, kid in enumerate(reversed(x.kids)):
                todo += [" ", kid] if n else [kid]
            todo.append("{")
        out.append(x.label)
    return "".join(out)


def packed(e: Expression) -> str:
    """The expression as lines (labels have no white space): mark or ``.`` and label, its kids, ``)``."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if x is None:
            out.append(")")
        else:
            out.append((x.mark or ".") + x.label)
            todo.append(None)
            todo += reversed(x.kids)
    return "\n".join(out)


def unpacked(text: str) -> Expression:
    open_: list[tuple[str, str, list[Expression]]] = [("", "", [])]
    for line in text.split("\n"):
        if line == ")":
            label, mark, kids = open_.pop()
            open_[-1][2].append(Expression(label, mark, tuple(kids)))
        else:
            open_.append((line[1:], line[0].strip("."), []))
    return open_[0][2][0]


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def article_slots(wrapper: Expression, sums: dict[int, tuple[int, int, bool]]) -> tuple[list[int], list[int]]:
    """Paths of the slots under ``article`` or ``main``, and of those that hold the article of a page without one.

    sums: per path characters, those in links, whether it is the same text on different pages.
    """
    marked: list[int] = []
    other: list[int] = []
    # Per open group: expression, path, inside an article, may hold other slots, kids, characters, linked ones, slots before it.
    open_ = [[wrapper, 0, False, True, iter(wrapper.kids), 0, 0, 0]]

    def enter() -> None:
        e, path, inside, usable = open_[-1][:4]
        if any(k.label in ("#", "@") for k in e.kids):
            chars, linked, same = sums.get(path, (0, 0, False))
            open_[-1][5:7] = chars, linked
            if inside:
                marked.append(path)
            elif usable and not same:
                other.append(path)

    enter()
    while open_:
        e, path, inside, usable, kids, chars, linked, before = open_[-1]
        kid = next(kids, None)
        if kid is None:
            open_.pop()
            if e.mark in ("+", "*") and chars and linked >= 0.8 * chars:
                del other[before:]
            if open_:
                open_[-1][5] += chars
                open_[-1][6] += linked
        elif kid.label not in ("#", "@"):
            aside = no_article(kid.label, inside)
            tag = kid.label.rstrip("~").split(".", 1)[0]
            if aside and (inside or tag in ASIDE - {"form"}):
                continue
            # A form or a group named like an aside may still enclose the article; its other texts count for nothing.
            open_.append([kid, step(path, kid.label), not aside and (inside or tag in MARKED), usable and not aside, iter(kid.kids), 0, 0, len(other)])
            enter()
    return sorted(set(marked)), sorted(set(other))


SLOTS = "array<struct<path: long, h: long, chars: long, linked: long>>"


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_expressions(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, page (hash of the html), expression, slots: per path a hash of the text, its characters, those in links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                hosts, digests, made, held = [], [], [], []
                for url, page in zip(*(c.to_pylist() for c in part.columns)):
                    root = read(page or "")
                    hosts.append(host_of(url))
                    digests.append(_digest(page or ""))
                    made.append(packed(expression(root)))
                    texts: dict[int, list[tuple[bool, str]]] = {}
                    for path, link, text, _ in slots(root):
                        if text.strip():
                            texts.setdefault(path, []).append((link, " ".join(text.split())))
                    held.append([{"path": p, "h": _digest("\n".join(t for _, t in v)), "chars": sum(len(t) for _, t in v), "linked": sum(len(t) for link, t in v if link)} for p, v in texts.items()])
                kind = pa.list_(pa.struct([("path", pa.int64()), ("h", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(made, pa.string()), pa.array(held, kind)], names=["host", "page", "expression", "slots"])

    return bounded_batches(pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string"))).mapInArrow(trimmed(run), f"host string, page long, expression string, slots {SLOTS}")


def _merged_by(rows: DataFrame) -> DataFrame:
    """host, expression: the expressions of each host and part aligned one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper = None, None
        for batch in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                e = unpacked(text)
                if key == last:
                    wrapper = merged(wrapper, e)
                else:
                    if last is not None:
                        out.append((last[0], packed(wrapper)))
                    last, wrapper = key, e
            yield _rows(out)
        yield _rows([] if last is None else [(last[0], packed(wrapper))])

    def _rows(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=["host", "expression"])

    keys = ("host", "part")
    return rows.select(*keys, "expression").repartition(*keys).sortWithinPartitions(*keys, "expression").mapInArrow(trimmed(run), "host string, expression string")


def _aligned(expressions: DataFrame) -> DataFrame:
    """host, expression: one wrapper per host. Each round leaves a ``PART``-th of the rows of a host."""
    while True:
        size = expressions.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        most = size.agg(F.max("n")).first()[0] or 1
        if most == 1:
            return expressions
        many = size.select("host", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        dealt = expressions.join(many, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("expression"), F.col("parts")), F.lit(0)))
        expressions = written(_merged_by(dealt), "wrappers")


def wrappers(read_pages: DataFrame) -> DataFrame:
    """host, wrapper (packed), marked, other array<long>: paths of the slots under ``article`` or ``main``, and of those that stand in for them."""
    whole = _aligned(read_pages.select("host", "expression").distinct())
    sums = (
        read_pages.select("host", "page", F.explode("slots").alias("s"))
        .groupBy("host", "s.path")
        .agg(F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"), F.min("s.h").alias("a"), F.max("s.h").alias("b"), F.approx_count_distinct("page", 0.02).alias("n"))
    )
    same = (F.col("a") == F.col("b")) & (F.col("n") >= LEAST_PAGES) & (F.col("host") != "")
    per_host = sums.groupBy("host").agg(F.collect_list(F.struct("path", "chars", "linked", same.alias("same"))).alias("sums"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            chosen = [article_slots(unpacked(text), {s["path"]: (s["chars"], s["linked"], s["same"]) for s in held or []}) for text, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in chosen], kind), pa.array([o for _, o in chosen], kind)], names=["host", "wrapper", "marked", "other"])

    return whole.join(per_host, "host", "left").select("host", "expression", "sums").mapInArrow(choose, "host string, wrapper string, marked array<long>, other array<long>")


def article_text(page: str | None, marked: frozenset[int], other: frozenset[int]) -> str:
    """The blocks of the slots in ``marked``; of a page that has no text there, those in ``other``."""
    texts = [(path, text, block) for path, _, text, block in slots(read(page or ""))]
    for wanted in (marked, other):
        blocks, last = [], None
        for path, text, block in texts:
            if path in wanted:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        if found := [b for b in (" ".join("".join(b).split()) for b in blocks) if b]:
            return "\n\n".join(found)
    return ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text: the main text of each page by the wrapper of its host."""
    seen = written(page_expressions(pages, url_col, html_col), "expressions")
    found = written(wrappers(seen).select("host", "marked", "other"), "article-slots")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    if (found.agg(F.sum(F.size("marked") + F.size("other") + 4)).first()[0] or 0) <= SLOTS_SENT:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:  # too many hosts to send everywhere: pages meet their host's slots, a host with many pages in several parts
        parts = seen.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PAGES).cast("int").alias("parts"))
        sent = found.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = rows.join(F.broadcast(parts.filter("parts > 1")), "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("parts")), F.lit(0)))
        rows = dealt.drop("parts").join(sent.drop("parts"), ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                chosen = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                texts = [article_text(p, frozenset(m or ()), frozenset(o or ())) for p, (m, o) in zip(part.column(2).to_pylist(), chosen)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return bounded_batches(rows.select("id", "url", "html", "marked", "other")).mapInArrow(trimmed(run), f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string")
