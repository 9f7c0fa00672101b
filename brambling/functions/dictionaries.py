"""Many terms against many texts: a text is read once, however many terms there are.

The terms of a checked table of rules come to the driver once and go to the tasks with the function; every task builds its
automaton (failure links over a trie) when it starts. Only the text column goes through Arrow, the results come back as
columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and characters up to which a table of rules is a dictionary.
MOST_TERMS, MOST_LETTERS = 200_000, 20_000_000


def rules_of(rules: DataFrame, *columns: str) -> list[tuple]:
    """The rows of a table of rules, sorted; its size is checked before anything is brought here."""
    rows = rules.select(*columns)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat_ws("", *columns))).alias("letters")).first()
    if n["n"] > MOST_TERMS or (n["letters"] or 0) > MOST_LETTERS:
        raise ValueError(f"a dictionary has at most {MOST_TERMS} terms and {MOST_LETTERS} letters")
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def automaton(terms: list[str]) -> ahocorasick.Automaton | None:
    """Finds, in one pass over a text, the least place of each different term."""
    made = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t and t not in made:
            made.add_word(t, i)
    if not len(made):
        return None
    made.make_automaton()
    return made


def terms_inside(text: Column, terms: list[str]) -> Column:
    """array<int>: the places (in ``terms``, of equal ones the first) of all terms that are a part of the text, ascending; null for null. Empty terms are part of nothing."""

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = automaton(terms)
        for batch in batches:
            rows = [None if t is None else sorted({i for _, i in made.iter(t)}) if made else [] for t in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.int32()))

    return found(text)


def first_inside(text: Column, terms: list[str], values: list[str | None]) -> Column:
    """The value of the first term (in the order given) that is a part of the text; null without one."""

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = automaton(terms)
        for batch in batches:
            firsts = [min((i for _, i in made.iter(t)), default=None) if t and made else None for t in batch.to_pylist()]
            yield pa.array([None if i is None else values[i] for i in firsts], pa.string())

    return found(text)


class Around:
    """Which terms contain a text: only terms with its rarest piece of up to three characters are looked at, in their order."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.having: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(terms):
            for piece in {t[j : j + n] for n in (1, 2, 3) for j in range(len(t) - n + 1)}:
                self.having[piece].append(i)

    def first(self, text: str, below: int) -> int:
        """The first term before ``below`` that contains the text, else ``below``."""
        n = min(3, len(text))
        nothing: list[int] = []
        near = min((self.having.get(text[j : j + n], nothing) for j in range(len(text) - n + 1)), key=len, default=nothing)
        return next((i for i in near if i >= below or text in self.terms[i]), below) if near else below


def first_either_way(text: Column, terms: list[str], values: list[str]) -> Column:
    """The value of the first term that is a part of the text or has the text as a part; empty texts and terms match nothing."""

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made, around = automaton(terms), Around(terms)
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                at = len(terms)
                if t and made:
                    at = min((i for _, i in made.iter(t)), default=at)
                    at = min(at, around.first(t, at))
                out.append(values[at] if at < len(terms) else None)
            yield pa.array(out, pa.string())

    return found(text)


#: What ends a run of plain characters in a pattern, and what makes the character before it optional.
PLAIN, OPTIONAL = re.compile(r"[^\\\[\](){}.*+?|^$]"), frozenset("*?{")


def needed(pattern: str) -> str:
    """The longest plain run, in lower case, that every match of a regular expression holds outside its groups; empty if none is certain.

    Anything but plain characters, escaped marks, groups, classes and repetitions gives up, and so do alternatives outside
    groups and letters beyond ASCII, whose case may not fold alike everywhere.
    """
    text = pattern[4:] if pattern.startswith("(?i)") else pattern
    if re.search(r"\(\?[a-z]*x", text):  # blanks are no characters then
        return ""
    best, run, depth, i = "", "", 0, 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        if c == "|" and depth == 0:
            return ""
        if c == "[":
            end = text.find("]", i + 2)
            if end < 0 or "[" in text[i + 1 : end] or "\\" in text[i:end]:
                return ""
            i, run, best = end + 1, "", max(best, run, key=len)
            continue
        if c == "(":
            depth, run, best = depth + 1, "", max(best, run, key=len)
        elif c == ")":
            depth, run = depth - 1, ""
        elif c == "\\":
            if after.isalnum() or not after.isascii():
                if after not in "dDwWsSbB":
                    return ""
                run, best = "", max(best, run, key=len)
            elif depth == 0 and text[i + 2 : i + 3] not in OPTIONAL:
                run += after
            else:
                run, best = "", max(best, run, key=len)
            i += 1
        elif PLAIN.match(c) and depth == 0 and c.isascii() and after not in OPTIONAL:
            run += c
        else:
            run, best = "", max(best, run, key=len)
            if c == "{":
                end = text.find("}", i)
                if end < 0:
                    return ""
                i = end
        i += 1
    return max(best, run, key=len).lower()


def matching(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows joined with the patterns (a table of rules) that match their text.

    Every pattern that has a run of characters each match must hold is tried only on texts that hold the run, which one
    automaton finds for all patterns; the others are tried on every text.
    """
    listed = [r[0] for r in rules_of(patterns.select(pattern).dropna().distinct(), pattern)]
    runs = [needed(p) for p in listed]
    different = sorted({r for r in runs if r})
    at = {r: i for i, r in enumerate(different)}
    spark = rows.sparkSession
    table = spark.createDataFrame([(p, at.get(r, -1)) for p, r in zip(listed, runs)], f"{pattern} string, _run int")
    inside = terms_inside(F.lower(F.col(text)), different)
    held = F.explode(F.concat(F.array(F.lit(-1)), inside) if "" in runs else inside)
    met = rows.withColumn("_run", held).join(F.broadcast(table), "_run").filter(F.regexp_like(F.col(text), F.col(pattern))).drop("_run")
    return met.join(F.broadcast(patterns), pattern)


def first_of_rules(text: Column, rules: DataFrame, order: str, part: str, value: str) -> Column:
    """The value of the first rule (by ``order``) whose part is in the text."""
    listed = rules_of(rules, order, part, value)
    return first_inside(text, [r[1] or "" for r in listed], [r[2] for r in listed])
