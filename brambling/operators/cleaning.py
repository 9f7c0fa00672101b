"""Scanned text made readable: spaced words put together, tokens kept as they are, ordered passes with counts. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brambling.functions.text import clean_lines, col, count_of, garbage_reason, merge_spaced_capitals, once

#: Stands for a kept token; a character of the private area.
KEPT = ""


def known_words(c: Column | str, words: dict[str, str]) -> Column:
    """Words whose letters were torn apart, whole again. words: word -> its letters as classes, e.g. ``P O L [İI]``."""
    out = col(c)
    for word, letters in words.items():
        pattern = r"(?iu)(?<!\p{L})" + r"[ \t]*".join(letters.split(" ")) + r"(?!\p{L})"
        out = F.regexp_replace(out, pattern, word)
    return out


def despaced(c: Column | str, words: dict[str, str], most: int = 4) -> Column:
    """struct(text, passes): spaced capitals and known words put together until nothing changes, ``most`` times at most."""
    state = lambda text, passes, going: F.struct(text.alias("text"), passes.alias("passes"), going.alias("going"))

    def one_pass(s: Column, _: Column) -> Column:
        again = once(known_words(merge_spaced_capitals(s["text"]), words), lambda after: state(after, s["passes"] + 1, F.coalesce(after != s["text"], F.lit(False))))
        return F.when(s["going"], again).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state(col(c), F.lit(0), F.lit(True)), one_pass, lambda s: F.struct(s["text"].alias("text"), s["passes"].alias("passes")))


def keeping(c: Column | str, tokens: str, work) -> Column:
    """``work`` on the text while what matches ``tokens`` stays as it is: each match is one mark, put back in order."""
    text = F.replace(col(c), F.lit(KEPT), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"({tokens})"), F.lit(1))
    parts = F.split(work(F.regexp_replace(text, tokens, KEPT)), KEPT, -1)
    return F.array_join(F.zip_with(parts, found, lambda p, t: F.concat(F.coalesce(p, F.lit("")), F.coalesce(t, F.lit("")))), "")


def normalised_ocr(c: Column | str, words: dict[str, str], tokens: str) -> Column:
    """Lines without noise, known words and spaced capitals put together, tokens (plates, numbers) kept, single blanks, trimmed lines."""
    lines = F.array_join(F.filter(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: garbage_reason(x).isNull()), "\n")
    mended = keeping(lines, tokens, lambda t: merge_spaced_capitals(known_words(t, words)))
    return F.regexp_replace(F.regexp_replace(mended, r"[^\S\n]+", " "), r"(?m)^ | $", "")


def sanitised(c: Column | str) -> Column:
    """struct(text, n_before, n_after, lines_dropped, control_removed) of a text without noise lines, control characters and long gaps."""
    text = F.coalesce(col(c), F.lit(""))
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    dropped = F.size(F.filter(lines, lambda x: garbage_reason(x).isNotNull()))
    control = count_of(text, r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f")
    return once(clean_lines(text), lambda clean: F.struct(clean.alias("text"), F.length(text).alias("n_before"), F.length(clean).alias("n_after"), dropped.alias("lines_dropped"), control.alias("control_removed")))


def pre_clean(c: Column | str, words: dict[str, str], labels: list[tuple[str, str]], fields: list[tuple[str, str]], headers: list[tuple[str, str]], most: int = 4) -> Column:
    """struct(text, despacing_passes, page_marks, lines_dropped) after eleven passes in a fixed order.

    Exotic spaces, control characters, noise lines, barcodes within lines, torn words, glued labels, registry fields, page
    marks, slashes, headings on lines of their own, white space. labels, fields and headers are tables (pattern, replacement).
    """
    text = F.coalesce(col(c), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]", " "), r"[\x{200b}-\x{200d}\x{feff}\x{fffd}]", "")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")

    def without_noise(lines: Column) -> Column:
        return once(F.filter(lines, lambda x: garbage_reason(x).isNull()), lambda kept: F.struct(F.regexp_replace(F.array_join(kept, "\n"), r"[|!Il1]{10,}", "").alias("text"), (F.size(lines) - F.size(kept)).alias("n")))

    mark = r"(?im)^[ \t]*-*[ \t]*(?:page|sayfa)[ \t]*:?[ \t]*(\d+)[ \t]*(?:/|of)[ \t]*(\d+)[ \t]*-*[ \t]*$"

    def labelled(text: Column) -> Column:
        for pattern, replacement in [*labels, *fields]:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    def finished(text: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(text, mark, "[Page $1/$2]"), r"(?<=\w)[ \t]*/[ \t]*(?=\w)", "/")
        for pattern, replacement in headers:
            text = F.regexp_replace(text, pattern, replacement)
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ | $", ""), r"\n{3,}", "\n\n"))

    def result(clean: Column, torn: Column) -> Column:
        marks = lambda text: F.size(F.regexp_extract_all(text, F.lit(f"({mark})"), F.lit(1)))
        return once(labelled(torn["text"]), lambda text: F.struct(finished(text).alias("text"), torn["passes"].alias("despacing_passes"), marks(text).alias("page_marks"), clean["n"].alias("lines_dropped")))

    return once(once(F.split(text, "\n"), without_noise), lambda clean: once(despaced(clean["text"], words, most), lambda torn: result(clean, torn)))
