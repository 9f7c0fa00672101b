"""String functions: folding, normal forms, similarity, quality ratios, signals, templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the Turkish alphabet and their plain forms; characters that OCR confuses.
TURKISH, PLAIN = "İıĞğÜüŞşÖöÇç", "IiGgUuSsOoCc"
OCR_CONFUSED, OCR_MEANT = "01lıi5", "oiiiis"
LETTERS = "a-zA-ZçğıöşüÇĞİÖŞÜâîûÂÎÛ"
ALL_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + LETTERS[6:]
BLANKS = " \t\n\x0b\f\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_ascii(c: Column | str) -> Column:
    """Turkish letters as their ASCII base letters."""
    return F.translate(col(c), TURKISH, PLAIN)


def lower_turkish(c: Column | str) -> Column:
    """Lower case by Turkish rules: dotless and dotted i stay apart."""
    return F.lower(F.translate(col(c), "Iİ", "ıi"))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def coverage_key(c: Column | str) -> Column:
    """The comparison form of a coverage name: folded, lower case, words of letters and digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_ascii(c)), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def label_key(c: Column | str) -> Column:
    return collapse_spaces(lower_turkish(c))


def tolerant_key(c: Column | str) -> Column:
    """Lower case, single spaces, none around : / , and full stops."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " "), r"\s*([:/,.])\s*", "$1"))


def identifier_key(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", "")), F.lit(""))


def ocr_key(c: Column | str) -> Column:
    """Characters that OCR confuses as one, and nothing but letters and digits."""
    return F.regexp_replace(F.translate(F.lower(col(c)), OCR_CONFUSED, OCR_MEANT), "[^a-z0-9]", "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein / longer length; two empty strings are alike, one empty string is like none."""
    a, b = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def ocr_alike(a: Column | str, b: Column | str, threshold: float = 0.85, short: float = 0.9) -> Column:
    """Equal or similar after OCR folding; keys under five characters must reach ``short``."""
    a, b = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    x, y = ocr_key(a), ocr_key(b)
    need = F.when(F.least(F.length(x), F.length(y)) < 5, short).otherwise(threshold)
    one_empty = (a == "") != (b == "")
    return ~one_empty & ((x == y) | (similarity(x, y) >= need))


def tokens(c: Column | str, least: int = 1) -> Column:
    """Lower-case words of letters and digits, in order."""
    found = F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: F.length(w) >= least)


def stem_set(c: Column | str, stop_words: list[str], prefix: int = 4) -> Column:
    """Distinct prefixes of the words that are no stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)), lambda w: F.substring(w, 1, prefix)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def without(c: Column | str, characters: str) -> Column:
    """The text without these characters: one pass, no pattern."""
    return F.translate(col(c), characters, "")


def letter_ratio(c: Column | str) -> Column:
    """Share of letters among what is no white space; 1 for blank text."""
    solid = without(c, BLANKS)
    n = F.length(solid)
    return F.when(n == 0, 1.0).otherwise((n - F.length(without(solid, ALL_LETTERS))) / n)


def count_of(c: Column | str, characters: str) -> Column:
    """How many characters of a class there are."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"[{characters}]", ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    A Column that is named twice is written out twice, and one that is built by steps grows with every step; a lambda's
    variable is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), use), 0)


def garbage_reason(line: Column | str) -> Column:
    """Why a line is scanning noise: a code of marks only, too many high bytes or control characters, too few letters; else null."""

    def reason(t: Column) -> Column:
        n = F.length(t)
        many = lambda marks, most, share: once(count_of(t, marks), lambda k: (k > most) | (k / n > share))
        return (
            F.when(n == 0, F.lit(None).cast("string"))
            .when(t.rlike(r"^[|!Il1\s]{10,}$|^[^\p{L}\p{N}\s]{6,}$"), "barcode")
            .when(many(r"\x{80}-\x{ff}", 10, 0.3), "high_ascii")
            .when(many(r"\x00-\x1f\x7f-\x{9f}\x{fffd}", 5, 0.2), "control")
            .when((n > 40) & (F.length(F.regexp_replace(t, r"\s", "")) > 40) & (letter_ratio(t) < 0.15), "few_letters")
        )

    return once(F.trim(col(line)), reason)


def clean_lines(c: Column | str) -> Column:
    """The text without noise lines, control characters and repeated blanks; line order kept."""
    text = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), r"[\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}]", " ")
    kept = F.filter(F.split(text, "\n"), lambda x: garbage_reason(x).isNull())
    tidy = F.transform(kept, lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[ \t]{2,}", " ")))
    return F.trim(F.regexp_replace(F.array_join(tidy, "\n"), "\n{3,}", "\n\n"))


def merge_spaced_capitals(c: Column | str) -> Column:
    """P O L I C Y as POLICY: single capitals apart by one blank, three at least."""
    return F.regexp_replace(col(c), r"(?<=(?<![\p{L}\p{N}])\p{Lu}) (?=\p{Lu}(?![\p{L}\p{N}]))", "")


def clean_links(c: Column | str) -> Column:
    """White space inside URLs and e-mail addresses goes, trailing punctuation too."""
    c = F.regexp_replace(col(c), r"(?i)\b(https?)\s*:\s*/\s*/\s*", "$1://")
    c = F.regexp_replace(c, r"(?i)\bwww\s*\.\s*", "www.")
    c = F.regexp_replace(c, r"([\w.+-]+)\s*@\s*([\w-]+(?:\.[\w-]+)+)", "$1@$2")
    return F.regexp_replace(c, r"((?:https?://|www\.)[^\s]*?)[.,;]+(?=\s|$)", "$1")


def escape_html(c: Column | str, longest: int | None = None) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.substring(out, 1, longest) if longest else out


INJECTION = r"(?i)ignore (?:all |the )?(?:previous|above|prior) instructions|disregard (?:all|the|your) |you are now |system prompt|<\s*script|javascript:|\bunion\s+select\b|\bdrop\s+table\b|--\s*$"


def looks_injected(c: Column | str, pattern: str = INJECTION) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def contains_phrase(c: Column | str, phrases: list[str]) -> Column:
    text = F.lower(col(c))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p.lower())) for p in phrases), F.lit(False))


def phrases_in(c: Column | str, phrases: list[str]) -> Column:
    """The phrases that occur, in the order given."""
    text = F.lower(col(c))
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p)) for p in phrases]))


def signal_score(c: Column | str, signals: list[tuple[str, float]], most: float = 1.0) -> Column:
    """Sum of the weights of the patterns that match, up to ``most``."""
    total = reduce(lambda a, b: a + b, (F.when(col(c).rlike(p), w).otherwise(0.0) for p, w in signals), F.lit(0.0))
    return F.least(total, F.lit(most))


def term_score(c: Column | str, terms: list[str], letters: str = "", padded: Column | str | None = None) -> Column:
    """0.7 of the share of terms that occur plus 0.3 of the special letters (five or more count in full).

    ``padded``: a column that holds ``padded_words`` of the text already, when many sets of terms are tried.
    """
    words = padded_words(c) if padded is None else col(padded)
    share = reduce(lambda a, b: a + b, (F.when(words.contains(f" {t} "), 1).otherwise(0) for t in terms), F.lit(0)) / max(1, len(terms))
    special = F.least(count_of(c, letters) / 5, F.lit(1.0)) if letters else F.lit(0.0)
    return F.lit(0.7) * share + F.lit(0.3) * special


def padded_words(c: Column | str) -> Column:
    """Lower-case words between single blanks, one before and one behind all."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def tokens_contain(c: Column | str, word: str) -> Column:
    return padded_words(c).contains(f" {word} ")


def best_label(scores: dict[str, Column], least: float = 0.0) -> Column:
    """The label of the greatest score, the first on a tie, null if none exceeds ``least``."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.when(top > least, F.coalesce(*[F.when(s == top, F.lit(k)) for k, s in scores.items()]))


def first_rule(c: Column | str, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(col(c).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def render_template(template: Column | str, values: Column | str) -> Column:
    """``{{#if name}}..{{/if}}`` blocks first (kept if the value is not empty), then ``{{name}}``; unknown names are empty. values: map<string,string>."""
    values = col(values)
    filled = F.aggregate(
        F.map_entries(values),
        col(template),
        lambda t, e: F.when(
            F.coalesce(e["value"], F.lit("")) == "", F.regexp_replace(t, F.concat(F.lit(r"(?s)\{\{#if "), e["key"], F.lit(r"\}\}.*?\{\{/if\}\}")), F.lit(""))
        ).otherwise(F.regexp_replace(t, F.concat(F.lit(r"(?s)\{\{#if "), e["key"], F.lit(r"\}\}(.*?)\{\{/if\}\}")), F.lit("$1"))),
    )
    filled = F.regexp_replace(filled, r"(?s)\{\{#if [^}]*\}\}.*?\{\{/if\}\}", "")
    filled = F.aggregate(F.map_entries(values), filled, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(filled, r"\{\{[^}]*\}\}", "")


def route_template(c: Column | str) -> Column:
    """A request path with ids as placeholders and without its query."""
    c = F.regexp_replace(col(c), r"\?.*$", "")
    c = F.regexp_replace(c, r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", ":id")
    return F.regexp_replace(c, r"/\d+(?=/|$)", "/:id")


def excerpt(c: Column | str, n: int = 50) -> Column:
    """The first ``n`` characters, and ``...`` if there are more."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def entity_type(number: Column | str) -> Column:
    """Eleven digits name a person, ten a company; anything else says nothing."""
    n = F.length(F.regexp_replace(col(number), r"\D", ""))
    return F.when(n == 11, "individual").when(n == 10, "corporate")
