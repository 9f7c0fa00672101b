"""Fields out of text by rules tables: labelled values, patterns with confidence, terms, custom rules, contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.functions.checks import VALIDATORS
from brambling.functions.dictionaries import rules_of, terms_inside
from brambling.functions.text import col


def labelled(c: Column | str, aliases: list[str], value: str = r"[^\n|]{1,80}") -> Column:
    """The value behind the first alias that occurs: after a colon on its line, in the next cell, or on the next line."""
    text = col(c)
    found = []
    for a in aliases:
        label = rf"(?im)^[ \t|]*{a}[ \t]*"
        found += [F.regexp_extract(text, rf"{label}[:=][ \t]*({value})", 1), F.regexp_extract(text, rf"{label}\|[ \t]*({value})", 1), F.regexp_extract(text, rf"{label}\n[ \t]*({value})", 1)]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in found])


def fields(docs: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, str | None, float]]) -> DataFrame:
    """key, field, value, confidence, valid. patterns: field -> (pattern with one group, validator or null, confidence).

    A value that its validator rejects keeps a third of the confidence.
    """
    made = []
    for name, (pattern, check, confidence) in patterns.items():
        v = F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))
        ok = VALIDATORS[check](v) if check else F.lit(True)
        made.append(F.when(v.isNotNull(), F.struct(F.lit(name).alias("field"), v.alias("value"), F.round(F.when(ok, confidence).otherwise(confidence / 3), 4).alias("confidence"), ok.alias("valid"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*made))).alias("f")).select(key, "f.*")


def vehicle(c: Column | str) -> Column:
    """struct(plate, vin, year) of the first finds."""
    text = F.upper(col(c))
    plate = F.regexp_replace(F.regexp_extract(text, r"(?<![A-Z0-9])((?:0[1-9]|[1-7][0-9]|8[01])[ ]?[A-Z]{1,3}[ ]?[0-9]{2,4})(?![A-Z0-9])", 1), " ", "")
    vin = F.regexp_extract(text, r"(?<![A-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])", 1)
    year = F.regexp_extract(text, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
    empty = F.lit("")
    return F.struct(F.nullif(plate, empty).alias("plate"), F.nullif(vin, empty).alias("vin"), year.alias("year"))


def table_rows(docs: DataFrame, key: str, text: str, separator: str = r"\|") -> DataFrame:
    """key, row, name, amount: lines of a table with a name and a number, in order."""
    from brambling.functions.numbers import parse_amount

    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("row", "line")).filter(F.col("line").rlike(rf"{separator}.*\d"))
    cells = lines.select(key, "row", F.filter(F.transform(F.split("line", separator), lambda x: F.trim(x)), lambda x: x != "").alias("cells")).filter(F.size("cells") >= 2)
    return cells.select(key, "row", F.col("cells")[0].alias("name"), parse_amount(F.element_at("cells", -1)).alias("amount"))


def normalised(c: Column | str, rules: list[tuple[str, str, str]]) -> Column:
    """struct(text, applied) after all rules (name, pattern, replacement) in order, with the names of those that changed something."""
    text, seen = col(c), []
    for name, pattern, replacement in rules:
        after = F.regexp_replace(text, pattern, replacement)
        seen.append(F.when(after != text, F.lit(name)))
        text = after
    return F.struct(text.alias("text"), F.array_compact(F.array(*seen)).alias("applied") if seen else F.array().cast("array<string>").alias("applied"))


def classified(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, label, score: the label with the most term weight, the first in order on a tie. terms (a table of rules): pos, label, term, weight."""
    lowered = terms.select("pos", "label", F.lower("term").alias("term"), "weight")
    different = [t for (t,) in rules_of(lowered.select("term").dropna().distinct(), "term")]
    places = docs.sparkSession.createDataFrame(list(enumerate(different)), "_i int, term string")
    found = docs.select(key, F.explode(terms_inside(F.lower(F.col(text)), different)).alias("_i"))
    hits = found.join(F.broadcast(places.join(lowered, "term")), "_i")
    sums = hits.groupBy(key, "label").agg(F.sum("weight").alias("score"), F.min("pos").alias("pos"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "label")).alias("m"))
    return docs.select(key).join(best, key, "left").select(key, F.col("m.label").alias("label"), F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("score"))


def place(c: Column | str, places: list[tuple[str, str]], default: str | None = None) -> Column:
    """The region of the first place whose name occurs as a word."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.upper(col(c)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = [F.when(F.contains(text, F.lit(f" {name.upper()} ")), F.lit(region)) for name, region in places]
    return F.coalesce(*hits, F.lit(default).cast("string"))


def province(c: Column | str, provinces: list[tuple[str, str]]) -> Column:
    """The code of the first province whose name is part of an address, else the first two-digit number that is a code."""
    text = F.upper(col(c))
    named = [F.when(F.contains(F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.lit(f" {name.upper()} ")), F.lit(code)) for name, code in provinces]
    codes = F.array(*[F.lit(code) for _, code in provinces])
    given = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{2})(?![0-9])"), F.lit(1)), lambda x: F.array_contains(codes, x))
    return F.coalesce(*named, F.try_element_at(given, F.lit(1)))


def contradictions(docs: DataFrame, key: str, text: str, claims: dict[str, tuple[str, str, str]]) -> DataFrame:
    """key, claim, severity: an extracted value that none of the pattern's finds in the text agrees with. claims: name -> (column, pattern, severity)."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"[\s.,]", ""))
    found = []
    for name, (column, pattern, severity) in claims.items():
        in_text = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), plain)
        wrong = F.col(column).isNotNull() & (F.size(in_text) > 0) & ~F.array_contains(in_text, plain(F.col(column).cast("string")))
        found.append(F.when(wrong, F.struct(F.lit(name).alias("claim"), F.lit(severity).alias("severity"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("c")).select(key, "c.*")


def integrity(severities: Column) -> Column:
    """Worst of an array of severities as a verdict."""
    return F.when(F.array_contains(severities, "critical"), "broken").when(F.array_contains(severities, "warning"), "doubtful").otherwise("sound")


def admission(text: Column, provider: Column, number: Column, n_coverages: Column) -> Column:
    """struct(decision, reasons): is a document fit for automatic handling?"""
    n = F.length(F.coalesce(text, F.lit("")))
    generic = F.lower(F.trim(F.coalesce(provider, F.lit("")))).isin("", "unknown", "sigorta", "insurance")
    bad_number = F.coalesce(F.trim(number), F.lit("")).isin("") | F.contains(F.coalesce(number, F.lit("")), F.lit("??"))
    rules = [("no_text", n < 100, True), ("little_text", (n >= 100) & (n < 500), False), ("no_provider", generic, False), ("no_number", bad_number, False), ("no_coverages", (n_coverages == 0) & (n < 3000), True)]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad, _ in rules]))
    refuse = reduce(lambda a, b: a | b, (bad for _, bad, hard in rules if hard))
    return F.struct(F.when(refuse, "reject").when(F.size(reasons) > 0, "review").otherwise("admit").alias("decision"), reasons.alias("reasons"))
