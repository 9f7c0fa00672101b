"""Validators of identifiers and amounts. Each gives true or false, false for null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brambling.functions.numbers import near
from brambling.functions.text import col


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _digits(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x.rlike("^[0-9]$")), lambda x: x.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def national_id(c: Column | str) -> Column:
    """Eleven digits, the first not zero; the tenth and eleventh check the others."""
    d = _digits(col(c))
    at = lambda *k: sum((F.get(d, i) for i in k[1:]), F.get(d, k[0]))
    tenth = F.pmod(at(0, 2, 4, 6, 8) * 7 - at(1, 3, 5, 7), F.lit(10))
    return _yes((F.size(d) == 11) & (F.get(d, 0) != 0) & (tenth == F.get(d, 9)) & (F.pmod(_sum(F.slice(d, 1, 10)), F.lit(10)) == F.get(d, 10)))


def tax_number(c: Column | str, offset: int = 10) -> Column:
    """Ten digits with a check digit. Two variants are in use: ``offset`` 10 and 9."""
    d = _digits(col(c))
    step = lambda x, i: (x + offset - i) % 10

    def term(x: Column, i: Column) -> Column:
        v = step(x, i)
        t = (v * F.pow(F.lit(2), 9 - i)).cast("int") % 9
        return F.when(v == 0, 0).when(t == 0, 9).otherwise(t)

    total = _sum(F.transform(F.slice(d, 1, 9), term))
    return _yes((F.size(d) == 10) & ((10 - total % 10) % 10 == F.get(d, 9)))


def vehicle_number(c: Column | str) -> Column:
    return _yes(col(c).rlike("^[A-HJ-NPR-Z0-9]{17}$"))


def vehicle_number_digit(c: Column | str) -> Column:
    """The ninth character checks the others modulo eleven (ten is X)."""
    # Letter values and weights of vehicle numbers.
    letters, values = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
    weights = F.array(*[F.lit(w) for w in (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)])
    c = F.upper(col(c))
    numbers = F.transform(F.filter(F.split(F.translate(c, letters, values), ""), lambda x: x != ""), lambda x: x.try_cast("int"))
    total = _sum(F.zip_with(numbers, weights, lambda a, b: a * b)) % 11
    return _yes(vehicle_number(c) & (F.substring(c, 9, 1) == F.when(total == 10, "X").otherwise(total.cast("string"))))


def plate(c: Column | str) -> Column:
    """Province 01 to 81, one to three letters, one to four digits."""
    c = F.upper(F.regexp_replace(col(c), r"\s+", ""))
    return _yes(c.rlike(r"^\d{2}[A-Z]{1,3}\d{1,4}$") & F.substring(c, 1, 2).try_cast("int").between(1, 81))


def iban(c: Column | str, country: str = "TR", digits: int = 24) -> Column:
    """Remainder one modulo 97 after the first four characters went to the end."""
    c = F.upper(F.regexp_replace(col(c), r"\s+", ""))
    turned = F.filter(F.split(F.concat(F.substring(c, 5, 99), F.substring(c, 1, 4)), ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("^[0-9]$"), x.try_cast("long")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(turned, F.lit(0).cast("long"), lambda r, x: (r * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97)
    return _yes(c.rlike(rf"^{country}\d{{{digits}}}$") & (rest == 1))


def phone(c: Column | str) -> Column:
    """Eleven digits with a leading zero, written 0AAA BBB CC DD; else the digits."""
    d = F.regexp_replace(col(c), r"\D", "")
    d = F.when(d.startswith("90"), F.concat(F.lit("0"), F.substring(d, 3, 99))).when(~d.startswith("0") & (F.length(d) == 10), F.concat(F.lit("0"), d)).otherwise(d)
    return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(.{4})(.{3})(.{2})(.{2})$", "$1 $2 $3 $4")).otherwise(d)


def premium_sum(net: Column | str, tax: Column | str, total: Column | str, tolerance: float = 0.01) -> Column:
    return _yes(near(col(net) + col(tax), col(total), tolerance))


def page_sequence(pages: Column | str) -> Column:
    """Page numbers 1, 2, 3, ... without a hole."""
    return _yes(F.array_sort(col(pages)) == F.sequence(F.lit(1), F.size(col(pages))))


def within(c: Column | str, low: float = 0, high: float = 100) -> Column:
    return _yes(col(c).between(low, high))


#: Validators by name, for rules tables.
VALIDATORS: dict[str, Callable[..., Column]] = {
    "national_id": national_id, "tax_number": tax_number, "vehicle_number": vehicle_number, "vehicle_number_digit": vehicle_number_digit,
    "plate": plate, "iban": iban, "premium_sum": premium_sum, "page_sequence": page_sequence, "percent": within,
}


def failures(rules: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Names of the rules that fail. rules: (name, validator, columns); a rule whose columns are all null is skipped."""
    tests = []
    for name, validator, columns in rules:
        given = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        tests.append(F.when(given & ~VALIDATORS[validator](*columns), F.lit(name)))
    return F.array_compact(F.array(*tests))
