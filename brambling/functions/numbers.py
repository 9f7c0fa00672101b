"""Numbers, money, dates, buckets, percentiles and small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brambling.functions.text import col, once


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, also below zero."""
    scale = 10**digits
    return F.floor(col(c) * scale + 0.5) / scale if digits else F.floor(col(c) + 0.5)


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)


def parse_number(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """The last separator is the decimal one (so ``1.000`` is 1); null outside the bounds."""
    kept = F.regexp_replace(col(c), r"[^\d.,-]", "")
    dot, comma = F.locate(".", F.reverse(kept)), F.locate(",", F.reverse(kept))
    comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
    plain = F.when(comma_last, F.regexp_replace(F.replace(kept, F.lit(".")), "^([^,]*),", "$1.")).otherwise(F.replace(kept, F.lit(",")))
    number = F.regexp_extract(plain, r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")
    good = F.lit(True)
    if low is not None:
        good &= number >= low
    if high is not None:
        good &= number <= high
    return F.when(good, number)


def parse_amount(c: Column | str) -> Column:
    """A money amount in which a dot before the last three digits parts thousands (so ``1.000`` is 1000); 0 if there is none."""
    kept = F.regexp_replace(col(c), r"[^\d.,]", "")
    with_comma = F.regexp_replace(F.replace(kept, F.lit(".")), "^([^,]*),", "$1.")
    with_dots = F.when(kept.rlike(r"\.\d{3}$"), F.replace(kept, F.lit("."))).otherwise(kept)
    number = F.when(F.contains(kept, F.lit(",")), with_comma).otherwise(with_dots)
    return F.coalesce(F.regexp_extract(number, r"^\d*\.?\d+", 0).try_cast("double"), F.lit(0.0))


def format_turkish(c: Column | str, digits: int = 2) -> Column:
    return F.translate(F.format_number(col(c), digits), ",.", ".,")


def near(a: Column | str, b: Column | str, tolerance: float = 0.02) -> Column:
    """Both null, both zero, or apart by at most a share of the greater magnitude."""
    a, b = col(a), col(b)
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(top == 0, True).otherwise(F.abs(a - b) / top <= tolerance)


def equivalent(a: Column | str, b: Column | str, pairs: list[tuple[float, float]], tolerance: float = 0.05) -> Column:
    """Equal, or the lesser near the first and the greater near the second of one of the pairs."""
    a, b = col(a), col(b)
    low, high = F.least(a, b), F.greatest(a, b)
    out = a == b
    for x, y in pairs:
        out = out | (near(low, F.lit(x), tolerance) & near(high, F.lit(y), tolerance))
    return F.coalesce(out & a.isNotNull() & b.isNotNull(), F.lit(False))


# Turkish month names.
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")


def parse_date(c: Column | str, pivot: int = 50) -> Column:
    """Day-first dates with . / or -, year-first ones, and Turkish month names; two-digit years above ``pivot`` are of the last century. No calendar day: null."""
    day_first = r"(?<!\d)(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{4}|\d{2})(?!\d)"
    year_first = r"(?<!\d)(\d{4})[./-](\d{1,2})[./-](\d{1,2})(?!\d)"

    def numbered(c: Column) -> Column:
        named = c
        for k, name in enumerate(MONTHS, 1):
            named = F.regexp_replace(named, rf"\s*{name}\s*", f".{k:02d}.")
        return F.when(c.rlike("|".join(MONTHS)), named).otherwise(c)

    def date(c: Column) -> Column:
        part = lambda p, k: F.regexp_extract(c, p, k)
        year = lambda y: F.concat(F.when(F.length(y) == 2, F.when(y.try_cast("int") > pivot, "19").otherwise("20")).otherwise(""), y)
        a = F.concat_ws("-", part(year_first, 1), F.lpad(part(year_first, 2), 2, "0"), F.lpad(part(year_first, 3), 2, "0"))
        b = F.concat_ws("-", once(part(day_first, 3), year), F.lpad(part(day_first, 2), 2, "0"), F.lpad(part(day_first, 1), 2, "0"))
        return F.when(c.rlike(year_first), a.try_cast("date")).when(c.rlike(day_first), b.try_cast("date"))

    return once(once(F.lower(F.translate(F.trim(col(c)), "Iİ", "ıi")), numbered), date)


def all_dates(c: Column | str) -> Column:
    """All dates in a text as sorted distinct dates."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?<!\d)(\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{1,2}-\d{1,2})(?!\d)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda x: parse_date(x)))))


def expiry_status(expiry: Column | str, today: Column, soon: int = 30) -> Column:
    left = F.datediff(col(expiry), today)
    return F.when(left < 0, "expired").when(left <= soon, "expiring").otherwise("active")


def period_start(ts: Column | str, period: str) -> Column:
    """Start of the hour, day, week (from Sunday) or month."""
    ts = col(ts)
    if period == "week":
        return F.date_trunc("week", ts + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    return F.date_trunc(period, ts)


def two_year_bucket(year: Column | str) -> Column:
    return (F.floor(col(year) / 2) * 2).cast("int")


def typology_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def rolling_hash(c: Column | str) -> Column:
    """Absolute value of the 32-bit h * 31 + code over all characters."""
    wrap = lambda x: (x + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648
    letters = F.filter(F.split(col(c), ""), lambda x: x != "")
    return F.abs(F.aggregate(letters, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + F.ascii(x))))


def rollout_bucket(user: Column | str, flag: Column | str) -> Column:
    return rolling_hash(F.concat(col(user), col(flag))) % 100


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height)."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def percentiles(c: Column | str, *shares: float) -> Column:
    """Exact, with linear interpolation, as an array."""
    return F.percentile(col(c), F.array(*[F.lit(s) for s in shares]))


def nearest_rank(c: str, share: float) -> Column:
    """The smallest value that at least that share of the values does not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {c})")


def lognormal_mean(mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * sigma / 2)


def pareto_mean(least: Column, alpha: Column) -> Column:
    return F.when(alpha > 1, alpha * least / (alpha - 1)).otherwise(F.lit(float("inf")))


def banded(c: Column | str, bands: list[tuple[float, str]], default: str, up_to: bool = False) -> Column:
    """The label of the first band that the value reaches (or, with ``up_to``, does not exceed)."""
    out = F.lit(default)
    for limit, label in reversed(bands):
        out = F.when((col(c) <= limit) if up_to else (col(c) >= limit), F.lit(label)).otherwise(out)
    return out


# Score bands.
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
STATUSES = [(90, "excellent"), (75, "good"), (60, "fair"), (40, "poor")]
RISK_LEVELS = [(20, "very_low"), (35, "low"), (55, "moderate"), (75, "high")]
URGENCY = [(80, "immediate"), (60, "soon"), (40, "planned")]


def grade(score: Column | str) -> Column:
    return banded(score, GRADES, "F")


def score_status(score: Column | str) -> Column:
    return banded(score, STATUSES, "critical")


def risk_level(score: Column | str) -> Column:
    return banded(score, RISK_LEVELS, "very_high", up_to=True)
