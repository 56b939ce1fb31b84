"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes, longest first, removed from company names.
COMPANY_SUFFIXES = ("corporation", "incorporated", "company", "limited", "holdings", "group", "corp", "inc", "ltd", "llc", "plc", "co", "ag", "sa", "nv")


def q(x: Column, digits: int = 4) -> Column:
    """Quantise half up, the same in every engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def slug(text: Column, length: int = 30) -> Column:
    """Lower case, runs of other characters become one hyphen, none at the ends, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def company_key(company: Column, ticker: Column) -> Column:
    """The company, or the ticker where it is missing or empty."""
    return F.coalesce(F.when(company != "", company), ticker)


def strip_suffix(name: Column) -> Column:
    """Company name without punctuation and one legal suffix, in lower case."""
    bare = F.trim(F.regexp_replace(F.lower(name), r"[.,]", ""))
    return F.trim(F.regexp_replace(bare, rf"\s+(?:{'|'.join(COMPANY_SUFFIXES)})$", ""))


def url_key(url: Column) -> Column:
    """md5 of the address in lower case without blanks at the ends and closing slashes."""
    return F.md5(F.regexp_replace(F.lower(F.trim(url)), "/+$", "").cast("binary"))


def content_key(text: Column) -> Column:
    """sha256 of the text in lower case with white space folded."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).cast("binary"), 256)


def quarter_label(day: Column) -> Column:
    """``Q1-2024``."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit("-"), F.year(day).cast("string"))


def quarter_index(day: Column) -> Column:
    """Quarters since year 0."""
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("bigint")


def parse_date(text: Column) -> Column:
    """First of four formats that fits, else null."""
    t = F.trim(text)
    return F.coalesce(
        *[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy")]
    )


#: Factors of amount units.
UNITS = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
INDIAN_UNITS = {"lakh crore": 1e12, "crore": 1e7, "cr": 1e7, "lakh": 1e5}
_USD = r"(?iu)\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(trillion|billion|million|thousand|bn|mn|[bmk])?\b"
_INR = r"(?iu)(?:rs\.?|inr|₹)\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(lakh crore|crore|cr|lakh)?\b"


def amount(text: Column) -> Column:
    """First amount of money: struct of value and unit (``USD_billion``, ``INR_crore``), or null."""

    def one(pattern: str, units: dict[str, float], currency: str) -> Column:
        number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
        unit = F.lower(F.regexp_extract(text, pattern, 2))
        factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), unit), F.lit(1.0))
        name = F.when(unit == "", F.lit(currency)).otherwise(F.concat(F.lit(f"{currency}_"), unit))
        return F.when(number != "", F.struct((number.cast("double") * factor).alias("value"), name.alias("unit")))

    return F.coalesce(one(_USD, UNITS, "USD"), one(_INR, INDIAN_UNITS, "INR"))


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` letters or digits, for Jaccard scores."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds one of the phrases, any case; one alternation, one pass."""
    import re as _re

    return F.coalesce(text.rlike("(?iu)" + "|".join(_re.escape(p) for p in phrases)), F.lit(False))


def first_tier(text: Column, tiers: tuple[tuple[tuple[str, ...], float], ...], default: float = 0.0) -> Column:
    """Value of the first tier one of whose phrases the text holds."""
    out = F.lit(default)
    for phrases, value in reversed(tiers):
        out = F.when(any_phrase(text, phrases), F.lit(value)).otherwise(out)
    return out
