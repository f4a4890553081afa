"""Raw values to standard ones, and small parsers of page fields: columns only, so they run inside Spark's generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlake.functions import patterns as P


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def clean(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def fuel_word(text: Column) -> Column:
    """The first fuel word as written, or else an engine code anywhere."""
    return F.coalesce(found(text, P.FUEL_WORDS), found(text, "(" + "|".join(P.ENGINE_CODES) + ")"))


def fuel(raw: Column) -> Column:
    """One of six fuels, or null: exact words, parts of words, engine codes, in that order."""
    value = F.lower(F.trim(raw))
    out = F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None))
    for name, words in P.FUEL_EXACT.items():
        out = out.when(value.isin(*words), name)
    for table in (P.FUEL_PARTS, P.FUEL_CODES):
        for name, parts in table.items():
            out = out.when(value.rlike(parts), name)
    return out


def mileage(raw: Column) -> Column:
    """Whole kilometres up to a million. Dots and spaces go first, so a decimal before an abbreviation is read as whole."""
    text = F.translate(raw, " .", "")
    value = F.try_to_number(found(text, r"(\d{1,18})"), F.lit("9" * 18)).cast("long")
    value = F.when(text.rlike(r"(?iU)\d\s*(?:tkm|tis|xxx|t\.?\s*km)"), value * 1000).otherwise(value)
    return F.when(value <= P.MOST_KM, value)


def power(raw: Column) -> Column:
    return found(raw, r"(\d{1,9})").cast("int")


def year(raw: Column) -> Column:
    value = found(raw, r"(\d{4})").cast("int")
    return F.when(value.between(*P.YEARS), value)


def price(cell: Column) -> Column:
    return F.nullif(F.regexp_replace(cell, r"\D", ""), F.lit("")).cast("long")


def listing_date(text: Column) -> Column:
    """[d.m. yyyy] as a date; null where there is no such day."""
    parts = [found(text, r"\[(\d{1,2})\.(\d{1,2})\.\s*(\d{4})\]", k) for k in (3, 2, 1)]
    return F.expr("null").cast("date") if not parts else F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("y-M-d")).cast("date")


def view_count(text: Column) -> Column:
    return found(text, r"(\d+) lid[ií]").cast("int")


def unique_id(url: Column) -> Column:
    return found(url, r"inzerat/(\d+)/")


def rewritten_fuel(value: Column) -> Column:
    """Rules run one after another over what the ones before have left. After the first that fits that is a known name, so the rest is told here."""
    rules = list(P.FUEL_REWRITES.items())
    out = F.when(value.isNull(), value)
    for k, (pattern, name) in enumerate(rules):
        for later, other in rules[k + 1 :]:
            name = other if re.search(later, name, re.I) else name
        out = out.when(value.rlike(f"(?i){pattern}"), name)
    return out.otherwise(value)


def misplaced_mileage(value: Column) -> Column:
    """Kilometres written into a fuel field."""
    digits = F.regexp_replace(found(F.lower(value), r"(\d+(?:\s?\d+)*)\s*t?km"), r"\s", "").cast("long")
    return F.when(F.lower(value).contains("tkm"), digits * 1000).otherwise(digits)


def derived(as_of_year: int) -> dict[str, Column]:
    """Years in use, price for a kilometre, kilometres a year."""
    years = F.lit(as_of_year) - F.col("year_manufacture")
    return {
        "years_in_usage": years,
        "price_per_km": F.when(F.col("mileage") > 0, F.col("price") / F.col("mileage")),
        "mileage_per_year": F.when(years > 0, F.col("mileage") / years),
    }


def context(text: Column, word: Column, around: int = 60) -> Column:
    """The text around the word's first place; the whole text where it isn't found."""
    at = F.locate(word, text) if isinstance(word, str) else F.call_function("locate", word, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(word) + around)).otherwise(text)


def description(*pairs: tuple[str, Column]) -> Column:
    """name value, name value, ...; what is null is left out."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{name} "), value.cast("string")) for name, value in pairs))
