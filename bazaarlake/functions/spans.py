"""Finding values in text together with where they stand: what Spark's own functions can't tell. Arrow batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlake.functions import patterns as P

MATCH = "array<struct<text:string,value:int,start:int,end:int,confidence:string>>"


Tiers = dict[str, list[tuple[re.Pattern, tuple[str, ...]]]]


def compiled(**tiers: tuple[list[str], list[tuple[str, ...]]]) -> Tiers:
    """Patterns with what a text holds that they fit."""
    return {name: [(re.compile(p, re.I), holds) for p, holds in zip(*both, strict=True)] for name, both in tiers.items()}


YEAR = compiled(
    excluded=(P.YEAR_EXCLUDED, P.YEAR_EXCLUDED_HOLDS), high=(P.YEAR_HIGH, P.YEAR_HIGH_HOLDS), medium=(P.YEAR_MEDIUM, P.YEAR_MEDIUM_HOLDS), low=(P.YEAR_LOW, P.YEAR_LOW_HOLDS)
)
MILEAGE = compiled(excluded=(P.MILEAGE_EXCLUDED, P.MILEAGE_EXCLUDED_HOLDS), high=(P.MILEAGE_HIGH, P.MILEAGE_HIGH_HOLDS), medium=(P.MILEAGE_MEDIUM, P.MILEAGE_MEDIUM_HOLDS))
POWER = compiled(high=(P.POWER_HIGH, P.POWER_HIGH_HOLDS), medium=(P.POWER_MEDIUM, P.POWER_MEDIUM_HOLDS))
#: Letters that patterns without regard to case take for others, though lower() doesn't; and runs of white space.
FOLDED, SPACE = str.maketrans("İıſ", "iis"), re.compile(r"\s+")


def folded(text: str) -> str:
    return SPACE.sub(" ", (text if text.isascii() else text.translate(FOLDED)).lower())


def matches(text: str, found: list[tuple[re.Pattern, tuple[str, ...]]], low: str) -> Iterator[re.Match]:
    """All matches of all patterns, in their order; patterns that can't fit aren't searched for. low: the text folded."""
    for pattern, holds in found:
        for word in holds:
            if word in low:
                break
        else:
            if holds:
                continue
        yield from pattern.finditer(text)


def first_tier(text: str, tiers: Tiers, accept, low: str) -> list[dict]:
    """Matches of the best tier that has any: one for each start, sorted. accept(match) gives (text, value) or None."""
    for name, found in tiers.items():
        if name == "excluded":
            continue
        hits: dict[int, dict] = {}
        for m in matches(text, found, low):
            got = accept(m)
            if got:
                start, end = m.span(1)
                hits.setdefault(start, {"text": got[0], "value": got[1], "start": start, "end": end, "confidence": name})
        if hits:
            return [hits[k] for k in sorted(hits)]
    return []


def whole_year(digits: str) -> int:
    """Two digits are of this century up to 29, of the last one beyond."""
    return int(digits) if len(digits) == 4 else int(digits) + (2000 if int(digits) <= 29 else 1900)


def years(text: str, low: str | None = None) -> list[dict]:
    """Years of manufacture; a year that elsewhere is one of inspection, service or a number's part counts nowhere."""
    low = low or folded(text)
    out = {m[1] for m in matches(text, YEAR["excluded"], low)}

    def accept(m: re.Match):
        year = whole_year(m[1])
        if P.YEARS[0] <= year <= P.YEARS[1] and str(year) not in out:
            return str(year), year

    return first_tier(text, YEAR, accept, low)


#: What beside a number means thousands, without spaces, dots and km.
THOUSANDS = ("tis", "tisíc", "k", "t", "xxx", "***")


def kilometres(number: str, written: str) -> int:
    """The value of a mileage: its digits, or thousands of them if a sign of thousands stands beside; then one dot or comma is decimal."""
    parts = re.findall(r"\d+", number)
    digits = int("".join(parts))
    if re.sub(r"km|[\d\s.,_]", "", written.lower()) not in THOUSANDS:
        return digits
    if len(parts) == 2 and ("." in number or "," in number):
        return round(float(".".join(parts)) * 1000)
    return digits if digits >= 1000 else digits * 1000


def mileages(text: str, low: str | None = None) -> list[dict]:
    """The largest mileage of the best tier; places that ranges, services or prices stand at are left out."""
    low = low or folded(text)
    out = {m.start(1) for m in matches(text, MILEAGE["excluded"], low)}
    found = first_tier(text, MILEAGE, lambda m: None if m.start(1) in out else (m[1], kilometres(m[2], m[1])), low)
    return [max(found, key=lambda x: x["value"])] if found else []


def powers(text: str, low: str | None = None) -> list[dict]:
    """Powers in kW."""
    least, most = P.POWERS
    return first_tier(text, POWER, lambda m: (m[1], int(m[2])) if least <= int(m[2]) <= most else None, low or folded(text))


def over_texts(find):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find(t) if t else [])

    return F.pandas_udf(run, MATCH)


def find_years(text: str | Column) -> Column:
    return over_texts(years)(text)


def find_mileage(text: str | Column) -> Column:
    return over_texts(mileages)(text)


def find_power(text: str | Column) -> Column:
    return over_texts(powers)(text)


def find_first(text: str | Column) -> Column:
    """Struct of the first year's value, and the mileage's and the first power's text, null if there is none, in one pass through Python."""

    def first(t: str | None) -> tuple[int | None, str | None, str | None]:
        low = folded(t or "")
        found = ((f(t, low) if t else []) for f in (years, mileages, powers))
        return tuple(x[0][key] if x else None for x, key in zip(found, ("value", "text", "text"), strict=True))

    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([first(t) for t in texts], columns=["year", "mileage", "power"], dtype=object)
        return found.astype({"year": "Int32"})

    return F.pandas_udf(run, "year int, mileage string, power string")(text)
