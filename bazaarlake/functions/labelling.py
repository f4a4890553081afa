"""Whether a text tells a field at all, and where in a text a known value stands: columns only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the simple detectors and of the places of known values; all are read without regard to case.
DETECTORS = {
    "mileage": [
        r"\d{1,3}(?:[\s._]?\d{3})+(?:[.,]\d+)?\s?km",
        r"\d{1,3}(?:[.,]\d+)?\s?km",
        r"\d{1,3}(?:[.,]\d+)?\s?tis\.?\s?km",
        r"\d{1,3}(?:[.,]\d+)?\s?tis\.?(?!\w)",
        r"\d{1,3}(?:[.,]\d+)?\s?tisíc\s?km",
        r"\d{1,3}(?:[.,]\d+)?\s?tisíc(?!\w)",
        r"\d{1,3}(?:[.,]\d+)?\s?k\s?km",
        r"\d{1,3}(?:[.,]\d+)?k(?!w|m|\w)",
        r"\d{1,3}(?:[.,]\d+)?\s?t\.?\s?km",
        r"\d{1,3}(?:[.,]\d+)?\s?t(?!d|s|i|e|a|\w)",
        r"\d{1,3}\s?xxx\s?km",
        r"\d{1,3}\s?xxx(?!\w)",
        r"\d{1,3}\s?\*{3}\s?km",
        r"\d{1,3}\s?\*{3}(?!\w)",
        r"\d{1,3}[\s._]\d{3}(?:[\s._]\d{3})?(?!\s?k[mw])",
        r"\b\d{5,6}(?!\s?k[mw]|\d)",
    ],
    "year": [r"(?:rok\s+výroby|R\.?V\.?|rok|r\.?v\.?|výroba)?\s*(\d{4})\b", r"\b(19\d{2}|20[0-2]\d)\b"],
    "power": [r"\d{1,3}\s?kw", r"\d{1,3}\s?ps", r"\d{1,3}\s?koní"],
    "fuel": [r"\b(benzin|benzín|nafta|diesel|dýzl|naftak|turbodiesel|tdi|tsi|hybrid|elektro|electric|lpg|cng|plyn)\b"],
}
MILEAGE_PLACES = [r"\d{1,3}(?:\s?\d{3})*\s?km", r"\d{1,3}\s?(?:tis|t)\s?km"]
POWER_UNITS = r"\s?(?:kw|ps|koní)"


def tells(field: str, text: Column) -> Column:
    """Whether any pattern of the field is in text; null text tells nothing."""
    return F.coalesce(reduce(or_, (text.rlike(f"(?iU){p}") for p in DETECTORS[field])), F.lit(False))


def place(text: Column, pattern: Column, label: str) -> Column:
    """Struct (start, end, label) of the pattern's first match, end exclusive; null if there is none."""
    at = F.regexp_instr(text, pattern)
    found = F.call_function("regexp_extract", text, pattern, F.lit(0))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(found)).alias("end"), F.lit(label).alias("label")))


def word_place(text: Column, word: Column, label: str) -> Column:
    at = F.call_function("locate", word, text)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(word)).alias("end"), F.lit(label).alias("label")))


def places(text: Column, mileage: Column, year: Column, power: Column, fuel: Column) -> Column:
    """Array of (start, end, label): where the values that are known, the others null, stand in text; those not found are left out."""
    miles = F.coalesce(*(place(text, F.lit(f"(?iU){p}"), "MILEAGE") for p in MILEAGE_PLACES))
    parts = [
        F.when(mileage.isNotNull(), miles),
        word_place(text, year.cast("string"), "YEAR"),
        place(text, F.concat(F.lit("(?iU)"), power.cast("string"), F.lit(POWER_UNITS)), "POWER"),
        word_place(F.lower(text), F.lower(fuel), "FUEL"),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


#: Of the detectors' patterns those that suggest labels, and the years that are suggested.
SUGGESTING = {"MILEAGE": DETECTORS["mileage"][:6], "YEAR": DETECTORS["year"][1:], "POWER": DETECTORS["power"], "FUEL": DETECTORS["fuel"]}
SUGGESTED_YEARS = (1990, 2030)


PLACES = "array<struct<start:int,end:int>>"


def all_places(text: Column, pattern: str) -> Column:
    """Array of structs (start, end) of all matches from left to right: what stands between them tells where they are."""
    none = F.array().cast(PLACES)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def add(held: Column, m: Column) -> Column:
        start = F.coalesce(F.try_element_at(held, F.lit(-1)).end, F.lit(0)) + m.gap
        return F.concat(held, F.array(F.struct(start.alias("start"), (start + m["size"]).alias("end"))))

    # The last gap, after all matches, has no size.
    zipped = F.zip_with(found, gaps, lambda f, b: F.struct(f.alias("size"), b.alias("gap")))
    return F.when(text.rlike(pattern), F.aggregate(F.filter(zipped, lambda m: m["size"].isNotNull()), none, add)).otherwise(none)


def suggestions(text: Column) -> Column:
    """Array of structs (start, end, label) that an annotator may accept, by label and place: of matches that start at one place the longest.

    Those of one label may overlap if they start apart, as do those of different labels; operators.labels.without_overlaps chooses.
    """
    made = []
    for label, patterns in SUGGESTING.items():
        places = F.flatten(F.array(*(all_places(text, f"(?iU){p}") for p in patterns)))
        if label == "YEAR":
            year = lambda e: F.substring(text, e.start + 1, e.end - e.start).cast("int")
            places = F.filter(places, lambda e: year(e).between(*SUGGESTED_YEARS))
        longest = F.aggregate(F.array_sort(places), F.array().cast("array<struct<start:int,end:int>>"), later_of_equal_starts)
        made.append(labelled_as(longest, label))
    return F.coalesce(F.concat(*made), F.array().cast("array<struct<start:int,end:int,label:string>>"))


def later_of_equal_starts(held: Column, e: Column) -> Column:
    """held with e, in place of the last one if that starts where e does; places come in order of start and end."""
    last = F.try_element_at(held, F.lit(-1))
    return F.when(last.start == e.start, F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(e))).otherwise(F.concat(held, F.array(e)))


def labelled_as(places: Column, label: str) -> Column:
    return F.transform(places, lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), F.lit(label).alias("label")))


def value_place(text: Column, value: Column) -> Column:
    """Struct (start, end) of where a reviewed value stands: as written, or else without regard to case; null if nowhere or empty."""
    exact, folded = F.call_function("locate", value, text), F.call_function("locate", F.lower(value), F.lower(text))
    at = F.when(exact > 0, exact).when(folded > 0, folded)
    return F.when((value != "") & at.isNotNull(), F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end")))


def reviewed_places(text: Column, mileage: Column, year: Column, power: Column, fuel: Column) -> Column:
    """Array of (start, end, label): the first places of reviewed values as written, a year exactly, the others without regard to case.

    Values that are null, empty or nowhere in the text are left out.
    """
    low = F.lower(text)
    parts = {"MILEAGE": (low, F.lower(mileage)), "YEAR": (text, year.cast("string")), "POWER": (low, F.lower(power)), "FUEL": (low, F.lower(fuel))}
    return F.filter(F.array(*(word_place(where, F.nullif(value, F.lit("")), label) for label, (where, value) in parts.items())), lambda x: x.isNotNull())
