"""Two opinions on each field of a listing, one of patterns and one of a model, made into one: decision tables as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlake.functions import patterns as P

FIELDS = ("mileage", "year", "power", "fuel")


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def power_unit(raw: Column) -> Column:
    """Number and unit, kw or ps; null for anything else."""
    pattern = r"^(\d+)\s*([a-zá-ží]+)"
    text = F.lower(F.trim(raw))
    return F.concat(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), mapped(P.POWER_UNITS, F.regexp_extract(text, pattern, 2)))


def distance_unit(raw: Column) -> Column:
    """Number and unit, km or mi. No unit means km; abbreviated thousands are written out; a dot ends the number."""
    text = F.regexp_replace(F.lower(F.trim(raw)), r"(\d)\s+(?=\d)", "$1")
    number = F.nullif(F.regexp_extract(text, r"^(\d+)", 1), F.lit(""))
    unit = F.regexp_extract(text, r"^\d+\s*([a-z]*)", 1)
    name = F.when(unit == "", "km").when(unit.isin(*P.THOUSANDS), "km").otherwise(mapped(P.DISTANCE_UNITS, unit))
    whole = F.when(unit.isin(*P.THOUSANDS), F.concat((number.cast("long") * 1000).cast("string"))).otherwise(number)
    return F.concat(whole, name)


def disagreement(model: Column, pattern: Column) -> Column:
    """NONE, MINOR_FORMATTING (same number, or one side is missing) or MAJOR, of standard values."""
    same_number = F.regexp_extract(model, r"(\d+)", 1) == F.regexp_extract(pattern, r"(\d+)", 1)
    return F.when(model.eqNullSafe(pattern), "NONE").when(model.isNull() | pattern.isNull() | same_number, "MINOR_FORMATTING").otherwise("MAJOR")


def resolved(model_raw: Column, pattern_raw: Column, standard, prefer_model: bool, major_model: float, override: Column | None = None) -> Column:
    """Struct disagreement, value, method, confidence. standard: power_unit or distance_unit; override: a value set by hand."""
    m, p = standard(model_raw), standard(pattern_raw)
    kind = disagreement(m, p)

    def answer(value: Column, method: str, confidence: float) -> Column:
        return F.struct(kind.alias("disagreement"), value.cast("string").alias("value"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    major = answer(model_raw, "ML_PREFERRED", major_model) if prefer_model else answer(pattern_raw, "REGEX_PREFERRED", 0.70)
    table = [
        (override.isNotNull() if override is not None else F.lit(False), answer(override if override is not None else F.lit(None), "MANUAL", 1.0)),
        (m.isNull() & p.isNull(), answer(F.lit(None), "AUTO_NORMALIZED", 0.0)),
        (kind == "NONE", answer(F.coalesce(model_raw, pattern_raw), "AUTO_NORMALIZED", 0.95)),
        (p.isNull(), answer(model_raw, "ML_PREFERRED", 0.75)),
        (m.isNull(), answer(pattern_raw, "REGEX_PREFERRED", 0.80)),
        (kind == "MINOR_FORMATTING", answer(model_raw if prefer_model else pattern_raw, "AUTO_NORMALIZED", 0.90)),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), value) for test, value in table), major)


def resolved_power(model_raw: Column, pattern_raw: Column, override: Column | None = None) -> Column:
    return resolved(model_raw, pattern_raw, power_unit, False, 0.60, override)


def resolved_mileage(model_raw: Column, pattern_raw: Column, override: Column | None = None) -> Column:
    return resolved(model_raw, pattern_raw, distance_unit, True, 0.70, override)


def sureness(tier: Column, confirmed: Column) -> Column:
    """How sure a value is that only the patterns found, after the model was asked about the words around it."""
    out = F.lit(None).cast("double")
    for (name, said), value in P.SURE.items():
        out = F.when((tier == name) & (confirmed == F.lit(said)), value).otherwise(out)
    return out


def verified_year(candidate: Column, tier: Column, confirmed: Column) -> Column:
    return (candidate.cast("int").between(*P.YEARS)) & (sureness(tier, confirmed) >= P.ENOUGH)


def verified_entity(kind: str, candidate: Column, tier: Column, confirmed: Column) -> Column:
    """Engine codes are no known fuel here, so they are never verified: so it is in the service whose results this matches."""
    number = F.regexp_extract(candidate, r"(\d+)", 1).try_cast("long")
    valid = {"power": number.between(*P.POWERS), "mileage": number.between(0, P.MOST_KM), "fuel": F.lower(F.trim(candidate)).isin(*P.FUELS_KNOWN)}[kind]
    return F.coalesce(valid, F.lit(False)) & (sureness(tier, confirmed) >= P.ENOUGH)


def compared(model: dict[str, Column], pattern: dict[str, Column], agreed: dict[str, Column] | None = None) -> Column:
    """Struct of lists agreements, disagreements, ml_only, regex_only, both_empty, and agreement_level.

    agreed: for some fields, a verdict of their own: true agreement, false disagreement, null undecided.
    """
    lists: dict[str, list[Column]] = {k: [] for k in ("agreements", "disagreements", "ml_only", "regex_only", "both_empty")}
    for f in FIELDS:
        m, p = model[f], pattern[f]
        own = (agreed or {}).get(f, F.lit(None).cast("boolean"))
        kind = F.when(own, "agreements").when(~own, "disagreements").when(m.isNull() & p.isNull(), "both_empty").when(p.isNull(), "ml_only")
        kind = kind.when(m.isNull(), "regex_only").when(m == p, "agreements").otherwise("disagreements")
        for name, held in lists.items():
            held.append(F.when(kind == name, f))
    made = {name: F.filter(F.array(*held), lambda x: x.isNotNull()) for name, held in lists.items()}
    n = F.size(made["agreements"])
    level = F.when(n == len(FIELDS), "full").when(n >= 2, "partial").otherwise("none")
    return F.struct(*(c.alias(k) for k, c in made.items()), level.alias("agreement_level"))


def decided(model: Column, pattern: Column) -> Column:
    """Agreement: the value; else that of the patterns; else that of the model."""
    return F.coalesce(F.when(model == pattern, model), pattern, model)


def confidence(level: Column, majors: list[Column]) -> Column:
    """high, medium or low by level of agreement; high falls to medium where a number differs."""
    major = reduce(lambda a, b: a | b, (m == "MAJOR" for m in majors))
    return F.when(level == "full", F.when(major, "medium").otherwise("high")).when(level == "partial", "medium").otherwise("low")


def route(level: Column) -> Column:
    """Where a listing goes: training examples, review by hand, or only the count."""
    return F.when(level == "full", "training").when(level == "none", "review").otherwise("counted")
