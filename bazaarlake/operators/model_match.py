"""Which model of its brand a listing is: the longest name or alias found in the heading, or else in the description.

The dictionary, a parameter, becomes a row for each brand that holds its patterns in order. So a listing meets its brand's
row in an equality join, and no row is made for a listing and a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that mustn't touch a name, and words after which a number is a year.
LETTERS = "a-záčďéěíňóřšťúůýž"
YEAR_BEFORE = r"(?:rok|rv|r\.?\s?v\.?|roku|rokem|roce)\s*$"


def pattern_of(name: str) -> str:
    """Spaces, hyphens and dots in a name may stand or be missing."""
    flexible = "".join(r"[\s\-.]*" if c in " -." else re.escape(c) for c in name)
    return rf"(?<![{LETTERS}\d]){flexible}(?![{LETTERS}])"


def dictionary(spark: SparkSession, models: dict[str, list[str]], aliases: dict[str, str]) -> DataFrame:
    """(brand, names): of each brand its models and their aliases, the longest first, then as given."""
    rows = []
    for brand, own in models.items():
        canonical = [m.lower() for m in own]
        names = [(m, m) for m in canonical] + [(a.lower(), c.lower()) for a, c in aliases.items() if c.lower() in set(canonical)]
        names.sort(key=lambda x: -len(x[0]))
        rows.append((brand, [(pattern_of(n), c, n.isdigit()) for n, c in names]))
    return spark.createDataFrame(rows, "brand string, names array<struct<pattern:string,model:string,number:boolean>>")


def first_model(names: Column, text: Column) -> Column:
    """The model of the first of names that is found in text. A number right after a word for year is none."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"(?U)\s+", " ")

    def found(name: Column) -> Column:
        before = F.call_function("regexp_extract", plain, F.concat(F.lit("(?s)^(.*?)"), name.pattern), F.lit(1))
        return F.regexp_like(plain, name.pattern) & ~(name.number & before.rlike(YEAR_BEFORE))

    return F.get(F.filter(names, found), F.lit(0)).model


def with_model(rows: DataFrame, names: DataFrame, *, brand: str = "brand", heading: str = "heading", description: str = "description", out: str = "model") -> DataFrame:
    """rows with the model, null where the brand is unknown or no name of it is found. names: from dictionary."""
    joined = rows.join(names.withColumnRenamed("brand", "_brand"), F.col(brand) == F.col("_brand"), "left")
    model = F.coalesce(first_model(F.col("names"), F.col(heading)), first_model(F.col("names"), F.col(description)))
    return joined.withColumn(out, model).drop("_brand", "names")


class Finder:
    """Finds a brand's model in texts: an automaton tells which names may stand there, in one pass; their patterns decide.

    Where a name may have spaces, hyphens or dots, so may the text, any number of them. So names and text are compared without:
    whatever a pattern matches, the automaton finds.
    """

    def __init__(self, names: list[tuple[str, str, bool]]):
        self.names = [(re.compile(pattern, re.ASCII), model, number) for _, pattern, model, number in names]
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for k, (name, *_) in enumerate(names):
            held.setdefault(SEPARATORS.sub("", name), []).append(k)
        self.always = held.pop("", [])
        for bare, places in held.items():
            self.automaton.add_word(bare, places)
        if held:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        """The model of the first of the names, the longest first, that stands in the text."""
        if text is None:
            return None
        plain = re.sub(r"\s+", " ", text.strip(" ")).lower()
        may = set(self.always)
        if len(self.automaton):
            may.update(k for _, places in self.automaton.iter(SEPARATORS.sub("", plain)) for k in places)
        for k in sorted(may):
            pattern, model, number = self.names[k]
            found = pattern.search(plain)
            if found and not (number and YEAR_BEFORE_END.search(plain, 0, found.start())):
                return model
        return None


SEPARATORS = re.compile(r"[\s\-.]+", re.ASCII)
YEAR_BEFORE_END = re.compile(YEAR_BEFORE)


def with_models(rows: DataFrame, models: dict[str, list[str]], aliases: dict[str, str], *, brand: str = "brand", heading: str = "heading", description: str = "description", out: str = "model") -> DataFrame:
    """As with_model, for dictionaries of any number of names: a text is read once, not once for each name of its brand."""
    found: dict[str, list] = {}
    for key, own in models.items():
        canonical = [m.lower() for m in own]
        names = [(m, m) for m in canonical] + [(a.lower(), c.lower()) for a, c in aliases.items() if c.lower() in set(canonical)]
        found[key] = [(n, pattern_of(n), c, n.isdigit()) for n, c in sorted(names, key=lambda x: -len(x[0]))]

    def match(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        finders: dict[str, Finder] = {}  # of the brands that the task meets
        for brands, headings, descriptions in parts:
            made = []
            for key, *texts in zip(brands, headings, descriptions, strict=True):
                if key in found and key not in finders:
                    finders[key] = Finder(found[key])
                finder = finders.get(key)
                made.append(next((m for t in texts if (m := finder(t)) is not None), None) if finder else None)
            yield pd.Series(made, dtype=object)

    return rows.withColumn(out, F.pandas_udf(match, "string")(F.col(brand), F.col(heading), F.col(description)))
