"""How good labelled examples are: complete, consistent in form, free of contradictions. Examples: text, entities (start, end, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of a complete example, the scores that count as good and fair, and words of one fuel.
WANTED, GOOD, FAIR = ("YEAR", "MILEAGE", "FUEL", "POWER"), 80, 60
DIESEL, PETROL = ("diesel", "nafta", "tdi"), ("benzín", "benzin", "gas")
DIESEL_ALIKE, PETROL_ALIKE = ("diesel", "nafta", "tdi", "td"), ("benzín", "benzin")
DIESEL_PARTS, PETROL_PARTS = ("diesel", "nafta", "tdi", "motorová nafta", "td", "naft"), ("benzín", "benzin", "b", "gas")


def words(text: Column, entities: Column, label: str) -> Column:
    """The texts of spans with the label."""
    return F.transform(F.filter(entities, lambda e: e.label == label), lambda e: F.substring(text, e.start + 1, e.end - e.start))


def completeness(rows: DataFrame) -> DataFrame:
    """One row: total, complete (four labels), incomplete, empty, quality_score (percent complete) and its grade; no rows: score 0."""
    labels = F.size(F.array_distinct(F.transform("entities", lambda e: e.label)))
    total, complete = F.count(F.lit(1)), F.count_if(labels == len(WANTED))
    counted = rows.agg(total.alias("total"), complete.alias("complete"), F.count_if((labels > 0) & (labels != len(WANTED))).alias("incomplete"), F.count_if(labels == 0).alias("empty"))
    score = F.coalesce(F.try_divide(F.col("complete") * 100, F.col("total")), F.lit(0.0))
    return counted.withColumn("quality_score", score).withColumn("grade", F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor"))


def fuel_synonyms(rows: DataFrame) -> DataFrame:
    """(word, n, fuel): fuel words as labelled, lower-cased, with the fuels whose synonyms they contain."""
    listed = rows.select(F.explode(words(F.col("text"), F.col("entities"), "FUEL")).alias("w")).select(F.lower(F.trim("w")).alias("word"))

    def holds(parts: tuple[str, ...], name: str) -> Column:
        return F.when(F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(F.col("word"), p)), name)

    fuel = F.concat_ws(",", holds(DIESEL_PARTS, "diesel"), holds(PETROL_PARTS, "benzín"))
    return listed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("fuel", fuel)


def contradictions(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, issue): an engine for diesel with a label for petrol, or labels of several fuels."""
    fuels = F.transform(words(F.col("text"), F.col("entities"), "FUEL"), F.lower)
    low = F.lower("text")
    engine = low.rlike(r"(?U)\btdi\b") | low.rlike(r"(?U)\btd[is]?\b")
    petrol = F.exists(fuels, lambda f: f.isin(*PETROL))
    one = F.array_distinct(fuels)

    def alike(known: tuple[str, ...]) -> Column:
        return F.forall(one, lambda f: f.isin(*known))

    several = (F.size(one) > 1) & ~(alike(DIESEL_ALIKE) | alike(PETROL_ALIKE))
    issues = F.array(F.when(engine & petrol, "diesel engine, petrol label"), F.when(several, "several fuels"))
    return rows.select(id_col, F.explode(issues).alias("issue")).where("issue is not null")


def format_profile(rows: DataFrame) -> DataFrame:
    """(label, form, n): how many labelled texts are written in each form."""
    listed = rows.select("text", F.explode("entities").alias("e")).select(F.col("e.label").alias("label"), F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("w"))
    w, low = F.col("w"), F.lower("w")
    forms = {
        "MILEAGE": {"space": w.contains(" km"), "no space": w.contains("km") & ~w.contains(" km"), "t": low.contains("t") & w.contains("km"), "tis": low.contains("tis")},
        "POWER": {
            "space": low.contains(" kw") | low.contains(" ps"),
            "no space": low.contains("kw") & ~low.contains(" kw"),
            "lower case": w.contains("kw") & ~w.contains("kW"),
            "upper case": w.contains("kW"),
            "full stop": w.endswith("."),
        },
        "YEAR": {"number": w.rlike(r"^\d{4}$"), "with words": ~w.rlike(r"^\d{4}$")},
    }
    made = F.array(*(F.when((F.col("label") == label) & rule, F.lit(form)) for label, own in forms.items() for form, rule in own.items()))
    found = listed.select("label", F.explode(made).alias("form")).where("form is not null")
    return found.groupBy("label", "form").agg(F.count(F.lit(1)).alias("n"))


# The units that labelled texts should name.
UNITS = {"MILEAGE": "km", "POWER": "kw"}


def unit_consistency(rows: DataFrame) -> DataFrame:
    """(label, with_unit, without_unit, consistent) of each label with a unit that occurs: consistent if all spans name it, or none."""
    listed = rows.select(F.explode("entities").alias("e"), "text").where(F.col("e.label").isin(*UNITS))
    unit = F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.col("e.label"))
    named = F.lower(F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))).contains(unit)
    counted = listed.groupBy(F.col("e.label").alias("label")).agg(F.count_if(named).alias("with_unit"), F.count_if(~named).alias("without_unit"))
    return counted.withColumn("consistent", (F.col("with_unit") == 0) | (F.col("without_unit") == 0))


# So many new examples are expected to add so many percent, up to a most.
GROWTH_STEP, STEP_GAIN, MOST_GAIN = 50, 2, 15


def growth(rows: DataFrame, base: str, source: str = "source") -> DataFrame:
    """One row: total, base, added, expected_gain (percent, null if nothing was added) of examples by source; no rows: zeros."""
    counted = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(source) == base).alias("base"))
    gain = F.least(F.expr(f"(total - base) div {GROWTH_STEP} * {STEP_GAIN}"), F.lit(MOST_GAIN).cast("bigint"))
    return counted.select("total", "base", (F.col("total") - F.col("base")).alias("added"), F.when(F.col("total") > F.col("base"), gain).alias("expected_gain"))
