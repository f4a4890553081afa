"""Suggested labels and models by automaton against plain versions."""

import random
import re

from pyspark.sql import functions as F

from bazaarlake.functions import labelling
from bazaarlake.operators import model_match
from bazaarlake.plans import catalog, pages
from bazaarlake.sources.listings import described, listings

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "193.500 km, r. 2011, 110 kW nafta", "najeto 150 tis. km a 1.5tis, 120tisíc km", "😀 90 kw 1985 1990 2029 2031 TDI tsi", "1 000 000 km100 km 150 PS 80koní", "km 2001 2002", "110 KW110kW BENZÍN/lpg", "12 345 km\n2000"]


def plain_suggestions(text):
    out = []
    for label, patterns in labelling.SUGGESTING.items():
        best = {}
        for p in patterns:
            for m in re.finditer(p, text or "", re.I):
                if label != "YEAR" or 1990 <= int(m[0]) <= 2030:
                    best[m.start()] = max(best.get(m.start(), 0), m.end())
        out += [(s, e, label) for s, e in sorted(best.items())]
    return out


def test_suggestions_are_those_of_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    df = df.union(described(listings(spark, SF)).select(F.col("id").cast("int") + 100, "text"))
    got = df.select("k", "t", labelling.suggestions(F.col("t")).alias("s")).collect()
    for r in got:
        assert [tuple(x) for x in r["s"]] == plain_suggestions(r["t"]), r["t"]
    assert {x[2] for r in got for x in r["s"]} == set(labelling.SUGGESTING)


def test_chosen_suggestions_do_not_overlap(spark):
    found = {}
    for r in catalog.QUERIES["x21_suggestions"](spark, SF).where("chosen").collect():
        found.setdefault(r["id"], []).append((r["start"], r["end"]))
    assert found and all(a[1] <= b[0] for x in found.values() for a, b in zip(sorted(x), sorted(x)[1:]))


def test_places_of_reviewed_values(spark):
    rows = [("Motor TDI, tdi", "tdi"), ("Nafta", "NAFTA"), ("ab", "c"), ("ab", ""), (None, "a"), ("a", None), ("😀 rok 2010", "2010")]
    got = spark.createDataFrame(rows, "t string, v string").select(labelling.value_place(F.col("t"), F.col("v")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in got] == [(11, 14), (0, 5), None, None, None, None, (6, 10)]


def test_automaton_finds_what_all_patterns_find(spark):
    """Names of every kind, aliases, numbers after words for year, against each pattern tried on each text."""
    rng = random.Random(6)
    models = {"b": ["5", "C 5", "C-5 Cross", "XX.1", "2008", "a", "ša", "c5 x", "X 5 M", "x5"], "c": ["Sx4 S-Cross"], **pages.MANY}
    aliases = {"five": "5", "s cross": "SX4 S-Cross", "..": "a", "unknown": "zz"}
    pieces = ["c", "5", " ", "-", ".", "cross", "xx", "1", "rok ", "r.v. ", "2008", "x", "m", "a", "š", "five", "sx4", "s", "   ", "X5", "C5"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(400)] + ["", None, "rok 2008 a 2008", "  C - 5. cross"]
    rows = [(rng.choice(["b", "b", "c", "nobrand", None]), rng.choice(texts), rng.choice(texts)) for _ in range(700)]
    df = spark.createDataFrame(rows, "brand string, heading string, description string")
    names = model_match.dictionary(spark, models, aliases)
    both = model_match.with_models(model_match.with_model(df, names, out="one"), models, aliases, out="two").collect()
    assert [r["two"] for r in both] == [r["one"] for r in both]
    assert len({r["two"] for r in both}) > 6
