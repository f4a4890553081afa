"""Phrases and the values that must be found in them; decision tables; the test whether an offer is a car."""

import re

import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import labelling, reconcile, spans
from bazaarlake.operators import deals, filters, model_match

MILEAGES = {
    "najeto 187 tis km": 187000,
    "najeto 187tis.": 187000,
    "najeto 187 tisíc km": 187000,
    "najeto 187 000 km": 187000,
    "najeto 187.000 km": 187000,
    "najeto 187_000 km": 187000,
    "najeto 187000": 187000,
    "najeto187k": 187000,
    "najeto 187 k km": 187000,
    "najeto 187t": 187000,
    "najeto 187xxx": 187000,
    "najeto 187 *** km": 187000,
    "187xxx celkem": 187000,
    "v provozu, má 96 tis. km": 96000,
    "najeto 2.5tis km": 2500,
    "143.000 km, servis při 120000 km": 143000,
    "výkon 110 kW": None,
    "dojezd 600 km": None,
}
YEARS = {
    "Fabia r.v. 07, najeto 90000 km": (2007, "high"),
    "Escort rv98, benzín": (1998, "high"),
    "Clio rok výroby 04": (2004, "high"),
    "Trabant r.v. 86": None,
    "rok výroby 2098": None,
    "Peugeot 5008": None,
    "Rok: 2014, Stk: 03/2027": (2014, "high"),
    "r.v. 2019, STK do 04/2027": (2019, "high"),
    "emise do 2027": None,
    "stk platnost 05/2027": None,
    "Škoda Octavia 2016, STK 02/2027": (2016, "medium"),
    "v provozu od 5/2011": (2011, "high"),
    "1. registrace 07/2009": (2009, "high"),
    "vozidlo 2013 kombi": (2013, "low"),
    "nové brzdy z roku 2018": None,
}
POWERS = {"výkon: 110 kW": (110, "high"), "85kw motor": (85, "high"), "TDI 103kW": (103, "medium"), "výkon 999 kW": None, "29 kW": None}


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r["found"] for r in df.select("k", make("text").alias("found")).orderBy("k").collect()]


def test_mileages(spark):
    found = column(spark, MILEAGES, spans.find_mileage)
    assert {t: f[0]["value"] if f else None for t, f in zip(MILEAGES, found)} == MILEAGES


@pytest.mark.parametrize(("table", "find"), [(YEARS, spans.find_years), (POWERS, spans.find_power)])
def test_years_and_powers(spark, table, find):
    found = column(spark, table, find)
    assert {t: (f[0]["value"], f[0]["confidence"]) if f else None for t, f in zip(table, found)} == table


def test_detectors_are_those_of_plain_patterns(spark):
    texts = [*MILEAGES, *YEARS, *POWERS, "nafta", "na naftu", "200t", "200td", "12 k", "150 koní", "", "1234567", "85 000", "85 000 kw"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for field, patterns in labelling.DETECTORS.items():
        got = [r["f"] for r in df.select("k", labelling.tells(field, F.col("text")).alias("f")).orderBy("k").collect()]
        assert got == [any(re.search(p, t, re.I) for p in patterns) for t in texts], field


CARS = {
    ("Škoda Octavia 2.0 TDI", None, 120000): None,
    ("Koupím Octavii", None, 50000): "not selling",
    ("Hledám auto do města", None, 50000): "not selling",
    ("Octavia na díly", None, 50000): "parts phrase",
    ("Zimní pneu 205/55", None, 6000): "parts phrase",
    ("Alu 7,5J x 17 Škoda", None, 9000): "wheel",
    ("Letní sada R16", None, 9000): "wheel",
    ("Převodovka Octavia II", None, 9000): "starts with a part",
    ("Turbo 1.9", None, 9000): "starts with a part",
    ("Nárazník Fabia", None, 5500): "part",
    ("Motorka Jawa", None, 30000): "part",
    ("Fabia", "bez TP, jen celá", 20000): "description of parts",
    ("Fabia", "prodám na opravu", 20000): "description of parts",
    ("Fabia", "možno na splátky", 20000): "installments",
    ("Fabia bez nahlížení do registru", "akontace 0", 20000): "installments",
    ("Fabia", None, 4999): "price",
    ("Fabia", None, None): "price",
    (" ", None, 20000): "no heading",
    (None, None, 20000): "no heading",
}


def test_each_family_of_the_classifier(spark):
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(CARS)], "k int, heading string, description string, price int")
    got = [r["reason"] for r in rows.select("k", filters.reject_reason().alias("reason")).orderBy("k").collect()]
    assert dict(zip(CARS, got)) == CARS
    assert filters.cars_only(rows).count() == 1
    assert [filters.page_size("admin", n) for n in (0, 50, 1000)] == [1, 50, 100]


def test_resolved_mileage(spark):
    cases = [
        ("150 tis km", "150 000 km", None, ("NONE", "150 tis km", "AUTO_NORMALIZED", 0.95)),
        ("150000 km", None, None, ("MINOR_FORMATTING", "150000 km", "ML_PREFERRED", 0.75)),
        (None, "150000", None, ("MINOR_FORMATTING", "150000", "REGEX_PREFERRED", 0.80)),
        ("93 mi", "93 km", None, ("MINOR_FORMATTING", "93 mi", "AUTO_NORMALIZED", 0.90)),
        ("100 km", "200 km", None, ("MAJOR", "100 km", "ML_PREFERRED", 0.70)),
        ("100 km", "200 km", "300 km", ("MAJOR", "300 km", "MANUAL", 1.0)),
        (None, None, None, ("NONE", None, "AUTO_NORMALIZED", 0.0)),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, m string, p string, o string")
    got = [tuple(r["r"]) for r in df.select("k", reconcile.resolved_mileage(F.col("m"), F.col("p"), F.col("o")).alias("r")).orderBy("k").collect()]
    assert got == [c[3] for c in cases]


def test_verified_entities_and_confidence(spark):
    cases = [("power", "110 kW", "high", True, True), ("power", "20 kW", "high", True, False), ("power", "110", "low", False, False), ("mileage", "150000", "medium", True, True)]
    cases += [("mileage", "2000000", "high", True, False), ("fuel", "Nafta", "medium", True, True), ("fuel", "tdi", "high", True, False), ("fuel", None, "high", True, False)]
    df = spark.createDataFrame([(k, *c[1:4]) for k, c in enumerate(cases)], "k int, candidate string, tier string, said boolean")
    for kind in ("power", "mileage", "fuel"):
        got = {r["k"]: r["v"] for r in df.select("k", reconcile.verified_entity(kind, F.col("candidate"), F.col("tier"), F.col("said")).alias("v")).collect()}
        assert all(got[k] == c[4] for k, c in enumerate(cases) if c[0] == kind)
    levels = spark.createDataFrame([("full", "NONE", "high"), ("full", "MAJOR", "medium"), ("partial", "NONE", "medium"), ("none", "MAJOR", "low")], "level string, kind string, want string")
    assert levels.where(reconcile.confidence(F.col("level"), [F.col("kind")]) != F.col("want")).count() == 0


def test_quartiles_from_counts_are_those_of_arrays(spark):
    groups = {1: [5], 2: [1, 2], 3: [3, 1, 2], 4: [10, 20, 20, 40], 5: [7] * 9, 6: list(range(101)), 7: [1, 1, 1, 1000, 1000]}
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k int, v int")
    want = rows.groupBy("k").agg(deals.quartiles(F.collect_list("v")).alias("s")).select("k", "s.*")
    assert sorted(map(tuple, deals.quartiles_of(rows, ["k"], "v").collect())) == sorted(map(tuple, want.collect()))


def test_models_of_odd_headings(spark):
    names = model_match.dictionary(spark, {"b": ["5", "C 5", "C-5 Cross", "XX.1"]}, {"five": "5"})
    cases = {"c5cross": "c-5 cross", "C 5": "c 5", "model 5": "5", "rok 5": None, "r.v. 5, five": "5", "x5": None, "5x": None, "XX1 a": "xx.1", "": None, None: None, "51": "5" if re.search(r"(?<![a-z\d])5(?![a-z])", "51") else None}
    rows = spark.createDataFrame([(k, "b", h, None) for k, h in enumerate(cases)] + [(99, None, "c 5", "x"), (98, "z", "c 5", "x")], "k int, brand string, heading string, description string")
    got = {r["k"]: r["model"] for r in model_match.with_model(rows, names).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] is None and got[98] is None
