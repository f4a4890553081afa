"""Rewritten fuels against rules that run one after another."""

import re

from bazaarlake.functions import normalise, patterns


def plain(value):
    for pattern, name in patterns.FUEL_REWRITES.items():
        if value is not None and re.search(pattern, value, re.I):
            value = name
    return value


def test_rules_run_one_after_another_and_each_is_asked_once(spark):
    values = [None, "", "x", "Benzin 95", "benzín", "nafta, lpg", "LPG/benzin", "elektro hybrid", "diesel 2.0 turbo", "Nafta", "electric", "zemní plyn CNG", "cng nafta", "hybrid benzin", "tdi"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    made = rows.select("v", normalise.rewritten_fuel(rows.v).alias("fuel"))
    assert {r["v"]: r["fuel"] for r in made.collect()} == {v: plain(v) for v in values}
    asked = made._jdf.queryExecution().analyzed().toString().upper().count("RLIKE")
    assert asked == len(patterns.FUEL_REWRITES)
