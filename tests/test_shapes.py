"""Labelled files by VARIANT against a plain check."""

import collections
import json

from pyspark.sql import functions as F

from bazaarlake.sources import shapes

TEXT = "najeto 193.500 km, tedy 193500 km"
EXAMPLES = [
    [TEXT, {"entities": [[7, 14, "MILEAGE"], [24, 30, "MILEAGE"]]}],
    ["a b", {"entities": []}],
    ["a b", {"entities": [[0, 1, "YEAR"], [0, 1], [0, 1, "YEAR", 4], "x", [0.5, 1, "YEAR"], ["0", 1, "YEAR"], [0, 1, 5], [0, 9, "YEAR"], [-1, 1, "YEAR"], [1, 1, "YEAR"], [0, 1, "BRAND"], [0, 9, "BRAND"]]}],
    ["only"],
    ["a", {"entities": []}, 3],
    5,
    {"text": "a"},
    [1, {"entities": []}],
    ["a", []],
    ["a", {"spans": []}],
    ["a", {"entities": "x"}],
    ["a", {"entities": [[0, 1, "FUEL"]]}],
    [TEXT, {"entities": [[24, 30, "YEAR"]]}],
]
KNOWN = ("MILEAGE", "YEAR", "POWER", "FUEL")


def plain_report(examples):
    found = collections.Counter()
    for x in examples:
        if not isinstance(x, list) or len(x) != 2:
            found["error", "not a pair"] += 1
        elif not isinstance(x[0], str):
            found["error", "text not a string"] += 1
        elif not isinstance(x[1], dict):
            found["error", "annotations not an object"] += 1
        elif "entities" not in x[1]:
            found["error", "no entities"] += 1
        elif not isinstance(x[1]["entities"], list):
            found["error", "entities not a list"] += 1
        else:
            for e in x[1]["entities"]:
                if not isinstance(e, list) or len(e) != 3:
                    found["error", "entity not a triple"] += 1
                elif not all(isinstance(p, int) for p in e[:2]):
                    found["error", "positions not integers"] += 1
                elif not isinstance(e[2], str):
                    found["error", "label not a string"] += 1
                else:
                    found["warning", "unknown label"] += e[2] not in KNOWN
                    if e[0] < 0 or e[1] > len(x[0]) or e[0] >= e[1]:
                        found["error", "invalid positions"] += 1
                    else:
                        near = x[0][max(0, e[0] - 10) : e[1] + 10]
                        own = x[0][e[0] : e[1]]
                        found["warning", "possibly normalised"] += e[2] == "MILEAGE" and own.isdigit() and len(own) >= 5 and ("." in near or " tis" in near.lower())
    return {k: n for k, n in found.items() if n}


def test_report_and_sound_examples(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EXAMPLES[:6]))
    (tmp_path / "b.json").write_text(json.dumps(EXAMPLES[6:], indent=1))
    (tmp_path / "c.json").write_text("[1, ")
    (tmp_path / "d.json").write_text('{"a": 1}')
    (tmp_path / "e.json").write_text("[]")
    rows, broken = shapes.examples(spark, str(tmp_path))
    assert {r["file"]: r["fault"] for r in broken.collect()} == {"c.json": "not json", "d.json": "not a list"}
    assert rows.count() == len(EXAMPLES)
    want = plain_report(EXAMPLES) | {("error", "not json"): 1, ("error", "not a list"): 1}
    assert {(r["level"], r["fault"]): r["n"] for r in shapes.report(rows, broken).collect()} == want
    sound = sorted((r["text"], [tuple(e) for e in r["entities"]]) for r in shapes.sound_examples(rows).collect())
    assert sound == sorted((x[0], [tuple(e) for e in x[1]["entities"]]) for x in (EXAMPLES[k] for k in (0, 1, 11, 12)))


def test_nothing_at_fault(spark):
    rows = spark.createDataFrame([("f", 0, '["a", {"entities": [[0, 1, "FUEL"]]}]')], "file string, place int, s string").select("file", "place", F.parse_json("s").alias("example"))
    assert shapes.report(rows).count() == 0


def test_report_reads_the_examples_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EXAMPLES))
    rows, _ = shapes.examples(spark, str(tmp_path))
    plan = shapes.report(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
