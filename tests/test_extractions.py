"""Files of extracted records, token alignment, and reviewed rows against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from bazaarlake.functions import labelling
from bazaarlake.operators import label_quality, labels
from bazaarlake.sources import extractions, files

RECORDS = [
    {"id": 1, "raw_values": {"mileage": "187.000 km", "year": 2015, "power": "145 KW", "fuel": "dieselový"}, "z": [1, {"a": None}], "fuel": "old"},
    {"mileage": 150000.7, "year": "r. 1985", "power": 0, "fuel": None, "q": "ž"},
    {"mileage": 1, "year": 2},
    5,
    {"raw_values": [1]},
    {"raw_values": {"fuel": 5}},
    {"raw_values": {"year": 2000, "mileage": 2_000_000, "power": True}},
    {"raw_values": {"fuel": "", "power": "", "mileage": "", "year": ""}, "_normalization_applied": False},
    None,
    {"raw_values": None, "mileage": "1 tis", "year": "", "power": "5", "fuel": "x"},
]
SOUND = {
    0: {"id": 1, "raw_values": RECORDS[0]["raw_values"], "z": [1, {"a": None}], "mileage": 187000, "year": 2015, "power": 145, "fuel": "diesel"},
    1: {"mileage": 150000, "year": None, "power": None, "fuel": None, "q": "ž"},
    6: {"raw_values": RECORDS[6]["raw_values"], "year": 2000, "mileage": None, "power": None},
    7: {"raw_values": RECORDS[7]["raw_values"], "fuel": None, "power": None, "mileage": None, "year": None},
}
FAULTS = {2: "no values", 3: "not an object", 4: "values not an object", 5: "fuel not a text", 8: "not an object", 9: "values not an object"}


def as_files(folder):
    (folder / "a.json").write_text(json.dumps(RECORDS, ensure_ascii=False, indent=2))
    (folder / "b.json").write_text(json.dumps({"extractions": [{"n": k, "raw_values": {"power": k}} for k in range(1, 400)], "more": 1}))
    (folder / "c.json").write_text("[1, ")
    (folder / "d.json").write_text('{"a": []}')
    (folder / "e.json").write_text("[]")
    (folder / "f.json").write_text(" ")
    (folder / "g.json").write_text("")  # no bytes: no row


def test_files_are_rewritten_one_by_one(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    as_files(source)
    for _ in range(2):  # a rerun changes nothing
        extractions.normalise_files(spark, str(source), str(out))
    got = {p.name: [json.loads(x) for f in sorted(p.glob("part-*")) for x in f.read_text().splitlines()] for p in (out / "normalised").glob("file=*")}
    assert got["file=a.json"] == [{**SOUND[k], "_normalization_applied": True} for k in sorted(SOUND)]
    assert [r["n"] for r in got["file=b.json"]] == list(range(1, 400)) and all(r["power"] == r["n"] for r in got["file=b.json"])
    assert set(got) == {"file=a.json", "file=b.json"}
    aside = spark.read.json(str(out / "aside")).collect()
    assert {r["place"]: r["fault"] for r in aside} == FAULTS and {r["file"] for r in aside} == {"a.json"}
    assert {json.dumps(json.loads(r["record"]), sort_keys=True) for r in aside} == {json.dumps(RECORDS[k], sort_keys=True) for k in FAULTS}
    broken = {r["file"]: r["fault"] for r in spark.read.json(str(out / "broken")).collect()}
    assert broken == {"c.json": "not json", "d.json": "unknown format", "f.json": "not json"}


def test_review_queue(spark):
    queue = [{"car_id": 1, "ml_result": {"mileage": "150 tis km", "x": 1}, "regex_result": None}, 3, {"x": 1, "ml_result_normalized": 9}]
    df = spark.createDataFrame([("q", json.dumps(queue)), ("none", None)], "file string, value string")
    got = [json.loads(r["record"]) for r in extractions.normalise_queue(extractions.records(df)[0]).orderBy("place").collect()]
    none = {"ml_result_normalized": {}, "regex_result_normalized": {}}
    assert got == [{**queue[0], **none, "ml_result_normalized": {"mileage": 150000}}, 3, {"x": 1, **none}]


def test_no_records(spark):
    rows, broken = extractions.records(spark.createDataFrame([], "file string, value string"))
    assert extractions.normalise_records(rows).count() == 0 and broken.count() == 0


def test_alignment_is_that_of_tokens(spark):
    rng = random.Random(4)
    texts = ["", "110kW, r.v. 2015", "řidič_1  č.5\n(x)", "😀a b", "áb c"] + ["".join(rng.choices("ab1č_ .,\n😀", k=12)) for _ in range(60)]
    rows = [(k, t, [(s, e, "X") for s in range(-1, len(t) + 2) for e in range(-1, len(t) + 2)]) for k, t in enumerate(texts)]
    rows += [(900, None, [(0, 1, "X")]), (901, "a", None)]
    df = spark.createDataFrame(rows, "k int, text string, entities array<struct<start:int,end:int,label:string>>")
    tokens = labelling.all_places(F.col("text"), f"(?U){labels.TOKEN}")
    got = df.select("k", "text", labels.aligned_only(F.col("entities"), F.col("text")).alias("kept"), tokens.alias("tokens")).collect()
    word = "\\w|\u0301"  # a combining accent belongs to its word
    for r in got[:-2]:
        plain = [m.span() for m in re.finditer(f"(?:{word})+|[^\\s\\w\u0301]", r["text"])]
        assert [tuple(x) for x in r["tokens"]] == plain, r["text"]
        starts, ends = {s for s, _ in plain}, {e for _, e in plain}
        want = [(s, e) for s in range(len(r["text"])) for e in range(s + 1, len(r["text"]) + 1) if s in starts and e in ends]
        assert [(e["start"], e["end"]) for e in r["kept"]] == want, r["text"]
    assert got[-2]["kept"] == [] and got[-1]["kept"] is None


def test_reviewed_rows_are_added_once(spark, tmp_path):
    folder = str(tmp_path / "r")
    first, second = spark.range(5), spark.range(10, 12)
    files.append_reviewed(first, folder, 0)
    old = sorted(p.name for p in (tmp_path / "r" / "batch=0").glob("part-*"))
    for _ in range(2):
        files.append_reviewed(second, folder, 1)
    assert old == sorted(p.name for p in (tmp_path / "r" / "batch=0").glob("part-*"))
    assert sorted(r["id"] for r in files.reviewed(spark, folder, "id bigint").collect()) == [0, 1, 2, 3, 4, 10, 11]


def test_reviewed_places_fold_case_but_for_years(spark):
    df = spark.createDataFrame([("TDI, tdi 88 KW", None, None, "88 kw", "tdi"), ("", "a", 1, "", None), (None, "a", 1, "b", "c")], "t string, m string, y int, p string, f string")
    got = [[tuple(p) for p in r["p"]] for r in df.select(labelling.reviewed_places(*(F.col(c) for c in "tmypf")).alias("p")).collect()]
    assert got == [[(9, 14, "POWER"), (0, 3, "FUEL")], [], []]


def test_growth(spark):
    for added, gain in ((0, None), (49, 0), (50, 2), (399, 14), (400, 15), (5000, 15)):
        rows = spark.range(added + 3).select(F.when(F.col("id") < 3, "base").when(F.col("id") > 3, "new").alias("source"))
        assert tuple(label_quality.growth(rows, "base").first()) == (added + 3, 3, added, gain)
    assert tuple(label_quality.growth(rows.limit(0), "base").first()) == (0, 0, 0, None)
