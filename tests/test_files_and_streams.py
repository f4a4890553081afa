"""Files of several shapes, links of pages, resolved overlaps, and incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import detail_page
from bazaarlake.operators import labels, state
from bazaarlake.sources import files
from bazaarlake.streaming import ingest


def test_examples_of_three_shapes(spark, tmp_path):
    found = [["a b", {"entities": [[0, 1, "YEAR"]]}], {"data": ["c", {"entities": []}], "car_id": 7, "source": "x"}, {"text": "d", "entities": [[0, 1, "FUEL"]]}, 5, ["only"], {"no": 1}]
    (tmp_path / "a.json").write_text(json.dumps(found))
    got = sorted((r["text"], [tuple(e) for e in r["entities"]], r["car_id"], r["source"]) for r in files.labelled_examples(spark, str(tmp_path)).collect())
    assert got == [("a b", [(0, 1, "YEAR")], None, None), ("c", [], "7", "x"), ("d", [(0, 1, "FUEL")], None, None)]


def test_json_arrays_and_separated_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1, "v": "x"}, {"k": 2}]')
    assert sorted(map(tuple, files.json_array(spark, str(tmp_path / "a.json"), "k int, v string").collect())) == [(1, "x"), (2, None)]
    (tmp_path / "t.txt").write_text("one\ntwo\n---\n  three \n---\n\n---\n")
    assert sorted(r[0] for r in files.separated_texts(spark, str(tmp_path / "t.txt")).collect()) == ["one\ntwo", "three"]


def test_spans_from_columns(spark, tmp_path):
    (tmp_path / "s.csv").write_text("text,year_start,year_end,fuel_start,fuel_end\nrok 2010 lpg,4,8,9,12\nnic,,,1,\n")
    got = {r["text"]: [tuple(e) for e in r["entities"]] for r in files.span_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"rok 2010 lpg": [(4, 8, "YEAR"), (9, 12, "FUEL")], "nic": []}


def test_written_texts_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a\n b",), ("c",)], "text string")
    for _ in range(2):
        files.write_texts(rows, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a b", "a b", "c", "c"]
    one, two = (files.replace_version(rows, str(tmp_path / "v")) for _ in range(2))
    assert one != two and spark.read.parquet(one).count() == spark.read.parquet(two).count() == 2


def test_links(spark):
    html = """<div class='x'><a href="/no">n</a></div><div class="inzeraty inzeratyflex"><h2><a class="t" href="/inzerat/1/a.php">A</a></h2><a href='http://o.org/2'>B</a></div>
<DIV CLASS=inzeraty><A HREF=/inzerat/3/>C</A></DIV><div class="inzeratydetnadpis"><a href="/no2">n</a></div>"""
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "k int, html string")
    got = {r["k"]: r["u"] for r in df.select("k", detail_page.result_links(F.col("html"), "https://b.cz").alias("u")).collect()}
    assert got[1] == ["https://b.cz/inzerat/1/a.php", "http://o.org/2", "https://b.cz/inzerat/3/"] and got[2] == [] and not got[3]


def test_pages_that_lack_a_part(spark):
    whole = "<div class=popisdetail>text</div><h1 class=nadpisdetail>head</h1><table><tr><td class=listadvlevo><table><tr><td>x<tr><td>1 500 Kč</table></td></table>"
    pages = [whole, whole.replace("popisdetail", "p"), whole.replace("nadpisdetail", "n"), whole.replace("listadvlevo", "l"), whole.replace("<tr><td>1 500 Kč", "<tr><td>Dohodou"), "", None]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = [r["f"] for r in df.select("k", detail_page.fields(F.col("html")).alias("f")).orderBy("k").collect()]
    assert tuple(got[0]) == ("text", "head", 1500, None, None) and got[4]["price"] is None and got[4]["heading"] == "head"
    assert [g is None for g in got] == [False, True, True, True, False, True, True]


@pytest.mark.parametrize(
    ("spans", "kept"),
    [
        ([(0, 5, "FUEL"), (3, 10, "YEAR")], [(3, 10, "YEAR")]),
        ([(0, 5, "FUEL"), (0, 5, "MILEAGE")], [(0, 5, "MILEAGE")]),
        ([(4, 8, "YEAR"), (0, 4, "YEAR"), (2, 6, "YEAR")], [(0, 4, "YEAR"), (4, 8, "YEAR")]),
        ([], []),
    ],
)
def test_resolved_overlaps(spark, spans, kept):
    df = spark.createDataFrame([(spans,)], "entities array<struct<start:int,end:int,label:string>>")
    assert [tuple(e) for e in df.select(labels.without_overlaps(F.col("entities")).alias("e")).first()["e"]] == kept


def test_ingest_goes_on_where_it_ended(spark, tmp_path):
    landing, target, mark = (str(tmp_path / x) for x in ("landing", "state", "mark"))

    def land(rows):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(landing)
        ingest.ingest(spark, landing, "k int, v string, at int", target, mark, "k", "at")

    def newest():
        last = max(int(p.name) for p in (tmp_path / "state").iterdir())
        return sorted(tuple(r) for r in spark.read.parquet(f"{target}/{last}").collect())

    land([(1, "a", 1), (2, "b", 1), (1, "c", 2)])
    assert newest() == [(1, "c", 2), (2, "b", 1)]
    land([(2, "d", 3), (3, "e", 3)])
    assert newest() == [(1, "c", 2), (2, "d", 3), (3, "e", 3)]
    ingest.ingest(spark, landing, "k int, v string, at int", target, mark, "k", "at")
    assert newest() == [(1, "c", 2), (2, "d", 3), (3, "e", 3)]


def test_new_names_are_numbered_in_order(spark):
    known = spark.createDataFrame([(4, "Audi"), (9, "BMW")], "id int, name string")
    names = spark.createDataFrame([("zetor",), ("audi",), (" Ford",), ("Fiat",), ("ford",), (None,), ("f",)], "name string")
    got = sorted(tuple(r) for r in state.lookup_or_insert(known, names).collect())
    assert got == [(4, "Audi"), (9, "BMW"), (10, "f"), (11, "Fiat"), (12, "Ford"), (13, "zetor")]
