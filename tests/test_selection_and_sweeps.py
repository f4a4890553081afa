"""Medians by selection, overlaps by a sweep, and pages parsed once, against plain versions."""

import random
import statistics

from pyspark.sql import functions as F

from bazaarlake.functions import detail_page, spans
from bazaarlake.operators import deals, labels


def test_quartiles_are_those_of_statistics(spark):
    rng = random.Random(1)
    values = {k: [rng.choice([rng.randrange(-50, 50), rng.randrange(1, 10**6), 7]) for _ in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 9, 40, 333))}
    df = spark.createDataFrame([(None if k == 5 else k, v) for k, x in values.items() for v in x] + [(99, None)], "k int, v int")
    got = {r["k"]: r for r in deals.quartiles_of(df, ["k"], "v").collect()}
    for k, x in values.items():
        r = got[None if k == 5 else k]
        q1, median, q3 = statistics.quantiles(x, n=4) if len(x) >= 4 else (min(x), statistics.median(x), max(x))
        assert (r["q1"], r["median"], r["q3"], r["count"]) == (q1, median, q3, len(x))
    assert 99 not in got


def test_bands_are_those_of_all_peers(spark):
    """Every branch: bands of 3 and 5 years, the whole segment, offers without a year, a hot segment, equal prices."""
    rng = random.Random(2)
    rows = [(i, "b", rng.choice("mmmmn"), rng.choice(["f", None]), rng.choice([None, 1990, 1994, 1999, 2000, 2001, 2011]), rng.choice([20_000, rng.randrange(9_000, 90_000)])) for i in range(400)]
    rows += [(1000 + i, "c", "m", "f", 1990 + 4 * i, 30_000 + i) for i in range(7)] + [(2000, "d", "m", "f", 2000, 50_000), (2001, None, "m", "f", 2000, 50_000)]
    got = {r["id"]: (r["median"], r["peers"], r["confidence"], r["segment_median"], r["segment_size"]) for r in deals.banded(spark.createDataFrame(rows, "id int, brand string, model string, fuel string, year_manufacture int, price int")).collect()}
    want = {}
    for i, *segment, year, price in rows:
        peers = [(y, p) for _, *s, y, p in rows if s == segment and 10_000 < p < 5_000_000]
        if segment[0] and 10_000 < price < 5_000_000 and len(peers) >= 5:
            whole = [p for _, p in peers]
            band, confidence = whole, "low"
            for width, name in ((5, "medium"), (3, "high")):
                near = [p for y, p in peers if year is not None and y is not None and abs(y - year) <= width]
                if len(near) >= 5:
                    band, confidence = near, name
            want[i] = (statistics.median(band), len(band), confidence, statistics.median(whole), len(whole))
    assert got == want and {w[2] for w in want.values()} == {"high", "medium", "low"}


SPANS = "id int, entities array<struct<start:int,end:int,label:string>>, text string"


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, [(s, s + rng.randrange(-2, 9), rng.choice(["YEAR", "FUEL"])) for s in (rng.randrange(-3, 40) for _ in range(rng.randrange(14)))], "x" * 38) for k in range(80)] + [(90, [], ""), (91, None, None)]
    df = spark.createDataFrame(rows, SPANS)
    want = labels.pairs(df).where(labels.overlap(F.col("a"), F.col("b"))).select("id", "i", "j", "a", "b")
    assert sorted(map(tuple, labels.overlapping(df).collect())) == sorted(map(tuple, want.collect()))
    counted = {}
    for _, entities, text in rows:
        for n, a in enumerate(entities or []):
            found = [name for name, hit in (("NEGATIVE_SPAN", a[0] < 0), ("INVALID_SPAN_ORDER", a[0] >= a[1]), ("OUT_OF_BOUNDS", a[1] > len(text))) if hit]
            for b in entities[n + 1 :]:
                same, meet = a[:2] == b[:2], a[0] < b[1] and b[0] < a[1]
                found += ["DUPLICATE"] if same and a[2] == b[2] else ["SAME_SPAN_DIFFERENT_LABELS"] if same else ["OVERLAP"] if meet else []
            for f in found:
                counted[f] = counted.get(f, 0) + 1
    assert {r["issue"]: r["n"] for r in labels.issues(df).collect()} == counted


def test_ten_thousand_spans_of_a_text(spark):
    """Spans side by side, each over the next one's first letter: as many rows as overlaps."""
    n = 10_000
    df = spark.createDataFrame([(1, [(3 * k, 3 * k + 4, "YEAR") for k in range(n)], "")], SPANS)
    assert labels.overlapping(df).count() == n - 1


def test_a_page_is_parsed_once(spark):
    page = "<div class=popisdetail>text</div><h1 class=nadpisdetail>head</h1><div class=inzeratydetnadpis>[3.4. 2001]</div><table><tr><td class=listadvlevo><table><tr><td>12 lidí<tr><td>1 500 Kč</table></td></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "k int, html string")
    made = detail_page.with_fields(df, F.col("html"))
    got = {r["k"]: r for r in made.collect()}
    assert tuple(str(x) for x in got[1][2:]) == ("text", "head", "1500", "2001-04-03", "12", "True")
    assert [got[k]["parsed"] for k in (2, 3)] == [False, False] and got[2]["heading"] is None
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("popisdetail") == detail_page.opening("div", "popisdetail").count("popisdetail")


def test_written_mileages():
    cases = {("187.000", "187.000 km"): 187_000, ("1.5", "1.5tis"): 1500, ("150", "150k"): 150_000, ("150", "150 * * *"): 150_000, ("150", "150***"): 150_000, ("187 000", "187 000 km"): 187_000}
    cases |= {("90", "90 tis. km"): 90_000, ("123", "123xxx km"): 123_000, ("12,5", "12,5 t km"): 12_500, ("4500", "4500"): 4500, ("2000", "2000 tis"): 2000, ("1.234.567", "1.234.567 km"): 1_234_567}
    assert {c: spans.kilometres(*c) for c in cases} == cases
