"""Queries over pages, headings, edits and labelled texts, all made from listings so that SQL can tell what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.functions import detail_page, labelling
from bazaarlake.operators import edits, label_quality, model_match
from bazaarlake.operators.changing import removed_repeats
from bazaarlake.operators.filters import is_car_by_keywords
from bazaarlake.operators.labels import aligned_only, without_overlaps
from bazaarlake.sources import extractions, shapes
from bazaarlake.sources.listings import AS_OF_YEAR, LISTINGS_SQL, described, listings, spread, table

BASE = "https://auto.example.org"


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def number(column):
    return F.col(column).cast("string")


def detail_pages(spark, sf_dir):
    """One in ten pages lacks its price table, one in ten has an empty price."""
    day = F.date_format("listing_date", "d.M. y")
    price = F.when(F.col("id") % 10 == 1, "Dohodou").otherwise(text(F.format_number("price", 0), " Kč"))
    prices = text("<table><tr><td class=listadvlevo><table><tr><td>Lokalita:</td></tr><tr><td>Vidělo:</td><td>", number("view_count"), " lidí</td></tr><tr><td><b>", price, "</b></td></tr></table></td></tr></table>")
    page = text(
        '<html><div class="inzeratydetnadpis"><h1 class=nadpisdetail> ', F.col("model"), " &amp; co </h1><span>[", day, ']</span></div><div class="x popisdetail">\n  Prodám <b>', F.col("model"), "</b>,<br>číslo ", number("id"), " </div>",
        F.when(F.col("id") % 10 != 0, prices).otherwise(F.lit("")), "</html>",
    )
    rows = spread(listings(spark, sf_dir), table(spark, sf_dir, "orders")).select("id", page.alias("html"))
    return detail_page.with_fields(rows, F.col("html")).drop("html")


def result_links(spark, sf_dir):
    block = text('<div class="inzeraty inzeratyflex"><a class=k href="/inzerat/', number("id"), '/x.php">A</a><h2><a href=\'', BASE, "/inzerat/", number("id"), "/y.php'>B</a></h2></div>")
    page = text("<a href=/no>menu</a>", block, block)
    found = listings(spark, sf_dir).select("id", F.posexplode(detail_page.result_links(page, BASE)).alias("place", "url"))
    return found.select("id", "place", "url")


def brand_menu(spark, sf_dir):
    links = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit('<li><a href="/brand'), k.cast("string"), F.lit('/">B</a></li>')))
    page = text("<p class=barvalevax><a href=/no/></a></p><div class=barvaleva><ul>", F.array_join(links, ""), "</ul></div>")
    rows = table(spark, sf_dir, "region").select("r_regionkey", detail_page.menu_brands(page, BASE).alias("menu"))
    return rows.select("r_regionkey", F.explode("menu").alias("m")).select("r_regionkey", "m.brand", "m.url")


MODELS = {"mazda": ["3", "CX-3", "MX-5"], "suzuki": ["Vitara", "Grand Vitara", "SX4 S-Cross"], "peugeot": ["308", "2008"]}
ALIASES = {"s-cross": "SX4 S-Cross", "miata": "MX-5"}
#: By the last digit of the id: brand, heading, description, and the model that must be found.
HEADINGS = [
    ("mazda", "Prodám Mazda cx 3 2.0", None, "cx-3"),
    ("mazda", "Mazda 3 sedan", "cx-3", "3"),
    ("mazda", "MAZDA CX3", None, "cx-3"),
    ("suzuki", "Suzuki GRAND  Vitara", None, "grand vitara"),
    ("suzuki", "Suzuki", "pěkná S.Cross 4x4", "sx4 s-cross"),
    ("suzuki", "Suzuki vitarax", "", None),
    ("peugeot", "Peugeot 308sw", None, None),
    ("peugeot", "rok 2008 Peugeot", "308 hdi", "308"),
    ("peugeot", "Peugeot 2008 r.v. 2015", None, "2008"),
    ("lada", "Lada 2008", None, None),
]


def models(spark, sf_dir):
    def of(k):
        return F.get(F.array(*(F.lit(x[k]) for x in HEADINGS)), (F.col("id") % 10).cast("int"))

    rows = listings(spark, sf_dir).select("id", of(0).alias("brand"), of(1).alias("heading"), of(2).alias("description"))
    return model_match.with_model(rows, model_match.dictionary(spark, MODELS, ALIASES)).select("id", "model")


#: A dictionary of 24 brands with 60 models each, by rule: series and number, as `serie 12` or `serie-12 gt`.
MANY = {f"brand{b}": [f"{'abcdefghij'[m % 10]}{b}{'- .'[m % 3]}{m}{' gt' * (m % 4 == 0)}" for m in range(60)] for b in range(24)}


def many_models(spark, sf_dir):
    """Headings that vary by row: a model of the row's brand, its separator written in one of four ways, after a number of the id."""
    b, m = F.col("id") % 24, (F.col("id") * 7) % 60
    number = m.cast("string")
    between = F.get(F.array(F.lit(" "), F.lit("-"), F.lit("."), F.lit("")), (F.col("id") % 4).cast("int"))
    name = F.concat(F.get(F.split(F.lit("a,b,c,d,e,f,g,h,i,j"), ","), (m % 10).cast("int")), b.cast("string"), between, number, F.when(m % 4 == 0, F.concat(between, F.lit("GT"))).otherwise(""))
    told = F.concat(F.lit("č. "), F.col("id").cast("string"), F.lit("z, Prodám  "), F.upper(name), F.lit(", "), F.col("model"))
    in_heading = F.col("id") % 5 != 0
    rows = listings(spark, sf_dir).select("id", F.concat(F.lit("brand"), b.cast("string")).alias("brand"), F.when(in_heading, told).otherwise(F.col("fuel")).alias("heading"), F.when(~in_heading & (F.col("id") % 10 != 0), told).alias("description"))
    return model_match.with_models(rows, MANY, {}).select("id", "model")


def suggested(spark, sf_dir):
    """Suggested labels of the listings' texts, and which of them are chosen."""
    rows = described(listings(spark, sf_dir)).select("id", "text")
    rows = spread(rows, table(spark, sf_dir, "orders")).select("id", labelling.suggestions(F.col("text")).alias("all"))
    found = rows.select("id", "all", without_overlaps(F.col("all")).alias("chosen")).select("id", "chosen", F.explode_outer("all").alias("e"))  # outer: a filter on "all" would make it twice
    return found.where("e is not null").select("id", "e.*", F.array_contains("chosen", F.col("e")).alias("chosen"))


#: Shapes of labelled examples by the id's remainder of 8; VALUE is the listing's model, PRICE its price.
SHAPES = [
    '["VALUE PRICE km", {"entities": [[0, 2, "YEAR"]]}]',
    '["VALUE", {"entities": [[0, 999, "YEAR"], [0, 1, "BRAND"]]}]',
    '["VALUE", {"entities": [[0, 1]]}]',
    '["VALUE", {"entities": "PRICE"}]',
    '["VALUE", {"spans": []}]',
    '[PRICE, {"entities": []}]',
    '{"text": "VALUE"}',
    '["VALUE", {"entities": [["0", 1, "YEAR"], [0, 1, PRICE], [1, 1, "FUEL"]]}]',
]


def shape_faults(spark, sf_dir):
    shape = F.get(F.array(*(F.lit(x) for x in SHAPES)), (F.col("id") % 8).cast("int"))
    said = F.replace(F.replace(shape, F.lit("VALUE"), F.col("model")), F.lit("PRICE"), F.col("price").cast("string"))
    rows = listings(spark, sf_dir).select(F.col("brand").alias("file"), F.col("id").alias("place"), F.parse_json(said).alias("example"))
    return shapes.report(rows)


#: Files of two records by the id's remainder of 6; MILES, YEAR, POWER and FUEL are the listing's, as JSON.
RECORDS = [
    '[{"id": 1, "raw_values": {"mileage": MILES, "year": "r. YEAR", "power": "POWER KW", "fuel": "Dieselový"}}, {"id": 2}]',
    '{"extractions": [{"mileage": "MILES km", "year": YEAR, "power": POWER, "fuel": FUEL, "x": 1}, 5]}',
    '[{"raw_values": {"mileage": "POWER tis km", "fuel": "2.0 TSI"}, "fuel": "old"}, {"raw_values": "none"}]',
    '[{"raw_values": {"fuel": POWER}}, {"raw_values": {"power": POWER.75}}]',
    '{"items": []}',
    '[{"raw_values": ',
]


def record_files(spark, sf_dir):
    """Files (file, value): one a listing."""
    shape = F.get(F.array(*(F.lit(x) for x in RECORDS)), (F.col("id") % 6).cast("int"))
    for name, column in (("MILES", "mileage"), ("YEAR", "year_manufacture"), ("POWER", "power")):
        shape = F.replace(shape, F.lit(name), F.coalesce(number(column), F.lit("0")))
    shape = F.replace(shape, F.lit("FUEL"), F.coalesce(text('"', F.col("fuel"), '"'), F.lit("null")))
    return listings(spark, sf_dir).select(F.col("id").alias("file"), shape.alias("value"))


def normalised_records(spark, sf_dir):
    rows, broken = extractions.records(record_files(spark, sf_dir))
    done = extractions.normalise_records(rows).select("file", "place", "mileage", "year", "power", "fuel", "fault")
    return done.unionByName(broken, allowMissingColumns=True)


EDGES = ((17, 11), (23, 5), (29, 7))


def aligned_spans(spark, sf_dir):
    """Spans at places by rules of the id, of which those on token boundaries stay."""
    said = text(F.col("model"), "; výkon:", F.coalesce(number("power"), F.lit("-")), " kW,rok_", F.coalesce(number("year_manufacture"), F.lit("")), " (č. ", number("id"), ")")
    made = [F.struct((F.col("id") % a).cast("int").alias("start"), (F.col("id") % a + F.col("id") % b).cast("int").alias("end"), F.lit(f"S{a}").alias("label")) for a, b in EDGES]
    rows = listings(spark, sf_dir).select("id", F.explode(aligned_only(F.array(*made), said)).alias("e"))
    return rows.select("id", "e.*")


def reviewed_places(spark, sf_dir):
    said = text("NAJETO ", number("view_count"), " TIS KM, 1-urgent; ", F.coalesce(number("year_manufacture"), F.lit("?")), "; ", F.coalesce(number("power"), F.lit("-")), " Kw 2-HIGH")
    p = labelling.reviewed_places(said, text(number("view_count"), " tis km"), F.col("year_manufacture"), text(number("power"), " kW"), F.col("fuel"))
    return listings(spark, sf_dir).select("id", F.explode(p).alias("p")).select("id", "p.*")


#: By the id's remainder of 8: a text, and whether it tells mileage, year, power and fuel.
TOLD = [
    ("najeto 150 tis km", 1, 0, 0, 0),
    ("r.v. 2005", 0, 1, 0, 0),
    ("výkon 110 kW", 0, 0, 1, 0),
    ("jezdí na NAFTU i naftu", 0, 0, 0, 0),
    ("2.0 TDI, 150PS, 200***", 1, 0, 1, 1),
    ("bez údajů", 0, 0, 0, 0),
    ("rok výroby 1999; 215k; lpg", 1, 1, 0, 1),
    (None, 0, 0, 0, 0),
]


def detectors(spark, sf_dir):
    said = F.get(F.array(*(F.lit(x[0]) for x in TOLD)), (F.col("id") % 8).cast("int"))
    return listings(spark, sf_dir).select("id", *(labelling.tells(k, said).alias(f"has_{k}") for k in labelling.DETECTORS))


def places(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("fuel", F.when(F.col("id") % 3 == 0, "Diesel").when(F.col("id") % 3 == 1, "lpg"))
    said = text("r.v. ", F.coalesce(number("year_manufacture"), F.lit("-")), "; na DIESEL; ", F.coalesce(number("power"), F.lit("-")), " kW")
    found = rows.select("id", F.explode(labelling.places(said, F.lit(None), F.col("year_manufacture"), F.col("power"), F.col("fuel"))).alias("p"))
    return found.select("id", "p.*")


def edit_requests(spark, sf_dir):
    """By the id's remainder of 6: a new mileage; a power out of bounds; an unknown field; two fields; a fuel emptied; none."""
    way = F.col("id") % 6

    def edit(field, value):
        return F.struct(F.lit(field).alias("field"), (value if value is None else value.cast("string")).alias("value") if value is not None else F.lit(None).cast("string").alias("value"))

    requests = (
        F.when(way == 0, F.array(edit("mileage", F.col("id") % 1000 + 1)))
        .when(way == 1, F.array(edit("power", F.lit(99999)), edit("price", F.lit(5))))
        .when(way == 2, F.array(edit("colour", F.lit("red"))))
        .when(way == 3, F.array(edit("price", F.lit(777)), edit("mileage", F.lit(10))))
        .when(way == 4, F.array(edit("fuel", None)))
    )
    return listings(spark, sf_dir).select("id", F.explode(requests).alias("e")).select("id", "e.*")


def applied_edits(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "price", "mileage", "power", "year_manufacture", "fuel")
    done, _ = edits.edited(rows, edit_requests(spark, sf_dir), AS_OF_YEAR)
    return done.select("id", "price", "mileage", "power", "fuel", F.round("price_per_km", 6).alias("price_per_km"))


def refused_edits(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "price", "mileage", "power", "year_manufacture", "fuel")
    refused = edits.edited(rows, edit_requests(spark, sf_dir), AS_OF_YEAR)[1]
    return refused.groupBy("field", "fault").agg(F.count(F.lit(1)).alias("n"))


def labelled(spark, sf_dir):
    """Examples with spans for power, year and fuel, some of them odd."""
    odd = F.when(F.col("id") % 4 == 0, "110kW").when(F.col("id") % 4 == 1, "85 kw").otherwise("90 PS")
    fuel = F.when(F.col("id") % 5 == 0, "benzín").when(F.col("id") % 5 == 1, "nafta").otherwise("Diesel")
    rows = listings(spark, sf_dir).select("id", odd.alias("p"), fuel.alias("f"), F.when(F.col("id") % 3 == 0, "2.0 TDI ").otherwise("2.0 ").alias("engine"))
    said = text(F.col("engine"), F.col("p"), " ", F.col("f"), " lpg rok 2016 150 tis km")
    size, p, f = (F.length(x) for x in ("engine", "p", "f"))

    def span(start, length, label):
        return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"), F.lit(label).alias("label"))

    at = size + p + 1
    every = [span(size, p, "POWER"), span(at, f, "FUEL")]
    full = [*every, span(at + f + 9, F.lit(4), "YEAR"), span(at + f + 14, F.lit(10), "MILEAGE")]
    both = [*every, span(at + f + 1, F.lit(3), "FUEL"), span(at + f + 5, F.lit(8), "YEAR")]
    entities = F.when(F.col("id") % 7 == 0, F.array().cast("array<struct<start:int,end:int,label:string>>")).when(F.col("id") % 7 == 1, F.array(*both)).when(F.col("id") % 7 == 2, F.array(*every)).otherwise(F.array(*full))
    return rows.select("id", said.alias("text"), entities.alias("entities"))


def cleaned(spark, sf_dir):
    events, lines = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    return removed_repeats({"events": (events, ["user_id", "event_type"]), "lineitem": (lines, ["l_orderkey", "l_linenumber"])})


def values(rows, names) -> str:
    """Rows as SQL values, strings quoted."""
    def one(x):
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(values " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + f") as v({names})"


L = LISTINGS_SQL
LABELLED_SQL = f"""{L}, x as (select id, case when id % 4 = 0 then '110kW' when id % 4 = 1 then '85 kw' else '90 PS' end as p,
 case when id % 5 = 0 then 'benzín' when id % 5 = 1 then 'nafta' else 'diesel' end as f, id % 3 = 0 as tdi, id % 7 as w from listings)"""
QUERIES = {
    "s6_detail_pages": detail_pages,
    "s5_result_links": result_links,
    "s7_brand_menu": brand_menu,
    "j11_models_by_dictionary": models,
    "j11_many_models": many_models,
    "x21_suggestions": suggested,
    "l4_shape_faults": shape_faults,
    "x26_normalised_records": normalised_records,
    "l3_aligned_spans": aligned_spans,
    "x24_reviewed_places": reviewed_places,
    "a18_unit_consistency": lambda s, d: label_quality.unit_consistency(labelled(s, d)),
    "f12_legacy_car_filter": lambda s, d: listings(s, d).select("id", is_car_by_keywords(F.when(F.col("id") % 9 != 0, F.col("model")), F.get(F.array(*map(F.lit, ["Octavia 2.0", "zimní PNEU", "Sada kol", "motory", "Alu kola R17"])), (F.col("id") % 5).cast("int")), F.col("price")).alias("is_car")),
    "f16_all_detectors": detectors,
    "x24_places_of_values": places,
    "p6_edited_offers": applied_edits,
    "p6_refused_edits": refused_edits,
    "a17_completeness": lambda s, d: label_quality.completeness(labelled(s, d)),
    "a18_fuel_synonyms": lambda s, d: label_quality.fuel_synonyms(labelled(s, d)),
    "a18_contradictions": lambda s, d: label_quality.contradictions(labelled(s, d)),
    "a19_label_formats": lambda s, d: label_quality.format_profile(labelled(s, d)),
    "w3_removed_repeats": cleaned,
    "o6_contiguous_slice": lambda s, d: listings(s, d).select("id", "brand", "price").orderBy("id").offset(123).limit(50),
    "o9_urls_across_brands": lambda s, d: listings(s, d).select("brand", "id").orderBy("brand", "id").limit(300),
}
ORACLE_SQL = {
    "s6_detail_pages": f"""{L} select id, id % 10 <> 0 as parsed, case when id % 10 <> 0 then 'Prodám ' || model || ',číslo ' || id end as description, case when id % 10 <> 0 then model || ' & co' end as heading,
 case when id % 10 > 1 then cast(price as bigint) end as price, case when id % 10 <> 0 then listing_date end as listing_date, case when id % 10 <> 0 then cast(view_count as int) end as view_count from listings""",
    "s5_result_links": f"{L} select id, place, '{BASE}/inzerat/' || id || case place when 0 then '/x.php' else '/y.php' end as url from listings, (values (0), (1)) as p(place)",
    "s7_brand_menu": f"select r_regionkey, 'brand' || k as brand, '{BASE}/brand' || k || '/' as url from region, range(1, 25) as t(k)",
    "j11_models_by_dictionary": f"{L} select id, v.model from listings join {values([(k, h[3]) for k, h in enumerate(HEADINGS)], 'k, model')} on id % 10 = k",
    "j11_many_models": f"""{L}, x as (select id, id % 24 as b, id * 7 % 60 as m from listings)
 select id, case when id % 10 <> 0 then substr('abcdefghij', cast(m % 10 as int) + 1, 1) || b || case m % 3 when 0 then '-' when 1 then ' ' else '.' end || m || case when m % 4 = 0 then ' gt' else '' end end as model from x""",
    "l4_shape_faults": f"""{L}, n as (select id % 8 as k, count(*) as n from listings group by 1), f(k, level, fault) as (values (1, 'error', 'invalid positions'), (1, 'warning', 'unknown label'),
 (2, 'error', 'entity not a triple'), (3, 'error', 'entities not a list'), (4, 'error', 'no entities'), (5, 'error', 'text not a string'), (6, 'error', 'not a pair'),
 (7, 'error', 'positions not integers'), (7, 'error', 'label not a string'), (7, 'error', 'invalid positions'))
 select level, fault, cast(sum(n) as bigint) as n from f join n using (k) group by all""",
    "x26_normalised_records": f"""{L}, x as (select id as file, id % 6 as w, coalesce(mileage, 0) as m, year_manufacture as y, power as p, fuel as f from listings)
 select file, 0 as place, case when m between 1 and 1000000 then m end as mileage, case when y >= 1990 then y end as year, coalesce(p, 0) as power, 'diesel' as fuel, null as fault from x where w = 0
 union all select file, 1, null, null, null, null, 'no values' from x where w = 0
 union all select file, 0, case when m <= 1000000 then m end, case when y >= 1990 then y end, p, null, null from x where w = 1
 union all select file, 1, null, null, null, null, 'not an object' from x where w = 1
 union all select file, 0, coalesce(p, 0) * 1000, null, null, 'benzín', null from x where w = 2
 union all select file, 1, null, null, null, null, 'values not an object' from x where w = 2
 union all select file, 0, null, null, null, null, 'fuel not a text' from x where w = 3
 union all select file, 1, null, null, p, null, null from x where w = 3
 union all select file, null, null, null, null, null, case w when 4 then 'unknown format' else 'not json' end from x where w > 3""",
    "l3_aligned_spans": f"""{L}, x as (select id, model || '; výkon:' || coalesce(cast(power as varchar), '-') || ' kW,rok_' || coalesce(cast(year_manufacture as varchar), '') || ' (č. ' || id || ')' as t from listings),
 s as (select id, t, {", ".join(f"id % {a} as s{a}, id % {a} + id % {b} as e{a}" for a, b in EDGES)} from x), e as ({" union all ".join(f"select id, t, cast(s{a} as int) as s, cast(e{a} as int) as e, 'S{a}' as label from s" for a, _ in EDGES)})
 select id, s as start, e as "end", label from e where s < e and e <= length(t) and substr(t, s + 1, 1) <> ' ' and substr(t, e, 1) <> ' '
 and not (s > 0 and regexp_matches(substr(t, s, 2), '^[\\p{{L}}\\p{{N}}_]{{2}}')) and not regexp_matches(substr(t, e, 2), '^[\\p{{L}}\\p{{N}}_]{{2}}')""",
    "x24_reviewed_places": f"""{L}, x as (select id, 'NAJETO ' || view_count || ' TIS KM, 1-urgent; ' || coalesce(cast(year_manufacture as varchar), '?') || '; ' || coalesce(cast(power as varchar), '-') || ' Kw 2-HIGH' as t,
 view_count || ' tis km' as m, cast(year_manufacture as varchar) as y, power || ' kw' as p, lower(fuel) as f from listings), v as (select id, lower(t) as t, m as v, 'MILEAGE' as label from x union all select id, t, y, 'YEAR' from x
 union all select id, lower(t), p, 'POWER' from x union all select id, lower(t), f, 'FUEL' from x) select id, cast(strpos(t, v) - 1 as int) as start, cast(strpos(t, v) - 1 + length(v) as int) as "end", label from v where strpos(t, v) > 0""",
    "a18_unit_consistency": f"""{LABELLED_SQL} select 'POWER' as label, count(*) filter (where id % 4 < 2) as with_unit, count(*) filter (where id % 4 >= 2) as without_unit, count(*) filter (where id % 4 < 2) = 0 or count(*) filter (where id % 4 >= 2) = 0 as consistent
 from x where w > 0 union all select 'MILEAGE', count(*), 0, true from x where w > 2""",
    "f12_legacy_car_filter": f"{L} select id, id % 9 <> 0 and price >= 5000 and id % 5 in (0, 3) as is_car from listings",
    "f16_all_detectors": f"{L} select id, " + ", ".join(f"v.{k} = 1 as has_{k}" for k in labelling.DETECTORS) + f" from listings join {values([(k, *t[1:]) for k, t in enumerate(TOLD)], 'k, mileage, year, power, fuel')} on id % 8 = k",
    "x24_places_of_values": f"""{L}, x as (select id, year_manufacture as y, power as p, 5 + coalesce(length(cast(year_manufacture as varchar)), 1) as n from listings)
 select id, 5 as start, 9 as end, 'YEAR' as label from x where y is not null union all
 select id, n + 13, n + 13 + length(cast(p as varchar)) + 3, 'POWER' from x where p is not null union all select id, n + 5, n + 11, 'FUEL' from x where id % 3 = 0""",
    "p6_edited_offers": f"""{L}, x as (select id, case when id % 6 = 3 then 777 else price end as price, case when id % 6 = 0 then id % 1000 + 1 when id % 6 = 3 then 10 else mileage end as mileage, power,
 case when id % 6 <> 4 then fuel end as fuel from listings) select *, round(case when mileage > 0 then price / cast(mileage as double) end, 6) as price_per_km from x""",
    "p6_refused_edits": f"{L}, x as (select id % 6 as w from listings) select 'power' as field, 'out of bounds' as fault, count(*) as n from x where w = 1 union all select 'price', null, count(*) from x where w = 1 union all select 'colour', 'field', count(*) from x where w = 2",
    "a17_completeness": f"""{LABELLED_SQL}, c as (select count(*) as total, count(*) filter (where w > 2) as complete, count(*) filter (where w in (1, 2)) as incomplete, count(*) filter (where w = 0) as empty from x)
 select *, complete * 100.0::double / total as quality_score, case when complete * 100.0::double / total >= 80 then 'good' when complete * 100.0::double / total >= 60 then 'fair' else 'poor' end as grade from c""",
    "a18_fuel_synonyms": f"""{LABELLED_SQL}, y as (select f as word from x where w > 0 union all select 'lpg' from x where w = 1)
 select word, count(*) as n, case word when 'benzín' then 'benzín' when 'lpg' then '' else 'diesel' end as fuel from y group by word""",
    "a18_contradictions": f"""{LABELLED_SQL} select id, 'diesel engine, petrol label' as issue from x where w > 0 and tdi and f = 'benzín' union all select id, 'several fuels' from x where w = 1""",
    "a19_label_formats": f"""{LABELLED_SQL}, y as (select 'POWER' as label, unnest(case p when '110kW' then ['no space', 'upper case'] when '85 kw' then ['space', 'lower case'] else ['space'] end) as form from x where w > 0
 union all select 'YEAR', case when w = 1 then 'with words' else 'number' end from x where w = 1 or w > 2 union all select 'MILEAGE', unnest(['space', 't', 'tis']) from x where w > 2) select label, form, count(*) as n from y group by all""",
    "w3_removed_repeats": "select 'events' as name, count(*) - count(distinct (user_id, event_type)) as removed from events union all select 'lineitem', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem",
    "o6_contiguous_slice": f"{L} select id, brand, price from listings order by id limit 50 offset 123",
    "o9_urls_across_brands": f"{L} select brand, id from listings order by brand, id limit 300",
}
