"""Queries that read listings' texts: extraction, normalisation, and the reconciliation of two opinions.

The texts are made from columns, so the SQL can say what must be found from the columns, without any pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.functions import normalise as nrm
from bazaarlake.functions import reconcile as rec
from bazaarlake.functions import spans
from bazaarlake.operators.filters import reject_reason
from bazaarlake.sources.listings import AS_OF_YEAR, FUEL_WORDS, LISTINGS_SQL, described, listings, spread, table

FUEL_SQL = "case fuel " + " ".join(f"when '{k}' then '{v}'" for k, v in FUEL_WORDS.items()) + " end"
#: A year that a six-digit mileage begins with is taken for part of a longer number.
YEAR_SQL = "case when not coalesce(id % 3 = 0 and mileage >= 100000 and left(cast(mileage as varchar), 4) = cast(year_manufacture as varchar), false) then year_manufacture end"
MILEAGE_SQL = "case when mileage < 10000 then null when id % 3 = 0 then mileage else mileage // 1000 * 1000 end"


def texts(spark, sf_dir):
    return spread(described(listings(spark, sf_dir)), table(spark, sf_dir, "orders"))


def extracted(spark, sf_dir):
    # The word is a column of its own, as what tells its fuel asks for it many times.
    found = texts(spark, sf_dir).select("id", spans.find_first("text").alias("m"), nrm.fuel_word(F.col("text")).alias("word"))
    return found.select(
        "id",
        "m.year",
        nrm.mileage(F.col("m.mileage")).alias("mileage"),
        nrm.power(F.col("m.power")).alias("power"),
        nrm.fuel(F.col("word")).alias("fuel"),
    )


def span_places(spark, sf_dir):
    found = texts(spark, sf_dir).select("id", "text", F.explode(spans.find_power("text")).alias("m"))
    return found.select("id", F.col("m.value").alias("power"), F.expr("substring(text, m.start + 1, m.end - m.start)").alias("written"), "m.confidence")


def opinions(spark, sf_dir):
    """What patterns read and what a model might: the same, nothing, another number, or the same number in another unit."""
    way, p = F.col("id") % 4, F.col("power")
    pattern = F.concat(p.cast("string"), F.lit(" kW"))
    model = F.when(way == 0, F.concat(p.cast("string"), F.lit("kw"))).when(way == 2, F.concat((p + 1).cast("string"), F.lit(" kW")))
    model = model.when(way == 3, F.concat(p.cast("string"), F.lit(" PS")))
    return listings(spark, sf_dir).select("id", model.alias("model"), pattern.alias("pattern"))


def power_resolution(spark, sf_dir):
    r = rec.resolved_power(F.col("model"), F.col("pattern"))
    return opinions(spark, sf_dir).select("id", r.alias("r")).select("id", "r.*")


def field_comparison(spark, sf_dir):
    rows = listings(spark, sf_dir)
    pattern = {"mileage": F.col("mileage").cast("string"), "year": F.col("year_manufacture").cast("string"), "power": F.col("power").cast("string"), "fuel": F.col("fuel")}
    model = {k: F.when(F.col("id") % 3 != i, v) for i, (k, v) in enumerate(pattern.items())} | {"fuel": F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("fuel"))}
    c = rec.compared(model, pattern)
    out = rows.select("id", c.alias("c"), rec.decided(model["fuel"], pattern["fuel"]).alias("fuel"))
    parts = [F.array_join(F.col(f"c.{k}"), ",").alias(k) for k in ("agreements", "disagreements", "ml_only", "regex_only", "both_empty")]
    return out.select("id", *parts, "c.agreement_level", rec.route(F.col("c.agreement_level")).alias("route"), "fuel")


def comparison_sql() -> str:
    value = {"mileage": "mileage", "year": "year_manufacture", "power": "power"}
    kinds = [f"case when {v} is null then 'both_empty' when id % 3 <> {k} then 'agreements' else 'regex_only' end as {f}" for k, (f, v) in enumerate(value.items())]
    kinds.append("case when id % 5 = 0 and fuel is null then 'ml_only' when id % 5 = 0 then 'disagreements' when fuel is null then 'both_empty' else 'agreements' end as fuel")
    n = " + ".join(f"(k.{f} = 'agreements')::int" for f in rec.FIELDS)

    def listed(kind: str) -> str:
        return "concat_ws(',', " + ", ".join(f"case when k.{f} = '{kind}' then '{f}' end" for f in rec.FIELDS) + f") as {kind}"

    lists = ", ".join(listed(k) for k in ("agreements", "disagreements", "ml_only", "regex_only", "both_empty"))
    level = f"case when {n} = 4 then 'full' when {n} >= 2 then 'partial' else 'none' end"
    return f"""{LISTINGS_SQL}, k as (select id, {', '.join(kinds)} from listings) select k.id, {lists}, {level} as agreement_level,
 case {level} when 'full' then 'training' when 'none' then 'review' else 'counted' end as route, case when k.id % 5 = 0 then coalesce(l.fuel, 'x') else l.fuel end as fuel
 from k join listings l on k.id = l.id"""


def sureness(spark, sf_dir):
    tier = F.element_at(F.array(*(F.lit(x) for x in ("high", "medium", "low"))), (F.col("id") % 3 + 1).cast("int"))
    rows = listings(spark, sf_dir).select("id", F.col("year_manufacture").cast("string").alias("y"), tier.alias("tier"), (F.col("id") % 2 == 0).alias("said"))
    return rows.select("id", rec.sureness(F.col("tier"), F.col("said")).alias("confidence"), F.coalesce(rec.verified_year(F.col("y"), F.col("tier"), F.col("said")), F.lit(False)).alias("verified"))


def classifier(spark, sf_dir):
    """Headings made from rows: some wanted notices, some parts, some for installments."""
    way = F.col("id") % 6
    heading = F.when(way == 0, "Koupím auto").when(way == 1, "Sada kol R16").when(way == 2, "").otherwise(F.concat(F.col("model"), F.lit(" 2.0 TDI")))
    rows = listings(spark, sf_dir).select("id", heading.alias("heading"), F.when(way == 3, "prodám na splátky").alias("description"), "price")
    return rows.select("id", reject_reason().alias("reason"))


def page_fields(spark, sf_dir):
    rows = listings(spark, sf_dir)
    text = F.concat(F.lit("vloženo ["), F.date_format("listing_date", "d.M. y"), F.lit("] videlo "), F.col("view_count").cast("string"), F.lit(" lidí"))
    cell = F.concat(F.format_number("price", 0), F.lit(" Kč"))
    url = F.concat(F.lit("https://auto.example.org/inzerat/"), F.col("id").cast("string"), F.lit("/nabidka.php"))
    made = rows.select("id", text.alias("t"), cell.alias("c"), url.alias("u"))
    return made.select("id", nrm.listing_date(F.col("t")).alias("listing_date"), nrm.view_count(F.col("t")).alias("view_count"), nrm.price(F.col("c")).alias("price"), nrm.unique_id(F.col("u")).alias("unique_id"))


def derived(spark, sf_dir):
    return listings(spark, sf_dir).select("id", *(c.alias(k) for k, c in nrm.derived(AS_OF_YEAR).items()))


def misplaced(spark, sf_dir):
    rows = listings(spark, sf_dir)
    wrong = F.when(F.col("id") % 4 == 0, F.concat((F.col("id") % 300).cast("string"), F.lit("tkm"))).when(F.col("id") % 4 == 1, F.lit("diesel 2.0 turbo")).otherwise(F.col("fuel"))
    rows = rows.select("id", "mileage", wrong.alias("fuel"))
    found = F.nullif(nrm.misplaced_mileage(F.col("fuel")), F.lit(0).cast("long"))
    return rows.withColumn("found", found).select(
        "id", F.coalesce("mileage", "found").alias("mileage"), F.when(F.col("found").isNull(), nrm.rewritten_fuel(F.col("fuel"))).alias("fuel")
    )


L = LISTINGS_SQL
QUERIES = {
    "x1_x11_r11_extraction": extracted,
    "x5_power_spans": span_places,
    "x12_x15_page_fields": page_fields,
    "x17_x18_p8_bulk_repairs": misplaced,
    "x19_derived": derived,
    "x22_descriptions": lambda s, d: listings(s, d).select("id", nrm.description(("year", F.col("year_manufacture")), ("power", F.col("power"))).alias("text")),
    "x16_x23_context": lambda s, d: texts(s, d).select("id", nrm.context(nrm.clean(F.col("text")), F.lit("km"), 3).alias("around")),
    "f11_f12_car_classifier": classifier,
    "f16_detectors": lambda s, d: texts(s, d).select("id", F.col("text").rlike(r"(?iU)\b\d+\s*kw\b").alias("has_power"), nrm.fuel_word(F.col("text")).isNotNull().alias("has_fuel")),
    "a20_hit_rates": lambda s, d: extracted(s, d).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in ("year", "mileage", "power", "fuel"))),
    "r2_r5_power_resolution": power_resolution,
    "r6_r7_verification": sureness,
    "r8_r10_comparison": field_comparison,
    "a15_agreement_statistics": lambda s, d: field_comparison(s, d).groupBy("agreement_level", "route").agg(F.count(F.lit(1)).alias("n")),
}
ORACLE_SQL = {
    "x1_x11_r11_extraction": f"{L} select id, {YEAR_SQL} as year, {MILEAGE_SQL} as mileage, power, {FUEL_SQL} as fuel from listings",
    "x5_power_spans": f"{L} select id, power, power || ' kW' as written, 'high' as confidence from listings where power is not null",
    "x12_x15_page_fields": f"{L} select id, listing_date, cast(view_count as int) as view_count, cast(price as bigint) as price, cast(id as varchar) as unique_id from listings",
    "x17_x18_p8_bulk_repairs": f"{L} select id, coalesce(mileage, case when id % 4 = 0 then nullif(id % 300 * 1000, 0) end) as mileage, case when id % 4 = 0 then case when id % 300 = 0 then '0tkm' end when id % 4 = 1 then 'diesel' else fuel end as fuel from listings",
    "x19_derived": f"{L} select id, {AS_OF_YEAR} - year_manufacture as years_in_usage, case when mileage > 0 then price / cast(mileage as double) end as price_per_km, case when {AS_OF_YEAR} > year_manufacture then mileage / cast({AS_OF_YEAR} - year_manufacture as double) end as mileage_per_year from listings",
    "x22_descriptions": f"{L} select id, concat_ws(', ', 'year ' || year_manufacture, 'power ' || power) as text from listings",
    "f11_f12_car_classifier": f"{L} select id, case when price < 5000 then 'price' when id % 6 = 2 then 'no heading' when id % 6 = 0 then 'not selling' when id % 6 = 1 then 'parts phrase' when id % 6 = 3 then 'installments' end as reason from listings",
    "f16_detectors": f"{L} select id, power is not null as has_power, fuel is not null as has_fuel from listings",
    "a20_hit_rates": f"{L} select avg(({YEAR_SQL} is not null)::int) as year, avg(coalesce(mileage >= 10000, false)::int) as mileage, avg((power is not null)::int) as power, avg((fuel is not null)::int) as fuel from listings",
    "r2_r5_power_resolution": f"""{L}, o as (select id, case when power is null then null when id % 4 = 1 then null else 1 end as m, power from listings)
 select id, case when power is null then 'NONE' when id % 4 = 0 then 'NONE' when id % 4 = 2 then 'MAJOR' else 'MINOR_FORMATTING' end as disagreement,
 case when power is null then null when id % 4 = 0 then power || 'kw' else power || ' kW' end as value,
 case when power is null or id % 4 in (0, 3) then 'AUTO_NORMALIZED' else 'REGEX_PREFERRED' end as method,
 case when power is null then 0.0 when id % 4 = 0 then 0.95 when id % 4 = 1 then 0.80 when id % 4 = 2 then 0.70 else 0.90 end::double as confidence from o""",
    "r6_r7_verification": f"""{L}, s as (select id, year_manufacture as y, case when id % 3 = 0 then case when id % 2 = 0 then 0.95 else 0.80 end when id % 3 = 1 then case when id % 2 = 0 then 0.85 else 0.55 end
 else case when id % 2 = 0 then 0.70 else 0.30 end end::double as confidence from listings) select id, confidence, y is not null and confidence >= 0.65 as verified from s""",
    "r8_r10_comparison": comparison_sql(),
    "a15_agreement_statistics": f"select agreement_level, route, count(*) as n from ({comparison_sql()}) group by all",
}
