"""Queries about listings: filters, joins, aggregates, order and pages, and the service's catalogue of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.operators import aggregates as agg
from bazaarlake.operators import filters as flt
from bazaarlake.sources.listings import AS_OF_YEAR, LISTINGS_SQL, dimensions, listings, offers, table

QUERIES, ORACLE_SQL = {}, {}
L = LISTINGS_SQL


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under a name, with its DuckDB SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def over_listings(name: str, sql: str | None, build) -> None:
    query(name, L + sql if sql else None)(lambda spark, sf_dir: build(listings(spark, sf_dir)))


MEANS = """avg(case when price > 0 and price < 10000000 then price end) as avg_price,
 avg(case when mileage > 0 and mileage < 1000000 then mileage end) as avg_mileage,
 avg(case when price > 0 and mileage > 0 then cast(price as double) / mileage end) as avg_price_per_km, avg(year_manufacture) as avg_year"""
WHOLE = "id, brand, model, fuel, year_manufacture, mileage, power, price, review_status"
COLS = [c.strip() for c in WHOLE.split(",")]


def cols(df):
    return df.select(*COLS)


over_listings("s1_table_scan", f" select {WHOLE}, listing_date, view_count from listings", lambda d: d.select(*COLS, "listing_date", "view_count"))
over_listings("s2_projected_scan", " select id, price, year_manufacture from listings", lambda d: d.select("id", "price", "year_manufacture"))
over_listings("f1_equality", f" select {WHOLE} from listings where brand = 'EUROPE' and fuel = '2-HIGH'", lambda d: cols(d.where(flt.matches("brand", "EUROPE") & flt.matches("fuel", "2-HIGH"))))
over_listings("f1_collated_equality", f" select {WHOLE} from listings where lower(brand) = 'europe'", lambda d: cols(d.where(flt.matches("brand", "eurOPE", "UNICODE_CI_AI"))))
over_listings("f2_null_parameter", f" select {WHOLE} from listings where fuel is null", lambda d: cols(d.where(flt.matches("fuel", "null"))))
over_listings("f3_ranges", f" select {WHOLE} from listings where price >= 100000 and price <= 200000 and year_manufacture >= 1997", lambda d: cols(d.where(flt.in_range("price", 100_000, 200_000) & flt.in_range("year_manufacture", 1997))))
over_listings("f4_near", f" select {WHOLE} from listings where year_manufacture between 1996 and 2000 and mileage between 399999 and 600001", lambda d: cols(d.where(flt.near(1998, 2, 500_001, 20) & F.col("mileage").between(399_999, 600_001))))
over_listings("f5_all_missing", f" select {WHOLE} from listings where fuel is null and power is null", lambda d: cols(d.where(flt.all_missing(["fuel", "power"]))))
over_listings("f6_complete", f" select {WHOLE} from listings where price is not null and mileage is not null and year_manufacture is not null", lambda d: cols(d.dropna(subset=["price", "mileage", "year_manufacture"])))
over_listings("f7_sanity_bounds", " select id, price from listings where price > 10000 and price < 5000000", lambda d: d.where(flt.plausible_price()).select("id", "price"))
over_listings("f8_regex", " select id, fuel from listings where regexp_matches(fuel, '[0-3]')", lambda d: d.where(F.col("fuel").rlike("[0-3]")).select("id", "fuel"))
over_listings("f9_in_list", " select id, review_status from listings where review_status in ('F', 'O')", lambda d: d.where(F.col("review_status").isin("F", "O")).select("id", "review_status"))
over_listings("f10_point_lookup", f" select {WHOLE} from listings where id = 7", lambda d: cols(d.where(F.col("id") == 7)))
over_listings(
    "f13_validators",
    """ select id, case when year_manufacture between 1900 and 2000 then year_manufacture end as year_manufacture, case when mileage between 1 and 1500000 then mileage end as mileage,
 case when power between 1 and 1500 then power end as power, case when price between 1 and 50000000 then price end as price from listings""",
    lambda d: d.select("id", *(flt.validated(c, 2000).alias(c) for c in ("year_manufacture", "mileage", "power", "price"))),
)
over_listings(
    "f14_edit_validator",
    " select id, coalesce(power between 0 and 200, true) as power_ok, fuel is null or fuel in ('1-URGENT', '2-HIGH') as fuel_ok from listings",
    lambda d: d.select("id", F.coalesce(F.col("power").between(0, 200), F.lit(True)).alias("power_ok"), (F.col("fuel").isNull() | F.coalesce(F.col("fuel").isin("1-URGENT", "2-HIGH"), F.lit(False))).alias("fuel_ok")),
)
over_listings(
    "f15_richness_histogram",
    " select fields, count(*) as n from (select (year_manufacture is not null)::int + (mileage is not null)::int + (power is not null)::int + (fuel is not null)::int as fields from listings) group by fields",
    lambda d: d.select(flt.richness([F.col(c).isNotNull() for c in ("year_manufacture", "mileage", "power", "fuel")]).alias("fields")).groupBy("fields").agg(agg.n()),
)
over_listings("j1_flat_join", " select brand, model, count(*) as n, sum(price) as total from listings group by brand, model", lambda d: d.groupBy("brand", "model").agg(agg.n(), F.sum("price").alias("total")))


@query("j3_models_of_brands", "select n_nationkey as id, n_name as model, r_name as brand from nation join region on n_regionkey = r_regionkey order by id limit 10")
def models_of_brands(spark, sf_dir):
    brands, models = dimensions(spark, sf_dir)
    joined = models.join(brands.withColumnRenamed("id", "brand_id").withColumnRenamed("name", "brand"), "brand_id")
    return joined.select("id", F.col("name").alias("model"), "brand").orderBy("id").limit(10)


over_listings("j2_a11_offers_by_brand", " select brand, count(*) as offers, max(scraped_at) as last_scraped from listings group by brand", lambda d: d.groupBy("brand").agg(agg.n("offers"), F.max("scraped_at").alias("last_scraped")))
over_listings(
    "a1_a2_q3_overview",
    f""" select count(*) as offers, count(distinct brand) as brands, count(distinct (brand, model)) as models, {MEANS},
 count(*) filter (where price is not null and mileage is not null and year_manufacture is not null) as complete, max(scraped_at) as last_scraped from listings""",
    agg.overview,
)
over_listings("a3_q4_brand_stats", f" select brand, count(*) as offers, {MEANS} from listings group by brand order by offers desc, brand limit 3", lambda d: agg.top(agg.by(d, "brand"), 3, "brand"))
over_listings("a4_q5_model_stats", f" select model, count(*) as offers, {MEANS} from listings where brand = 'ASIA' group by model order by offers desc, model limit 20", lambda d: agg.top(agg.by(d.where(flt.matches("brand", "ASIA")), "model"), 20, "model"))
over_listings("a5_q6_year_distribution", " select year_manufacture, count(*) as n from listings where year_manufacture >= 1985 group by year_manufacture", agg.by_year)
over_listings("a6_q7_fuel_distribution", " select fuel, count(*) as n, count(*) * 100.0::double / sum(count(*)) over () as percent from listings where fuel is not null group by fuel", agg.by_fuel)
over_listings("a7_q8_price_histogram", " select cast(floor(price / 50000) * 50000 as bigint) as bucket, count(*) as n from listings where price > 10000 and price < 5000000 group by 1", lambda d: agg.histogram(d, 50_000))
over_listings("a8_q18_price_stats", " select avg(price) as avg_price, max(price) as max_price, min(price) as min_price, count(*) as n from listings where brand = 'EUROPE' and year_manufacture >= 1996", lambda d: agg.price_stats(d.where(flt.matches("brand", "EUROPE") & flt.in_range("year_manufacture", 1996))))
over_listings("a9_q19_price_rank", " select avg(case when price < 250000 then 1.0 else 0.0 end * 100) as percent_cheaper, count(*) as n from listings where brand = 'AFRICA'", lambda d: agg.price_rank(d.where(flt.matches("brand", "AFRICA")), 250_000))
over_listings(
    "a10_q13_completeness",
    "".join(
        f" {'union all ' if k else ''}select '{c}' as field, count({c}) as filled, count(*) - count({c}) as missing, count({c}) * 100.0::double / count(*) as percent from listings"
        for k, c in enumerate(flt.MISSABLE)
    ),
    lambda d: agg.completeness(d, list(flt.MISSABLE)),
)
over_listings(
    "a10_anomalies",
    f" select count(*) filter (where regexp_matches(fuel, '[0-9]')) as digits_in_fuel, count(*) filter (where year_manufacture < 1900 or year_manufacture > {AS_OF_YEAR + 1}) as impossible_year, count(*) filter (where mileage > 1000000) as impossible_mileage from listings",
    lambda d: agg.anomalies(d, AS_OF_YEAR),
)
over_listings("a24_top_models_or_other", " select coalesce(b.model, 'other') as model, cast(sum(a.n) as bigint) as n from (select model, count(*) as n from listings group by model) a left join (select model from (select model, count(*) as n from listings group by model) order by n desc, model limit 10) b on a.model = b.model group by 1", lambda d: agg.top_or_other(d, "model"))


@query("a14_x25_word_frequency", "select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\\s+')) as word from documents) where regexp_full_match(word, '[\\p{L}\\p{N}]+') and word not in ('the', 'of', 'and', 'de', 'la', 'der') group by word")
def word_frequency(spark, sf_dir):
    return agg.word_counts(table(spark, sf_dir, "documents"), ["the", "of", "and", "de", "la", "der"])


@query("a26_row_counts", "".join(f"{' union all ' if k else ''}select '{t}' as name, count(*) as n from {t}" for k, t in enumerate(("region", "nation", "customer", "orders"))))
def row_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(agg.n()).select(F.lit(t).alias("name"), "n") for t in ("region", "nation", "customer", "orders")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


over_listings("o1_q11_whitelisted_order", f" select {WHOLE} from listings where fuel is null order by price desc nulls last, id limit 100", lambda d: cols(d.where("fuel is null").orderBy(F.desc_nulls_last("price"), "id").limit(flt.clamp(500, 1, flt.PAGE_SIZES["admin"]))))
over_listings("o2_q1_brands", " select distinct brand from listings", lambda d: d.select("brand").distinct().orderBy("brand"))
over_listings("o2_q2_models", " select distinct model from listings where brand = 'EUROPE'", lambda d: d.where(flt.matches("brand", "EUROPE")).select("model").distinct().orderBy("model"))
over_listings("o3_top_k", " select model, count(*) as offers from listings group by model order by offers desc, model limit 5", lambda d: agg.top(d.groupBy("model").agg(agg.n("offers")), 5, "model"))
over_listings("o4_q17_page", f" select {WHOLE} from listings order by id limit 50 offset 100", lambda d: cols(d.orderBy("id").offset(100).limit(50)))
over_listings("o5_q9_scatter_sample", None, lambda d: d.where(flt.plausible_price()).orderBy(F.rand(42)).limit(500).select("id", "price", "mileage", "brand"))
over_listings("o7_recent", " select id, scraped_at from listings order by scraped_at desc, id limit 20", lambda d: d.select("id", "scraped_at").orderBy(F.desc("scraped_at"), "id").limit(20))


@query("o8_shuffled_split")
def shuffled_split(spark, sf_dir):
    """Training examples, four fifths, and the rest for tests; the seed fixes who goes where."""
    train, test = table(spark, sf_dir, "documents").select("doc_id").randomSplit([0.8, 0.2], seed=42)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query("u4_distinct_fuels", "select distinct nullif(o_orderpriority, '4-NOT SPECIFIED') as fuel from orders")
def distinct_fuels(spark, sf_dir):
    return offers(spark, sf_dir).select("fuel").distinct()
