"""Queries for deals: medians of like offers, scores, suspicion."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlake.operators import deals
from bazaarlake.sources.listings import LISTINGS_SQL, listings

BANDED = """, plausible as (select * from listings where price > 10000 and price < 5000000),
sized as (select *, count(*) over (partition by brand, model, fuel) as segment_size, quantile_cont(price, 0.5) over (partition by brand, model, fuel) as segment_median from plausible),
framed as (select *,
  count(*) over (partition by brand, model, fuel order by year_manufacture range between 3 preceding and 3 following) as n3,
  quantile_cont(price, 0.5) over (partition by brand, model, fuel order by year_manufacture range between 3 preceding and 3 following) as m3,
  count(*) over (partition by brand, model, fuel order by year_manufacture range between 5 preceding and 5 following) as n5,
  quantile_cont(price, 0.5) over (partition by brand, model, fuel order by year_manufacture range between 5 preceding and 5 following) as m5
  from sized where segment_size >= 5),
banded as (select *,
  case when year_manufacture is not null and n3 >= 5 then m3 when year_manufacture is not null and n5 >= 5 then m5 else segment_median end as median,
  case when year_manufacture is not null and n3 >= 5 then n3 when year_manufacture is not null and n5 >= 5 then n5 else segment_size end as peers,
  case when year_manufacture is not null and n3 >= 5 then 'high' when year_manufacture is not null and n5 >= 5 then 'medium' else 'low' end as confidence
  from framed)"""


def found(min_score: int) -> str:
    return f"""{LISTINGS_SQL}{BANDED}, scored as (select *, (median - price) / median * 100 as score from banded
  where segment_median <> 0 and price < segment_median * (1 - {min_score} / 100.0::double) and price > greatest(10000.0::double, median * 0.1::double)),
found as (select * from scored where score >= {min_score})"""


OUT = "id, brand, model, fuel, year_manufacture, price, median, peers, confidence, score"
COLS = [c.strip() for c in OUT.split(",")]
REASONS = " || ".join(f"case when {rule} then '{name};' else '' end" for name, rule in deals.SUSPICIONS.items())


def quartile_sql(i: int) -> str:
    j = f"greatest(least({i} * (n + 1) // 4, n - 1), 1)"
    return f"(x[{j}] * (4 - ({i} * (n + 1) - 4 * {j})) + x[{j} + 1] * ({i} * (n + 1) - 4 * {j})) / 4.0::double"


def quartiles_query(spark, sf_dir):
    return deals.quartiles_of(listings(spark, sf_dir), deals.SEGMENT, "price")


STATS = f"""select *, {quartile_sql(2)} as median, {quartile_sql(1)} as q1, {quartile_sql(3)} as q3 from (select brand, model, fuel, list(price order by price) as x, count(*) as n from listings group by brand, model, fuel)
 where n >= 4 union all select *, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2.0::double, x[1], x[n] from (select brand, model, fuel, list(price order by price) as x, count(*) as n from listings group by brand, model, fuel) where n < 4"""


def score_single(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return deals.score_offers(rows, rows.where("id % 20 = 0")).select("id", "score", "median", "count")


def score_all(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return deals.score_offers(rows, rows).select("id", "score", "median", "count")


QUERIES = {
    "d3_find_deals": lambda s, d: deals.find_deals(listings(s, d)).select(*COLS),
    "d3_filtered_deals": lambda s, d: deals.find_deals(listings(s, d), brand="ASIA", min_score=30).select(*COLS),
    "d1_d2_j9_year_bands": lambda s, d: deals.banded(listings(s, d)).select("id", "median", "peers", "confidence", deals.score(F.col("price"), F.col("median")).alias("score")),
    "d4_q10_suspicious": lambda s, d: deals.suspicious(listings(s, d)).select("id", F.array_join("reasons", ";").alias("reasons"), F.size("reasons").alias("n"), "score"),
    "d5_j13_score_offers": score_single,
    "d5_j13_score_all_offers": score_all,
    "d6_confidence": lambda s, d: deals.find_deals(listings(s, d), min_confidence="medium").select("id", "confidence", "score"),
    "j5_without_reviewed": lambda s, d: deals.find_deals(listings(s, d)).join(listings(s, d).where("review_status is not null").select("id"), "id", "left_anti").select("id", "score"),
    "q16_deals_page": lambda s, d: deals.page(deals.find_deals(listings(s, d)), 20, 20).select(*COLS),
    "a12_quartiles": quartiles_query,
    "a13_segments": lambda s, d: listings(s, d).groupBy(*deals.SEGMENT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= deals.MIN_PEERS),
}
ORACLE_SQL = {
    "d3_find_deals": f"{found(15)} select {OUT} from found",
    "d3_filtered_deals": f"{found(30).replace('price < 5000000)', 'price < 5000000 and brand = ' + chr(39) + 'ASIA' + chr(39) + ')', 1)} select {OUT} from found",
    "d1_d2_j9_year_bands": f"{LISTINGS_SQL}{BANDED} select id, median, peers, confidence, case when median <> 0 then (median - price) / median * 100 end as score from banded",
    "d4_q10_suspicious": f"""{found(25)}, told as (select id, score, review_status, {REASONS} as r from found)
 select id, r[:-2] as reasons, cast(length(r) - length(replace(r, ';', '')) as int) as n, score from told where r <> '' and review_status is null""",
    "d5_j13_score_offers": f"""{LISTINGS_SQL}, p as (select * from listings where price > 10000 and price < 5000000),
 a as (select brand, model, fuel, quantile_cont(price, 0.5) as m, count(*) as n from p group by all having count(*) >= 5),
 b as (select brand, model, quantile_cont(price, 0.5) as m, count(*) as n from p group by all having count(*) >= 5)
 select id, (coalesce(a.m, b.m) - price) / coalesce(a.m, b.m) * 100 as score, coalesce(a.m, b.m) as median, coalesce(a.n, b.n) as count from listings t
 left join a on t.brand = a.brand and t.model = a.model and t.fuel is not distinct from a.fuel left join b on t.brand = b.brand and t.model = b.model
 where t.id % 20 = 0 and coalesce(a.m, b.m) is not null""",
    "d6_confidence": f"{found(15)} select id, confidence, score from found where confidence in ('high', 'medium')",
    "j5_without_reviewed": f"{found(15)} select id, score from found where review_status is null",
    "q16_deals_page": f"{found(15)} select {OUT} from found order by score desc, id limit 20 offset 20",
    "a12_quartiles": f"{LISTINGS_SQL} select brand, model, fuel, q1, median, q3, q3 - q1 as iqr, n as count from ({STATS})",
    "a13_segments": f"{LISTINGS_SQL} select brand, model, fuel, count(*) as n from listings group by all having count(*) >= 5",
}
ORACLE_SQL["d5_j13_score_all_offers"] = ORACLE_SQL["d5_j13_score_offers"].replace("t.id % 20 = 0 and ", "")
