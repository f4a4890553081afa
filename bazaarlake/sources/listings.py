"""The listing relation: brands, models and offers joined flat, and free texts that describe the offers.

The test tables hold no car listings, so a bridge derives the columns from orders, customers, nations and regions: a brand
is a region, a model one of its nations, an offer an order. Catalyst reads only the columns that a query asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The year that counts as the present one, for results that can be repeated.
AS_OF_YEAR = 2002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(brands: DataFrame, models: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers with their model's and brand's name: two inner joins on foreign keys. Spark broadcasts the dimensions by size."""
    named = models.select(F.col("id").alias("model_id"), F.col("name").alias("model"), "brand_id")
    owned = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    return offers.join(named, "model_id").join(owned, "brand_id").drop("brand_id")


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands (id, name) and models (id, brand_id, name)."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    brands = region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    models = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("brand_id"), F.col("n_name").alias("name"))
    return brands, models


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with model_id. An order's customer gives the model; columns that may be null are so by a rule of the key."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")

    def unless(divisor: int, value: Column) -> Column:
        return F.when(key % divisor != 0, value)

    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"),
        F.col("c_nationkey").alias("model_id"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("fuel"),
        unless(11, F.year("o_orderdate")).alias("year_manufacture"),
        F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") * 100)).cast("long").alias("mileage"),
        unless(7, 30 + key % 300).cast("int").alias("power"),
        F.floor("o_totalprice").cast("int").alias("price"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("review_status"),
        F.col("o_orderdate").cast("date").alias("listing_date"),
        F.col("o_orderdate").alias("scraped_at"),
        (F.col("o_custkey") % 1000).alias("view_count"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat relation that most queries read."""
    brands, models = dimensions(spark, sf_dir)
    return flat(brands, models, offers(spark, sf_dir))


#: The same relation in DuckDB SQL, to stand before a query.
LISTINGS_SQL = """
with listings as (
  select o_orderkey as id, r_name as brand, n_name as model, nullif(o_orderpriority, '4-NOT SPECIFIED') as fuel,
    case when o_orderkey % 11 <> 0 then cast(year(o_orderdate) as int) end as year_manufacture,
    case when c_acctbal > 0 then cast(floor(c_acctbal * 100) as bigint) end as mileage,
    case when o_orderkey % 7 <> 0 then cast(30 + o_orderkey % 300 as int) end as power,
    cast(floor(o_totalprice) as int) as price, nullif(o_orderstatus, 'P') as review_status,
    cast(o_orderdate as date) as listing_date, o_orderdate as scraped_at, o_custkey % 1000 as view_count
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def spread(rows: DataFrame, source: DataFrame) -> DataFrame:
    """rows, dealt to all cores if the table that they come from has fewer splits than there are cores; large ones stay as they are.

    For work on texts that takes far longer than moving them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if source.rdd.getNumPartitions() < cores else rows


def described(rows: DataFrame) -> DataFrame:
    """listings with text: a description in which each column that is present is written in one of several ways."""
    way = F.col("id") % 3
    miles = (
        F.when(way == 0, F.concat(F.lit("najeto "), F.col("mileage").cast("string"), F.lit(" km")))
        .when(way == 1, F.concat(F.lit("najeto "), F.floor(F.col("mileage") / 1000).cast("string"), F.lit(" tis km")))
        .otherwise(F.concat(F.floor(F.col("mileage") / 1000).cast("string"), F.lit("tkm")))
    )
    year = F.concat(F.when(way == 1, "rok výroby ").otherwise("r.v. "), F.col("year_manufacture").cast("string"))
    power = F.concat(F.lit("výkon "), F.col("power").cast("string"), F.lit(" kW"))
    fuel = F.element_at(F.create_map(*(F.lit(x) for pair in FUEL_WORDS.items() for x in pair)), F.col("fuel"))
    inspected = F.when(F.col("id") % 5 == 0, F.lit("STK do 2004"))
    parts = [F.col("model"), year, F.when(F.col("mileage") >= 10_000, miles), power, fuel, inspected]
    return rows.withColumn("text", F.concat_ws("; ", *parts))


FUEL_WORDS = {"1-URGENT": "diesel", "2-HIGH": "benzín", "3-MEDIUM": "lpg", "5-LOW": "hybrid"}
