"""Summaries of listings. Each is one aggregation over one scan; means are of plausible values only, unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.operators.filters import BUCKETS, clamp, in_range, plausible_price

# Caps for means, first year of the distribution.
MAX_MILEAGE, MAX_PRICE, FIRST_YEAR = 1_000_000, 10_000_000, 1985


def n(alias: str = "n", when: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if when is None else F.count_if(when)).alias(alias)


def means() -> list[Column]:
    price, miles = F.col("price"), F.col("mileage")
    return [
        F.avg(F.when((price > 0) & (price < MAX_PRICE), price)).alias("avg_price"),
        F.avg(F.when((miles > 0) & (miles < MAX_MILEAGE), miles)).alias("avg_mileage"),
        F.avg(F.when((price > 0) & (miles > 0), price / miles)).alias("avg_price_per_km"),
        F.avg("year_manufacture").alias("avg_year"),
    ]


def overview(rows: DataFrame) -> DataFrame:
    """One row about all offers. A model counts once for each brand; rows without either don't count."""
    complete = F.col("price").isNotNull() & F.col("mileage").isNotNull() & F.col("year_manufacture").isNotNull()
    distinct = [F.count_distinct("brand").alias("brands"), F.count_distinct("brand", "model").alias("models")]
    return rows.agg(n("offers"), *distinct, *means(), n("complete", complete), F.max("scraped_at").alias("last_scraped"))


def by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(n("offers"), *means())


def top(grouped: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The groups with the most offers; Spark keeps only limit rows of each partition."""
    return grouped.orderBy(F.desc("offers"), *ties).limit(limit)


def by_year(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("year_manufacture") >= FIRST_YEAR).groupBy("year_manufacture").agg(n())


def by_fuel(rows: DataFrame) -> DataFrame:
    """Offers by fuel and their percentage of all with a fuel."""
    counted = rows.where(F.col("fuel").isNotNull()).groupBy("fuel").agg(n())
    everything = Window.partitionBy(F.lit(1))  # over a row for each fuel
    return counted.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(everything))


def histogram(rows: DataFrame, bucket: int) -> DataFrame:
    """Offers by price bucket; empty buckets are left out."""
    width = clamp(bucket, *BUCKETS)
    start = (F.floor(F.col("price") / width) * width).cast("long").alias("bucket")
    return rows.where(plausible_price()).groupBy(start).agg(n())


def price_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.min("price").alias("min_price"), n())


def price_rank(rows: DataFrame, price: float) -> DataFrame:
    """Percent of offers that are cheaper; offers without a price stay in the whole."""
    return rows.agg(F.avg(F.when(F.col("price") < price, 1.0).otherwise(0.0) * 100).alias("percent_cheaper"), n())


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column how many rows have it, how many lack it, and the percentage: one pass, then turned to rows."""
    counts = rows.agg(n("total"), *(F.count(c).alias(c) for c in columns))
    turned = counts.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns))).alias("x"))
    return turned.select("x.field", "x.filled", (F.col("total") - F.col("x.filled")).alias("missing"), (F.col("x.filled") * 100.0 / F.col("total")).alias("percent"))


def anomalies(rows: DataFrame, as_of_year: int) -> DataFrame:
    return rows.agg(
        n("digits_in_fuel", F.col("fuel").rlike("[0-9]")),
        n("impossible_year", ~in_range("year_manufacture", 1900, as_of_year + 1)),
        n("impossible_mileage", F.col("mileage") > MAX_MILEAGE),
    )


def top_or_other(rows: DataFrame, column: str, keep: int = 10) -> DataFrame:
    """Offers by the most frequent values of a column; all the rest are other."""
    counted = rows.groupBy(column).agg(n())
    best = counted.orderBy(F.desc("n"), column).limit(keep).select(F.col(column).alias("kept"))
    label = F.coalesce("kept", F.lit("other")).alias(column)
    return counted.join(F.broadcast(best), F.col(column) == F.col("kept"), "left").groupBy(label).agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, stop_words: list[str], text_col: str = "text") -> DataFrame:
    """Alphanumeric words, lower-cased, without stop words. Spark adds up within tasks before it shuffles words."""
    words = texts.select(F.explode(F.split(F.lower(text_col), r"(?U)\s+")).alias("word"))
    return words.where(F.col("word").rlike(r"(?U)^[\p{L}\p{N}]+$") & ~F.col("word").isin(stop_words)).groupBy("word").agg(n())
