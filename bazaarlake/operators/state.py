"""Tables that change: dedup, upsert, lookup-or-insert, resume. Each takes the old state and gives the new one, as DataFrames.

Plain Parquet has no MERGE, so a change is a set operation on keys and the new version is written whole, or by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key are no repeats of each other and all stay."""
    some = rows.dropna(subset=keys)
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    missing = " or ".join(f"`{k}` is null" for k in keys)
    return first.unionByName(rows.where(missing))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with new rows merged by key, the last version winning; columns keep_old stay as the old row has them.

    Merging the same rows again changes nothing. New rows without a key are all added.
    """
    latest = keep_one(new, [key], [F.desc(version)])
    if not keep_old:
        return old.join(latest.where(F.col(key).isNotNull()), key, "left_anti").unionByName(latest)
    kept = old.select(F.col(key).alias("_key"), F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in keep_old))
    joined = latest.join(kept, F.col(key) == F.col("_key"), "left")
    changed = joined.select(*(F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep_old else c for c in latest.columns))
    return old.join(latest.where(F.col(key).isNotNull()), key, "left_anti").unionByName(changed)


def lookup_or_insert(dimension: DataFrame, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """dimension with a row for each new name, told apart without regard to case and outer spaces. Ids go on from the largest.

    New names are numbered in order: within those of one beginning each, after the numbers of the beginnings before.
    """
    plain = F.lower(F.trim(name_col))
    known = dimension.select(plain.alias("_name"))
    fresh = names.select(F.trim(name_col).alias(name_col)).withColumn("_name", plain).dropna()
    fresh = fresh.groupBy("_name").agg(F.min(name_col).alias(name_col)).join(known, "_name", "left_anti")
    fresh = fresh.withColumn("_start", F.substring("_name", 1, 3))
    before = Window.partitionBy(F.lit(1)).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("_start").agg(F.count(F.lit(1)).alias("_n")).select("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    largest = dimension.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_max"))  # one row
    numbered = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_start").orderBy("_name"))).join(starts, "_start").crossJoin(F.broadcast(largest))
    number = F.col("_max") + F.col("_before") + F.col("_n")
    return dimension.select(id_col, name_col).unionByName(numbered.select(number.cast(dimension.schema[id_col].dataType).alias(id_col), name_col))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done; a null key never is."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def to_do(urls: DataFrame, log: DataFrame, key: str = "url") -> DataFrame:
    """Urls to fetch: neither saved nor filtered so far; failed ones are tried again. key: what rows of the log are known by."""
    return remaining(urls, log.where(F.col("status").isin("saved", "filtered")), key)


def merge_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, repeats and all, and the first of each new key."""
    return old.unionByName(remaining(new, old, key).dropDuplicates([key]), allowMissingColumns=True)


def delete_cascade(brands: DataFrame, models: DataFrame, offers: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without the brands that are gone, their models and the models' offers."""
    lost = brands.where(gone).select(F.col("id").alias("brand_id"))
    lost_models = models.join(lost, "brand_id", "left_semi").select(F.col("id").alias("model_id"))
    return brands.where(~gone), models.join(lost, "brand_id", "left_anti"), offers.join(lost_models, "model_id", "left_anti")


def replace_values(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The column's values by mapping (old, new); others stay."""
    return rows.join(mapping, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")
