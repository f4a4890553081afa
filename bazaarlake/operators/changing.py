"""Clean-ups of several tables at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removed_repeats(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, removed): how many rows go from each table (rows, keys) when one of each key stays; rows with a null key stay."""
    def one(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        counts = rows.dropna(subset=keys).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n"))
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed")).select(F.lit(name).alias("name"), "removed")

    return reduce(DataFrame.unionByName, (one(name, rows, keys) for name, (rows, keys) in tables.items()))
