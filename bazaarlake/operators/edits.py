"""Edits of single fields: checked against a whitelist and bounds, written, and what is derived from them worked out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.normalise import derived
from bazaarlake.operators.filters import VALID

#: Fields that may be edited, with their types; fuel is free text.
EDITABLE = {"year_manufacture": "int", "mileage": "bigint", "power": "int", "price": "int", "fuel": "string"}


def fault(as_of_year: int, field: str = "field", value: str = "value") -> Column:
    """Why an edit (field, value as text) is not possible; null if it is. A null value empties a field."""
    number = F.expr(f"try_cast({value} as bigint)")
    found = F.when(~F.col(field).isin(*EDITABLE), "field").when(F.col(field).isNull(), "field").when(F.col(value).isNull() | (F.col(field) == "fuel"), None).when(number.isNull(), "no number")
    for name, (low, high) in VALID.items():
        found = found.when((F.col(field) == name) & ~number.between(low, as_of_year if high is None else high), "out of bounds")
    return found


def edited(rows: DataFrame, edits: DataFrame, as_of_year: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """rows with edits (key, field, value) applied, and the edits of keys for which one is not possible, with its fault.

    All edits of a key are applied, or none. Of several of one field the last in the order of text wins. Edits of other keys
    than rows have change nothing. Derived columns are worked out for the rows that change.
    """
    judged = edits.withColumn("fault", fault(as_of_year))
    bad = judged.where("fault is not null").select(key).distinct()
    refused = judged.join(bad, key, "left_semi")
    last = judged.join(bad, key, "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(key, "field").orderBy(F.desc("value")))).where("_n = 1")
    wide = last.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("_new"))
    joined = rows.join(wide, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNotNull()
    for name, kind in EDITABLE.items():
        new = F.try_element_at("_new", F.lit(name))
        joined = joined.withColumn(name, F.when(new.isNotNull(), new.value.cast(kind)).otherwise(F.col(name)).cast(rows.schema[name].dataType))
    for name, value in derived(as_of_year).items():
        joined = joined.withColumn(name, F.when(changed | ~F.lit(name in rows.columns), value).otherwise(F.col(name) if name in rows.columns else value))
    return joined.drop("_key", "_new"), refused
