"""Whole files of extracted records: their raw values made standard, everything else kept, and what can't be read put aside.

A file holds a JSON array of records, or an object whose `extractions` is one. A record's raw values are its `raw_values`, or the
record itself if it has all four fields. Records stay VARIANT, so fields that nobody knows survive; nothing is parsed in Python.
A file is read by one task and its records are rows from then on: neither a shuffle nor a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions import normalise as nrm
from bazaarlake.functions import patterns as P
from bazaarlake.sources.shapes import exploded, got, kind

FIELDS = ("mileage", "year", "power", "fuel")
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
#: Faults of files and of records; the first that holds counts.
FILE_FAULTS = ("not json", "unknown format")
RECORD_FAULTS = ("not an object", "no values", "values not an object", "fuel not a text")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, place, record as VARIANT) of all files, and (file, fault) of those that hold no records' list. A file of no bytes gives no row."""
    return records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from rows (file, value): value is a whole file's text; null, or JSON with one key twice, is not json."""
    parsed = files.select("file", F.try_parse_json("value").alias("v"))
    inner = got(F.col("v"), "$.extractions")
    held = F.when(kind(F.col("v")) == "ARRAY", F.col("v")).when((kind(F.col("v")) == "OBJECT") & (kind(inner) == "ARRAY"), inner)
    told = parsed.select("file", held.alias("held"), F.when(F.col("v").isNull(), "not json").when(held.isNull(), "unknown format").alias("fault"))
    return exploded(told.where("fault is null"), "held", "place", "record").select("file", "place", "record"), told.where("fault is not null").select("file", "fault")


def number(value: Column) -> Column:
    """A JSON number without its fraction; null for other kinds, and for 0, which stands for nothing known."""
    whole = F.when(kind(value).isin(*NUMBERS), got(value, "$", "double").try_cast("bigint"))
    return F.nullif(whole, F.lit(0).cast("bigint"))


def written(value: Column) -> Column:
    return F.when(kind(value) == "STRING", got(value, "$", "string"))


def normalised(raw: Column) -> Column:
    """Struct (mileage long, year int, power int, fuel string) of a VARIANT with any of these fields, each a number or a text as written.

    What is missing, null, empty, of another kind or out of bounds is null.
    """
    value = {k: got(raw, f"$.{k}") for k in FIELDS}
    miles, year = number(value["mileage"]), number(value["year"])
    return F.struct(
        F.coalesce(F.when(miles <= P.MOST_KM, miles), nrm.mileage(written(value["mileage"]))).alias("mileage"),
        F.coalesce(F.when(year.between(*P.YEARS), year).cast("int"), nrm.year(written(value["year"]))).alias("year"),
        F.coalesce(number(value["power"]).try_cast("int"), nrm.power(written(value["power"]))).alias("power"),
        nrm.fuel(written(value["fuel"])).alias("fuel"),
    )


def raw_values(record: Column) -> Column:
    """VARIANT of a record's raw values, or null if it has none."""
    own, whole = got(record, "$.raw_values"), F.lit(True)
    for k in FIELDS:
        whole = whole & got(record, f"$.{k}").isNotNull()
    return F.when(own.isNotNull(), own).when(whole, record)


def record_fault(record: Column, raw: Column) -> Column:
    fuel = kind(got(raw, "$.fuel"))
    return (
        F.when(kind(record) != "OBJECT", "not an object")
        .when(raw.isNull(), "no values")
        .when(kind(raw) != "OBJECT", "values not an object")
        .when(~fuel.isin("STRING", "VOID"), "fuel not a text")
    )


def rewritten(record: Column, raw: Column, values: Column) -> Column:
    """The record with those of its raw values' fields that it has in standard form, and a mark; its other fields stay."""
    fields = record.cast("map<string,variant>")
    new = F.create_map(*(x for k in FIELDS for x in (F.lit(k), F.coalesce(values[k].cast("variant"), F.parse_json(F.lit("null"))))))
    new = F.map_filter(new, lambda k, _: F.map_contains_key(raw.cast("map<string,variant>"), k))
    kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(new, k) & (k != "_normalization_applied"))
    mark = F.create_map(F.lit("_normalization_applied"), F.parse_json(F.lit("true")))
    return F.to_json(F.to_variant_object(F.map_concat(kept, new, mark)))


def normalise_records(rows: DataFrame) -> DataFrame:
    """(file, place, mileage, year, power, fuel, record, fault) of (file, place, record): record as JSON text, rewritten if there is no fault."""
    raw = rows.withColumn("raw", raw_values(F.col("record")))
    told = raw.withColumn("fault", record_fault(F.col("record"), F.col("raw")))
    sound = F.col("fault").isNull()
    made = told.withColumn("values", F.when(sound, normalised(F.col("raw"))))
    out = F.when(sound, rewritten(F.col("record"), F.col("raw"), F.col("values"))).otherwise(F.to_json("record"))
    return made.select("file", "place", *(F.col(f"values.{k}").alias(k) for k in FIELDS), out.alias("record"), "fault")


def normalise_queue(rows: DataFrame) -> DataFrame:
    """(file, place, record) of a review queue: each item gains ml_result_normalized and regex_result_normalized beside the raw results.

    A result that is missing has nothing normalised; an item that isn't an object stays as it is.
    """
    item = F.col("record")

    def beside(name: str) -> Column:
        raw = F.coalesce(got(item, f"$.{name}"), F.parse_json(F.lit("{}")))
        raw = F.when(kind(raw) == "OBJECT", raw).otherwise(F.parse_json(F.lit("{}")))
        values = normalised(raw)
        new = F.create_map(*(x for k in FIELDS for x in (F.lit(k), F.coalesce(values[k].cast("variant"), F.parse_json(F.lit("null"))))))
        return F.to_variant_object(F.map_filter(new, lambda k, _: F.map_contains_key(raw.cast("map<string,variant>"), k)))

    added = {f"{name}_normalized": beside(name) for name in ("ml_result", "regex_result")}
    kept = F.map_filter(item.cast("map<string,variant>"), lambda k, _: ~k.isin(*added))
    both = F.map_concat(kept, F.create_map(*(x for name, value in added.items() for x in (F.lit(name), value))))
    out = F.when(kind(item) == "OBJECT", F.to_json(F.to_variant_object(both))).otherwise(F.to_json(item))
    return rows.select("file", "place", out.alias("record"))


def write_by_file(rows: DataFrame, folder: str) -> None:
    """Records one a line, in folder/file=<name>/, in the order of the old file; other files' folders stay, so a rerun changes nothing.

    rows as normalise_records leaves them: a file's records are in one task and in order, so nothing is shuffled.
    """
    ordered = rows.sortWithinPartitions("file", "place")
    writer = ordered.select("file", "record").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("file").text(folder)


def normalise_files(spark: SparkSession, path: str, folder: str) -> None:
    """Sound records to folder/normalised, faulty ones with their fault to folder/aside, files without records to folder/broken."""
    rows, broken = read(spark, path)
    done = normalise_records(rows)
    write_by_file(done.where("fault is null"), f"{folder}/normalised")
    done.where("fault is not null").select("file", "place", "record", "fault").write.mode("overwrite").json(f"{folder}/aside")
    broken.write.mode("overwrite").json(f"{folder}/broken")
