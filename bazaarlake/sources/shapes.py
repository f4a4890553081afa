"""Files of labelled examples checked and read by VARIANT: a row for each example, faults by kind, malformed files kept aside.

A file holds a JSON array. Its examples become rows by variant_explode, in the file's task; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators.labels import LABELS

#: Kinds of faults of files, examples, and entities; the first that holds counts. The last two of entities are warnings.
FILE_FAULTS = ("not json", "not a list")
EXAMPLE_FAULTS = ("not a pair", "text not a string", "annotations not an object", "no entities", "entities not a list")
ENTITY_FAULTS = ("entity not a triple", "positions not integers", "label not a string", "invalid positions")
WARNINGS = ("unknown label", "possibly normalised")


def kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING, BIGINT, ... without what is inside; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def got(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def exploded(rows: DataFrame, value: str, at: str, out: str) -> DataFrame:
    """A row for each element of a variant array, with its place and value; none for other kinds."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()).select(F.col("pos").alias(at), F.col("value").alias(out)))


def examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, place, example as VARIANT) of all files, and (file, fault) of those that hold no JSON array."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    fault = F.when(F.col("v").isNull(), "not json").when(kind(F.col("v")) != "ARRAY", "not a list")
    told = files.withColumn("fault", fault)
    return exploded(told.where("fault is null"), "v", "place", "example").select("file", "place", "example"), told.where("fault is not null").select("file", "fault")


def example_fault(example: Column) -> Column:
    pair, text, notes, entities = got(example, "$[2]"), got(example, "$[0]"), got(example, "$[1]"), got(example, "$[1].entities")
    return (
        F.when((kind(example) != "ARRAY") | got(example, "$[1]").isNull() | pair.isNotNull(), "not a pair")
        .when(kind(text) != "STRING", "text not a string")
        .when(kind(notes) != "OBJECT", "annotations not an object")
        .when(entities.isNull(), "no entities")
        .when(kind(entities) != "ARRAY", "entities not a list")
    )


def checked(rows: DataFrame) -> DataFrame:
    """rows in one pass: a row for each example's own fault, and for each entity of those without: the text, the entity's place, parts and fault.

    An example without a fault and entities gives one row as well, without nth.
    """
    wrong = F.col("example_fault").isNotNull()
    told = rows.select("file", "place", "example", example_fault(F.col("example")).alias("example_fault"))
    parts = told.select(
        "file", "place", "example_fault",
        F.when(~wrong, got(F.col("example"), "$[0]", "string")).alias("text"),
        F.when(~wrong, got(F.col("example"), "$[1].entities", "array<variant>")).alias("entities"),
    )
    each = parts.select("file", "place", "example_fault", "text", F.posexplode_outer("entities").alias("nth", "e"))
    e = F.col("e")
    whole = lambda p: kind(got(e, p)) == "BIGINT"
    each = each.withColumns({"start": F.when(whole("$[0]"), got(e, "$[0]", "bigint")), "end": F.when(whole("$[1]"), got(e, "$[1]", "bigint")), "label": got(e, "$[2]", "string")})
    start, end, text = F.col("start"), F.col("end"), F.col("text")
    fault = (
        F.when((kind(e) != "ARRAY") | got(e, "$[2]").isNull() | got(e, "$[3]").isNotNull(), "entity not a triple")
        .when(start.isNull() | end.isNull(), "positions not integers")
        .when(kind(got(e, "$[2]")) != "STRING", "label not a string")
        .when((start < 0) | (end > F.length(text)) | (start >= end), "invalid positions")
    )
    return each.withColumn("fault", F.when(F.col("nth").isNotNull(), fault)).drop("e")


def entities_of(rows: DataFrame) -> DataFrame:
    """A row for each entity of the examples without a fault of their own: the text, the entity's place, parts and fault."""
    return checked(rows).where("nth is not null").drop("example_fault")


def warnings_of() -> list[Column]:
    """Warnings, or nulls, of a row of checked: a label that isn't known, and a mileage without separators where the text near it has some."""
    entity, sound = F.col("nth").isNotNull(), F.col("fault").isNull()
    start, end, text = (F.col(c).cast("int") if c != "text" else F.col(c) for c in ("start", "end", "text"))
    near = F.substring(text, F.greatest(start - 10, F.lit(0)) + 1, F.least(end + 10, F.length(text)) - F.greatest(start - 10, F.lit(0)))
    plain = F.substring(text, start + 1, end - start).rlike(r"^\d{5,}$")
    formatted = (F.col("label") == "MILEAGE") & plain & (near.contains(".") | F.lower(near).contains(" tis"))
    unknown = (sound | (F.col("fault") == "invalid positions")) & ~F.col("label").isin(*LABELS)
    return [F.when(entity & unknown, "unknown label"), F.when(entity & sound & formatted, "possibly normalised")]


def report(rows: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """(level, fault, n) of examples (file, place, example), and of the files that hold none: level error or warning."""
    told = [("error", F.coalesce("example_fault", "fault")), *(("warning", w) for w in warnings_of())]
    each = F.filter(F.array(*(F.struct(F.lit(level).alias("level"), fault.alias("fault")) for level, fault in told)), lambda x: x.fault.isNotNull())
    found = checked(rows).select(F.inline(each))
    if broken is not None:
        found = found.unionByName(broken.select(F.lit("error").alias("level"), "fault"))
    return found.groupBy("level", "fault").agg(F.count(F.lit(1)).alias("n"))


def sound_examples(rows: DataFrame) -> DataFrame:
    """(file, place, text, entities) of the examples of which nothing is at fault, entities as array<struct<start, end, label>>."""
    entities = entities_of(rows)
    bad = entities.where("fault is not null").select("file", "place").distinct()
    spans = entities.where("nth is not null").groupBy("file", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "start", "end", "label"))), lambda e: F.struct(e.start.cast("int").alias("start"), e.end.cast("int").alias("end"), e.label.alias("label"))).alias("entities"))
    sound = rows.where(example_fault(F.col("example")).isNull()).select("file", "place", got(F.col("example"), "$[0]", "string").alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return sound.join(bad, ["file", "place"], "left_anti").join(spans, ["file", "place"], "left").withColumn("entities", F.coalesce("entities", none))
