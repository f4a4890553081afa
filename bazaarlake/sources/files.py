"""Files of labelled examples, listings and reviews: three shapes of JSON, CSV of spans, and texts with separators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "array<struct<start:int,end:int,label:string>>"
EXAMPLE = f"text string, entities {ENTITIES}, car_id string, source string"


def as_example(found: object) -> tuple | None:
    """A bare pair, a wrapped pair, or an object; None for any other shape."""
    car, source = None, None
    if isinstance(found, dict) and "data" in found:
        car, source, found = found.get("car_id"), found.get("source"), found["data"]
    if isinstance(found, dict) and "text" in found:
        found = [found["text"], {"entities": found.get("entities", [])}]
    if not (isinstance(found, list) and len(found) == 2 and isinstance(found[0], str) and isinstance(found[1], dict)):
        return None
    spans = [(int(s), int(e), str(label)) for s, e, label in found[1].get("entities", [])]
    return found[0], spans, None if car is None else str(car), source


def labelled_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of all three shapes from files that hold a JSON array each; other shapes are dropped. A file is one row."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [x for text in part["value"] for item in json.loads(text) if (x := as_example(item))]
            spans = [[{"start": s, "end": e, "label": label} for s, e, label in r[1]] for r in rows]
            yield pd.DataFrame({"text": [r[0] for r in rows], "entities": spans, "car_id": [r[2] for r in rows], "source": [r[3] for r in rows]})

    return spark.read.text(path, wholetext=True).mapInPandas(read, EXAMPLE)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def span_csv(spark: SparkSession, path: str, labels: tuple[str, ...] = ("mileage", "year", "power", "fuel")) -> DataFrame:
    """text and entities from columns like year_start and year_end; a label without both has no span."""
    rows = spark.read.option("header", True).csv(path)
    made = [
        F.when(F.col(f"{x}_start").isNotNull() & F.col(f"{x}_end").isNotNull(), F.struct(F.col(f"{x}_start").cast("int").alias("start"), F.col(f"{x}_end").cast("int").alias("end"), F.lit(x.upper()).alias("label")))
        for x in labels
        if f"{x}_start" in rows.columns
    ]
    return rows.select("text", F.filter(F.array(*made), lambda e: e.isNotNull()).alias("entities"))


def separated_texts(spark: SparkSession, path: str, separator: str = "\n---\n") -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(F.trim("value").alias("text")).where("text <> ''")


def write_texts(rows: DataFrame, path: str) -> None:
    """One text a line; line breaks within are spaces."""
    rows.select(F.regexp_replace("text", r"\s*\R\s*", " ")).write.mode("append").text(path)


def replace_version(rows: DataFrame, folder: str) -> str:
    """Writes a new version beside the old ones, whose folders stay as backups, and returns its path."""
    path = f"{folder}/version-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in parts by ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()


def page_offsets(spark: SparkSession, brands: DataFrame, most: int = 20_000, step: int = 20) -> DataFrame:
    """(brand, offset) of each results page from (brand, n). The first page has no offset and isn't among them."""
    last = F.least(F.col("n"), F.lit(most)) - 1
    return brands.where(last >= step).select("brand", F.explode(F.sequence(F.lit(step), last, F.lit(step))).alias("offset"))


def quota(rows: DataFrame, quotas: DataFrame, key: str = "brand") -> DataFrame:
    """The first n rows by id of each key, n from quotas (key, n)."""
    from pyspark.sql import Window

    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("id")))
    return ranked.join(quotas, key).where("_n <= n").drop("_n", "n")


def append_reviewed(rows: DataFrame, folder: str, batch: int) -> None:
    """Adds reviewed rows as JSON lines in folder/batch=N; earlier batches aren't read, and a batch that comes again replaces itself."""
    writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").json(folder)


def reviewed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all batches."""
    return spark.read.schema(f"{schema}, batch int").json(folder).drop("batch")
