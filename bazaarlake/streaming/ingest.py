"""Incremental ingest: new files are parsed once, merged into the state by key, and each url's outcome is logged."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bazaarlake.operators.state import upsert
from bazaarlake.operators.stored_state import KeyedState


def ingest(spark: SparkSession, landing: str, schema: str, state: str, checkpoint: str, key: str, version: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Merges all files that have landed since the last run, and ends. A batch that is run again gives the same state.

    Every batch writes a whole version, which suits states of which old versions are wanted; see ingest_keyed for large ones.

    state: a folder of versions, one for each batch; the newest is the state. A batch reads the version before its own, so one that
    failed halfway is written anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = prepare(batch)
        if number:
            new = upsert(spark.read.parquet(f"{state}/{number - 1}"), new, key, version)
        else:
            new = upsert(new.limit(0), new, key, version)
        new.write.mode("overwrite").parquet(f"{state}/{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(landing)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_of(spark: SparkSession, landing: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(landing)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands all batches that are due to each, and ends; what was done is in the checkpoint."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_keyed(spark: SparkSession, landing: str, schema: str, state: KeyedState, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """As ingest(), into a state split by key: a batch rewrites only the parts that it touches. For states of any size."""
    run_to_end(stream_of(spark, landing, schema), lambda batch, number: state.merge(prepare(batch), number) and None, checkpoint)


def guarded(rows: DataFrame, work: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """rows with the columns of schema that work makes of each, and error.

    A row on which work raises has nulls there and the exception in error; it takes no other row with it. For None too, without
    an error. Only for work that no column expression can do; those have try_cast and the like.
    """
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    none: dict = dict.fromkeys(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for row in part.to_dict("records"):
                try:
                    made.append({**none, **(work(row) or {}), "error": None})
                except Exception as e:  # whatever it is, it is this row's outcome
                    made.append({**none, "error": traceback.format_exception_only(e)[-1].strip()[:500]})
            out = pd.DataFrame(made, columns=[*names, "error"], index=part.index, dtype=object)
            yield pd.concat([part, out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {schema}, error string")


def file_outcomes(rows: DataFrame, folder: str, batch: int, state: KeyedState | None = None, error: str = "error", reason: str = "reason") -> None:
    """Writes a batch's rows to folder/batch=N/status=saved, filtered or failed, in one pass, and merges the saved ones into a state.

    The folder of a batch is overwritten, so a batch that is run twice leaves the same files and the same state.
    """
    path = f"{folder}/batch={batch}"
    rows.withColumn("status", outcome(error, reason)).write.mode("overwrite").partitionBy("status").parquet(path)
    if state:
        schema = rows.sparkSession.createDataFrame([], state.schema).schema
        filed = rows.sparkSession.read.schema(rows.schema.add("status", "string")).parquet(path).where("status = 'saved'")
        state.merge(filed.select(*schema.names), batch)


def filed(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that file_outcomes wrote, with batch and status."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def first_statuses(stream: DataFrame) -> DataFrame:
    """(url, status, at) of each url's first status, once in the life of the stream's checkpoint.

    Of statuses that arrive together the earliest counts; whatever comes for a url later changes nothing. stream: url string,
    status string, at long. State: one pair for each url, kept over restarts.
    """

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        found = None
        for part in parts:
            best = part.sort_values("at", kind="stable").iloc[0]
            if found is None or best["at"] < found[1]:
                found = (str(best["status"]), int(best["at"]))
        state.update(found)
        yield pd.DataFrame({"url": [key[0]], "status": [found[0]], "at": [found[1]]})

    known = stream.where("url is not null and status is not null and at is not null")
    return known.groupBy("url").applyInPandasWithState(first, "url string, status string, at long", "status string, at long", "append", GroupStateTimeout.NoTimeout)


def count_first_statuses(spark: SparkSession, landing: str, schema: str, folder: str, checkpoint: str, columns: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(status, n) over all that has landed so far; goes on from the checkpoint. Each batch's first statuses are kept in folder/batch=N."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run_to_end(first_statuses(columns(stream_of(spark, landing, schema))), keep, checkpoint)
    found = spark.read.schema("url string, status string, at long, batch int").parquet(folder)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def outcome(failed: str = "error", filtered: str = "reason") -> Column:
    """Status of a url: failed, filtered, or saved."""
    return F.when(F.col(failed).isNotNull(), "failed").when(F.col(filtered).isNotNull(), "filtered").otherwise("saved")


def counted(log: DataFrame) -> DataFrame:
    """(status, n), of each url the first status."""
    first = log.groupBy("url").agg(F.min_by("status", "at").alias("status"))
    return first.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type in windows of time, for batch and stream; later ones than late are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
