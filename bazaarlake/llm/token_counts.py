"""Token counts: a shortcut for whole tokens, the library's merges for the rest (see tokens.py).

Null text counts as empty: no bytes, no tokens. Repeated rows each get their own row; an empty table gives none.
Other columns of the input are not read and never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import read
from bazaarlake.llm.tokens import coder, tokenizer_path

OUT = "key long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of each row's whole text. path: the tokenizer's file on every executor."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array([bpe.count(t) for t in texts], pa.int64()),
                ],
                ["key", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(count, OUT).withColumnRenamed("key", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Counts of every document, and whether it is longer than a context of limit tokens."""
    return token_counts(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > limit)
