"""What the operators share: reading tables, stored intermediate results, let-bindings."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word.
SPACE = r"[\x09-\x0D ]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes in an Arrow batch, about. Texts are long, and a task and its worker hold several batches at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")  # one process: every folder is shared
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of the tables that this process has stored and not deleted.
STORED: list[str] = []


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once as Parquet to the shared folder and read again, and the table's folder."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    return stored_at(df, name)[0]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables; such as all of STORED, once results are written that were made from them."""
    for name in list(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        STORED.remove(name)


def give_back() -> None:
    """Returns freed memory to the system, for a Python worker that later tasks use again; does nothing where that can't be done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where lambdas inside body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other characters than space and \\x09-\\x0D; null text: empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return let(bare, lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE + "+")))
