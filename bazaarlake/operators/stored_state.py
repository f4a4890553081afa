"""A state in a folder, split by a hash of its key: a change rewrites the parts that it touches and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators.state import upsert


@dataclass
class KeyedState:
    """Rows by key, in folder/keyed/part=N; rows without a key, which no later row replaces, in folder/unkeyed/batch=N.

    parts: how many parts keys are dealt to, fixed for the folder's life; a part should be some hundred MB.
    """

    folder: str
    key: str
    version: str
    schema: str
    parts: int = 16
    keep_old: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows."""
        return self.part(spark, "keyed", "part").drop("part").unionByName(self.part(spark, "unkeyed", "batch").drop("batch"))

    def part(self, spark: SparkSession, name: str, column: str) -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        schema = f"{self.schema}, {column} int"
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def merge(self, new: DataFrame, batch: int = 0) -> list[int]:
        """Merges rows by key, the latest version winning, and returns the parts rewritten.

        Only the touched parts are read, merged and overwritten. Merging the same batch again gives the same state: keys converge
        on their latest version, and rows without a key replace those of the same batch number.
        """
        spark = new.sparkSession
        part = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int").alias("part")
        dealt = new.where(F.col(self.key).isNotNull()).select("*", part)
        touched = sorted(r[0] for r in dealt.select("part").distinct().collect())  # self.parts numbers at most
        if touched:
            old = self.part(spark, "keyed", "part").where(F.col("part").isin(touched))
            older = old.drop("part").unionByName(dealt.drop("part").limit(0))
            # A version older than the stored one changes nothing.
            stored = old.select(F.col(self.key).alias("_key"), F.col(self.version).alias("_version"))
            fresh = dealt.drop("part").join(stored, F.col(self.key) == F.col("_key"), "left").where(F.col("_version").isNull() | (F.col(self.version) >= F.col("_version")))
            merged = upsert(older, fresh.drop("_key", "_version"), self.key, self.version, self.keep_old)
            self.write(merged.select("*", part).repartition("part"), "keyed", "part")
        unkeyed = new.where(F.col(self.key).isNull()).withColumn("batch", F.lit(batch).cast("int"))
        if not unkeyed.isEmpty():
            self.write(unkeyed, "unkeyed", "batch")
        return touched

    def write(self, rows: DataFrame, name: str, column: str) -> None:
        """Replaces the parts that rows have; files are moved in once all are written, so reading the same folder is safe."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(f"{self.folder}/{name}")
