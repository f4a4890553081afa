"""Connected components of a graph of links between long ids, as alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import forget, stored_at


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links (a, b) name, but roots themselves; root is the smallest node it reaches.

    Each round joins the links with every node's smallest neighbour; both sides are aggregated before the join, and a
    node with very many links is a skewed key of a plain join, which Spark splits. Rounds grow with the logarithm of
    the longest path; the driver sees two numbers a round.
    """

    def tidy(df: DataFrame) -> DataFrame:
        high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        return df.where(F.col("a") != F.col("b")).select(high, low).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now, path = stored_at(tidy(links), "links")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        before = path
        now, path = stored_at(tidy(small), "links")
        forget(links.sparkSession, [before])
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
