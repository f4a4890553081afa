"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by covering hash tables.

Covering: bit i of the fingerprint gets a vector m(i) of radius + 1 bits; table v (every non-zero vector) keeps the
bits whose m(i) has an odd product with v. Any radius bits span at most radius dimensions, so some v is orthogonal to
all of them: its table drops every bit in which a pair within the radius differs, and the pair meets there. No pair is
missed, whatever the data.

Null and empty texts have fingerprint zero and link like any other. Copies collapse to one fingerprint before any
table is built. An empty table gives an empty result. Rows with a null id take part in links; a class whose ids are all
null has a null component. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm import near_copies
from bazaarlake.llm.common import read, stored
from bazaarlake.llm.components import components

BITS = 64
#: Buckets up to this many distinct fingerprints are compared within one task; larger ones go by midpoints.
BUCKET = 8192


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(joined[s:e], seed) for s, e in zip(first, last, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): fp as a signed long."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(hash_texts, "key long, fp long").withColumnRenamed("key", id_col)


def masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits, as signed longs."""
    size = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, size + 1):
        bits = [i for i in range(BITS) if ((1 + i % size) & v).bit_count() % 2]
        found.append(int(np.array(sum(1 << i for i in bits), np.uint64).view(np.int64)))
    return found


def flips(distance: int) -> list[int]:
    """All patterns of up to distance changed bits, as signed longs."""
    found = {0}
    for _ in range(distance):
        found |= {x ^ (1 << i) for x in found for i in range(BITS)}
    return np.array(sorted(found), np.uint64).view(np.int64).tolist()


def spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all values within the radius of each other, one fewer than values in each class."""
    rest, links = np.sort(values).view(np.uint64), []  # of signed ones, bitwise_count takes the absolute value
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                links += [(x, int(at.view(np.int64))) for x in rest[near].view(np.int64).tolist()]
                queue.extend(rest[near])
                rest = rest[~near]
    return links


def links_in(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each row's bucket."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for values in batch.column(0).to_pylist():
            if len(values) == 2:
                if ((values[0] ^ values[1]) & (2**64 - 1)).bit_count() <= radius:
                    a.append(max(values))
                    b.append(min(values))
                continue
            for x, y in spanning(np.array(values, np.int64), radius):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): enough links between distinct fingerprints fp that all within the radius of each other are joined.

    A bucket beyond the bound is handled without comparing its pairs: two fingerprints within an even radius share a
    midpoint within half of it from both, and all that share a midpoint are within the radius of each other. So each
    one names its midpoints and links to the smallest that names the same: 2,081 rows for each of its fingerprints at a
    radius of 4 (itself, with one bit and with two bits changed). That grows with the bucket, not its square.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)))
    rows = fps.select("fp", F.posexplode(keys).alias("t", "key"))
    large = stored(rows.groupBy("t", "key").count().where(F.col("count") > bucket), "large-buckets")
    crowded = not large.isEmpty()
    small = rows.join(large, ["t", "key"], "left_anti") if crowded else rows
    groups = small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    links = groups.mapInArrow(lambda batches: links_in(batches, radius), "a long, b long")
    if crowded:
        moved = F.transform(F.lit(flips(radius // 2)), lambda f: f.bitwiseXOR(F.col("fp")))
        mids = rows.join(large, ["t", "key"], "left_semi").select("fp").distinct().select("fp", F.explode(moved).alias("mid"))
        least = mids.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        links = links.union(mids.join(least, "mid").where("fp > low").select("fp", "low"))
    return links.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id that links reach."""
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    firsts = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    roots = components(near_links(firsts.select("fp"), radius))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id; docs' own columns.

    Candidates are texts whose fingerprints differ in at most 4 of 64 bits, all of them, as in near_duplicates, and those that
    MinHash names, as fingerprints alone leave out most copies at a Jaccard similarity of 0.8 of their sets of five-word shingles.
    Of both, that similarity decides (near_copies): near fingerprints alone may be those of texts that repeat themselves.
    Of rows of the component that repeat the kept id, one stays, that with the smallest text hash; of a component without
    any id, one row stays for each set. Rows that share an id but not the component are no copies.
    """
    hashed = docs.withColumn("_text_hash_", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = near_copies.linked(hashed, id_col, text_col, "_text_hash_", (fingerprint, near_links)).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")
    kept = found.groupBy("root", alone).agg(F.min(F.struct("_text_hash_", id_col)).alias("row"))
    kept = kept.select(F.col(f"row.{id_col}").alias("_kept_id_"), F.col("row._text_hash_").alias("_kept_hash_")).distinct()
    same = hashed[id_col].eqNullSafe(kept["_kept_id_"]) & (hashed["_text_hash_"] == kept["_kept_hash_"])
    return hashed.join(kept, same, "left_semi").dropDuplicates([id_col, "_text_hash_"]).drop("_text_hash_")
