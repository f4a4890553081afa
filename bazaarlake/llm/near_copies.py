"""Texts that share most of their word shingles: fingerprints and MinHash find candidates, the exact Jaccard similarity of the sets decides.

Each text's set of shingle hashes gets BANDS keys of ROWS minima each; texts that share a key are candidates. At a
similarity of 0.8 a pair has no common key with a chance of (1 - 0.8 ** 5) ** 24 < 1e-4, less above. Texts whose fingerprints
are near (linked, by) are candidates as well: of those nearly the same none is missed. Candidates are
joined to classes first, each text linking to the smallest of its bucket; then the sets of a class meet in one task, which
links all pairs that are similar enough. So what candidates bring together wrongly comes apart again.

A class of more than GROUP texts, or WEIGHT shingles, is dealt to several tasks: links within each task; then between the largest classes
found there; then of all texts outside the largest class with all others. Pairs left out are within one class already.

Texts with equal sets, such as all texts without a word, count as one. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import stored
from bazaarlake.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of one class that meet in a task, and about how many shingles of theirs.
GROUP, WEIGHT = 1024, 2_000_000
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, n))


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band of minima, as signed longs; none for an empty set."""
    if not len(found):
        return []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (FACTORS[:, None] * found[at : at + 1024]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 1), np.uint64).view(np.int64))


def spanning(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between places of non-empty sets that join all pairs similar enough, one fewer than sets in each class."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = owner[np.argsort(ids, kind="stable")]
    end = np.cumsum(np.bincount(ids))
    begin = np.concatenate(([0], end[:-1]))
    parts = np.split(ids, np.cumsum(size)[:-1])
    rest, links = np.ones(len(sets), bool), []
    while rest.any():
        start = int(rest.argmax())
        rest[start] = False
        queue = [start]
        while queue and rest.any():
            at = queue.pop()
            both = np.bincount(np.concatenate([held[begin[k] : end[k]] for k in parts[at].tolist()]), minlength=len(sets))
            near = np.flatnonzero(rest & (both >= similar * (size + size[at] - both) - 1e-9)).tolist()
            rest[near] = False
            links += [(x, at) for x in near]
            queue.extend(near)
    return links


def links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (task, fp, shingles) that follow each other and have one task."""

    def made(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = spanning(sets) if len(keys) > 1 else []
        pairs = [pa.array([keys[link[k]] for link in found], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    now, keys, sets = None, [], []
    for batch in batches:
        for task, fp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if task != now:
                yield made(keys, sets)
                now, keys, sets = task, [], []
            keys.append(fp)
            sets.append(np.frombuffer(data, "<u8"))
    yield made(keys, sets)


def links_by(dealt: DataFrame) -> DataFrame:
    """(a, b) within each task of (task, fp, shingles)."""
    return dealt.select("task", "fp", "shingles").repartition("task").sortWithinPartitions("task").mapInArrow(links_in, "a long, b long")


def exact_links(members: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links that join all similar pairs among members (root, fp, shingles) with the same root."""
    weight = F.sum(F.octet_length("shingles")) / (8 * WEIGHT)
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / group, weight)).alias("chunks"))
    sizes = stored(sizes.where("chunks > 1"), "large-classes")
    dealt = members.join(sizes, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks")).withColumn("task", F.xxhash64("root", "chunk"))
    links = stored(links_by(dealt), "similar-links")
    if sizes.isEmpty():
        return links
    large = stored(dealt.where("chunks > 1"), "similar-dealt")

    def labelled(found: DataFrame) -> DataFrame:
        roots = components(found).withColumnRenamed("root", "label")
        return large.join(roots, large.fp == roots.node, "left").drop("node").withColumn("label", F.coalesce("label", "fp"))

    def largest(rows: DataFrame, keys: list[str]) -> DataFrame:
        counts = rows.groupBy(*keys, "label").count()
        return counts.groupBy(*keys).agg(F.max(F.struct("count", "label")).label.alias("label"))

    heads = largest(labelled(links), ["root", "chunk"]).select(F.col("label").alias("fp"))
    between = links_by(large.join(heads, "fp", "left_semi").withColumn("task", F.col("root")))
    links = stored(links.union(between), "similar-links")
    known = labelled(links)
    main = largest(known, ["root"]).withColumnRenamed("label", "main")
    outside = known.join(main, "root").where("label != main").select("root", "fp", "shingles", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to"))
    sent = outside.where(F.col("to") != F.col("chunk")).select(F.xxhash64("root", F.col("to").cast("long")).alias("task"), "fp", "shingles")
    return links.union(links_by(large.select("task", "fp", "shingles").union(sent)))


def links_of_marks(marks: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) that join sets whose marks are one or joined: marks (fp, mark), near gives links (a, b) of distinct marks fp."""
    marks = stored(marks.distinct(), "marks-of-sets")
    roots = components(near(marks.select(F.col("mark").alias("fp")).distinct()))
    named = marks.join(roots, marks.mark == roots.node, "left").select("fp", F.coalesce("root", "mark").alias("name")).distinct()
    least = named.groupBy("name").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(least, "name").where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def linked(docs: DataFrame, id_col: str, text_col: str, hash_col: str, by: tuple[Callable[[str | None], int], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(id_col, hash_col, fp, root, component_id): fp tells sets apart, root classes; component_id is a class's smallest id.

    by: a text's fingerprint, a signed long, and the links between fingerprints, which name candidates beside those of MinHash.
    """
    mark_of, near_marks = by

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, marks = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text)
                keys.append(set_key(found))
                bands.append(band_keys(found))
                marks.append(mark_of(text))
            arrays = [*batch.columns[:2], pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "h", "fp", "bands", "mark"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_set(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["root", "fp", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(hash_col).alias("h"), F.col(text_col).alias("text"))
    marked = stored(rows.mapInArrow(mark, "key long, h long, fp long, bands array<long>, mark long"), "minima")
    firsts = stored(marked.groupBy("fp").agg(F.min("key").alias("first"), F.min(F.struct("h", "key")).alias("one"), F.any_value("bands").alias("bands")), "distinct-sets")
    dealt = firsts.select("fp", F.explode("bands").alias("band"))
    least = dealt.groupBy("band").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = dealt.join(least, "band").where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    near = components(shared.union(links_of_marks(marked.select("fp", "mark"), near_marks)).distinct())
    near = stored(near.union(near.select(F.col("root").alias("node"), "root")).distinct(), "candidates")
    named = firsts.join(near, firsts.fp == near.node).select("root", "fp", F.col("one.h").alias("one_h"), F.col("one.key").alias("one_key"))
    texts = rows.join(named, (rows.h == named.one_h) & rows.key.eqNullSafe(named.one_key)).select("root", "fp", "text")
    members = stored(texts.mapInArrow(sets, "root long, fp long, shingles binary").dropDuplicates(["fp"]), "similar-sets")
    roots = components(exact_links(members))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = marked.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")
    return found.select(F.col("key").alias(id_col), F.col("h").alias(hash_col), "fp", "root", "component_id")
