"""Benchmark decontamination: latent semantic retrieval of passages, then word-order and answer checks.

Passages are pairs of neighbouring blocks of BLOCK words; benchmark items are cut into passages too. Their TF-IDF vectors,
over hashed words, meet in a randomised SVD: each task adds up random combinations of its passages' vectors, and the sums
over all tasks span nearly the space of the largest singular vectors. All passages are then projected into that space, and
the singular vectors of the projections, from sums over all tasks again, are the latent space. Passages of documents and
items whose cosine there is high enough, and that share enough of their TF-IDF weight, are candidates. The longest common
subsequence of words decides, together with the item's answer (its rarest words) where the wording was changed.

Words are runs of word characters, lower-cased, compared by 32-bit hashes. All documents count for the statistics and are
searched. Null and empty texts and items match nothing; an empty table or benchmark gives an empty result. Rows that repeat
a document give their pairs once, and so do items that repeat an id; an item without an id has a null one. Extra columns
are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored

WORD = re.compile(r"\w+")
BLOCK, FEATURES, RANK, SPARE, SKETCH = 16, 4096, 48, 16, 256
#: Least cosine in the latent space and share of weight of a candidate; least share of an item in order to be a leak, alone
#: and with its answer found.
COSINE, SHARED, ORDER, ORDER_WITH_ANSWER = 0.55, 0.45, 0.75, 0.55
#: Words of an answer; items, and about how many characters of theirs, that are searched for in one pass.
ANSWER, ITEMS, CHARS = 5, 2000, 2_000_000


class Hashes(dict):
    """The hashes of the words in what stands between white space, in 4 bytes each; words never hold white space."""

    def __missing__(self, part: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        words = (part,) if part.isalpha() else WORD.findall(part)
        value = self[part] = b"".join([zlib.crc32(w.encode()).to_bytes(4, "little") for w in words])
        return value


_hashes = Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(_hashes.__getitem__, (text or "").lower().split())), "<u4")


def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, words)."""
    for batch in batches:
        words = [word_hashes(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.binary())], ["doc_id", "h", "words"])


def grid(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks (FEATURES where a block ends early), and each block's text."""
    per = np.array([-(-len(w) // BLOCK) for w in words], np.int64)
    padded = [np.full(n * BLOCK, FEATURES, np.int64) for n in per]
    for row, w in zip(padded, words, strict=True):
        row[: len(w)] = w % FEATURES
    cells = np.concatenate(padded) if padded else np.zeros(0, np.int64)
    return cells.reshape(-1, BLOCK), np.repeat(np.arange(len(words)), per)


def passages(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each block and the next of the same text, sorted; repeats and gaps are FEATURES; its text and first block."""
    cells, text = grid(words)
    if not len(cells):
        return np.zeros((0, 2 * BLOCK), np.int64), text, text
    nxt = np.vstack([cells[1:], np.full((1, BLOCK), FEATURES)])
    nxt[np.append(text[1:] != text[:-1], True)] = FEATURES
    both = np.sort(np.hstack([cells, nxt]), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = FEATURES
    first = np.arange(len(text)) - np.searchsorted(text, text)
    return both, text, first


def chunks(batches: Iterator[pa.RecordBatch], size: int = 60_000) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Documents with about size words in all."""
    ids, hashes, words, held = [], [], [], 0
    for batch in batches:
        for key, h, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(key)
            hashes.append(h)
            words.append(np.frombuffer(data, np.uint32))
            held += len(words[-1])
            if held >= size:
                yield ids, hashes, words
                ids, hashes, words, held = [], [], [], 0
    if ids:
        yield ids, hashes, words


def summed(rows: DataFrame, function, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of function(features of passages), a matrix of a fixed shape."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, _, words in chunks(batches):
            total += function(passages(words)[0])
        yield from lines(total)

    def lines(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(total.any(axis=1))
        data = [x.tobytes() for x in total[used].astype("<f4")]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(data, pa.binary())], ["f", "y"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for f, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[f] += np.frombuffer(data, "<f4")
        yield from lines(total)

    schema = "f long, y binary"
    out = np.zeros(shape)
    for f, data in rows.mapInArrow(add, schema).repartition("f").mapInArrow(merge, schema).collect():  # a row for each of shape
        out[f] += np.frombuffer(data, "<f4")
    return out


def count_by_feature(cells: np.ndarray) -> np.ndarray:
    return np.bincount(cells.reshape(-1), minlength=FEATURES + 1)[:FEATURES, None].astype(float)


def weigh(cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the cells, each row of length 1. weight ends with 0, for no feature."""
    values = weight[cells]
    return values / np.maximum(np.sqrt((values * values).sum(axis=1, keepdims=True)), 1e-6)


def project(cells: np.ndarray, values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Passages times basis, whose last row is 0."""
    out = np.zeros((len(cells), basis.shape[1]), np.float32)
    for k in range(cells.shape[1]):
        out += values[:, k : k + 1] * basis[cells[:, k]]
    return out


def latent_space(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each feature, and the largest right singular vectors of the passages, by a randomised SVD."""
    df = summed(rows, count_by_feature, (FEATURES, 1))[:, 0]
    weight = np.append(np.log((1 + df.max()) / (1 + df)) + 0.1, 0).astype(np.float32)
    width = RANK + SPARE
    sketch = summed(rows, lambda cells: combined(cells, weigh(cells, weight), SKETCH), (FEATURES, SKETCH))
    basis = padded(np.linalg.svd(sketch, full_matrices=False)[0][:, :width])

    def gram(cells: np.ndarray) -> np.ndarray:
        projected = project(cells, weigh(cells, weight), basis)
        return projected.T @ projected

    vectors = np.linalg.eigh(summed(rows, gram, (width, width)))[1][:, ::-1][:, :RANK]  # the right singular ones of the projections
    return weight, padded(basis[:-1] @ vectors)


def padded(basis: np.ndarray) -> np.ndarray:
    """With a row of zeros, for no feature."""
    return np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)


def combined(cells: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The passages times a sparse random matrix: each is added to, or taken from, one of width sums.

    Which one depends on the passage alone, so that a task that runs again adds the same.
    """
    seeds = (cells.astype(np.uint64) * np.arange(1, cells.shape[1] + 1, dtype=np.uint64)).sum(axis=1)
    seeds = (seeds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    column, sign = (seeds >> np.uint64(1)) % np.uint64(width), np.where(seeds & np.uint64(1), 1.0, -1.0)
    at = cells * width + column.astype(np.int64)[:, None]
    size = FEATURES * width
    return np.bincount(np.minimum(at, size).reshape(-1), (values * sign[:, None]).reshape(-1), size + 1)[:size].reshape(FEATURES, width)


def common_order(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, in a number's bits: a bit for each of the item's words."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Searcher:
    """A block of benchmark items, ready to be compared with passages."""

    def __init__(self, items: list[tuple[int | None, str]], weight: np.ndarray, basis: np.ndarray):
        found = [(k, word_hashes(t)) for k, t in items]
        self.items = [(k, w) for k, w in found if len(w)]
        self.weight, self.basis = weight, basis
        self.lists = [w.tolist() for _, w in self.items]
        self.rare = [set(sorted(set(w), key=lambda x: (-weight[x % FEATURES], x))[:ANSWER]) for w in self.lists]
        cells, self.owner, first = passages([w for _, w in self.items])
        # The end of an item that the passage before holds too is no passage of its own.
        whole = (first == 0) | ((cells < FEATURES).sum(axis=1) >= BLOCK) if len(cells) else np.zeros(0, bool)
        cells, self.owner = cells[whole], self.owner[whole]
        self.vectors = self.latent(cells)
        self.masks = np.zeros((len(cells), FEATURES + 1), bool)
        self.masks[np.arange(len(cells))[:, None], cells] = True
        self.masks[:, FEATURES] = False
        self.mass = weight[cells].sum(axis=1)

    def latent(self, cells: np.ndarray) -> np.ndarray:
        vectors = project(cells, weigh(cells, self.weight), self.basis)
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def find(self, words: list[np.ndarray]) -> Iterator[tuple[int, int | None, float, float, bool]]:
        """(text, item_id, cosine, share in order, answer found) of each leak: the best of a text and item."""
        cells, text, first = passages(words)
        if not len(cells) or not self.items:
            return
        weights = self.weight[cells]
        own = weights.sum(axis=1)
        best: dict[tuple[int, int], tuple] = {}
        cosines = self.vectors @ self.latent(cells).T
        parts, near = np.nonzero(cosines >= COSINE)
        shared = (weights[near] * self.masks[parts[:, None], cells[near]]).sum(axis=1)
        keep = shared >= SHARED * np.minimum(own[near], self.mass[parts])
        # A passage that several passages of an item are near is compared with the item once.
        order = np.lexsort((-cosines[parts[keep], near[keep]], near[keep], self.owner[parts[keep]]))
        items, hits = self.owner[parts[keep]][order], near[keep][order]
        high = cosines[parts[keep], near[keep]][order]
        once = np.r_[True, (items[1:] != items[:-1]) | (hits[1:] != hits[:-1])] if len(items) else np.zeros(0, bool)
        for item, p, cosine in zip(items[once].tolist(), hits[once].tolist(), high[once].tolist(), strict=True):
            t, at = int(text[p]), int(first[p]) * BLOCK
            wanted = self.lists[item]
            part = words[t][max(0, at - len(wanted)) : at + 2 * BLOCK + len(wanted)].tolist()
            share = common_order(wanted, part) / len(wanted)
            rare = self.rare[item]
            answered = len(rare.intersection(part)) * 2 > len(rare)
            if share >= ORDER or (answered and share >= ORDER_WITH_ANSWER):
                best[t, item] = max(best.get((t, item), (0.0,)), (share, cosine, answered))
        for (t, item), (share, cosine, answered) in best.items():
            yield t, self.items[item][0], cosine, share, answered


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, h, item_id, cosine, in_order, answer_found): h is a hash of the document's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = stored(narrow.mapInArrow(list_hashes, "doc_id long, h long, words binary"), "word-hashes")
    schema = "doc_id long, h long, item_id long, cosine double, in_order double, answer_found boolean"
    found: list[DataFrame] = []
    items = benchmark.select(F.col(item_col).cast("long"), F.col("text")).where(F.col("text").isNotNull())
    weight, basis = latent_space(rows)

    def search(block: list[tuple[int | None, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast((block, weight, basis))  # bounded by ITEMS and CHARS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*sent.value)
            for ids, hashes, words in chunks(batches):
                out = [(ids[t], hashes[t], *rest) for t, *rest in searcher.find(words)]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, row, strict=True)) for row in out], OUT)

        return rows.mapInArrow(run, schema)

    block: list[tuple[int | None, str]] = []
    size = 0
    for item in items.toLocalIterator():  # the query set, a block at a time
        block.append(tuple(item))
        size += len(item[1])
        if len(block) == ITEMS or size >= CHARS:
            found.append(search(block))
            block, size = [], 0
    if block or not found:
        found.append(search(block))
    return functools.reduce(DataFrame.union, found).dropDuplicates(["doc_id", "h", "item_id"])


OUT = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("in_order", pa.float64()), ("answer_found", pa.bool_())]
)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("h")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no benchmark item; docs' own columns."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["_h"])
    return docs.join(found, same, "left_anti")
