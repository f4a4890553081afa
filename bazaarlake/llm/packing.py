"""Packing token sequences as a cutting-stock problem, solved by column generation.

Documents are cut into pieces of the sequence length and a rest; a histogram of piece lengths, in classes of WIDTH
tokens, is the demand. A linear program over patterns (how many pieces of each class fill one sequence) starts from
greedily filled patterns; a knapsack dynamic program finds the pattern that would help most, until none helps.
Rounded down, the patterns take all but a bounded rest (less than one sequence a pattern), which first-fit packs. Spark
ranks the pieces within their class and hands each one the slot of that rank.

Null text counts as empty: one token, the end mark. Very long texts give as many pieces as they fill sequences. Repeated rows are packed each on its own. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored
from bazaarlake.llm.tokens import coder, tokenizer_path

LENGTH, WIDTH, END = 2048, 8, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each document's pieces (PIECES): as many of the full length as there are, and the rest."""
    path = path or tokenizer_path()
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.ids(text) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((key, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(pieces, PIECES)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth, and the number of each size (ascending), that fit the capacity; any number of each."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fitting[room]:
            value = best[room - sizes[:n]] + worth[:n]
            k = value.argmax()
            if value[k] > best[room] + 1e-12:
                best[room], took[room] = value[k], k
    counts = np.zeros(len(sizes))
    room = capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def filled_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, one a column, how often each is used, which take the need exactly, and the inverse of the patterns.

    Each pattern takes the largest sizes still needed and is used until one of its sizes is; no later pattern holds that
    size. So with the rows in the order in which sizes go, the patterns are a lower triangle, which is inverted row by row.
    """
    basis, used, gone = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes)), []
    left, wanted = need.copy(), np.ones(len(sizes), bool)
    for j in range(len(sizes)):
        pattern, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(wanted)[::-1]:
            if sizes[i] <= room:
                pattern[i] = min(room // sizes[i], max(1, int(left[i])))
                room -= int(pattern[i] * sizes[i])
        held = np.flatnonzero(pattern)
        out = held[(left[held] / pattern[held]).argmin()]
        used[j] = left[out] / pattern[out]
        left = np.maximum(left - used[j] * pattern, 0)
        wanted[out] = False
        gone.append(out)
        basis[:, j] = pattern
    inverse = np.zeros_like(basis)
    for j, i in enumerate(gone):
        inverse[j, i] = 1.0
        for before in np.flatnonzero(basis[i, :j]):
            inverse[j] -= basis[i, before] * inverse[before]
        inverse[j] /= basis[i, j]
    return basis, used, inverse


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product, without the linear algebra library, whose threads may block those of a driver."""
    return (matrix * vector).sum(axis=1)


def patterns_by_columns(demand: dict[int, int], capacity: int, rounds: int = 1200, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} with how often each is used, which take the demand exactly.

    The revised simplex method keeps the inverse of the basis; its prices go into the knapsack. It stops within gap of
    the linear optimum, and after so many rounds in any case: it is feasible all the same. Work and memory are bounded by the number of classes.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    exact = np.array([demand[int(s)] for s in sizes], float)
    need = exact * (1 + 1e-7 * np.sqrt(2 + np.arange(len(sizes))))  # no two ratios tie, so the method can't cycle
    basis, used, inverse = filled_basis(sizes, need, capacity)
    full = (1 + gap) * (need * sizes).sum() / capacity
    for k in range(rounds):
        if used.sum() <= full:  # hardly more sequences than if all were full
            break
        worth, column = knapsack(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + gap:  # the optimum is at least the present number of sequences over worth
            break
        move = times_vector(inverse, column)
        ratio = np.where(move > 1e-9, used / np.where(move > 1e-9, move, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used -= step * move
        used[out] = step
        basis[:, out] = column
        inverse[out] /= move[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(move[others], inverse[out])
    times = np.floor(np.maximum(used, 0) + 1e-6)
    rest = exact - times_vector(basis, times)
    while (rest < 0).any():  # an error of rounding took one pattern too many
        times[int((basis[int(rest.argmin())] * (times > 0)).argmax())] -= 1
        rest = exact - times_vector(basis, times)
    found = [({int(s): int(n) for s, n in zip(sizes, basis[:, j], strict=True) if n}, int(t)) for j, t in enumerate(times) if t]
    return found + [(p, 1) for p in first_fit({int(s): int(n) for s, n in zip(sizes, rest, strict=True)}, capacity)]


def first_fit(rest: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Sequences for a bounded rest: the largest pieces first, each where it fits most closely."""
    bins: list[tuple[int, Counter]] = []
    for size in sorted(rest, reverse=True):
        for _ in range(rest[size]):
            fits = [k for k, (room, _) in enumerate(bins) if room >= size]
            if fits:
                k = min(fits, key=lambda k: bins[k][0])
                bins[k][1][size] += 1
                bins[k] = (bins[k][0] - size, bins[k][1])
            else:
                bins.append((capacity - size, Counter({size: 1})))
    return [dict(held) for _, held in bins]


def ranked(pieces: DataFrame, largest: int) -> DataFrame:
    """pieces with rank: 0, 1, ... within each class, by document and place.

    Classes are split by a hash into about the square root of the largest class's size of groups; ranks are counted in
    each and moved up by the groups before. So neither the groups nor the list of groups of a class grows unboundedly.
    """
    groups = max(1, math.isqrt(largest))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    within = Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    before = Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("cls", "salt").count()
    moved = sizes.select("cls", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("moved"))
    own = salted.withColumn("own", F.row_number().over(within) - 1)
    return own.join(moved, ["cls", "salt"]).withColumn("rank", F.col("own") + F.col("moved"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """PIECES with sequence_id and offset, the piece's place in its sequence."""
    spark = docs.sparkSession
    cls = F.ceil(F.col("length") / WIDTH).cast("int")
    pieces = stored(cut(docs, id_col=id_col, text_col=text_col, path=path).withColumn("cls", cls), "pieces")
    demand = {c: n for c, n in pieces.groupBy("cls").count().collect()}  # LENGTH / WIDTH rows at most
    slots, taken, base = [], Counter(), 0
    for pattern, times in patterns_by_columns(demand, LENGTH // WIDTH):
        for c, each in pattern.items():
            slots.append((c, taken[c], taken[c] + each * times, times, base))
            taken[c] += each * times
        base += times
    schema = "cls int, low long, high long, times long, base long"
    # At most a row for each class of each pattern, and no more patterns than twice the classes.
    held = F.broadcast(spark.createDataFrame(slots, schema).withColumnRenamed("cls", "slot_cls"))
    rank = F.col("rank")
    fits = (F.col("cls") == F.col("slot_cls")) & (rank >= F.col("low")) & (rank < F.col("high"))
    placed = ranked(pieces, max(demand.values(), default=0)).join(held, fits)
    numbered = placed.withColumn("sequence_id", F.col("base") + (rank - F.col("low")) % F.col("times"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
