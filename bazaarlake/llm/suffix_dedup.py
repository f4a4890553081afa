"""Suffix-array dedup: remove each byte that a string of MIN bytes covers which also starts earlier in the corpus.

A sparse suffix array does it without a row for each byte. Prefix polynomial hashes give the hash of any substring in one
step. In each window of MIN bytes the K-byte string with the smallest hash is the window's anchor; equal windows have
equal anchors, at the same place. Runs of windows with one anchor form a region, some 35 windows long, so the corpus has a
row for about every 35th byte: (hash of the anchor, hash of the region, place).

1. Regions with equal hashes: all but the earliest are repeats, whole. Each task drops its own repeats first, so that a
   passage that very many documents hold reaches the shuffle once a task. An anchor that stands in more than CAP different
   regions of one task skips this step, but for two regions that tell all others of it, so that no task gets them all.
2. Regions whose anchor stands in different regions are cut in two: windows with the anchor in their right half, and the
   others. Windows can only be equal if the bytes that all windows of their part have in common are: 66 or 67 bytes rather
   than 32. Parts with equal common bytes meet; most parts meet none.
3. Of up to CAP parts that meet, the suffixes from the anchor on are merge-sorted, two suffixes being compared at the end of
   their common extension, which a binary search over prefix hashes finds; common extensions to the left are found the
   same way. Together they tell which windows are equal; the bytes are compared before anything is removed (collision
   verification).
4. Where more than CAP parts meet, each is cut in two again, with more bytes in common, until parts are single windows and
   the earliest of equal ones stays. Each task drops parts that are equal, byte by byte, to one it has met.

Step 1 relies on two unrelated 64-bit hashes, a polynomial of the anchor and XXH3 of the region, being equal together; all
later steps compare bytes.

Documents are told apart by id and a 64-bit hash of the text: rows that repeat a document, id and text, count once, and
all get the same result. A null id comes before all others; null text counts as empty. Documents under MIN bytes lose
nothing. An empty table gives an empty result; extra columns are carried by remove_repeats only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored

MIN, K = 100, 32
SPAN = MIN - K + 1
#: Bytes hashed at once; rows gathered before a task drops its own repeats; parts compared in one task.
BLOCK, ROWS, CAP = 1 << 19, 200_000, 64
NULL_ID = -(2**63)
FOUND = "a long, r long, doc long, h long, loc long"
#: Parts that meet have one g; a repeat has no part, and the number of its windows in g.
PARTS = "g long, doc long, h long, loc long, part binary"
SPANS = "doc long, h long, s long, n long"

_random = np.random.default_rng(20240607)
#: A random number for each byte value, and the odd base of the polynomials with its inverse, modulo 2**64.
BYTE = _random.integers(0, 2**64, 256, np.uint64)
BASE = int(_random.integers(0, 2**64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)


@functools.cache
def powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """sums, such that (sums[j] - sums[i]) * INVERSE ** i is the hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, BLOCK + 1)[: len(data)], out=sums[1:])
    return sums


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours, from running minima within blocks of that width."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts at starts with sizes in data: each region's first window, windows, anchor's offset, and both hashes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < MIN or not (sizes >= MIN).any():
        return none
    sums, back = prefix_hashes(data), powers(INVERSE, BLOCK + 1)
    grams = mix((sums[K:] - sums[:-K]) * back[: len(data) - K + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    long = sizes >= MIN
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (starts + sizes - MIN + 1)[long], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = anchor[window]
    first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(window) != 1)])
    s, n, p = window[first], np.diff(np.r_[first, len(window)]), anchor[first]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    ends = (s + n - 1 + MIN).tolist()
    whole = np.fromiter((digest(view[i:j], seed) for i, j, seed in zip(s.tolist(), ends, (p - s).tolist(), strict=True)), np.uint64, len(s))
    return s, n, p - s, grams[p], whole


class Gathered:
    """Rows of a task: of equal (a, r), the earliest goes on, the others are repeats."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """FOUND rows. loc is place << 16 | windows << 8 | offset; a repeat has no windows there, but in r."""
        if not self.size:
            return
        a, r, doc, h, s, n, off = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((s, h, doc, r, a))
        a, r, doc, h, s, n, off = (c[order] for c in (a, r, doc, h, s, n, off))
        first = np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]
        again = np.r_[False, ~first[1:] & (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (s[1:] == s[:-1])]
        loc = s << 16 | n << 8 | off
        group = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
        regions = np.bincount(group, first)
        nth = np.cumsum(first) - np.repeat(np.cumsum(regions) - regions, np.bincount(group)).astype(np.int64)
        many = regions[group] > CAP
        plain = first & (~many | (nth <= 2))
        yield batch_of(a[plain], r[plain], doc[plain], h[plain], loc[plain])
        if many.any():  # negative places: these regions are known to have others of their anchor
            hot = first & many
            yield batch_of(mix((a[hot] ^ r[hot]).view(np.uint64)).view(np.int64), r[hot], doc[hot], h[hot], ~loc[hot])
        rest = ~first & ~again
        doc, h, s, n = doc[rest], h[rest], s[rest], n[rest]
        if len(doc):
            order = np.lexsort((s, h, doc))
            doc, h, s, n = doc[order], h[order], s[order], n[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (s[1:] > s[:-1] + n[:-1])]
            begin = np.flatnonzero(new)
            last = np.r_[begin[1:], len(doc)] - 1
            size = s[last] + n[last] - s[begin]
            spread = mix((s[begin] ^ doc[begin]).view(np.uint64)).view(np.int64)
            yield batch_of(spread, size, doc[begin], h[begin], s[begin] << 16)


def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
    names = ["a", "r", "doc", "h", "loc"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def blocks(sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, size), up to BLOCK bytes each. Longer texts come in parts that overlap by a window less 1."""
    held: list[tuple[int, int, int]] = []
    room = BLOCK
    for row, size in enumerate(sizes):
        at = 0
        while size - at >= MIN:
            part = min(size - at, BLOCK)
            if part > room:
                yield held
                held, room = [], BLOCK
            held.append((row, at, part))
            room -= part
            at += part - MIN + 1
    if held:
        yield held


def find_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of (doc, h, bytes)."""
    gathered = Gathered()
    for batch in batches:
        doc, h, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        sizes = pc.binary_length(texts).to_pylist()
        for block in blocks(sizes):
            parts = [np.frombuffer(texts[row].as_buffer(), np.uint8)[at : at + size] for row, at, size in block]
            size = np.array([x[2] for x in block])
            start = np.cumsum(size) - size
            s, n, off, a, r = regions(np.concatenate(parts), start, size)
            k = np.searchsorted(start, s, side="right") - 1
            rows = np.array([x[0] for x in block])[k]
            place = s - start[k] + np.array([x[1] for x in block])[k]
            gathered.add(a.view(np.int64), r.view(np.int64), doc[rows], h[rows], place, n, off)
            if gathered.size >= ROWS:
                yield from gathered.flush()
    yield from gathered.flush()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, h, text): docs' other columns, what tells documents apart, and the bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")
    return docs.select(others, doc.alias("doc"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def place_of(loc: str = "loc") -> Column:
    return F.shiftright(loc, 16)


def halves(level: int) -> list[tuple[int, int]]:
    """Classes (low, high) of windows by the anchor's offset in them, after so many cuts in two."""
    classes = [(0, SPAN - 1)]
    for _ in range(level):
        cut = [(low, high, (low + high + 1) // 2) for low, high in classes]
        classes = [c for low, high, mid in cut for c in ((low, mid - 1), (mid, high)) if c[0] <= c[1]]
    return classes


#: Cuts until each part is a single window.
LEVELS = next(k for k in range(SPAN) if len(halves(k)) == SPAN)


class Parts:
    """Parts met in a task: of equal ones the earliest goes on, the others are repeats."""

    def __init__(self, level: int):
        self.classes = halves(level)
        self.met: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        self.repeats: list[tuple[int, int, int, int]] = []

    def cut(self, doc: int, h: int, place: int, n: int, off: int, region: bytes) -> None:
        """The parts of the region of n windows from place on, its anchor off bytes into it."""
        for low, high in self.classes:
            i, j = max(0, off - high), min(n - 1, off - low)
            if i > j:
                continue
            # What all windows of the class hold: low bytes before the anchor, MIN - K - high after it.
            g = xxhash.xxh3_64_intdigest(region[off - low : off + MIN - high], high << 8 | low)
            key, one = (g, off - i, region[i : j + MIN]), (doc, h, place + i)
            other = self.met.setdefault(key, one)
            if other != one:
                self.met[key], late = min(one, other), max(one, other)
                self.repeats.append((*late, j - i + 1))

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(g, doc, h, s << 16 | (len(part) - MIN + 1) << 8 | off, part) for (g, off, part), (doc, h, s) in self.met.items()]
        rows += [(n, doc, h, s << 16, None) for doc, h, s, n in self.repeats]
        self.met, self.repeats = {}, []
        if rows:
            g, doc, h, loc, part = zip(*rows, strict=True)
            ints = [pa.array(np.array(x, np.uint64).view(np.int64)) if x is g else pa.array(x, pa.int64()) for x in (g, doc, h, loc)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(part, pa.binary())], ["g", "doc", "h", "loc", "part"])

    @property
    def size(self) -> int:
        return len(self.met) + len(self.repeats)


def cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, h, text, marks) to PARTS rows of the marked regions, cut in two."""
    parts = Parts(1)
    for batch in batches:
        for doc, h, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for loc in marks:
                s, n = loc >> 16, loc >> 8 & 255
                parts.cut(doc, h, s, n, loc & 255, text[s : s + n - 1 + MIN])
                if parts.size >= ROWS // 4:
                    yield from parts.flush()
    yield from parts.flush()


def cut_again(level: int):
    """PARTS rows to those of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(level)
        for batch in batches:
            for doc, h, loc, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.cut(doc, h, loc >> 16, loc >> 8 & 255, loc & 255, part)
            if parts.size >= ROWS // 4:
                yield from parts.flush()
        yield from parts.flush()

    return run


class Side:
    """A part's bytes with prefix hashes, seen from its anchor."""

    def __init__(self, row: dict):
        self.key, self.loc, self.bytes = (row["doc"], row["h"], row["loc"] >> 16), row["loc"], row["part"]
        self.anchor = row["loc"] & 255
        self.sums = prefix_hashes(np.frombuffer(self.bytes, np.uint8)).tolist()

    def hash(self, i: int, j: int) -> int:
        return (self.sums[j] - self.sums[i]) * BACK[i] & (2**64 - 1)


BACK = powers(INVERSE, 512).tolist()


def right(x: Side, y: Side) -> int:
    """Length of the common extension from the anchors on."""
    low, high = 0, min(len(x.bytes) - x.anchor, len(y.bytes) - y.anchor)
    while low < high:
        mid = (low + high + 1) // 2
        if x.hash(x.anchor, x.anchor + mid) == y.hash(y.anchor, y.anchor + mid):
            low = mid
        else:
            high = mid - 1
    return low


def left(x: Side, y: Side) -> int:
    """Length of the common extension before the anchors."""
    low, high = 0, min(x.anchor, y.anchor)
    while low < high:
        mid = (low + high + 1) // 2
        if x.hash(x.anchor - mid, x.anchor) == y.hash(y.anchor - mid, y.anchor):
            low = mid
        else:
            high = mid - 1
    return low


def compare(x: Side, y: Side) -> int:
    """Order of the suffixes from the anchors on: by the first byte after their common extension, or by length."""
    n = right(x, y)
    a, b = x.bytes[x.anchor + n : x.anchor + n + 1], y.bytes[y.anchor + n : y.anchor + n + 1]
    return (a > b) - (a < b)


def repeats(rows: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, h, place, windows) of windows in parts that an earlier part holds too."""
    order = sorted((Side(row) for row in rows), key=functools.cmp_to_key(compare))  # a merge sort
    common = [right(x, y) for x, y in zip(order, order[1:], strict=False)]
    for i, x in enumerate(order):
        shared = MIN
        for j in range(i + 1, len(order)):
            shared = common[j - 1] if j == i + 1 else min(shared, common[j - 1])
            y = order[j]
            before = left(x, y)
            if before + shared < MIN:
                if shared + min(x.anchor, SPAN) < MIN:
                    break  # so it is for all that follow
                continue
            if x.key == y.key:
                continue  # one place, in rows that repeat a document
            one, other = (z.bytes[z.anchor - before : z.anchor + shared] for z in (x, y))
            if one != other:  # equal hashes of different strings: one in 2**64
                before = matching(x.bytes[: x.anchor][::-1], y.bytes[: y.anchor][::-1])
                after = matching(x.bytes[x.anchor :], y.bytes[y.anchor :])
            else:
                after = shared
            late = max(x, y, key=lambda z: z.key)
            # Windows of the part only: those that hold the anchor, from where both agree to where they do no longer.
            if before + after >= MIN:
                yield (*late.key[:2], late.key[2] + late.anchor - before, before + after - MIN + 1)


def matching(a: bytes, b: bytes) -> int:
    """Length of the common start, byte by byte."""
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for rows in batch.column(0).to_pylist() for x in repeats(rows)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "h", "s", "n"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, h, s, n): n windows from byte s on are repeats. texts: (doc, h, text)."""
    rows = texts.mapInArrow(find_regions, FOUND)
    # One shuffle and one sort serve both windows.
    each = Window.partitionBy("a").orderBy("r", "doc", "h", "loc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("a", "r").orderBy("doc", "h", "loc")
    is_repeat, is_hot = F.col("loc").bitwiseAND(F.lit(0xFF00)) == 0, F.col("loc") < 0
    place = F.struct("doc", "h", "loc")
    seen = (
        rows.withColumn("lowest", F.first("r").over(each))
        .withColumn("highest", F.last("r").over(each))
        .withColumn("rank", F.row_number().over(same))
        .withColumn("later", F.first(place).over(same) != place)
    )
    kind = (
        F.when(is_hot, "mixed")
        .when(is_repeat, "repeat")
        .when(F.col("later"), "later")
        .when((F.col("rank") == 1) & (F.col("lowest") != F.col("highest")), "mixed")
    )
    held = seen.select("r", "doc", "h", F.when(is_hot, F.bitwise_not("loc")).otherwise(F.col("loc")).alias("loc"), kind.alias("kind"))
    held = stored(held.where("kind is not null"), "regions")
    n_windows = F.shiftright("loc", 8).bitwiseAND(F.lit(255))
    whole = held.where("kind in ('repeat', 'later')")
    spans = [whole.select("doc", "h", place_of().alias("s"), F.when(F.col("kind") == "repeat", F.col("r")).otherwise(n_windows).alias("n"))]
    marks = held.where("kind = 'mixed'").groupBy("doc", "h").agg(F.collect_set("loc").alias("marks"))
    parts = stored(texts.join(marks, ["doc", "h"]).select("doc", "h", "text", "marks").mapInArrow(cut_regions, PARTS), "parts-1")
    for level in range(2, LEVELS + 2):
        spans.append(parts.where("part is null").select("doc", "h", place_of().alias("s"), F.col("g").alias("n")))
        parts = parts.where("part is not null")
        sizes = stored(parts.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "part-sizes")
        if level > LEVELS:  # single windows
            firsts = parts.groupBy("g").agg(F.min(F.struct("doc", "h", "loc", "part")).alias("one"))
            again = parts.join(firsts, "g").where((F.struct("doc", "h", "loc") != F.struct("one.doc", "one.h", "one.loc")) & (F.col("part") == F.col("one.part")))
            spans.append(again.select("doc", "h", place_of().alias("s"), F.lit(1).cast("long").alias("n")))
            break
        few = parts.join(sizes.where(F.col("c") <= CAP), "g").groupBy("g").agg(F.collect_list(F.struct("doc", "h", "loc", "part")).alias("rows"))
        spans.append(few.select("rows").mapInArrow(compared, SPANS))
        large = sizes.where(F.col("c") > CAP).select("g")
        if large.isEmpty():
            break
        parts = stored(parts.join(large, "g").select("doc", "h", "loc", "part").mapInArrow(cut_again(level), PARTS), f"parts-{level}")
    return functools.reduce(DataFrame.unionByName, spans)


def remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """(row, text, spans) to (row, n_bytes, n_removed, n_spans, kept); as_text leaves out cut characters."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, at, count, cut = [], 0, 0, 0
            for s, n in sorted((x["s"], x["n"]) for x in spans or ()):
                end = s + n - 1 + MIN
                if s > at or not count:
                    kept.append(text[at:s])
                    count += 1
                    cut += end - s
                    at = end
                elif end > at:
                    cut += end - at
                    at = end
            kept.append(text[at:])
            whole = b"".join(kept)
            out.append((len(text), cut, count, whole.decode(errors="ignore") if as_text else whole))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): row has docs' other columns, kept the bytes or the text that stay."""
    texts = keyed(docs, id_col, text_col)
    spans = repeated_spans(texts.select("doc", "h", "text")).groupBy("doc", "h").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    joined = texts.join(spans, ["doc", "h"], "left").select("row", "text", "spans")
    fields = f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept "
    return joined.mapInArrow(lambda batches: remove(batches, as_text), fields + ("string" if as_text else "binary"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats removed from the texts; all rows stay, some with an empty text."""
    done = without_repeats(docs, id_col=id_col, text_col=text_col, as_text=True)
    return done.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and a digest of what stays."""
    done = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
