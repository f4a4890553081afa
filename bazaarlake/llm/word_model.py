"""Unigram word scores with corpus-wide counts, without moving a row for each word of each text.

Texts are read in blocks. A block lists its distinct words once, with counts over its training texts, and each text as a
sorted bag of places in that list. The words meet in one shuffle to be counted; counts return to their blocks where they
differ from the block's own, and every text is scored from its bag. So a very frequent word costs a row for each block,
not for each text, and a word of one block only is not sent back. Across blocks, words are told apart by a 64-bit hash
(XXH3): of a thousand million words two have one hash with a chance of some three in a hundred, and would share their count.

The same pass gives each text's subword ids, worked out once for each distinct word of a block.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import give_back, stored
from bazaarlake.llm.tokens import PRETOKEN, SAFE, SPECIAL, SPELT, WordBpe, coder

#: Bytes of text in a block, about, and split at once; words whose ids are put together at once; what ends each text, as a word that
#: no text holds.
BLOCK, PIECE, AT_ONCE = 28 << 20, 4 << 20, 200_000
END = b" "
LISTED = "block long, word long, i int, n int, doc_id long, train boolean, bag binary, ids binary"


def bag(places: np.ndarray) -> bytes:
    """Sorted places as differences, in 2 bytes each where that is enough."""
    steps = np.diff(np.sort(places), prepend=0)
    wide = len(steps) and steps.max() >= 1 << 16
    return (b"\4" if wide else b"\2") + steps.astype("<u4" if wide else "<u2").tobytes()


def unbag(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1), dtype=np.int64)


def id_type(n_ids: int) -> str:
    """The type of stored ids, the end among them."""
    return "<u2" if n_ids < 1 << 16 else "<u4"


class Made(dict):
    """The ids of pre-tokens, in 4 bytes each; new ones are worked out when they are looked up."""

    def __init__(self, bpe: WordBpe):
        super().__init__(bpe.single)
        self.bpe = bpe
        self.coded = [k.to_bytes(4, "little") for k in range(bpe.whole.get_vocab_size())]

    def __missing__(self, pretoken: str) -> bytes:
        coded, spelt = self.coded, pretoken if pretoken.isascii() else pretoken.translate(SPELT)
        found = self[pretoken] = b"".join([coded[t.id] for t in self.bpe.merge(spelt)])
        return found

    def ids(self, word: str) -> bytes:
        """Of a word in lower case."""
        return self[word] if word.isalpha() else b"".join(map(self.__getitem__, PRETOKEN.findall(word)))


class Block:
    """Texts, as places of their words in the block's list of distinct ones; what ends a text stands last there."""

    def __init__(self, path: str):
        self.bpe = coder(path)
        self.end = self.bpe.whole.get_vocab_size()
        self.type = id_type(self.end)
        self.words: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """batch: (doc_id, text, train)."""
        # ASCII functions: A-Z only, and ASCII white space only. Sessions may send large strings, which can't be joined again.
        bare = pc.ascii_trim_whitespace(pc.ascii_lower(batch.column(1).cast(pa.string())))
        split = pc.ascii_split_whitespace(bare)
        words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.binary_length(bare).to_numpy(zero_copy_only=False) == 0
        if blank.any():  # no words, and not one empty one
            words, sizes = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, sizes)
        self.words.append(words)
        self.sizes.append(sizes)
        for doc_id, text, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_word = SAFE.fullmatch(text) and not ("<|" in text and SPECIAL.search(text))  # the ids are those of the words
            self.docs.append((doc_id, train, None if by_word else self.bpe.ids(text)))
            self.size += len(text)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(self.words)
        self.words.clear()
        listed = words.dictionary_encode()
        distinct = listed.dictionary
        end = len(distinct)
        size = end + 1
        sizes = np.concatenate(self.sizes)
        places = np.insert(listed.indices.to_numpy(), np.cumsum(sizes), end)
        del words, listed
        sizes += 1
        n = np.bincount(places[np.repeat(np.array([doc[1] for doc in self.docs]), sizes)], minlength=size)
        if size >= 1 << 31 or n.max(initial=0) >= 1 << 31:
            raise ValueError("a block is too large")
        yield batch_of(block=pa.array([number]), bag=pa.array([n.astype("<u4").tobytes()], pa.binary()))
        flat, length, made = [], np.zeros(size, np.int64), Made(self.bpe)
        for at in range(0, size, AT_ONCE // 4):
            words, parts = [], []
            if part := len(own := distinct.slice(at, AT_ONCE // 4)):
                joined = pc.binary_join(pa.ListArray.from_arrays([0, part], own), " ")[0].as_py()  # no word holds a space
                words, parts = joined.encode().split(b" "), list(map(made.ids, joined.lower().split(" ")))
            if at + AT_ONCE // 4 >= size:
                words.append(END)
                parts.append(self.end.to_bytes(4, "little"))
            i = np.arange(at, at + len(words), dtype=np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
            yield batch_of(block=pa.array(np.full(len(words), number)), word=pa.array(hashes), i=pa.array(i), n=pa.array(n[i].astype(np.int32)))
            length[i] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            flat.append(np.frombuffer(b"".join(parts), "<u4").astype(self.type))
        del distinct, made
        flat, start = np.concatenate(flat), np.cumsum(length) - length
        first = np.cumsum(sizes) - sizes
        cuts = np.flatnonzero(np.diff(first // AT_ONCE)) + 1
        for docs, at in zip(np.split(np.arange(len(sizes)), cuts), np.split(places, first[cuts]), strict=True):
            yield self.texts(number, [self.docs[k] for k in docs], at, sizes[docs], flat, start, length)

    def texts(
        self, number: int, docs: list[tuple], at: np.ndarray, words: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray
    ) -> pa.RecordBatch:
        """Rows of docs. at: their words' places, one text's after the other's; words: how many each has."""
        sizes = length[at]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1])]
        last = np.cumsum(words)
        found = []
        for (_, _, own), part in zip(docs, np.split(ids, ends[last - 1][:-1]), strict=True):
            if own is not None:
                part = np.append(np.frombuffer(own, "<u4"), self.end).astype(self.type)
            found.append(part.tobytes())
        return batch_of(
            block=pa.array([number] * len(docs)),
            doc_id=pa.array([doc[0] for doc in docs], pa.int64()),
            train=pa.array([doc[1] for doc in docs]),
            bag=pa.array([bag(part) for part in np.split(at, last[:-1])], pa.binary()),
            ids=pa.array(found, pa.binary()),
        )


KINDS = pa.schema(
    [("block", pa.int64()), ("word", pa.int64()), ("i", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("bag", pa.binary()), ("ids", pa.binary())]
)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    """Columns of LISTED; null where none is given."""
    size = len(columns["block"])
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in KINDS], schema=KINDS)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch, cut before texts that begin another PIECE bytes."""
    size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE)) + 1
    for at, to in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
        yield batch.slice(at, to - at)


def listing(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, train) to rows for the words of a block, one for their counts, and rows for its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        block = Block(path)
        for batch in batches:
            for part in pieces(batch):
                block.add(part)
                if block.size >= BLOCK:
                    yield from block.rows(number)
                    block, number = Block(path), number + 1
        if block.docs:
            yield from block.rows(number)
        # The worker goes on to other stages: what blocks took needn't stay.
        del block
        give_back()

    return run


def word_counts(listed: DataFrame) -> DataFrame:
    """(block, i, n, c, once): the corpus count of each block's words; once is true in one row of each word."""
    of_word = Window.partitionBy("word")
    words = listed.where(F.col("word").isNotNull()).select("block", "i", "word", "n")
    counted = words.withColumn("c", F.sum("n").over(of_word)).withColumn("k", F.row_number().over(of_word.orderBy("block")))
    return stored(counted.select("block", "i", "n", "c", (F.col("k") == 1).alias("once")), "word-counts")


#: What a row tells of its block, in the order in which a task reads it: its words' own counts, a corpus count, a text.
OWN, CHANGED, HELD_OUT, TRAIN = range(4)


def base_scores(listed: DataFrame, counted: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score). scored: (block, doc_id, train, bag, score).

    A block's rows meet sorted, so a task holds the counts of one block at a time, and neither its texts nor its words.
    """
    total, distinct = counted.agg(F.sum("n"), F.count_if(F.col("once") & (F.col("c") > 0))).first()
    total = total or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = logs = np.zeros(0)
        for batch in batches:
            block, kind = (batch.column(k).to_numpy() for k in (0, 1))
            starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(kind) != 0)]).tolist()
            for at, to in itertools.pairwise([*starts, batch.num_rows]):
                part, of = batch.slice(at, to - at), kind[at]
                if of == OWN:
                    c, logs = np.frombuffer(part.column("bag")[0].as_py(), "<u4").astype(np.int64), None
                elif of == CHANGED:
                    c[part.column("i").to_numpy()] = part.column("number").to_numpy()
                else:
                    if logs is None:
                        logs = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
                    n_tokens, n_known, base = [], [], []
                    for data in part.column("bag"):
                        places = unbag(data.as_py())
                        n_tokens.append(len(places))
                        n_known.append(int((c[places] > 0).sum()))
                        base.append(float(logs[places].sum()))
                    ints = (pa.array(x, pa.int64()) for x in (n_tokens, n_known, [total] * len(base)))
                    arrays = [part.column("number"), pa.array([bool(of == TRAIN)] * len(base)), *ints, pa.array(base, pa.float64()), part.column("score")]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = {"i": "int", "number": "bigint", "score": "double", "bag": "binary"}

    def part(df: DataFrame, kind: Column | int, **values: str) -> DataFrame:
        given = (F.col(values[k]) if k in values else F.lit(None) for k in kinds)
        kind = F.lit(kind) if isinstance(kind, int) else kind
        return df.select("block", kind.alias("kind"), *(v.cast(t).alias(k) for v, (k, t) in zip(given, kinds.items(), strict=True)))

    rows = part(scored, F.when(F.col("train"), TRAIN).otherwise(HELD_OUT), number="doc_id", score="score", bag="bag")
    rows = rows.union(part(counted.where("c != n"), CHANGED, i="i", number="c"))
    rows = rows.union(part(listed.where("word is null and ids is null"), OWN, bag="bag"))
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)
