"""Language identification: unigram models of word pieces, summed over every segmentation of each word.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over
all ways to cut it into pieces, of the product of their probabilities; the forward algorithm finds it place by
place, for many words and all languages at once. The probabilities come from expectation-maximisation with the same sums, on
a sample of about PER_LANGUAGE labelled documents of each language. Then every whole text is scored.

Words are runs of letters (Unicode's categories L), lower-cased; runs over LONGEST letters are scored in parts. Texts that are null or have no
letter are und, score 0. So is everything if no row can be learned from. Repeated rows each get their own row; an empty table
gives none. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import read

WORD = regex.compile(r"\p{L}+")
START = "▁"
LONGEST, FLOOR = 30, 1e-8
#: About how many documents of each language the model is fitted on.
PER_LANGUAGE = 1500
ROUNDS = 3
#: Words remembered in a worker before it starts afresh.
MEMO = 200_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of the vocabulary that are lower-case letters, with or without a word's start."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(k) for k in range(model.vocab_size())}
        kept = sorted(p for p in found if WORD.fullmatch(p.removeprefix(START)) and p == p.lower() and len(p) <= LONGEST + 1)
        self.longest = max(map(len, kept))
        self.n = len(kept)
        up = np.arange(LONGEST + 2)
        self.power = np.array([pow(BASE, int(k), 2**64) for k in up], np.uint64)
        self.back = np.array([pow(INVERSE, int(k), 2**64) for k in up], np.uint64)
        keys = np.array([sum((ord(c) + 1) * int(self.power[i]) for i, c in enumerate(p)) % 2**64 for p in kept], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def lattice(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """The words' sizes, and for each (end, length) the piece there of every word, n for none."""
        marked = [START + w for w in words]
        sizes = np.array([len(w) for w in marked])
        width = int(sizes.max())
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), np.uint32).reshape(-1, width)
        sums = np.zeros((len(words), width + 1), np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[:width], axis=1, out=sums[:, 1:])
        cells = {}
        for end in range(1, width + 1):
            for length in range(1, min(end, self.longest) + 1):
                key = (sums[:, end] - sums[:, end - length]) * self.back[end - length]
                at = np.minimum(np.searchsorted(self.keys, key), self.n - 1)
                cells[end, length] = np.where(self.keys[at] == key, self.order[at], self.n)
        return sizes, cells

    def forward(self, sizes: np.ndarray, cells: dict, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each word's first 0, 1, ... letters. p: a row for each piece and none, a column for each language."""
        width = int(sizes.max())
        alpha = np.zeros((width + 1, len(sizes), p.shape[1]))
        alpha[0] = 1
        for end in range(1, width + 1):
            alpha[end] = alpha[end - 1] * np.maximum(p[cells[end, 1]], FLOOR)
            for length in range(2, min(end, self.longest) + 1):
                piece = cells[end, length]
                hit = np.flatnonzero(piece < self.n)
                alpha[end][hit] += alpha[end - length][hit] * p[piece[hit]]
        return alpha

    def expected(self, sizes: np.ndarray, cells: dict, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations weighed by probability. p: one language."""
        column = p[:, None]
        alpha = self.forward(sizes, cells, column)[:, :, 0]
        width = int(sizes.max())
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(sizes))] = 1
        used = np.zeros(self.n + 1)
        total = counts / alpha[sizes, np.arange(len(sizes))]
        for end in range(width, 0, -1):
            for length in range(1, min(end, self.longest) + 1):
                piece = cells[end, length]
                chance = np.maximum(p[piece], FLOOR) if length == 1 else p[piece]
                used += np.bincount(piece, alpha[end - length] * chance * beta[end] * total, self.n + 1)
                beta[end - length] += chance * beta[end]
        return used[: self.n]

    def fit(self, words: list[str], counts: list[int], rounds: int = ROUNDS) -> np.ndarray:
        """A language's probability of each piece, and 0 for none."""
        p = np.append(np.full(self.n, 1 / self.n), 0.0)
        order = np.argsort([len(w) for w in words], kind="stable")
        parts = [order[at : at + 20_000] for at in range(0, len(order), 20_000)]
        weights = np.array(counts, float)
        for _ in range(rounds):
            used = np.zeros(self.n)
            for part in parts:
                sizes, cells = self.lattice([words[k] for k in part])
                used += self.expected(sizes, cells, p, weights[part])
            p[: self.n] = (used + 0.01) / (used.sum() + 0.01 * self.n)
        return p


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def words_of(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Scorer:
    """Log probabilities of words in every language, remembered."""

    def __init__(self, path: str, table: np.ndarray):
        self.pieces, self.table = pieces_of(path), table
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, self.table.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.row)
        if len(self.row) + len(new) > MEMO and self.row:
            self.clear()
            new = words
        found, order = [self.logs], sorted(new, key=len)
        for at in range(0, len(order), 8192):
            part = order[at : at + 8192]
            sizes, cells = self.pieces.lattice(part)
            alpha = self.pieces.forward(sizes, cells, self.table)
            found.append(np.log(np.maximum(alpha[sizes, np.arange(len(part))], 1e-300)))
        self.row.update(zip(order, range(len(self.row), len(self.row) + len(order)), strict=True))
        self.logs = np.concatenate(found)


def learn(docs: DataFrame, path: str, per_language: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece table, log prior) from (text, lang, pick); pick is uniform in 0 to 1 and chooses the sample."""
    shares = [(r["lang"], r["n"]) for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each language
    if not shares:
        return [], np.zeros((0, 0)), np.zeros(0)
    take = F.lit(0.0)
    for lang, n in shares:
        take = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(take)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "word", "n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = pieces_of(path).fit(words, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([p.tolist()])], ["lang", "p"])

    counted = docs.where(F.col("pick") < take).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    summed = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # One row a language, as long as the sample's words.
    lists = summed.groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("x")).select("lang", "x.word", "x.n")
    fitted = sorted((r["lang"], r["p"]) for r in lists.mapInArrow(fit, "lang string, p array<double>").collect())
    if not fitted:
        return [], np.zeros((0, 0)), np.zeros(0)
    n = dict(shares)
    langs = [x[0] for x in fitted]
    return langs, np.array([x[1] for x in fitted]).T.copy(), np.log([n[x] / sum(n.values()) for x in langs])


def identify(docs: DataFrame, train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id_col, lang_pred, score) of each row of docs; learned from the rows of train with a language."""
    path = path or vocabulary_path()
    pick = (F.xxhash64(id_col, text_col).bitwiseAND(F.lit(2**40 - 1)) / 2**40).alias("pick")
    known = train.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), pick)
    langs, table, prior = learn(known, path, per_language)
    model = docs.sparkSession.sparkContext.broadcast((langs, table, prior))  # languages times a fixed vocabulary
    held: list[Scorer] = []

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, prior = model.value
        for batch in batches:
            preds, scores = [], []
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            if langs:
                if not held:
                    held.append(Scorer(path, table))
                scorer = held[0]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                if langs:
                    scorer.learn(set().union(*part))
                for words in part:
                    if not words or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    rows = np.fromiter(map(scorer.row.__getitem__, words), np.int64, len(words))
                    logs = scorer.logs[rows].sum(axis=0) + prior
                    k = int(logs.argmax())
                    preds.append(langs[k])
                    scores.append(1 / math.fsum(np.exp(np.maximum(logs - logs[k], -700))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(predict, "key long, lang_pred string, score double").withColumnRenamed("key", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
