"""LM scoring: a small causal self-attention model, written and trained in numpy, over subword ids.

A token's probability is that of its group, times that of its bin in the group, both from attention over the tokens before
it, times the token's share within group and bin. Groups hold tokens with like neighbours, the bins of a group tokens of like
frequency, the most frequent ones alone.

Everything the model starts from is counted over all training documents: tokens, which tokens stand beside which, which
groups and bins follow which. The attention weights then learn what these counts don't tell, from every window of every
training document: in each of ROUNDS rounds, every Spark task goes over one in ROUNDS windows of its documents, other ones in
each round, and the tasks' weights are averaged by their windows. The weights depend a little on how the input is split into
tasks.

A text is read in windows of WIDTH tokens that overlap by WIDTH - STEP; each window scores its last STEP tokens, so every
token is scored once, with at least WIDTH - STEP places before it, which hold the end's sign where the text has no more
tokens. Windows are run many at a time, under a mask that hides later tokens.

Null and empty texts are scored as their end alone. Rows without an id are held out; every row gets a result of its own, and
repeated rows equal ones (scores are rounded to PLACES decimals). An empty table gives none; with nothing to learn from, all tokens are equally likely. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored
from bazaarlake.llm.tokens import coder, tokenizer_path
from bazaarlake.llm.word_model import LISTED, base_scores, id_type, listing, word_counts

WIDTH, STEP, SIZE, HIDDEN = 32, 16, 16, 16
GROUPS, BINS, OWN = 32, 16, 1000
#: Buckets of neighbours before, and after, that tokens are told apart by.
NEAR = 16
#: Rounds of learning, of how many windows each takes one (as many: all are met); windows in a step; the rate of steps.
ROUNDS = SHARE = 2
BATCH, RATE = 128, 0.03
#: Windows of a step whose gradients are worked out at once: arrays of this size stay in a core's cache, and in memory that is kept.
PART = 64
#: Ids read at once; windows scored at once; slices of sums; counts that a prior is worth; the log of no probability.
AT_ONCE, RUN, SUMS, PRIOR, NEVER = 200_000, 128, 64, 20.0, -60.0
#: Decimals of a score: the last bits of 32-bit products depend on what they are multiplied with.
PLACES = 4

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    """end: the id after the last subword id; of each id its cell (group and bin), log10 share within it, and input row.

    by_group: log probabilities of groups after each cell; by_bin: of bins in each group after each cell.
    """

    end: int
    cell: np.ndarray
    share: np.ndarray
    row: np.ndarray
    by_group: np.ndarray
    by_bin: np.ndarray
    weights: Weights


# The model.

#: Places between each of a window's last STEP places and all of its places; WIDTH for later ones.
APART = np.arange(WIDTH - STEP, WIDTH)[:, None] - np.arange(WIDTH)
APART[APART < 0] = WIDTH
#: The number that each weight of an input row has among all of them.
NUMBERS = np.arange((OWN + GROUPS * BINS) * SIZE).reshape(-1, SIZE)


def visible(w: Weights) -> np.ndarray:
    """What a window's last STEP places see of its places: 0 of later ones, and more or less by distance."""
    return np.append(np.exp(w["distance"]), w["distance"].dtype.type(0))[APART]


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention of each window, its sums by place, and what its last places attend to; k and v of all places, q of the last."""
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= seen
    total = a.reshape(-1, WIDTH) @ np.ones((WIDTH, 1), a.dtype)
    met = (a @ v).reshape(-1, v.shape[-1])
    met /= total
    return a, total, met


def chances(model: Model, y: np.ndarray, last: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Natural logs of the target cells' probabilities after cells last; y with the hidden layer; exponentials of groups, then bins; their
    two sums; the targets' groups, then bins, among the exponentials."""
    w, groups = model.weights, model.by_group.shape[1]
    both = np.empty((len(y), SIZE + HIDDEN), y.dtype)
    both[:, :SIZE] = y
    h = y @ w["up"]
    h += w["up0"]
    np.maximum(h, 0, out=both[:, SIZE:])
    logits = both @ w["head"]
    group, bin_ = np.divmod(target, BINS)
    logits[:, :groups] += model.by_group.take(last, axis=0)
    logits[:, groups:] += model.by_bin.reshape(-1, BINS).take(last * groups + group, axis=0)
    np.clip(logits, NEVER, 30, out=logits)
    at = np.arange(0, logits.size, logits.shape[1])
    spots = np.concatenate([at + group, at + (groups + bin_)])
    found = logits.reshape(-1).take(spots)
    p = np.exp(logits, out=logits)
    sums = p @ np.repeat(np.eye(2, dtype=p.dtype), [groups, BINS], axis=0)
    return found[: len(at)] + found[len(at) :] - np.log(sums[:, 0] * sums[:, 1]), both, p, sums, spots


def gradients(model: Model, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the places that count, of windows of inputs and targets of their last STEP places; its gradient by each weight.

    Windows go PART at a time, and the gradients are sums over all of them.
    """
    w = model.weights
    kind = w["embed"].dtype
    rows, last, target = model.row.take(inputs), model.cell.take(inputs[:, WIDTH - STEP :]).reshape(-1), model.cell.take(targets).reshape(-1)
    weight = (counts.reshape(-1) / max(1, counts.sum())).astype(kind)
    scale = 1 / np.sqrt(SIZE).astype(kind)
    made = {"query": w["query"] * scale, "key and value": np.concatenate([w["key"], w["value"]], axis=1), "seen": visible(w)}
    g = {k: np.zeros_like(x) for k, x in (made | {k: w[k] for k in ("up", "up0", "head")}).items()}
    dx = np.empty((*inputs.shape, SIZE), kind)
    loss = 0.0
    for at in range(0, len(inputs), PART):
        part, places = slice(at, at + PART), slice(at * STEP, (at + PART) * STEP)
        loss += add_gradients(model, made, g, dx[part], rows[part], last[places], target[places], weight[places])
    both = g.pop("key and value")
    g |= {"query": g["query"] * scale, "key": both[:, :SIZE], "value": both[:, SIZE:]}
    g["distance"] = np.bincount(APART.reshape(-1), g.pop("seen").reshape(-1))[:WIDTH].astype(kind)
    numbers = NUMBERS.take(rows.reshape(-1), axis=0).reshape(-1)
    g["embed"] = np.bincount(numbers, dx.reshape(-1), w["embed"].size).reshape(-1, SIZE).astype(kind)
    return loss, g


def add_gradients(
    model: Model, made: Weights, g: Weights, dx: np.ndarray, rows: np.ndarray, last: np.ndarray, target: np.ndarray, weight: np.ndarray
) -> float:
    """Loss of some windows, by weight of each of their last places; adds to the gradients g, and sets those by each place's input, dx.

    made: what products take of the weights. Products are those of all windows at once where they can be.
    """
    w, groups = model.weights, model.by_group.shape[1]
    x, own = w["embed"].take(rows, axis=0), w["embed"].take(rows[:, WIDTH - STEP :], axis=0)
    flat_x, flat_own = x.reshape(-1, SIZE), own.reshape(-1, SIZE)
    q = (flat_own @ made["query"]).reshape(own.shape)
    kv = (flat_x @ made["key and value"]).reshape(len(x), WIDTH, 2 * SIZE)
    k, v = kv[..., :SIZE], kv[..., SIZE:]
    a, total, met = attend(q, k, v, made["seen"])
    y = met + flat_own
    logs, both, d, sums, spots = chances(model, y, last, target)
    d *= (weight[:, None] / sums) @ np.repeat(np.eye(2, dtype=d.dtype), [groups, BINS], axis=1)
    d.reshape(-1)[spots] -= np.concatenate([weight, weight])
    g["head"] += both.T @ d
    dboth = d @ w["head"].T
    dh = dboth[:, SIZE:] * (both[:, SIZE:] > 0)
    g["up"] += y.T @ dh
    g["up0"] += np.ones(len(dh), dh.dtype) @ dh
    dy = dh @ w["up"].T
    dy += dboth[:, :SIZE]
    # By attention before it is divided by its sums: what a place attends to is its mean by a.
    by_sum = dy / total
    dmet = by_sum.reshape(own.shape)
    ds = dmet @ v.transpose(0, 2, 1)
    met *= by_sum
    ds -= (met @ np.ones((SIZE, 1), met.dtype)).reshape(len(x), STEP, 1)
    ds *= a
    g["seen"] += ds.sum(axis=0)
    dq = (ds @ k).reshape(-1, SIZE)
    dkv = np.empty_like(kv)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :SIZE])
    np.matmul(a.transpose(0, 2, 1), dmet, out=dkv[..., SIZE:])
    flat_dkv = dkv.reshape(-1, 2 * SIZE)
    g["query"] += flat_own.T @ dq
    g["key and value"] += flat_x.T @ flat_dkv
    np.matmul(flat_dkv, made["key and value"].T, out=dx.reshape(-1, SIZE))
    dy += dq @ made["query"].T
    dx[:, WIDTH - STEP :] += dy.reshape(own.shape)
    return -float(logs @ weight)


class Adam:
    """Steps along the gradient, by its running mean and variance; changes the weights in place, which become parts of one vector."""

    def __init__(self, w: Weights):
        self.w, self.t = w, 0
        self.all = np.concatenate([x.reshape(-1) for x in w.values()])
        self.m, self.v, self.d = (np.zeros_like(self.all) for _ in range(3))
        at = np.cumsum([x.size for x in w.values()])[:-1]
        w.update({k: part.reshape(w[k].shape) for k, part in zip(list(w), np.split(self.all, at), strict=True)})

    def step(self, g: Weights, rate: float) -> None:
        self.t += 1
        m, v, d = self.m, self.v, self.d
        np.concatenate([g[k].reshape(-1) for k in self.w], out=d)
        m *= 0.9
        m += 0.1 * d
        v *= 0.99
        d *= d
        d *= 0.01
        v += d
        np.divide(v, 1 - 0.99**self.t, out=d)
        np.sqrt(d, out=d)
        d += 1e-8
        np.divide(m, d, out=d)
        d *= rate / (1 - 0.9**self.t)
        self.all -= d


# Texts.


class Stream:
    """Texts of ids that close with the end, one after the other, each from a multiple of STEP on, STEP ends before it.

    Window b scores the ids from b * STEP on; windows of no text score nothing.
    """

    def __init__(self, texts: list[np.ndarray], end: int):
        self.sizes = np.array([len(x) for x in texts])
        blocks = -(-self.sizes // STEP)
        first = np.cumsum(blocks + 1) - blocks
        self.blocks = int(blocks.sum()) + len(texts)
        self.before = np.cumsum(self.sizes) - self.sizes
        self.at = np.repeat(first * STEP - self.before, self.sizes) + np.arange(int(self.sizes.sum()))
        self.ids = np.full(self.blocks * STEP, end, np.int64)
        self.ids[self.at] = np.concatenate(texts)
        self.inputs = np.concatenate(([end], self.ids[:-1]))
        self.inputs[(first - 1) * STEP] = end  # not the last of the text before
        self.counts = np.zeros(len(self.ids), bool)
        self.counts[self.at] = True
        #: Each window's number in its text, from 1; 0 for the ends before it.
        self.nth = np.arange(self.blocks) - np.repeat(first - 1, blocks + 1)
        self.text = np.repeat(np.arange(len(texts)), blocks + 1)

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of each window, targets of its last STEP places, and which of these count."""
        at = pick[:, None] * STEP + np.arange(STEP - WIDTH, STEP)
        return self.inputs[at], self.ids.reshape(-1, STEP)[pick], self.counts.reshape(-1, STEP)[pick]


def scores(model: Model, texts: list[np.ndarray], at_once: int = RUN) -> np.ndarray:
    """log10 probability of each text of ids that closes with the end."""
    w, stream = model.weights, Stream(texts, model.end)
    # A place's query, key and value follow from its row alone: tables of them.
    query, key, value = w["embed"] @ w["query"] / np.float32(np.sqrt(SIZE)), w["embed"] @ w["key"], w["embed"] @ w["value"]
    seen = visible(w)
    rows, last, target = model.row[stream.inputs], model.cell[stream.inputs], model.cell[stream.ids]
    logs = np.zeros(len(stream.ids))
    for b in range(1, stream.blocks, at_once):
        to = min(b + at_once, stream.blocks)
        part = slice(b * STEP, to * STEP)
        around, own = rows[(b - 1) * STEP : to * STEP], rows[part]
        k, v = overlapping(key.take(around, axis=0)), overlapping(value.take(around, axis=0))
        shape = (to - b, STEP, SIZE)
        y = attend(query.take(own, axis=0).reshape(shape), k, v, seen)[2]
        y += w["embed"].take(own, axis=0)
        logs[part] = chances(model, y, last[part], target[part])[0]
    found = logs[stream.at] / np.log(10) + model.share[stream.ids[stream.at]]
    return np.add.reduceat(found, stream.before)


def overlapping(places: np.ndarray) -> np.ndarray:
    """Windows of WIDTH places, STEP apart, as a view."""
    row, column = places.strides
    count = (len(places) - WIDTH) // STEP + 1
    return np.lib.stride_tricks.as_strided(places, (count, WIDTH, places.shape[1]), (STEP * row, row, column), writeable=False)


def texts_of(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[list[np.ndarray]]:
    """Texts of ids, about AT_ONCE ids at a time, from the last column of batches."""
    for batch in batches:
        held: list[np.ndarray] = []
        size = 0
        for data in batch.column(batch.num_columns - 1):
            held.append(np.frombuffer(data.as_buffer(), kind))
            size += len(held[-1])
            if size > AT_ONCE:
                yield held
                held, size = [], 0
        if held:
            yield held


# What is learned.


def mixed(ids: np.ndarray) -> np.ndarray:
    """A bucket of NEAR for each id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % NEAR


def chained(texts: list[np.ndarray], end: int) -> np.ndarray:
    """Ids of texts one after the other, each after an end."""
    first = np.array([end], texts[0].dtype)
    return np.concatenate([part for x in texts for part in (first, x)]).astype(np.int64)


def neighbours(texts: DataFrame, end: int) -> np.ndarray:
    """Of each id and the end: how often it occurs, and beside ids of each bucket, before (NEAR) and after (NEAR)."""
    kind = id_type(end)
    width = 2 * NEAR

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros((end + 1) * width, np.int64), mixed(np.arange(end + 1))
        for held in texts_of(batches, kind):
            ids = chained(held, end)
            one, other = ids[:-1], ids[1:]
            inside = other != end  # what an end starts is another text
            inside |= one != end
            one, other = one[inside], other[inside]
            np.add.at(total, other * width + bucket.take(one), 1)
            np.add.at(total, one * width + NEAR + bucket.take(other), 1)
        total = total.reshape(-1, width)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([x.tobytes() for x in total[used].astype("<i8")], pa.binary())], ["id", "near"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = np.frombuffer(data, "<i8")
                total[k] = total[k] + near if k in total else near
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["id", "near"])

    schema = "id long, near binary"
    found = np.zeros((end + 1, width))
    for k, data in texts.select("ids").mapInArrow(count, schema).repartition("id").mapInArrow(add, schema).collect():  # the vocabulary at most
        found[k] = np.frombuffer(data, "<i8")
    return found


def grouped(near: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A group of GROUPS - 1 for each id, by its neighbours and whether it ends a word; the last group is for ids that don't occur."""
    group = np.full(len(counts), GROUPS - 1)
    used = np.flatnonzero(counts)
    if len(used) < 4 * GROUPS:
        group[used] = 0
        return group
    points = features(near[used], counts[used], ends[used])
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    weight = np.log1p(counts[used])
    centre = [points[int(counts[used].argmax())]]
    while len(centre) < GROUPS - 1:  # far from those before, and not a rare id
        centre.append(points[int(((1 - (points @ np.array(centre).T).max(axis=1)) * weight).argmax())])
    centre = np.array(centre)
    for _ in range(15):
        nearest = (points @ centre.T).argmax(axis=1)
        for k in range(GROUPS - 1):
            if (nearest == k).any():
                centre[k] = (points[nearest == k] * weight[nearest == k, None]).sum(axis=0)
                centre[k] /= np.linalg.norm(centre[k]) + 1e-9
    group[used] = nearest
    return group


def features(near: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How the shares of each id's neighbours differ from those of all, and whether it ends a word; rare ids count as nearly average."""
    usual = near.sum(axis=0) / max(1, near.sum())
    shares = np.sqrt((near + 20 * usual) / (near.sum(axis=1, keepdims=True) + 20)) - np.sqrt(usual)
    shares /= shares.std() + 1e-9
    return np.hstack([shares, (2 * ends[:, None] - 1) * 2.0])


def prepared(near: np.ndarray, ends: np.ndarray, seed: int = 7) -> Model:
    """A model from neighbours' counts whose weights have learned nothing. ends: ids that end a word."""
    end = len(near) - 1
    counts = near[:, :NEAR].sum(axis=1)
    group = grouped(near, counts, ends)
    cell = np.zeros(end + 1, np.int64)
    for k in range(GROUPS):
        own = np.flatnonzero(group == k)
        own = own[np.argsort(-counts[own], kind="stable")]
        mass = (counts[own] + 0.5) ** 0.75
        before = np.cumsum(mass) - mass
        cell[own] = k * BINS + np.minimum(BINS * before / max(mass.sum(), 1e-9), BINS - 1).astype(np.int64)
    mass = np.bincount(cell, counts + 0.5, GROUPS * BINS)
    share = np.log10((counts + 0.5) / mass[cell])
    row = OWN + cell
    frequent = np.argsort(-counts, kind="stable")[:OWN]
    row[frequent] = np.arange(len(frequent))
    rng = np.random.default_rng(seed)

    def init(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    # Input rows start from what their ids' neighbours are.
    found = features(near, counts, ends)
    weight = counts + 0.5
    total = np.bincount(row, weight, OWN + GROUPS * BINS)
    mean = np.array([np.bincount(row, weight * column, len(total)) for column in found.T]).T / np.maximum(total, 1e-9)[:, None]
    embed = mean @ rng.standard_normal((mean.shape[1], SIZE)) / np.sqrt(mean.shape[1])
    embed = embed / (embed.std(axis=1, keepdims=True) + 1e-3) + 0.3 * rng.standard_normal(embed.shape)
    embed = embed.astype(np.float32)
    w = {"embed": embed, "query": init(SIZE, SIZE), "key": init(SIZE, SIZE), "value": init(SIZE, SIZE), "distance": np.zeros(WIDTH, np.float32)}
    w |= {"up": init(SIZE, HIDDEN), "up0": np.zeros(HIDDEN, np.float32), "head": np.zeros((SIZE + HIDDEN, GROUPS + BINS), np.float32)}
    model = Model(end, cell, share, row, np.zeros((0, GROUPS)), np.zeros((0, GROUPS, BINS)), w)
    return with_order(model, mass, np.zeros((GROUPS * BINS, GROUPS, BINS)))


def with_order(model: Model, mass: np.ndarray, after: np.ndarray) -> Model:
    """model with probabilities from counts of groups with bins after each cell. mass: of each cell.

    Cells that are seldom met lean on what follows their group, groups on what is usual.
    """
    mass = mass.reshape(GROUPS, BINS)
    usual = mass.sum(axis=1) / mass.sum()
    within = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)

    def leaning(counts: np.ndarray, on: np.ndarray) -> np.ndarray:
        return (counts + PRIOR * on) / (counts.sum(axis=-1, keepdims=True) + PRIOR)

    of_group = after.reshape(GROUPS, BINS, GROUPS, BINS).sum(axis=1)
    by_group = leaning(after.sum(axis=2), np.repeat(leaning(of_group.sum(axis=2), usual), BINS, axis=0))
    by_bin = leaning(after, np.repeat(leaning(of_group, within), BINS, axis=0))
    logs = (np.maximum(np.log(np.maximum(p, 1e-30)), NEVER).astype(np.float32) for p in (by_group, by_bin))
    return replace(model, **dict(zip(("by_group", "by_bin"), logs, strict=True)))


def summed(texts: DataFrame, function, shape: int) -> tuple[int, np.ndarray]:
    """Sums over all tasks of function(batches), a number and shape floats; tasks add up a slice each for the driver."""

    def rows(found: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        n, data = ([x[k] for x in found.values()] for k in (0, 1))
        arrays = [pa.array(list(found), pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["slice", "n", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, values = function(batches)
        if n:
            yield rows({k: (n, part) for k, part in enumerate(np.array_split(values.astype("<f8"), SUMS))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for k, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, total = found.get(k, (0, 0.0))
                found[k] = n + m, total + np.frombuffer(data, "<f8")
        yield rows(found)

    schema = "slice long, n long, values binary"
    found = sorted(tuple(r) for r in texts.mapInArrow(run, schema).repartition(SUMS, "slice").mapInArrow(add, schema).collect())
    return (found[0][1], np.concatenate([np.frombuffer(r[2], "<f8") for r in found])) if found else (0, np.zeros(shape))


def ordered(texts: DataFrame, sent: Broadcast, kind: str) -> np.ndarray:
    """How often each group and bin follow each cell, over all texts."""
    cells = GROUPS * BINS

    def count(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
        model, n, total = sent.value, 0, np.zeros(cells * cells, np.int64)
        for held in texts_of(batches, kind):
            found = model.cell.take(chained(held, model.end))
            inside = np.ones(len(found), bool)
            inside[np.cumsum([len(x) + 1 for x in held])[:-1]] = False  # the end before a text
            np.add.at(total, (found[:-1] * cells + found[1:])[inside[1:]], 1)
            n += len(found)
        return n, total

    return summed(texts.select("ids"), count, cells * cells)[1].reshape(cells, GROUPS, BINS)


def chosen(stream: Stream, texts: list[np.ndarray], turn: int, share: int = SHARE, rounds: int = ROUNDS) -> np.ndarray:
    """The windows that a round learns from: every share-th of each text, from one that the text and the round tell.

    As share is the number of rounds, each window of each text is met in one of them.
    """
    mark = np.array([int(x[:8].sum()) + len(x) for x in texts])
    return np.flatnonzero((stream.nth > 0) & ((stream.nth + mark[stream.text] + turn * max(1, share // rounds)) % share == 0))


def learn(model: Model, adam: Adam, texts: list[np.ndarray], turn: int, share: int = SHARE, rounds: int = ROUNDS) -> int:
    """Steps over the round's windows of each text, in mixed order; their number."""
    stream = Stream(texts, model.end)
    model = replace(model, weights=adam.w)
    pick = chosen(stream, texts, turn, share, rounds)
    pick = pick[np.random.default_rng(len(pick)).permutation(len(pick))]
    for at in range(0, len(pick), BATCH):
        part = pick[at : at + BATCH]
        _, g = gradients(model, *stream.windows(part))
        adam.step(g, RATE * len(part) / BATCH * min(1, (adam.t + 1) / 20))
    return len(pick)


def learned(texts: DataFrame, sent: Broadcast, kind: str, turn: int, share: int = SHARE, rounds: int = ROUNDS) -> tuple[int, Weights]:
    """The number of windows that all tasks learned from, and the mean of the tasks' weights."""

    def teach(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
        model, n = sent.value, 0
        adam = Adam({k: x.copy() for k, x in model.weights.items()})
        for held in texts_of(batches, kind):
            n += learn(model, adam, held, turn, share, rounds)
        return n, np.concatenate([x.reshape(-1) for x in adam.w.values()]).astype(float) * n

    weights = sent.value.weights
    sizes = [x.size for x in weights.values()]
    n, total = summed(texts.select("ids"), teach, sum(sizes))
    if not n:
        return 0, weights
    parts = np.split((total / n).astype(np.float32), np.cumsum(sizes)[:-1])
    return n, {k: p.reshape(x.shape) for (k, x), p in zip(weights.items(), parts, strict=True)}


def trained(texts: DataFrame, path: str) -> Model:
    """A model from texts (ids, each closing with the end)."""
    bpe = coder(path)
    end = bpe.whole.get_vocab_size()
    kind = id_type(end)
    ends = np.zeros(end + 1, bool)
    ends[[k for token, k in bpe.whole.get_vocab().items() if token.endswith("</w>")]] = True
    near = neighbours(texts, end)
    model = prepared(near, ends)
    send = texts.sparkSession.sparkContext.broadcast  # a model is as large as the vocabulary
    mass = np.bincount(model.cell, near[:, :NEAR].sum(axis=1) + 0.5, GROUPS * BINS)
    model = with_order(model, mass, ordered(texts, send(model), kind))
    for turn in range(ROUNDS):
        model = replace(model, weights=learned(texts, send(model), kind, turn)[1])
    return model


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    path = path or tokenizer_path()
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~held_out).alias("train"))
    listed = stored(rows.mapInArrow(listing(path), LISTED), "words-and-ids")
    texts = listed.where("ids is not null")
    counted = word_counts(listed)
    model = docs.sparkSession.sparkContext.broadcast(trained(texts.where("train"), path))
    kind = id_type(model.value.end)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(model.value, held) for held in texts_of([batch], kind)]
            columns = [*batch.columns[:-1], pa.array(np.concatenate(found).round(PLACES))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "train", "bag", "score"])

    schema = "block long, doc_id long, train boolean, bag binary, score double"
    scored = texts.select("block", "doc_id", "train", "bag", "ids").mapInArrow(score, schema)
    found = base_scores(listed, counted, scored)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by words alone and by the model."""
    return score_texts(read(spark, sf_dir, "documents"))
