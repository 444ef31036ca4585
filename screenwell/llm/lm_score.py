"""Masked pseudo-likelihood: a bidirectional window network in numpy scores every token from both sides.

Tokens are words (`common.words`).  The network knows them by `VOCAB` hashed buckets: the two words on each side (past
the ends stands a padding bucket) enter as vectors, gated by their place; their sum through tanh predicts the bucket
in the middle.  Its distribution is a binary tree over the buckets, most frequent first, with a logistic unit in each
node, so a probability takes `DEPTH` units.  A word's probability is its bucket's times its own share of that bucket,
from a table of all words' counts, which grows with the input and stays in Spark.  A text's score is the sum of the
log-probabilities of all its tokens.

Texts are read once, in blocks: what is written of them are their buckets, and each block's words once, with their tokens and
the places of the texts that have them, so a frequent word costs a row per block.  A word's rows meet in one group, whose sum is its count; its
share goes from there to the texts.  Training and scoring read the buckets.

Training uses all texts.  Sums by bucket shape the tree.  Then, in each round, every text that one task read is learnt from
with one in `ROUNDS` of the positions masked, others in each round, so that every token is a target once; gradient steps go
from the common parameters, and the changes of what was touched are sent; Spark sums them by parameter, weighted by positions, and the averages
are the next parameters.  What is sent grows with the number of tasks; the driver and the broadcasts hold one model, whose size is fixed.

Targets are sorted by the subtree that holds their leaf: those of a subtree share the upper part of their paths, so that the units of all of
them are one product of matrices.

Edge cases.  Null and empty texts have no tokens, log-likelihood 0 and a null mean.  Repeated rows
give a row each, an empty table no rows (and an untrained model).  Other columns are not read.  A word that the table of
counts lacks, which only other documents than the counted ones can hold, has probability 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import map_rows, sliced, words, written

DEPTH = 12
VOCAB = 1 << DEPTH
SIDE = 2
SIZE = 16
ROUNDS = 2
RATE = 0.1
BATCH = 4096
#: Buckets as they are written.
IDS = "<i2"
#: Bits of a row's number below that of the task that read it.
TASK = 40


class Model(NamedTuple):
    """Word vectors (the last row pads), place gates, hidden bias, node vectors and biases; each bucket's rank."""

    vectors: np.ndarray
    gates: np.ndarray
    bias: np.ndarray
    nodes: np.ndarray
    node_bias: np.ndarray
    rank: np.ndarray


def new_model(counts: np.ndarray, seed: int = 11) -> Model:
    """Untrained, but each node's bias is the log odds of the counts below its branches."""
    rng = np.random.default_rng(seed)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(VOCAB, np.int64)
    rank[order] = np.arange(VOCAB)
    bias = []
    for depth in range(DEPTH):
        halves = (counts[order] + 0.5).reshape(2 ** depth, 2, -1).sum(2)
        bias.append(np.log(halves[:, 1] / halves[:, 0]))
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Model(draw(VOCAB + 1, SIZE), np.ones((2 * SIDE, SIZE), np.float32), np.zeros(SIZE, np.float32),
                 np.zeros((VOCAB - 1, SIZE), np.float32), np.concatenate(bias).astype(np.float32), rank)


def ids_of(text: str | None) -> np.ndarray:
    ws = words(text)
    return np.fromiter(map(zlib.crc32, ws), np.int64, len(ws)) & VOCAB - 1


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets around each place of a text."""
    padded = np.concatenate([np.full(SIDE, VOCAB), ids, np.full(SIDE, VOCAB)])
    return padded.take(at[:, None] + [o for o in range(2 * SIDE + 1) if o != SIDE])


def paths(rank: np.ndarray, height: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Nodes from the root to a leaf, and 1 where the path turns to the rarer half."""
    depth = np.arange(height)
    return (1 << depth) - 1 + (rank[:, None] >> (height - depth)), rank[:, None] >> (height - 1 - depth) & 1


#: Depth of the nodes below which a subtree hangs each.  The buckets of a subtree share their path down to it.
TOP = 6
LOW = DEPTH - TOP
GROUPS, WIDTH = 1 << TOP, TOP + (1 << LOW) - 1
#: For each subtree, the nodes of the path to it and its own, level by level.
_NODES = np.concatenate([paths(np.arange(GROUPS), TOP)[0], *[(GROUPS << d) - 1 + (np.arange(GROUPS)[:, None] << d) + np.arange(1 << d)
                                                             for d in range(LOW)]], axis=1)
#: For each node that belongs to a subtree, its place among all of theirs.
_HANGING = np.argsort(_NODES[:, TOP:].ravel())


class Tree(NamedTuple):
    """By bucket: nodes of its path, their columns among the nodes of its subtree, their turns and signs."""

    node: np.ndarray
    column: np.ndarray
    turn: np.ndarray
    sign: np.ndarray


def tree(rank: np.ndarray) -> Tree:
    node, turn = paths(rank)
    inner = paths(rank & (1 << LOW) - 1, LOW)[0] + TOP
    return Tree(node, np.concatenate([np.broadcast_to(np.arange(TOP), (len(rank), TOP)), inner], axis=1),
                turn.astype(np.float32), (1 - 2 * turn).astype(np.float32))


def by_subtree(rank: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order in which the targets of a subtree stand together, and where those of each subtree stand then."""
    group = (rank >> LOW).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return order, [(k, slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def gate_matrix(gates: np.ndarray) -> np.ndarray:
    """The gates as a matrix by which vectors side by side become their gated sum."""
    return (gates[:, :, None] * np.eye(SIZE, dtype=np.float32)).reshape(-1, SIZE)


def places(columns: np.ndarray, width: int) -> np.ndarray:
    """Columns of each row as places in the flat matrix."""
    return columns + np.arange(len(columns))[:, None] * width


def log_probability(m: Model, around: np.ndarray, target: np.ndarray, of: Tree | None = None) -> np.ndarray:
    """`of` is the model's tree, if made before."""
    of = of or tree(m.rank)
    order, groups = by_subtree(m.rank.take(target))
    target = target.take(order)
    h = m.vectors.take(around.take(order, axis=0), axis=0).reshape(len(target), -1) @ gate_matrix(m.gates)
    h += m.bias
    np.tanh(h, out=h)
    nodes, units = m.nodes.take(_NODES, axis=0), np.empty((len(target), WIDTH), np.float32)
    for k, here in groups:
        np.matmul(h[here], nodes[k].T, out=units[here])
    unit = units.take(places(of.column.take(target, axis=0), WIDTH))
    unit += m.node_bias.take(of.node.take(target, axis=0))
    unit *= of.sign.take(target, axis=0)
    np.clip(unit, -25, 25, out=unit)
    np.exp(unit, out=unit)
    unit += 1
    out = np.empty(len(target))
    out[order] = -np.log(unit.prod(1, dtype=np.float64))
    return out


#: Rows of a place that are added one by one, for all places at once; what is beyond is summed place by place.
FEW = 8


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray, spare: np.ndarray | None = None) -> None:
    """`out[at] += rows` where rows of the same place add up; `spare` is room for as many rows."""
    if not len(at):
        return
    order = np.argsort(at.astype(np.int16), kind="stable")   # radix sort; places are below 2 ** 15
    at, rows = at.take(order), rows.take(order, axis=0, out=spare, mode="clip")
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(starts, append=len(at))
    order = np.argsort(-sizes, kind="stable")   # the places of most rows come first
    starts, sizes = starts.take(order), sizes.take(order)
    sums = rows.take(starts, axis=0)
    longer = np.searchsorted(-sizes, -np.arange(FEW + 1))   # how many places have more rows than 0, 1, ...
    for n in range(1, FEW):
        sums[:longer[n]] += rows.take(starts[:longer[n]] + n, axis=0)
    if many := longer[FEW]:
        rest = sizes[:many] - FEW
        ends = np.cumsum(rest)
        of = np.repeat(starts[:many] + FEW - ends + rest, rest) + np.arange(ends[-1])
        sums[:many] += np.add.reduceat(rows.take(of, axis=0), ends - rest)
    out[at.take(starts)] += sums


class Learner:
    """Adagrad steps on a copy of a model, of `BATCH` targets at most; large arrays are made once."""

    def __init__(self, start: Model) -> None:
        self.m = start._replace(**{f: getattr(start, f).copy() for f in Model._fields[:5]})
        self.tree = tree(start.rank)
        self.square = [np.full_like(p, 1e-2) for p in self.m[:5]]
        self.grads = [np.zeros_like(p) for p in self.m[:5]]
        self.spare = [np.empty_like(p) for p in self.m[:5]]
        made = lambda *shape: np.empty(shape, np.float32)
        self.x, self.rows, self.ordered = made(BATCH, 2 * SIDE, SIZE), made(BATCH, 2 * SIDE * SIZE), made(BATCH * 2 * SIDE, SIZE)
        self.units, self.spread, self.hidden = made(BATCH, WIDTH), made(BATCH, WIDTH), made(BATCH, SIZE)
        self.subtrees = made(GROUPS, WIDTH, SIZE)
        self.seen = 0

    def gradients(self, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the summed loss, by parameter; valid up to the next call."""
        m, of, n, grads = self.m, self.tree, len(target), self.grads
        order, groups = by_subtree(m.rank.take(target))
        around, target = around.take(order, axis=0), target.take(order)
        mix = gate_matrix(m.gates)
        x = m.vectors.take(around, axis=0, out=self.x[:n], mode="clip")   # other modes copy; all places are inside
        h = np.matmul(x.reshape(n, -1), mix, out=self.hidden[:n])
        h += m.bias
        np.tanh(h, out=h)
        nodes, units, spread = m.nodes.take(_NODES, axis=0), self.units[:n], self.spread[:n]
        for k, here in groups:
            np.matmul(h[here], nodes[k].T, out=units[here])
        node, at = of.node.take(target, axis=0), places(of.column.take(target, axis=0), WIDTH)
        err = units.take(at)
        err += m.node_bias.take(node)
        np.clip(err, -30, 30, out=err)
        err = 1 / (1 + np.exp(-err)) - of.turn.take(target, axis=0)
        spread.fill(0)
        spread.put(at, err)   # errors in the columns of their nodes
        self.subtrees.fill(0)
        d_sum = np.empty_like(h)
        for k, here in groups:
            np.matmul(spread[here], nodes[k], out=d_sum[here])
            np.matmul(spread[here].T, h[here], out=self.subtrees[k])
        d_sum *= 1 - h * h
        grads[0].fill(0)
        add_rows(grads[0], around.ravel(), np.matmul(d_sum, mix.T, out=self.rows[:n]).reshape(-1, SIZE), self.ordered[:around.size])
        np.einsum("nks,ns->ks", x, d_sum, out=grads[1])
        d_sum.sum(0, out=grads[2])
        for d in range(TOP):
            grads[3][(1 << d) - 1:(2 << d) - 1] = self.subtrees[:, d].reshape(1 << d, -1, SIZE).sum(1)
        self.subtrees[:, TOP:].reshape(-1, SIZE).take(_HANGING, axis=0, out=grads[3][GROUPS - 1:], mode="clip")
        grads[4][:] = np.bincount(node.ravel(), err.ravel(), len(m.nodes))
        return grads

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        for p, g, s, spare in zip(self.m[:5], self.gradients(around, target), self.square, self.spare):
            g /= np.float32(len(target) / 64)
            s += np.multiply(g, g, out=spare)
            g *= np.float32(RATE)
            p -= np.divide(g, np.sqrt(s, out=spare), out=spare)
        self.seen += len(target)

    def changes(self, start: Model) -> tuple[np.ndarray, np.ndarray]:
        """Places in the flat parameters that were changed, and by how much."""
        flat = np.concatenate([(a - b).ravel() for a, b in zip(self.m[:5], start[:5])])
        at = np.flatnonzero(flat)
        return at, flat[at]


#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n: tokens of every word over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for part in sliced(batch):
                for t in part.column(0).to_pylist():
                    counts.update(words(t))
                    if len(counts) > HELD_WORDS:
                        yield out()
        yield out()

    return written(documents.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")), "lm_words")


def by_bucket(counts: DataFrame) -> DataFrame:
    """bucket, bucket_n: tokens of every bucket."""
    return counts.groupBy((F.crc32("word") % VOCAB).alias("bucket")).agg(F.sum("n").alias("bucket_n"))


def bucket_counts(counts: DataFrame) -> np.ndarray:
    out = np.zeros(VOCAB)
    for r in by_bucket(counts).collect():   # `VOCAB` rows at most
        out[r["bucket"]] = r["bucket_n"]
    return out


def count_buckets(documents: DataFrame, text: str) -> np.ndarray:
    """Tokens per bucket over all texts."""
    return bucket_counts(count_words(documents, text))


def count_ids(ids: DataFrame) -> np.ndarray:
    """Tokens per bucket of texts read before (`ids`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(VOCAB, np.int64)
        for batch in batches:
            for part in sliced(batch):
                for b in part.column(0).to_pylist():
                    n += np.bincount(np.frombuffer(b, IDS), minlength=VOCAB)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCAB)), pa.array(n)], names=["bucket", "n"])

    out = np.zeros(VOCAB)
    for r in ids.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]   # `VOCAB` rows at most
    return out


def masked(n: int, number: int, rounds: int) -> np.ndarray:
    """Positions of a text of n tokens that a round predicts; the rounds together have each once.

    They are dealt by a hash, so that a text of equal periods shows all its words in each round.
    """
    at = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero(((at ^ at >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(rounds) == number)


def first_row() -> int:
    """Number of a task's first row; no two tasks share a number."""
    return TaskContext.get().partitionId() << TASK


def read_ids(documents: DataFrame, text: str = "text") -> DataFrame:
    """row, ids: a number and the buckets of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first_row()
        for batch in batches:
            for part in sliced(batch):
                ids = [ids_of(t).astype(IDS).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.binary())], names=["row", "ids"])
                row += len(ids)

    return written(documents.select(F.col(text).alias("text")).mapInArrow(run, "row long, ids binary"), "lm_ids")


def round_of_training(ids: DataFrame, model: Model, number: int, rounds: int) -> Model:
    """The texts that one task read are learnt from together, however their files are dealt out now."""
    held = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, usual = held.value, masked(BATCH, number, rounds)
        task, learner, around, target, n = None, None, [], [], 0

        def out() -> pa.RecordBatch:
            if n:
                learner.step(np.concatenate(around), np.concatenate(target))
            at, change = learner.changes(start)
            weight = np.full(len(at), float(learner.seen))
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(change * weight), pa.array(weight)], names=["at", "change", "weight"])

        for batch in batches:
            for part in sliced(batch):
                for row, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if row >> TASK != task:
                        if learner:
                            yield out()
                        task, learner, around, target, n = row >> TASK, Learner(start), [], [], 0
                    text = np.frombuffer(b, IDS).astype(np.int64)
                    at = usual[:np.searchsorted(usual, len(text))] if len(text) <= BATCH else masked(len(text), number, rounds)
                    while len(at):
                        now, at = at[:BATCH - n], at[BATCH - n:]
                        around.append(contexts(text, now))
                        target.append(text[now])
                        n += len(now)
                        if n == BATCH:
                            learner.step(np.concatenate(around), np.concatenate(target))
                            around, target, n = [], [], 0
        if learner:
            yield out()

    rows = (ids.select("row", "ids").mapInArrow(run, "at long, change double, weight double")
            .groupBy("at").agg((F.sum("change") / F.sum("weight")).alias("change")).toArrow())   # one model's parameters
    flat = np.concatenate([p.ravel() for p in model[:5]])
    flat[rows.column("at").to_numpy()] += rows.column("change").to_numpy().astype(np.float32)
    ends = np.cumsum([p.size for p in model[:5]])
    return Model(*[part.reshape(p.shape) for part, p in zip(np.split(flat, ends[:-1]), model[:5])], model.rank)


def fit_ids(ids: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of texts read before, with the tokens of every bucket."""
    model = new_model(counts)
    for number in range(rounds):
        model = round_of_training(ids, model, number, rounds)
    return model


def fit(documents: DataFrame, text: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> Model:
    """A model of all texts; `counts` are theirs by `count_words`, if made before."""
    ids = read_ids(documents, text)
    return fit_ids(ids, count_ids(ids) if counts is None else bucket_counts(counts), rounds)


def score_text(model: Model, text: str | None) -> tuple[int, float]:
    """Tokens and the sum of their buckets' conditional log-probabilities."""
    ids = ids_of(text)
    total = 0.0
    for i in range(0, len(ids), BATCH):
        at = np.arange(i, min(i + BATCH, len(ids)))
        total += float(log_probability(model, contexts(ids, at), ids[at]).sum())
    return len(ids), total


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def read_block(texts: list[str | None]) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of each text; the words, their tokens, and for each in turn the texts that have it.

    The latter are ends of the words' ranges (after a 0), numbers of texts and tokens there.
    """
    numbers, read = Numbers(), []
    for t in texts:
        ws = words(t)
        read.append(np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)))
    bucket = (np.fromiter(map(zlib.crc32, numbers), np.int64, len(numbers)) & VOCAB - 1).astype(IDS)
    ids = [bucket.take(r).tobytes() for r in read]
    of = np.repeat(np.arange(len(texts)), [len(r) for r in read])
    numbered = np.concatenate([np.zeros(0, np.int64), *read])
    del read
    many = np.bincount(numbered, minlength=len(numbers))
    numbered *= len(texts)
    numbered += of
    pairs, n = np.unique(numbered, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(numbers) + 1) * len(texts))
    return ids, list(numbers), many, ends, pairs % len(texts), n


_BLOCK = [T.StructField("ids", T.BinaryType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()),
          T.StructField("first", T.LongType()), T.StructField("texts", T.ArrayType(T.IntegerType())),
          T.StructField("counts", T.ArrayType(T.IntegerType()))]


def read_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document (row, key, ids) and one per word of a block (word, n, first, texts, counts).

    The latter's texts are rows `first + texts`, its tokens n.
    """
    df = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", df.schema["key"].dataType), *_BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first_row()
        for batch in batches:
            for part in sliced(batch):
                ids, found, many, ends, texts, n = read_block(part.column("text").to_pylist())
                kinds = [pa.int64(), part.schema.field("key").type, pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                         pa.list_(pa.int32()), pa.list_(pa.int32())]
                rows, none = len(ids), lambda k, many: [pa.nulls(many, t) for t in k]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + rows)), part.column("key"), pa.array(
                    ids, pa.binary()), *none(kinds[3:], rows)], names=schema.names)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (texts, n)]
                made = pa.RecordBatch.from_arrays([*none(kinds[:3], len(found)), pa.array(found, pa.binary()), pa.array(many), pa.array(
                    np.full(len(found), row)), *lists], names=schema.names)
                for at in range(0, len(found), BATCH):
                    yield made.slice(at, BATCH)
                row += rows

    return written(df.mapInArrow(run, schema), "lm_blocks")


#: Tokens scored at a time.
LOT = 2 * BATCH


def score_ids(m: Model, read: list[np.ndarray], of: Tree, shares: np.ndarray) -> np.ndarray:
    """Of each text, the sum of its buckets' conditional log-probabilities and of their `shares`."""
    sizes = [len(r) for r in read]
    number = np.repeat(np.arange(len(read)), sizes)
    pad = np.full(SIDE, VOCAB)
    spaced = np.concatenate([pad, *(x for r in read for x in (r, pad))])
    at, sides = np.flatnonzero(spaced != VOCAB), np.array([o for o in range(-SIDE, SIDE + 1) if o])
    totals = np.zeros(len(read))
    for i in range(0, len(at), LOT):
        here, first = at[i:i + LOT], number[i]
        target = spaced.take(here)
        one = log_probability(m, spaced.take(here[:, None] + sides), target, of) + shares.take(target)
        sums = np.bincount(number[i:i + LOT] - first, one)
        totals[first:first + len(sums)] += sums
    return totals


def score_rows(blocks: DataFrame, model: Model, bucket_n: np.ndarray) -> DataFrame:
    """row, key, n_tokens, by_buckets: the log-likelihood but for the logarithms of the words' counts."""
    held = blocks.sparkSession.sparkContext.broadcast((model, -np.log(np.maximum(bucket_n, 1))))
    df = blocks.filter(F.col("row").isNotNull()).select("row", "key", "ids")
    schema = T.StructType([*df.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("by_buckets", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shares = held.value
        of = tree(m.rank)
        for batch in batches:
            for part in sliced(batch, 1 << 20):
                read = [np.frombuffer(b, IDS).astype(np.int64) for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), pa.array([len(r) for r in read], pa.int64()),
                                                  pa.array(score_ids(m, read, of, shares))], names=schema.names)

    return df.mapInArrow(run, schema)


def add_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of blocks with the logarithm of their counts to sums by row."""
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        many = c["texts"].value_lengths().to_numpy()
        rows = np.repeat(c["first"].to_numpy(), many) + c["texts"].flatten().to_numpy()
        share = np.repeat(c["log_n"].to_numpy(zero_copy_only=False), many) * c["counts"].flatten().to_numpy()
        rows, at = np.unique(rows, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, share, len(rows)))], names=["row", "by_share"])


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """Per document: key, n_tokens, log_likelihood (of all tokens) and mean_log_likelihood.

    `counts` are those of `count_words`; without them the log-likelihood is that of the tokens' buckets.
    """
    if counts is None:
        held = documents.sparkSession.sparkContext.broadcast(model)

        def make():
            m = held.value
            return lambda texts: (score_text(m, t) for t in texts)

        scored = map_rows(documents.select(F.col(key), F.col(text).alias("scored text")), [
            T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())], make, [key])
    else:
        blocks = read_blocks(documents, key, text)
        bucket_n = bucket_counts(counts)
        logs = counts.select("word", F.log("n").alias("log_n"))
        listed = _listed(blocks).join(logs, "word", "left").withColumn("log_n", F.coalesce("log_n", F.lit(float("-inf"))))
        scored = _summed(score_rows(blocks, model, bucket_n), listed, key)
    return _with_mean(scored)


def _listed(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("word").isNotNull()).select("word", "n", "first", "texts", "counts")


def _summed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Documents' sums by buckets, with those of their words' log_n."""
    sums = listed.select("first", "texts", "counts", "log_n").mapInArrow(add_shares, "row long, by_share double").groupBy("row").agg(
        F.sum("by_share").alias("by_share"))
    return rows.join(sums, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("by_buckets") + F.coalesce("by_share", F.lit(0.0))).alias("log_likelihood"))


def _with_mean(scored: DataFrame) -> DataFrame:
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def report(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores under a model of the documents themselves, every word by its own probability.

    Texts are read once; a word's blocks meet in one group, which has its count over all texts.
    """
    blocks = read_blocks(documents, key, text)
    ids = blocks.filter(F.col("row").isNotNull()).select("row", "ids")
    bucket_n = count_ids(ids)
    listed = _listed(blocks).withColumn("log_n", F.log(F.sum("n").over(Window.partitionBy("word"))))
    return _with_mean(_summed(score_rows(blocks, fit_ids(ids, bucket_n), bucket_n), listed, key))
