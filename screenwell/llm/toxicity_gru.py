"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of two inputs: a hashed word vector and the mean of hashed vectors of its character runs (three and four
letters, ends marked).  Two recurrent layers read a window of `SPAN` words in both directions; attention
weighs their states, and the pooled state gives a logit.  All windows of a text, `STRIDE` apart, are scored; the
text's score is the calibrated largest logit.

Training.  Labels belong to texts, not windows.  So the network first learns from random windows under their text's
label, then twice from the windows that it finds worst in each text.  Last, a logistic curve from the largest
logit to the label is fitted, with the weights that undo the sample's balance.  The sample is bounded: `PER_LABEL`
texts of each label, by a hash of the key, of `SAMPLE_CHARS` characters at most in all (a text that does not fit is left out).
Held-out texts, crc32 of the key modulo 4 being 2, are never in it.

Edge cases.  Null and empty texts are one window of no words and get its score.  A null key counts as the empty
text in the hash.  Of several labels of a key the largest counts; labels without key or value are not used.  Without
texts of both labels every score is 0 or, if all are toxic, 1.  Repeated rows give a row each, an empty table
no rows, and other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import map_rows, words

SPAN, STRIDE = 32, 20
SIZE, STATE = 16, 12
BUCKETS = 8192
PER_LABEL = 1200
SAMPLE_CHARS = 12_000_000
THRESHOLD = 0.3
#: One text in so many is kept from training, for the calibration.
ASIDE = 5
HELD_OUT = 2
ROWS = 150_000


class Net(NamedTuple):
    """Word vectors, character vectors, input and state weights (update, reset, candidate gates) of both
    directions, attention, output; then slope and shift of the calibration."""

    word: np.ndarray
    chars: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    bias: np.ndarray
    att: np.ndarray
    att_bias: np.ndarray
    att_out: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    curve: np.ndarray


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Net(draw(0.1, BUCKETS, SIZE), draw(0.1, BUCKETS, SIZE), draw(0.3, 2, SIZE, 3 * STATE),
               draw(0.3, 2, STATE, 3 * STATE), np.zeros((2, 1, 3 * STATE), np.float32), draw(0.3, 2 * STATE, STATE),
               np.zeros(STATE, np.float32), draw(0.3, STATE), draw(0.3, 2 * STATE), np.zeros(1, np.float32),
               np.array([1, 0], np.float32))


# -- inputs ----------------------------------------------------------------------------------------


def runs(word: bytes) -> list[int]:
    """Buckets of the word's character runs (of UTF-8 bytes), ends marked."""
    w = b"<" + word + b">"
    return [zlib.crc32(w[i:i + n]) % BUCKETS for n in (3, 4) for i in range(max(1, len(w) - n + 1))]


class Inputs(NamedTuple):
    """Of a list of words: word buckets, character buckets end to end, where each word's begin, how many they are."""

    word: np.ndarray
    chars: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(vocabulary: list[bytes]) -> Inputs:
        found = [runs(w) for w in vocabulary]
        count = np.array([len(r) for r in found], np.int64)
        return Inputs(np.array([zlib.crc32(w) % BUCKETS for w in vocabulary], np.int64),
                      np.array([b for r in found for b in r], np.int64), np.cumsum(count) - count, count)

    def vectors(self, net: Net) -> np.ndarray:
        return net.word[self.word] + np.add.reduceat(net.chars[self.chars], self.begin) / self.count[:, None].astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows; a text without words has one, of none."""
    count = 1 + np.maximum(0, -(-(lengths - SPAN) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first, np.minimum(SPAN, lengths[text] - first)


def gather(flat: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word numbers per window and place; 0 stands for no word."""
    place = np.arange(SPAN)
    at = (offsets[text] + first)[:, None] + place
    return np.where(place < size[:, None], flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else 0, 0)


# -- the network ----------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(net: Net, gates: np.ndarray, keep: bool = False):
    """Logits of windows from their words' gate inputs (place, direction, window, 3 x state)."""
    steps, n = len(gates), gates.shape[2]
    h = np.zeros((2, n, STATE), np.float32)
    states = np.empty((steps, 2, n, STATE), np.float32)
    tape = []
    for t in range(steps):
        x = np.stack([gates[t, 0], gates[steps - 1 - t, 1]])
        zr = sigmoid(x[..., :2 * STATE] + h @ net.wh[..., :2 * STATE])
        z, r = zr[..., :STATE], zr[..., STATE:]
        c = np.tanh(x[..., 2 * STATE:] + (r * h) @ net.wh[..., 2 * STATE:])
        if keep:
            tape.append((h, z, r, c))
        h = h + z * (c - h)
        states[t, 0], states[steps - 1 - t, 1] = h[0], h[1]
    both = np.concatenate([states[:, 0], states[:, 1]], axis=-1)
    seen = np.tanh(both @ net.att + net.att_bias)
    weight = seen @ net.att_out
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[..., None] * both).sum(0)
    logits = pooled @ net.out + net.out_bias[0]
    return (logits, (tape, both, seen, weight, pooled)) if keep else logits


def gate_inputs(net: Net, vectors: np.ndarray) -> np.ndarray:
    """(direction, word, 3 x state)."""
    return vectors @ net.wx + net.bias


def backward(net: Net, ids: np.ndarray, inputs: Inputs, vectors: np.ndarray, kept, grad: np.ndarray) -> Net:
    """Gradient of everything but the curve, given that of the logits; `ids` are the windows' rows of `inputs`."""
    tape, both, seen, weight, pooled = kept
    steps, n = both.shape[:2]
    d_out, d_pool = pooled.T @ grad, grad[:, None] * net.out
    d_weight = np.einsum("tnk,nk->tn", both, d_pool)
    d_both = weight[..., None] * d_pool
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_seen = d_score[..., None] * net.att_out * (1 - seen ** 2)
    d_both += d_seen @ net.att.T
    d_gates = np.zeros((steps, 2, n, 3 * STATE), np.float32)
    d_wh = np.zeros_like(net.wh)
    dh = np.zeros((2, n, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c = tape[t]
        dh = dh + np.stack([d_both[t, :, :STATE], d_both[steps - 1 - t, :, STATE:]])
        dc = dh * z * (1 - c ** 2)
        dz = dh * (c - h) * z * (1 - z)
        d_rh = dc @ net.wh[..., 2 * STATE:].transpose(0, 2, 1)
        dr = d_rh * h * r * (1 - r)
        d_zr = np.concatenate([dz, dr], axis=-1)
        d_wh[..., :2 * STATE] += h.transpose(0, 2, 1) @ d_zr
        d_wh[..., 2 * STATE:] += (r * h).transpose(0, 2, 1) @ dc
        d_x = np.concatenate([d_zr, dc], axis=-1)
        d_gates[t, 0], d_gates[steps - 1 - t, 1] = d_x[0], d_x[1]
        dh = dh * (1 - z) + d_rh * r + d_zr @ net.wh[..., :2 * STATE].transpose(0, 2, 1)
    per_word = np.zeros((2, len(vectors), 3 * STATE), np.float32)
    for d in (0, 1):
        np.add.at(per_word[d], ids.T.ravel(), d_gates[:, d].reshape(-1, 3 * STATE))
    d_vec = (per_word @ net.wx.transpose(0, 2, 1)).sum(0)
    d_word, d_chars = np.zeros_like(net.word), np.zeros_like(net.chars)
    np.add.at(d_word, inputs.word, d_vec)
    np.add.at(d_chars, inputs.chars, np.repeat(d_vec / inputs.count[:, None].astype(np.float32), inputs.count, axis=0))
    flat = both.reshape(-1, 2 * STATE)
    return Net(d_word, d_chars, vectors.T @ per_word, d_wh, per_word.sum(1, keepdims=True),
               flat.T @ d_seen.reshape(-1, STATE), d_seen.sum((0, 1)), np.einsum("tnk,tn->k", seen, d_score), d_out,
               np.array([grad.sum()], np.float32), np.zeros(2, np.float32))


class Adam:
    def __init__(self, net: Net, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]

    def step(self, net: Net, grads: Net) -> None:
        self.t += 1
        for p, g, m, v in zip(net, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-6)


class Scorer:
    """Texts to largest logits; gate inputs of words seen lately are kept, `ROWS` of them at most between batches."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.row = {b"": 0}
        self.table = gate_inputs(self.net, Inputs.of([b""]).vectors(self.net))

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window of texts given as words."""
        if len(self.row) > ROWS:
            self.reset()
        new = list(set().union(*texts).difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.table = np.concatenate([self.table, gate_inputs(self.net, Inputs.of(new).vectors(self.net))], axis=1)
        flat = np.array([self.row[w] for ws in texts for w in ws], np.int64)
        lengths = np.array([len(ws) for ws in texts], np.int64)
        text, first, size = windows(lengths)
        offsets = np.cumsum(lengths) - lengths
        out = np.empty(len(text), np.float32)
        for i in range(0, len(text), 4096):
            part = slice(i, i + 4096)
            ids = gather(flat, offsets, text[part], first[part], size[part])
            out[part] = forward(self.net, self.table[:, ids.T].transpose(1, 0, 2, 3))
        return text, out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        split = [words(t) for t in texts]
        text, logit = self.logits(split)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, text, logit)
        slope, shift = self.net.curve
        return sigmoid(np.clip(slope * top + shift, -30, 30).astype(np.float64))


# -- training --------------------------------------------------------------------------------------------


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 7, batch: int = 384,
          rounds: tuple[int, ...] = (40, 30, 20), rate: float = 0.02) -> Net:
    """A network from texts and their labels; `weights` count for the calibration only."""
    net = new_net(seed)
    if not len(labels) or labels.min() == labels.max():
        return net._replace(curve=np.array([0, 30 if len(labels) and labels[0] else -30], np.float32))
    rng = np.random.default_rng(seed)
    split = [words(t) for t in texts]
    vocabulary = [b"", *sorted(set().union(*split) - {b""})]
    number = {w: i for i, w in enumerate(vocabulary)}
    flat = np.array([number[w] for ws in split for w in ws], np.int64)
    lengths = np.array([len(ws) for ws in split], np.int64)
    offsets = np.cumsum(lengths) - lengths
    text, first, size = windows(lengths)
    adam = Adam(net, rate)
    common = common_buckets(split)
    for table, seen in zip((net.word, net.chars), common):
        table *= seen

    def tops() -> tuple[np.ndarray, np.ndarray]:
        """The worst window of each text, and its logit."""
        logit = Scorer(net).logits(split)[1]
        order = np.lexsort((logit, text))
        last = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        return last, logit[last]

    aside = np.arange(len(labels)) % ASIDE == 0
    if labels[aside].min() == labels[aside].max() or labels[~aside].min() == labels[~aside].max():
        aside[:] = False   # too few texts to leave some out of the training
    learnt = ~aside[text]
    toxic, clean = learnt & (labels[text] == 1), learnt & (labels[text] == 0)
    pool = (np.flatnonzero(toxic), np.flatnonzero(clean))
    for stage, steps in enumerate(rounds):
        if stage:
            worst = tops()[0]
            pool = (worst[~aside & (labels == 1)], worst[~aside & (labels == 0)])
        for _ in range(steps):
            half = rng.choice(pool[1], batch // 2)
            if stage:   # the worst of clean texts, and any of them
                half[::2] = rng.choice(np.flatnonzero(clean), len(half[::2]))
            picked = np.concatenate([rng.choice(pool[0], batch // 2), half])
            ids = gather(flat, offsets, text[picked], first[picked], size[picked])
            ids[rng.random(ids.shape) < 0.1] = 0   # words go missing, so that no single one decides by chance
            own, local = np.unique(ids, return_inverse=True)
            inputs = Inputs.of([vocabulary[i] for i in own])
            local = local.reshape(ids.shape)
            vectors = inputs.vectors(net)
            logits, kept = forward(net, gate_inputs(net, vectors)[:, local.T].transpose(1, 0, 2, 3), keep=True)
            wrong = (sigmoid(logits) - labels[text[picked]]) / len(picked)
            grads = backward(net, local, inputs, vectors, kept, wrong.astype(np.float32))
            adam.step(net, grads._replace(word=grads.word * common[0], chars=grads.chars * common[1]))
    judged = aside if aside.any() else np.ones(len(labels), bool)
    return net._replace(curve=calibrate(tops()[1][judged], labels[judged], weights[judged]))


def common_buckets(split: list[list[bytes]], share: int = 200, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """1 for word and character buckets met in `least` texts, and one text in `share`; the vectors of others stay 0,
    so that texts are not told apart by words of their own."""
    texts = np.zeros((2, BUCKETS), np.int64)
    for ws in split:
        own = Inputs.of(list(set(ws)))
        texts[0, np.unique(own.word)] += 1
        texts[1, np.unique(own.chars)] += 1
    return tuple((texts >= max(least, len(split) // share)).astype(np.float32)[:, :, None])


def calibrate(logit: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope and shift of the weighted logistic fit, slightly held towards slope 1."""
    x, w = np.stack([logit, np.ones_like(logit)]).astype(np.float64), weights / weights.sum()
    theta, prior = np.array([1.0, 0.0]), np.array([1e-3, 1e-6])
    def loss(theta: np.ndarray) -> float:
        return float(w @ (np.logaddexp(0, theta @ x) - labels * (theta @ x)) + 0.5 * prior @ (theta - [1, 0]) ** 2)

    for _ in range(50):
        p = sigmoid(np.clip(theta @ x, -30, 30))
        grad = x @ (w * (p - labels)) + prior * (theta - [1, 0])
        hess = (x * (w * p * (1 - p))) @ x.T + np.diag(prior) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
    theta[0] = max(theta[0], 0.05)
    return theta.astype(np.float32)


# -- on Spark ---------------------------------------------------------------------------------------------


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> Net:
    """Train on a bounded sample of labelled texts that are not held out."""
    usable = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).dropna()
              .groupBy("key").agg(F.max("y").alias("y")).filter(remainder(F.col("key")) != HELD_OUT))
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).filter("y in (0, 1)").collect()}
    order = [F.xxhash64(F.col("key").cast("string")), F.col("key")]
    parts = [usable.filter(F.col("y") == y).orderBy(*order).limit(per_label) for y in (1, 0)]
    chosen = F.broadcast(parts[0].union(parts[1]))   # 2 x per_label rows at most
    sizes = documents.select(F.col(key).alias("key"), F.length(text).alias("n")).join(chosen, "key").groupBy("key").agg(
        F.max("n").alias("n")).orderBy(*order).collect()
    fits, used = [], 0
    for r in sizes:
        if r["n"] is not None and used + r["n"] <= sample_chars:
            used += r["n"]
            fits.append((r["key"],))
    if not fits:
        return train([], np.zeros(0), np.zeros(0))
    kind = documents.schema[key].dataType
    kept = documents.sparkSession.createDataFrame(fits, T.StructType([T.StructField("key", kind)]))
    rows = (documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(kept), "key")
            .groupBy("key").agg(F.max("text").alias("text")).join(chosen, "key").orderBy(*order).collect())
    y = np.array([r["y"] for r in rows], np.int64)
    share = {v: totals[v] / max(1, (y == v).sum()) for v in totals}
    return train([r["text"] for r in rows], y, np.array([share[v] for v in y], float))


def score(documents: DataFrame, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, score and predicted (score at `THRESHOLD` or more)."""
    held = documents.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(held.value)

        def run(texts):
            for i in range(0, len(texts), 512):
                for p in scorer(texts[i:i + 512]).tolist():
                    yield p, int(p >= THRESHOLD)

        return run

    return map_rows(documents.select(F.col(key), F.col(text).alias("scored text")),
                    [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, [key])


def report(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    scored = score(documents, fit(documents, labels, key, text), key, text)
    return scored.select(key, (remainder(F.col(key)) == HELD_OUT).alias("held_out"), "score", "predicted")
