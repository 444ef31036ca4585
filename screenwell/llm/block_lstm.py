"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page.

A page is read into its leaf blocks (`html_blocks`).  A block enters as the sum of hashed vectors of the tokens on its tag path,
the mean of hashed vectors of its words (damped where these are few), and a few measures (length, share of links, place).  Two recurrent
layers of numpy read the whole sequence of blocks in both directions, so every block is judged with all the
others in sight.  The blocks kept, joined by one space, are the text.

Training.  Pages that mark their article themselves (`article` or `main`, without `nav`, `aside`, `form`, `footer` or `header`
inside and out) label themselves.  Practice pages (`html_layouts`) set texts of the same pages into drawn layouts, as other sites
name and nest things otherwise.  The sample is bounded: `SAMPLE` pages by a hash of url and key, each of `SAMPLE_CHARS`
characters at most, and `LAYOUTS` practice pages.  Scoring reads every page whole.

Edge cases.  Null, empty and blank pages, and such without visible text, have an empty text.  Malformed pages are
read as far as they go.  Repeated rows and null keys give a row each, an empty table no rows.  A table without a page that marks its
article is learnt from practice pages alone.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import map_rows, named, words
from screenwell.llm.html_blocks import Leaf, Reader
from screenwell.llm.html_layouts import KEEP, Layout

SIZE, STATE = 24, 16
TAGS, WORDS, MEASURES = 4096, 8192, 8
SAMPLE, SAMPLE_CHARS, LAYOUTS = 240, 60_000, 4000
ROUNDS, BATCH, RATE = 3, 24, 0.01
#: Added to a block's number of words in their mean, so that one or two unknown words do not decide.
DAMP = 3
#: Times that a page which labels itself comes up in a round; share of blocks without words in training.
REAL, MUTE = 5, 0.4
#: Tokens and words looked up lately, in each task.
CACHE = 200_000
ASIDE = frozenset("t:nav t:aside t:form t:footer t:header".split())


class Net(NamedTuple):
    """Token and word vectors, weights of the measures; input and state weights (input, forget, output gate, value) of both
    directions; output weights of the states, of the input, and a shift."""

    tag: np.ndarray
    word: np.ndarray
    measure: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_own: np.ndarray
    out_bias: np.ndarray


def new_net(seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    bias = np.zeros((2, 1, 4 * STATE), np.float32)
    bias[..., STATE:2 * STATE] = 1
    return Net(draw(0.2, TAGS, SIZE), draw(0.1, WORDS, SIZE), draw(0.2, MEASURES, SIZE), draw(0.2, 2, SIZE, 4 * STATE),
               draw(0.2, 2, STATE, 4 * STATE), bias, draw(0.2, 2 * STATE), draw(0.2, SIZE), np.zeros(1, np.float32))


# -- inputs ----------------------------------------------------------------------------------------


class Inputs(NamedTuple):
    """Blocks end to end: token numbers and word numbers with each block's begin and count, what each word counts for, measures,
    blocks of each page."""

    tags: np.ndarray
    tag_at: np.ndarray
    tag_n: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    word_n: np.ndarray
    word_share: np.ndarray
    measures: np.ndarray
    pages: np.ndarray


class Encoder:
    """Blocks to `Inputs`; hashes of tokens and words seen lately are kept."""

    def __init__(self) -> None:
        self.paths: dict[tuple, list[int]] = {}
        self.buckets: dict[bytes, int] = {}

    def path(self, path: tuple) -> list[int]:
        """Tokens of all elements, those of the nearest two marked as such once more."""
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= CACHE // 10:
                self.paths.clear()
            near = [f"{i}{token}" for i, tokens in enumerate(path[:2]) for token in tokens]
            found = self.paths[path] = sorted({zlib.crc32(x.encode()) % TAGS for tokens in path for x in tokens} |
                                              {zlib.crc32(x.encode()) % TAGS for x in near} or {0})
        return found

    def numbers(self, ws: list[bytes]) -> list[int]:
        known = self.buckets
        if len(known) >= CACHE:
            known.clear()
        new = set(ws).difference(known)
        known.update((w, zlib.crc32(w) % WORDS) for w in new)
        return [known[w] for w in ws]

    def __call__(self, pages: list[list[Leaf]]) -> Inputs:
        tags, tag_n, ids, word_n, measures = [], [], [], [], []
        for leaves in pages:
            n = len(leaves)
            for i, leaf in enumerate(leaves):
                path = self.path(leaf.path)
                tags += path
                tag_n.append(len(path))
                numbers = self.numbers(words(leaf.text)) or [0]
                ids += numbers
                word_n.append(len(numbers))
                size = len(leaf.text)
                measures.append((1.0, len(numbers) ** 0.5 / 6, min(2.0, size / 400), leaf.linked / max(1, size), i / n, (n - i) / n,
                                 float(leaf.text[-1] in ".!?:;\"”»"), leaf.text.count(",") / max(4, len(numbers)) * 4))
        tag_n, word_n = np.array(tag_n, np.int64), np.array(word_n, np.int64)
        return Inputs(np.array(tags, np.int64), np.cumsum(tag_n) - tag_n, tag_n, np.array(ids, np.int64), np.cumsum(word_n) - word_n,
                      word_n, (1 / (word_n + DAMP)).astype(np.float32), np.array(measures, np.float32).reshape(-1, MEASURES), np.array([len(p) for p in pages], np.int64))


def block_vectors(net: Net, x: Inputs) -> np.ndarray:
    if not len(x.tag_n):
        return np.zeros((0, SIZE), np.float32)
    path = np.add.reduceat(net.tag[x.tags], x.tag_at) / np.sqrt(x.tag_n)[:, None].astype(np.float32)
    text = np.add.reduceat(net.word[x.words], x.word_at) * x.word_share[:, None]
    return np.tanh(path + text + x.measures @ net.measure)


# -- the network ----------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _order(pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages by falling length: their first blocks, lengths, and how many are as long as each step."""
    order = np.argsort(-pages, kind="stable")
    length = pages[order]
    first = (np.cumsum(pages) - pages)[order]
    most = int(length[0]) if len(length) else 0
    return first, length, np.searchsorted(-length, -np.arange(most), "left")


def forward(net: Net, vectors: np.ndarray, pages: np.ndarray, keep: bool = False):
    """Logits of all blocks; only the pages that still have blocks take part in a step."""
    first, length, active = _order(pages)
    states = np.zeros((2, len(vectors), STATE), np.float32)
    tape: list[list] = [[], []]
    for d in (0, 1):
        gates = vectors @ net.wx[d] + net.bias[d]
        h = c = np.zeros((len(pages), STATE), np.float32)
        for t, n in enumerate(active):
            at = first[:n] + (t if d == 0 else length[:n] - 1 - t)
            z = gates[at] + h[:n] @ net.wh[d]
            s = sigmoid(z[:, :3 * STATE])
            i, f, o, v = s[:, :STATE], s[:, STATE:2 * STATE], s[:, 2 * STATE:], np.tanh(z[:, 3 * STATE:])
            if keep:
                tape[d].append((at, h[:n], c[:n], i, f, o, v))
            c = f * c[:n] + i * v
            h = o * np.tanh(c)
            states[d, at] = h
    both = np.concatenate([states[0], states[1]], axis=1)
    logits = both @ net.out + vectors @ net.out_own + net.out_bias[0]
    return (logits, (tape, both)) if keep else logits


def backward(net: Net, x: Inputs, vectors: np.ndarray, kept, grad: np.ndarray) -> Net:
    """Gradient of everything, given that of the logits."""
    tape, both = kept
    d_vec = grad[:, None] * net.out_own
    d_wx, d_wh, d_bias = np.zeros_like(net.wx), np.zeros_like(net.wh), np.zeros_like(net.bias)
    for d in (0, 1):
        d_both = grad[:, None] * net.out[d * STATE:(d + 1) * STATE]
        d_gates = np.zeros((len(vectors), 4 * STATE), np.float32)
        most = len(tape[d][0][0]) if tape[d] else 0
        dh, dc = np.zeros((most, STATE), np.float32), np.zeros((most, STATE), np.float32)
        for at, h, c, i, f, o, v in reversed(tape[d]):
            n = len(at)
            now = np.tanh(f * c + i * v)
            up = dh[:n] + d_both[at]
            down = dc[:n] + up * o * (1 - now ** 2)
            dz = np.concatenate([down * v * i * (1 - i), down * c * f * (1 - f), up * now * o * (1 - o), down * i * (1 - v ** 2)], axis=1)
            d_gates[at] = dz
            d_wh[d] += h.T @ dz
            dh[:n], dc[:n] = dz @ net.wh[d].T, down * f
        d_wx[d], d_bias[d, 0] = vectors.T @ d_gates, d_gates.sum(0)
        d_vec += d_gates @ net.wx[d].T
    d_in = d_vec * (1 - vectors ** 2)
    d_tag, d_word = np.zeros_like(net.tag), np.zeros_like(net.word)
    np.add.at(d_tag, x.tags, np.repeat(d_in / np.sqrt(x.tag_n)[:, None].astype(np.float32), x.tag_n, axis=0))
    np.add.at(d_word, x.words, np.repeat(d_in * x.word_share[:, None], x.word_n, axis=0))
    return Net(d_tag, d_word, x.measures.T @ d_in, d_wx, d_wh, d_bias, both.T @ grad, vectors.T @ grad,
               np.array([grad.sum()], np.float32))


# -- training --------------------------------------------------------------------------------------------


def own_labels(leaves: list[Leaf]) -> list[int] | None:
    """Labels of a page that marks its article; None where it does not."""
    names = [{x for tokens in leaf.path for x in tokens} for leaf in leaves]
    inside = [bool({"t:article", "t:main"} & n) for n in names]
    return [int(a and not n & ASIDE) for a, n in zip(inside, names)] if any(inside) else None


def practice(pool: list[str], number: int, seed: int) -> list[tuple[list[Leaf], list[int]]]:
    layout, reader, out = Layout(pool, seed), Reader(), []
    for _ in range(number):
        leaves = [leaf for leaf in reader.leaves(layout.page()) if len(leaf.text) > 1]
        marks = [leaf.text[0] for leaf in leaves]
        out.append(([leaf._replace(text=leaf.text[1:].strip() or "-") for leaf in leaves], [int(m == KEEP) for m in marks]))
    return out


def train(pages: list[tuple[list[Leaf], list[int]]], seed: int = 11, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE) -> Net:
    """A network from labelled pages, by Adam; the step size falls towards the end.

    The words of some blocks are left out at random, as tags must do where words are new.
    """
    net, rng, encoder = new_net(seed), np.random.default_rng(seed), Encoder()
    pages = [p for p in pages if p[0]]
    m, v, mean = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], Net(*[p.copy() for p in net])
    total, t = rounds * -(-len(pages) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(pages))
        for begin in range(0, len(order), batch):
            chosen = [pages[i] for i in order[begin:begin + batch]]
            x = encoder([p[0] for p in chosen])
            x = x._replace(word_share=x.word_share * (rng.random(len(x.word_n)) > MUTE))
            y = np.array([label for p in chosen for label in p[1]], np.float32)
            # Every page counts the same, so that long ones do not outweigh.
            weight = np.repeat(1 / np.sqrt(x.pages), x.pages).astype(np.float32)
            vectors = block_vectors(net, x)
            logits, kept = forward(net, vectors, x.pages, keep=True)
            grads = backward(net, x, vectors, kept, ((sigmoid(logits) - y) * weight / batch).astype(np.float32))
            t += 1
            step = rate * min(1.0, 2 * (1 - (t - 1) / total) + 0.02)
            for p, g, a, b in zip(net, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= step * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-6)
            if t > total // 2:     # the mean of the second half's networks varies less than the last one
                for p, q in zip(net, mean):
                    q += (p - q) / (t - total // 2)
    return mean if t > 1 else net


def fit(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE, layouts: int = LAYOUTS,
        seed: int = 11) -> Net:
    """A network learnt from a bounded sample of a table's pages."""
    size = F.length(named(html))
    drawn = pages.filter((size > 0) & (size <= SAMPLE_CHARS)).select(
        F.xxhash64(named(url), named(key)).alias("at"), named(html).alias("html")).orderBy("at", "html").limit(sample)
    reader = Reader()
    read = [reader.leaves(row["html"]) for row in drawn.collect()]
    labelled = [(leaves, own_labels(leaves)) for leaves in read]
    pool = sorted({leaf.text for leaves in read for leaf in leaves})
    return train([p for p in labelled if p[1]] * REAL + practice(pool, layouts, seed), seed)


# -- on Spark ----------------------------------------------------------------------------------------------


class Extractor:
    """Pages to the texts of their kept blocks and the blocks' numbers, kept and all."""

    def __init__(self, net: Net) -> None:
        self.net, self.reader, self.encoder = net, Reader(), Encoder()

    def labels(self, pages: list[list[Leaf]], together: int = 256) -> list[np.ndarray]:
        out = []
        for begin in range(0, len(pages), together):
            x = self.encoder(pages[begin:begin + together])
            logits = forward(self.net, block_vectors(self.net, x), x.pages)
            out += np.split(logits > 0, np.cumsum(x.pages)[:-1])
        return out

    def __call__(self, pages: list[str | None]) -> list[tuple[str, int, int]]:
        read = [self.reader.leaves(p) for p in pages]
        out = []
        for leaves, kept in zip(read, self.labels(read)):
            texts = [leaf.text for leaf, k in zip(leaves, kept) if k]
            out.append((" ".join(texts), len(texts), len(leaves)))
        return out


def extract(pages: DataFrame, net: Net, html: str = "html") -> DataFrame:
    """The other columns of `pages` and text, n_kept, n_blocks."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_kept", T.LongType()), T.StructField("n_blocks", T.LongType())]
    return map_rows(pages, fields, lambda: Extractor(net), [c for c in pages.columns if c != html])


def report(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", net: Net | None = None) -> DataFrame:
    """Per page: key, url, text, n_chars (code points), n_kept and n_blocks."""
    net = net or fit(pages, key, url, html)
    df = pages.select(named(key).alias("key"), named(url).alias("url"), named(html).alias("html"))
    return extract(df, net).select(F.col("key").alias(key), F.col("url").alias(url), "text",
                                   F.char_length("text").cast("long").alias("n_chars"), "n_kept", "n_blocks")
