"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits.

Rules are compiled into one conditional expression; the longest that fits wins.  The trees are grown in numpy by
histograms of binned features (logistic loss), from labelled URLs; without labels of one's own, the URLs that
rules decide are the labelled ones.  Features: lengths, depths, digit ratio, entropy, counts of parameters and
marks, and smoothed label odds of the host's last label and last two labels.

Size.  The trees are fitted on `SAMPLE` labelled rows, chosen by a hash of the row.  Suffix counts cover all
labelled rows; they are kept by hashed bucket, so the model that is sent to tasks has a fixed size.

Edge cases.  A null URL, or one without `://`, has empty host and path, fits no rule and is judged by its features
(null as the empty text).  Repeated rows give a row each, an empty table no rows.  With labels of one kind the model
always answers that kind, with none it allows.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import map_rows

SAMPLE = 20_000
BUCKETS = 4096
BINS = 32
#: Numbers in a row of features.
WIDTH = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """`verdict` for hosts equal to or below `host` whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


# -- features --------------------------------------------------------------------------------------


def suffixes(host: str) -> tuple[int, int]:
    """Buckets of the last label and of the last two."""
    labels = host.rsplit(".", 2)
    return zlib.crc32(labels[-1].encode()) % BUCKETS, zlib.crc32(b"2 " + ".".join(labels[-2:]).encode()) % BUCKETS


def lexical(url: str | None, host: str, path: str) -> tuple[float, ...]:
    url = url or ""
    n = len(url) or 1
    counts = Counter(url)
    rest = url.partition("://")[2][len(host) + len(path):]
    return (len(url), len(host), len(path), host.count("."), path.count("/"), sum(c.isdigit() for c in url) / n,
            -sum(k / n * math.log2(k / n) for k in counts.values()), rest.count("="), rest.count("&"), host.count("-"),
            counts["%"], float("#" in rest), max(map(len, host.split("."))), float(url.startswith("https:")))


def features(urls: Sequence, hosts: Sequence, paths: Sequence, odds: np.ndarray) -> np.ndarray:
    rows = [lexical(u, h, p) + tuple(odds[list(suffixes(h))]) for u, h, p in zip(urls, hosts, paths)]
    return np.array(rows, np.float64).reshape(len(rows), WIDTH)


# -- boosted trees ------------------------------------------------------------------------------------


class Trees(NamedTuple):
    """Complete binary trees: a split feature and threshold per inner node, a value per leaf."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of block per row."""
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-margin))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Fit by second-order boosting; `y` is 1 for block."""
    inner, width = 2 ** depth - 1, x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        bias = (20.0 if y[0] else -20.0) if len(y) else -20.0
        return Trees(bias, *(np.zeros((0, inner), t) for t in (np.int64, np.float64)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    mean = y.mean()
    bias = math.log(mean / (1 - mean))
    margin = np.full(len(y), bias)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, wide = 2 ** level - 1, 2 ** level
            local = node - base
            best = np.zeros(wide)
            for f in range(width):
                at = local * BINS + binned[f]
                g = np.bincount(at, grad, wide * BINS).reshape(wide, BINS).cumsum(1)
                h = np.bincount(at, hess, wide * BINS).reshape(wide, BINS).cumsum(1)
                left, right = (g, h), (g[:, -1:] - g, h[:, -1:] - h)
                gain = sum(a * a / (b + ridge) for a, b in (left, right)) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, :len(cuts[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    better = gain[np.arange(wide), k] > best + 1e-9
                    best = np.where(better, gain[np.arange(wide), k], best)
                    feature[base:base + wide][better] = f
                    threshold[base:base + wide][better] = cuts[f][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        margin += leaf[at]
        out.append((feature, threshold, leaf))
    return Trees(bias, *map(np.stack, zip(*out)))


class Model(NamedTuple):
    trees: Trees
    odds: np.ndarray


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> Model:
    """A model from rows of a URL and a label (`block` or `allow`; others and nulls are left out)."""
    rows = labelled.filter(F.col(label).isin("block", "allow")).select(
        F.col(url).alias("url"), (F.col(label) == "block").alias("y"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    last = F.substring_index("host", ".", -1)
    both = F.concat(F.lit("2 "), F.substring_index("host", ".", -2))
    buckets = F.array(*[F.pmod(F.crc32(c.cast("binary")), F.lit(BUCKETS)) for c in (last, both)])
    counts = rows.select("y", F.explode(buckets).alias("b")).groupBy("b").agg(
        F.count_if("y").alias("block"), F.count("*").alias("n")).collect()   # a row per bucket at most
    block, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        block[r["b"]], n[r["b"]] = r["block"], r["n"]
    odds = np.log((block + 1) / (n - block + 1))
    chosen = rows.orderBy(F.xxhash64("url"), "url", "y").limit(sample).collect()   # the same, however the table is laid out
    x, y = features(*[[r[c] for r in chosen] for c in ("url", "host", "path")], odds), np.array([r["y"] for r in chosen], float)
    if len(y):   # a row's own label is not among its inputs
        own = np.array([list(suffixes(r["host"])) for r in chosen])
        x[:, -own.shape[1]:] = np.log((block[own] - y[:, None] + 1) / (n[own] - block[own] - 1 + y[:, None] + 1))
    return Model(boost(x, y), odds)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES,
          model: Model | None = None) -> DataFrame:
    """Per page: key, host, path, rule, score (of block) and verdict: the rule's, else the model's."""
    df = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    df = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, own = apply_rules(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "own": own})
    if model is None:
        model = fit(df, "url", "own")
    held = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        trees, odds = held.value

        def score(urls, hosts, paths):
            return ((float(p),) for p in trees.score(features(urls, hosts, paths, odds)))

        return score

    read = df.withColumns({"u": F.col("url"), "h": F.col("host"), "p": F.col("path")}).drop("url")
    scored = map_rows(read, [T.StructField("score", T.DoubleType())], make, ["key", "host", "path", "rule", "own"])
    verdict = F.coalesce("own", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
