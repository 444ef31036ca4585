"""HTML extraction, ranked search, Merkle manifest."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from screenwell.llm import block_lstm as bl
from screenwell.llm import merkle_manifest as mm
from screenwell.llm import term_pipeline as tp
from screenwell.llm.common import words
from screenwell.llm.html_blocks import Reader
from screenwell.llm.queries import QUERIES

# -- HTML extraction ---------------------------------------------------------------------------------


def texts(page):
    return [leaf.text for leaf in Reader().leaves(page)]


def test_reader():
    assert texts("<p>One <b>two</b>three<br>four &amp; five<p>six &nbsp; x</div>tail<ul><li>a<li>b</ul>") == [
        "One twothree four & five", "six x", "tail", "a", "b"]
    assert texts("<script>var t='</p>';</SCRIPT><!-- <p>x --><style>p{}</style><p title='a>b'>y") == ["y"]
    assert texts("a < b <3 </nope><p title='it\"s'>z &lt;b&gt;") == ["a < b <3", "z <b>"]
    assert texts(None) == texts("") == texts(" \n ") == texts("<p></p><br>") == [] and texts("<b>only") == ["only"]
    assert texts("<script>never closed <p>x") == [] and texts("İ<style>x</style>y") == ["İy"]
    leaf, = Reader().leaves('<div class="postComments" id=main2><p>x <a href="/">link</a></p></div>')
    assert leaf.path == (("t:p",), ("t:div", "k:post", "k:comment", "k:main")) and leaf.linked == 4


@pytest.mark.parametrize("page", ['<a "' * 30000, "<div>" * 30000 + "x", "<" * 50000, "<p>" * 30000 + "x" * 10, "</p>" * 30000, "&" * 50000])
def test_reader_is_linear(page):
    Reader().leaves(page)


def test_gradient():
    rng, real = random.Random(3), np.random.default_rng(0)
    pages = [p for p, _ in bl.practice(["one two three.", "four five", "six"], 3, 5)]
    x = bl.Encoder()(pages)
    net = bl.Net(*[p.astype(np.float64) for p in bl.new_net()])
    y = real.integers(0, 2, len(x.tag_n)).astype(float)

    def loss():
        logits = bl.forward(net, bl.block_vectors(net, x).astype(np.float64), x.pages)
        return float(np.sum(np.logaddexp(0, logits) - y * logits))

    vectors = bl.block_vectors(net, x)
    logits, kept = bl.forward(net, vectors, x.pages, keep=True)
    grads = bl.backward(net, x, vectors, kept, bl.sigmoid(logits) - y)
    for name, p, g in zip(net._fields, net, grads):
        flat = np.flatnonzero(g) if name in ("tag", "word") else np.arange(g.size)
        for at in rng.sample(flat.tolist(), min(4, len(flat))):
            old, step = p.flat[at], 1e-3
            p.flat[at] = old + step
            up = loss()
            p.flat[at] = old - step
            down = loss()
            p.flat[at] = old
            assert abs((up - down) / (2 * step) - g.flat[at]) < 2e-2 * max(1, abs(g.flat[at])), name


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inside))).split())


@pytest.fixture(scope="module")
def net(spark, data):
    return bl.fit(spark.read.parquet(f"{data}/pages.parquet"))


def test_articles_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op11_html_text"](spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_practice_pages_not_learnt_from(net):
    pool = [f"{a} {b} of the {c}." for a in ("Old", "New", "Some") for b in ("houses", "trees", "words") for c in ("town", "river")]
    pages = bl.practice(pool, 300, 4321)
    labels = bl.Extractor(net).labels([p for p, _ in pages])
    right = sum(int(a == b) for (_, want), got in zip(pages, labels) for a, b in zip(want, got))
    assert right / sum(len(w) for _, w in pages) > 0.98


def test_other_layouts(net):
    body = "The council met on Tuesday to discuss the new bridge, and members agreed on a plan. It will cost more than was expected."
    page = (f"<html><body><div id='header'><a href='/'>The Gazette</a></div><div class='navbar'><a href='/a'>News</a> <a href='/b'>Sport</a></div>"
            f"<div class='cookie-notice'><p>We use cookies. Accept</p></div><div id='content'><h1>Bridge plan agreed</h1><p>{body}</p>"
            f"<div class='advert'>Buy shoes now</div><p>{body}</p><ul><li>First point of the plan</li><li>Second point</li></ul></div>"
            f"<div class='sidebar'><h3>Related</h3><ul><li><a href='/c'>Other story</a></li></ul></div><form class='newsletter'><label>Subscribe</label>"
            f"<button>Send</button></form><div id='comments'><div class='comment'><p>I do not agree with the plan at all, it is far too much.</p></div></div>"
            f"<div id='footer'>Copyright 2024</div></body></html>")
    text, = (t for t, _, _ in bl.Extractor(net)([page]))
    assert text == f"Bridge plan agreed {body} {body} First point of the plan Second point"


def test_pages_on_spark(spark, net):
    long = "<article>" + "".join(f"<p>Part {i} of a long page with some words.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None, "own"), (2, None, "", "own"), (None, None, " \n", "own"), (4, "u", "<script>x", "own"), (5, "u", long, "own"),
            (5, "u", long, "own"), (6, "u", "<p>\x00퟿ &#x1F600; &bogus; &#0;</p>", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string").selectExpr("*", "'own' AS text", "1 AS n_chars")
    got = bl.report(df, net=net).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 1, 2, 4, 5, 5, 6]
    for r in got:
        if r.page_id == 5:
            assert r.text == " ".join(texts(long)) and r.n_chars == len(r.text)
        elif r.page_id != 6:
            assert r.text == "" and r.n_chars == 0
    assert bl.report(df.limit(0), net=net).count() == 0
    out = bl.extract(df.drop("text"), net)
    assert "a.b" in out.columns and out.count() == 7


def test_fit_without_marked_pages(spark):
    df = spark.createDataFrame([(1, "u", "<div>some words</div>"), (2, None, None)], "page_id long, url string, html string")
    net = bl.fit(df, layouts=40)
    assert bl.report(df, net=net).count() == 2 and bl.report(df.limit(0), net=bl.fit(df.limit(0), layouts=20)).count() == 0


# -- ranked search -----------------------------------------------------------------------------------


def ranked(docs, items, k=10):
    """Every score of every document, sorted."""
    bags = [(key, Counter(words(t))) for key, t in docs if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = Counter()
    for item, text in items:
        asked = Counter(words(text))
        scores = []
        for at, (key, bag) in enumerate(bags):
            m = 25 + 75 * sum(bag.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * bag[w] // (1000 * bag[w] + 8 * m))
                    for w, q in asked.items() if w in bag)
            if s > 0:
                scores.append((-s, key is None, key or 0, at))
        for rank, (s, none, key, _) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if none else key, -s] += 1
    return out


def found(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_search_equals_all_scores(spark, messy, benchmark, empty):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert found(tp.search(messy, benchmark)) == ranked(docs, items)
    assert found(tp.search(messy, benchmark, shard=3, bundle=2, owners=(8, 3))) == ranked(docs, items)
    assert tp.search(empty, benchmark).count() == 0 and tp.search(messy, benchmark.limit(0)).count() == 0


def test_search_prunes_without_loss(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(vocabulary[min(299, int(rng.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = [(rng.randrange(250), draw(rng.choice((1, 3, 20, 80)))) for _ in range(400)]
    items = [(i, draw(rng.choice((1, 2, 8, 30)))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found(tp.search(d, i, shard=50, bundle=16)) == ranked(docs, items)
    assert found(tp.search(d, i, k=3, owners=())) == ranked(docs, items, 3)


def test_late_stages_open_nothing():
    """With a floor above what is left, a frequent term only adds to the accumulators that are there."""
    m = np.full(6, 100)
    terms = [(np.arange(6), np.ones(6, np.int64), 10, np.array([0]), np.array([1]))]
    s, p, v, best = tp.visit(np.array([0]), np.array([2]), np.array([9_000_000_000]), terms, m, np.array([10_000_000]), np.array([0]),
                             np.array([8_000_000_000]), np.arange(6), 10)
    assert (s.tolist(), p.tolist(), best.tolist()) == ([0], [2], [0]) and v[0] == 9_000_000_000 + 10 * (10 ** 9 // 1800)


# -- Merkle manifest ---------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(leaves):
    """Top and, for each leaf, its steps (left, right)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // 16 * 16
            steps[i].append((nodes[run:a], nodes[a + 1:run + 16]))
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], steps


def manifest(rows):
    groups = {}
    for r in rows:
        leaf = h(*[field(v) for v in r])
        chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        start = h(*[field(v) for v in (*r[:4], lower(r[4]))]) if chosen else leaf
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf), r[0], leaf, start))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, upper):
        for (_, key, leaf, start), below in zip(sorted(groups[s]), trees[s][1]):
            fold, proof = start, []
            for left, right in below + above:
                fold = h(*left, fold, *right)
                proof += left + right
            out[key, leaf, trees[s][0], root, h(*proof), fold, fold == root] += 1
    return out


def proven(df):
    return Counter(tuple(r) for r in mm.report(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_equals_plain_trees(spark, messy, empty):
    assert proven(messy) == manifest(as_rows(messy)) and mm.report(empty).count() == 0
    one = messy.filter("doc_id = 1")
    assert proven(one) == manifest(as_rows(one))


@pytest.mark.parametrize("sizes", [(4097, 17, 16, 1), (300, *[1] * 40)])
def test_manifest_of_several_rounds(spark, sizes):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(i * 7 % 5003, None if s == 1 else f"é{s}", "en", i, f"Text {i} of {s}") for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = proven(spark.createDataFrame(rows, schema).repartition(5))
    assert got == manifest(rows) and {k[-1] for k in got} == {True, False}


def test_manifest_odd_names(spark):
    schema = T.StructType([T.StructField("k.1", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("h", T.StringType())])
    df = spark.createDataFrame([("b", "x", "One"), ("a", "x", None), (None, None, "One")], schema)
    got = mm.report(df, "k.1", "tree", "h", fields=("k.1", "tree", "h")).collect()
    assert len(got) == 3 and {len(r.root) for r in got} == {64} and len({r.root for r in got}) == 1
