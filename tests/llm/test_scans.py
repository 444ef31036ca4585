"""License scan, secret ledger, quality rules, URL filter, decontamination against plain Python."""

import hashlib
import random
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from screenwell.llm import decontaminate as dc
from screenwell.llm import license_scan as ls
from screenwell.llm import quality_rules as qr
from screenwell.llm import queries
from screenwell.llm import secret_ledger as sl
from screenwell.llm import simhash_trie as st
from screenwell.llm import url_filter as uf
from screenwell.llm.common import parted
from screenwell.llm.license_rules import load

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check_sql(spark, data, name):
    assert compare.compare(queries.QUERIES[name](spark, data), compare.connect(data), queries.CHECKS[name]) is None


# -- licenses ----------------------------------------------------------------------------------


def test_license_base_places(messy, documents):
    for df in (messy.select("doc_id", "text"), documents.select("doc_id", "text")):
        want = []
        for doc_id, text in df.collect():
            ws = words(text)
            at = [(i, label) for phrase, label in ls.BASE for i in range(len(ws))
                  if [w.encode() for w in ws[i:i + len(phrase.split())]] == phrase.split()]
            places = [i for i, _ in at]
            want.append((doc_id, len(ws), len(at), min(places, default=None), max(places, default=None),
                         ",".join(sorted({x for _, x in at}))))
        got = ls.report(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_license_rules_need_their_keyword_and_hold_suppression():
    rules = load()
    assert len(rules) > 200
    scanner = ls.Scanner(rules)
    found = scanner("MIT License: GNU General Public License, version 3, or Apache-2.0 licensed")[2]
    assert [f["label"] for f in found] == ["mit", "gpl-3.0", "apache-2.0"]
    assert [(f["start"], f["end"]) for f in found] == [(0, 2), (2, 8), (9, 13)]


@pytest.mark.parametrize("name", ["Share Alike", "ShareAlike", "Share-Alike"])
def test_license_share_alike_in_both_spellings(name):
    found = ls.Scanner(load())(f"Creative Commons Attribution-{name} 3.0")[2]
    assert [f["label"] for f in found] == ["cc-by-sa-3.0"]


def test_license_resolve_is_containment():
    rng = random.Random(3)
    for _ in range(300):
        found = [(a := rng.randrange(20), a + rng.randrange(1, 9), rng.randrange(1, 4), i) for i in range(rng.randrange(9))]
        key = lambda f: (f[0], -f[1], f[2], f[3])
        want = [f for f in found if not any(g is not f and g[2] <= f[2] and g[0] <= f[0] and g[1] >= f[1]
                                            and key(g) < key(f) for g in found)]
        assert ls.resolve(found) == sorted(want, key=key)


def test_license_empty(empty, messy):
    assert ls.report(empty).count() == 0
    assert ls.report(messy).count() == messy.count()
    assert {tuple(r) for r in ls.report(messy.filter("text IS NULL OR text = ''")).select(
        "n_words", "labels", "score").collect()} == {(0, "", 0.0)}


# -- secrets -----------------------------------------------------------------------------------


def plain_spans(text):
    out = []
    for at, r in enumerate(sl.RULES):
        flags = re.I | re.A if r.regex.startswith("(?i)") else 0
        for m in re.compile(r.regex.removeprefix("(?i)").replace("\\x20", " "), flags).finditer(text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), at, m.end()))
    return sorted(out)


def test_secret_spans_equal_python(spark, messy):
    rng = random.Random(5)
    bits = ["password", "PASSWD", "=", ": ", " ", "\"", "ſecret", "secret", "token", "api_key", "apikey", "abc123", "AKIA",
            "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789abcdef", "é", "\U0001F600", "\n", "://", "a:b@", "eyJabcdefgh.",
            "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(messy.select("doc_id", "text"))
    got = sl.scan(df, sl.fresh_ledger(spark)).collect()
    want = [(r.doc_id, plain_spans(r.text)) for r in df.collect()]
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=repr) == sorted(want, key=repr)


def test_ledger_reads_only_what_is_new(spark, messy):
    path = sl.fresh_ledger(spark)
    first = sl.report(messy, path).collect()
    blobs = messy.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    assert spark.read.parquet(path).count() == blobs
    assert sorted(sl.report(messy, path).collect(), key=repr) == sorted(first, key=repr)
    assert spark.read.parquet(path).count() == blobs
    newer = [r._replace(version=2) if r.kind == "hex" else r for r in sl.RULES]
    assert sorted(sl.report(messy, path, rules=newer).collect(), key=repr) == sorted(first, key=repr)
    again = spark.read.parquet(path).groupBy("scanned").count().collect()
    assert sorted(r["count"] for r in again) == [blobs, blobs] and ["hex@2"] in [r.scanned for r in again]
    more = messy.union(messy.limit(1).withColumn("text", F.lit("token=brandnewvalue")))
    sl.scan(more, path, rules=newer)
    assert spark.read.parquet(path).count() == 2 * blobs + 1


def test_redact(spark, messy, empty):
    out = sl.redact(messy, sl.fresh_ledger(spark))
    assert out.columns == messy.columns and out.count() == messy.count()
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[9].text == "[REDACTED:assign]\" and token=ab secret=token: abcdefgh [REDACTED:hex]"
    assert texts[9].n_chars == len(texts[9].text) and texts[0].text is None and texts[9].blob == "own"
    many = "é token=abcdef0123 x" * 3000
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    assert sl.redact(df, sl.fresh_ledger(spark)).first().text == "é [REDACTED:assign] x" * 3000
    assert sl.redact(empty, sl.fresh_ledger(spark)).count() == 0


# -- quality -------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    ws = re.findall("[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    twice = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 3000 else set()
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))


def test_quality_counts(messy, documents):
    df = messy.filter("length(text) < 20000 OR text IS NULL").select("doc_id", "text").union(
        documents.select("doc_id", "text").filter("length(text) < 6000"))
    got = qr.measure(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r.doc_id, *plain_counts(r.text)) for r in df.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_quality_keeps(messy, empty):
    verdicts = qr.measure(messy)
    assert verdicts.filter("kept AND base_failed").count() == 0
    kept = qr.keep(messy)
    assert kept.columns == messy.columns
    assert kept.count() == verdicts.filter("kept").count()
    assert qr.keep(empty).count() == 0 and qr.measure(empty).count() == 0


def test_quality_follows_labels(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    r = qr.measure(documents).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in r}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * n[(0, False)]


# -- URLs ------------------------------------------------------------------------------------------


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = host.translate(UPPER)
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_url_rules(spark, data):
    odd = [None, "", "nourl", "HTTP://WWW.Example.COM/en/1?x=1&y=://z", "http://example.com/en/", "x://com", "x://Com/",
           "http://a.b.example.com/EN/", "https://foo.net/es/9#a", "https://xnet/es/9", "a://b\n.net/es/", "://net/fr/"]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").union(
        spark.createDataFrame([(None if i == 3 else -i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    pages = pages.union(pages.limit(2)).withColumn("host", F.lit("own"))
    got = uf.judge(pages).collect()
    url = [(r.page_id, *plain_rule(r.url)) for r in pages.collect()]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(
        ((i, h, p, r and r.text) for i, h, p, r in url), key=repr)
    verdict = {r.text: r.verdict for r in uf.RULES}
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    assert uf.judge(pages.limit(0)).count() == 0


def test_trees_learn_and_are_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, uf.WIDTH))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    trees = uf.boost(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    by_hand = np.full(20, trees.bias)
    for f, t, leaf in zip(*trees[1:]):
        for i in range(20):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > t[node])
            by_hand[i] += leaf[node - len(f)]
    assert np.allclose(trees.score(x[:20]), 1 / (1 + np.exp(-by_hand)))
    assert (uf.boost(x, np.ones(len(x))).score(x) > 0.5).all() and not (uf.boost(x[:0], y[:0]).score(x) > 0.5).any()


def test_url_model_on_held_out_rules(spark):
    """URLs whose labels follow lexical marks, judged on others of the kind."""
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        url = f"http://{name}{'-win-99' if bad else ''}.org/{'x' * rng.randrange(5)}" + ("?a=1&b=2&c=3" if bad else "")
        rows.append((i, url, "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    model = uf.fit(df.filter("page_id % 3 > 0"))
    got = uf.judge(df.filter("page_id % 3 = 0"), rules=(), model=model).join(df, "page_id")
    assert got.filter("verdict = label").count() > 0.97 * got.count()


# -- decontamination ----------------------------------------------------------------------------------


def plain_hits(ws, items, size=10):
    hit, ids = set(), set()
    for item, iw in items:
        k = min(size, len(iw))
        wins = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1):
            if tuple(ws[i:i + k]) in wins:
                hit.update(range(i, i + k))
                ids |= {str(item)} if item is not None else set()
    return hit, ids


def test_automaton_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.randrange(2, 5)
        draw = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(n))]
        items = [(str(i), draw(9)) for i in range(4)]
        auto, ws = dc.Automaton(items, size), draw(40)
        spans, numbers = auto.spans(ws)
        hit, ids = plain_hits(ws, items, size)
        assert {j for a, b in spans for j in range(a, b)} == hit and {auto.ids[n] for n in numbers} == ids
        assert spans == dc.merged(spans) and all(a < b for a, b in spans)


def test_report(messy, benchmark, empty):
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    want = []
    for r in messy.select("doc_id", "text").collect():
        ws = words(r.text)
        hit, ids = plain_hits(ws, items)
        want.append((r.doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                     bool(hit)))
    for shard in (200_000, 12):   # one automaton, several passes
        assert sorted(map(tuple, dc.report(messy, benchmark, shard_words=shard).collect()), key=repr) == sorted(want, key=repr)
    assert dc.report(empty, benchmark).count() == 0
    assert dc.report(messy, benchmark.limit(0)).filter("contaminated").count() == 0


def test_clean(messy, benchmark, empty):
    for shard in (200_000, 12):
        out = dc.clean(messy, benchmark, shard_words=shard)
        assert out.columns == messy.columns
        left = {(r.doc_id, r.text) for r in out.collect()}
        before = {(r.doc_id, r.text) for r in messy.collect()}
        assert dc.report(out, benchmark).filter("contaminated").count() == 0
        clean = dc.report(messy, benchmark).filter("NOT contaminated").select("doc_id").collect()
        assert {x for x in before if x[0] in {r.doc_id for r in clean} - {4, None}} <= left   # clean texts as they were
        assert (3, "one") not in left and (0, None) in left and (1, "") in left
    assert dc.clean(empty, benchmark).count() == 0


def test_clean_does_not_depend_on_shards(spark):
    """Over the limit only in sum; a window of one shard's item brought together by a cut of another's."""
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 70), ("b", 20), ("c", 10)))
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "item_id long, text string").coalesce(1)
    rest = [f"x{i}" for i in range(200)]
    texts = [" ".join(a + b + rest[:10]), " ".join(a + b + rest[:40]), " ".join([*rest, *c[:5], *b[:10], *c[5:], "end."]),
             " ".join([*rest, *a[:5], *c, *a[5:10], "end."]), "Left, as it was.", "", None, " ".join(a + rest), " ".join(a + rest)]
    docs = spark.createDataFrame([(i % 8, t, "own", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, spans string, n_chars long").repartition(2)
    whole, parts = (dc.clean(docs, items, shard_words=n) for n in (200_000, 12))
    assert parts.columns == docs.columns
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(parts) == key(whole)
    assert dc.report(parts, items).filter("contaminated").count() == 0
    assert whole.count() == len(texts) - 1 and " ".join(rest[:10]) not in {(r.text or "").strip() for r in whole.collect()}


# -- private keys, names with dots, null keys --------------------------------------------------------

KEY = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nMIIEowIBAAKCAQEA+/x\nq83=\n-----END RSA PRIVATE KEY-----"


def test_whole_private_keys_are_redacted(spark):
    texts = [f"before {KEY} after", f"a {KEY} b {KEY} c", "open -----BEGIN PRIVATE KEY-----\nMIIEow\nAB12. Rest stays", "-----BEGIN PRIVATE KEY-----"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in sl.redact(df, sl.fresh_ledger(spark)).orderBy("doc_id").collect()]
    mark = "[REDACTED:private_key]"
    assert got == [f"before {mark} after", f"a {mark} b {mark} c", f"open {mark}. Rest stays", mark]


def test_names_with_dots_pass(spark, messy, benchmark):
    odd = messy.withColumn("a.b", F.lit(1)).withColumn("x`y", F.lit(2))
    for fn in (lambda d: sl.redact(d, sl.fresh_ledger(spark)), st.distinct, lambda d: dc.clean(d, benchmark),
               lambda d: dc.clean(d, benchmark, shard_words=12), qr.keep):
        out = fn(odd)
        assert out.columns == odd.columns and out.count() == fn(messy).count()


def test_many_null_keys(spark):
    rows = [(None, f"secret = abc{i:06d}") for i in range(40)] + [(None, "secret = same99")] * 40 + [(5, "none"), (5, "token: zzzzzz")]
    got = sl.report(spark.createDataFrame(rows, "doc_id long, text string"), sl.fresh_ledger(spark)).collect()
    assert len(got) == 82 and sum(r.n_assign for r in got) == 81


def test_parted_is_a_superset(spark):
    df = spark.range(5000).withColumn("v.x", F.col("id"))
    some = df.filter("id % 100 = 7").select(F.col("id").alias("k"))
    sure, perhaps = parted(df, "v.x", some, "k")
    a, b = {r.id for r in sure.collect()}, {r.id for r in perhaps.collect()}
    assert a | b == set(range(5000)) and not a & b and {i for i in range(7, 5000, 100)} <= b and len(b) < 100
