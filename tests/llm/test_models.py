"""Toxicity network, language model, token codes, BPE, SimHash components, pipeline."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from screenwell.llm import bpe_cuts as bc
from screenwell.llm import components as cc
from screenwell.llm import lm_score as lm
from screenwell.llm import simhash_trie as st
from screenwell.llm import token_codes as tc
from screenwell.llm import toxicity_gru as tg
from screenwell.llm.common import ALNUM, BLANKS, shared_folder, tokenizer_file, words
from screenwell.llm.queries import QUERIES

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
BITS = ["a", "The", " ", "  ", "\n", "\t", "é", "ß", "漢字", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "123", "!!", "\x1c",
        "\x85", " ", " ", "É", "É", "J̌", "\U0001F600", "\x00", "don't", "_", "ΩΣ", "　", "\r\n", "ſ", "<|",
        "½", "٣", "İ", "K", "word,", "aaaaaaaa"]


def ids_by_library(path, text):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(1500)]


# -- BPE ---------------------------------------------------------------------------------------------


def test_bpe_equals_library(odd_texts):
    tok, codec = Tokenizer.from_file(BYTE), bc.Codec(BYTE, most=40)   # caches that turn over all the time
    for i in range(0, len(odd_texts), 50):
        for text, ids in zip(odd_texts[i:i + 50], codec.encode(odd_texts[i:i + 50])):
            want = tok.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert codec.decode(ids) == tok.decode(want, skip_special_tokens=False), text


def test_cuts_lie_between_tokens():
    codec, tok = bc.Codec(BYTE), Tokenizer.from_file(BYTE)
    for letters in ("Ġthththinking", "xqzjkvw", "zzzqqq", "aaaaaaaaa"):
        parts = codec.cuts(letters)
        assert "".join(parts) == letters
        ends = np.cumsum([len(t.value) for t in tok.model.tokenize(letters)]).tolist()
        assert set(np.cumsum([len(p) for p in parts]).tolist()) <= set(ends)


def test_cuts_are_looked_for_in_many_pretokens_at_once(monkeypatch):
    """Not letter by letter in Python; a pre-token without a cut is known once, not as a fragment too."""
    codec, tok, asked = bc.Codec(BYTE), Tokenizer.from_file(BYTE), []
    own = codec.cuts
    monkeypatch.setattr(codec, "cuts", lambda letters: asked.append(letters) or own(letters))
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("etaoinshrdlu" if i % 3 else "xqzjkvwé\t7", k=7)) for i in range(3000))
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert not asked and not set(codec.fragments) & {p for p in codec.pretokens if own(p) == [p] and len(p) == 8}
    joined = {t[i:i + 2] for t in tok.get_vocab() for i in range(len(t) - 1)}
    known = ["a", *codec.pretokens]
    for letters, marked in zip(known, codec.cut(known)):
        assert marked == "".join(c if not i or letters[i - 1] + c in joined else bc.CUT + c for i, c in enumerate(letters))
    assert codec.cut([]) == [] and codec.encode([]) == [] and codec.encode([None, ""]) == [b"", b""]


def test_bpe_holds_little_at_a_time():
    """Four million characters and many new fragments: what is held beside the ids stays far below a worker's share."""
    codec, asked = bc.Codec(BYTE), []
    merge = codec.merger.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, lot, **options):
            asked.append(len(lot))
            return merge(lot, **options)

    codec.merger = Counting()
    text = "the old town has much time for people and " * 1000
    texts = [text] * 95 + [" ".join(f"z{i:x}q" for i in range(20_000))]
    tracemalloc.start()
    n = sum(len(ids) for some in bc.few(texts) for ids in codec.encode(some))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4 * sum(len(Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids) for t in texts[-2:-1]) * 95 + len(
        codec.encode(texts[-1:])[0])
    assert max(asked) <= 1024 and peak < 40 << 20


def test_bpe_on_spark(messy, empty):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bc.round_trip(messy, BYTE).collect()}
    want = set()
    for r in messy.collect():
        ids = ids_by_library(BYTE, r.text)
        want.add((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want and bc.round_trip(messy, BYTE).count() == messy.count() and bc.round_trip(empty, BYTE).count() == 0
    back = {r.text for r in bc.decode(bc.encode(messy, BYTE), BYTE).collect()}
    assert back == {r.text or "" for r in messy.collect()}


# -- token codes -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [2, 256, 50_000, 2 ** 32])
def test_codes_give_any_id(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype("<u4")
    codes = tc.Codes(tc.pack(ids))
    assert len(codes) == n and [codes[i] for i in range(n)] == ids.tolist()
    for a in range(0, n + 1, max(1, n // 7)):
        assert codes.between(a, n).tolist() == ids[a:].tolist() and codes.between(0, a).tolist() == ids[:a].tolist()
    with pytest.raises(IndexError):
        codes[n]


def test_word_encoder_equals_library(odd_texts):
    tok, enc = Tokenizer.from_file(WORD), tc.Encoder(WORD, most=40)
    for i in range(0, len(odd_texts), 50):
        for text, ids in zip(odd_texts[i:i + 50], enc(odd_texts[i:i + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, messy, empty):
    for segment in (tc.SEGMENT, 50):
        path = shared_folder(spark, "codes")
        tc.write(messy, path, WORD, segment=segment)
        got = tc.digests(spark, path).collect()
        texts = {}
        for r in messy.collect():
            ids = ids_by_library(WORD, r.text) + (1).to_bytes(4, "little")
            texts.setdefault(r.doc_id, []).append((len(ids) // 4, zlib.crc32(ids)))
        seen = {}
        for r in got:
            seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in texts.items()}
        in_order = sorted(got, key=lambda r: r.start)
        assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
        keys = [-1 if r.doc_id is None else r.doc_id for r in in_order]
        assert keys == sorted(keys)
        assert {zlib.crc32(r.ids) for r in tc.read(spark, path).collect()} == {r.ids_crc32 for r in got}
    path = shared_folder(spark, "codes")
    tc.write(empty, path, WORD)
    assert tc.digests(spark, path).count() == 0


# -- SimHash -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    ws = [w for w in "".join(" " if "\t" <= c <= "\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), seed=42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(prints, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1:]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def prints():
    rng = np.random.default_rng(1)
    out = [0, 1, 3, 2 ** 64 - 1]
    for base in rng.integers(0, 2 ** 64, 40, dtype=np.uint64):
        for _ in range(30):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("width", [50, 1 << 17])
def test_trie_join_is_exact(prints, width):
    pairs = []
    st.link_tries(prints, [(0, len(prints), 0, len(prints))], 4, 0, lambda i, j: pairs.extend(zip(i.tolist(), j.tolist())), width)
    want = {(i, i + 1 + int(j)) for i in range(len(prints)) for j in np.flatnonzero(
        np.bitwise_count(prints[i] ^ prints[i + 1:]) <= 4)}
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want
    a, b = prints[::2], prints[1::2]
    pairs = []
    st.link_tries(np.concatenate([a, b]), [(0, len(a), len(a), len(prints))], 4, 0,
                  lambda i, j: pairs.extend(zip(i.tolist(), j.tolist())), width)
    assert set(pairs) == {(i, len(a) + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ b) <= 4)}


@pytest.mark.parametrize("split", [8192, 9])   # with the small one nearly every trie is dealt out
def test_components_of_fingerprints(spark, prints, split):
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    root = {r.node: r.root for r in cc.components(st.star_links(df, split=split)).collect()}
    names = [root.get(int(x), int(x)) for x in prints.view(np.int64)]
    want = plain_groups(prints)
    assert len(set(names)) == len(set(want)) == len(set(zip(names, want)))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 160)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 160: 150, 200: 150}


def test_simhash_report(documents, messy, empty):
    docs = documents.select("doc_id", "text").orderBy("doc_id").collect()
    want_prints = [plain_fingerprint(r.text) for r in docs]
    want = plain_groups(np.array(want_prints, np.uint64))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in st.report(documents).collect()}
    assert got == {r.doc_id: (f"{p:016x}", docs[g].doc_id) for r, p, g in zip(docs, want_prints, want)}
    assert st.report(empty).count() == 0
    found = st.report(messy)
    assert found.count() == messy.count()
    assert {r.component_id for r in found.filter("doc_id in (0, 1, 2)").collect()} == {0}
    kept = st.distinct(messy)
    assert kept.columns == messy.columns and st.distinct(empty).count() == 0
    groups = plain_groups(np.array([plain_fingerprint(r.text) for r in messy.collect()], np.uint64))
    assert kept.count() == len(set(groups))
    assert {0, 3, 4, 7} <= {r.doc_id for r in kept.collect()} and not {1, 2, 5} & {r.doc_id for r in kept.collect()}


# -- toxicity ----------------------------------------------------------------------------------------


def test_gradient():
    rng = np.random.default_rng(0)
    inputs = tg.Inputs.of([b"", b"bad", b"the", b"abc", b"loweischaft"])
    net = tg.Net(*[p.astype(np.float64) for p in tg.new_net()])
    ids, y = rng.integers(0, 5, (6, tg.SPAN)), rng.integers(0, 2, 6)

    def logits(keep=False):
        v = inputs.vectors(net)
        return v, tg.forward(net, tg.gate_inputs(net, v)[:, ids.T].transpose(1, 0, 2, 3), keep)

    v, (z, kept) = logits(True)
    grads = tg.backward(net, ids, inputs, v, kept, (tg.sigmoid(z) - y) / 6)
    for p, g in zip(net[:-1], grads[:-1]):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for d in (1e-3, -2e-3):
            p[i] += d
            z = logits()[1]
            losses.append(float((np.log1p(np.exp(z)) - y * z).mean()))
        p[i] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - g[i]) < 1e-5 + 1e-3 * abs(g[i])


def test_windows_cover_all_words():
    lengths = np.array([0, 1, tg.SPAN, tg.SPAN + 1, 500])
    text, first, size = tg.windows(lengths)
    for t, n in enumerate(lengths):
        at = {j for x, a, s in zip(text, first, size) if x == t for j in range(a, a + s)}
        assert at == set(range(n)) and (text == t).sum() >= 1


def made_up(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(60)], ["vile", "nasty"]
    out = []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randrange(1, 150))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad) + rng.choice(["", "er", "ness"]))
        out.append((i, " ".join(ws), toxic))
    return out


def test_toxicity_held_out(spark, empty, messy):
    rows = made_up(700, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = tg.report(docs, labels).toPandas()
    truth = {r[0]: r[2] for r in rows}
    held = got[got.held_out]
    assert sorted(got.doc_id[got.held_out]) == [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= tg.THRESHOLD))).all()
    net = tg.fit(docs, labels.limit(0))
    assert tg.score(messy, net).count() == messy.count() and tg.score(empty, net).count() == 0
    assert {r.score for r in tg.score(messy, net).collect()} == {tg.Scorer(net)([""])[0]}


def test_scores_do_not_depend_on_the_batch():
    net = tg.new_net()
    texts = [r[1] for r in made_up(40, 5)] + ["", None]
    assert np.allclose(tg.Scorer(net)(texts), [tg.Scorer(net)([t])[0] for t in texts], atol=1e-6)


# -- language model ------------------------------------------------------------------------------------


def test_probabilities_add_up_and_training_helps(spark, empty, messy):
    rng = random.Random(4)
    texts = [" ".join(x for _ in range(40) for x in rng.choice([("red", "big", "fox"), ("old", "blue", "sea")])) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = lm.new_model(lm.count_buckets(docs, "text"))
    around = np.repeat(lm.contexts(lm.ids_of(texts[0]), np.array([5])), lm.VOCAB, 0)
    for m in (plain, trained := lm.fit(docs, rounds=3)):
        assert abs(np.exp(lm.log_probability(m, around, np.arange(lm.VOCAB))).sum() - 1) < 1e-4
    before, after = (sum(lm.score_text(m, t)[1] for t in texts[:20]) for m in (plain, trained))
    assert after > 0.8 * before > before   # log-likelihoods are negative
    got = {r.doc_id: (r.n_tokens, r.log_likelihood) for r in lm.score(docs, trained).collect()}
    assert all(np.allclose(got[i], lm.score_text(trained, t)) for i, t in enumerate(texts))
    out = lm.score(messy, trained)
    assert out.count() == messy.count() and lm.report(empty).count() == 0
    none = out.filter("doc_id in (0, 1, 2)").collect()
    assert {(r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for r in none} == {(0, 0.0, None)}


def test_words_of_a_bucket_differ(spark, messy):
    """'atshsh' shares the bucket of 'the', 'ontior' that of 'der'."""
    assert lm.ids_of("the")[0] == lm.ids_of("atshsh")[0] and lm.ids_of("der")[0] == lm.ids_of("ontior")[0]
    texts = ["the old fox and the der sea"] * 30 + ["atshsh old fox", "ontior sea ontior", "the the the", "", None]
    docs = spark.createDataFrame([(i % 33, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    every = Counter(w for t in texts for w in words(t))
    bucket = Counter()
    for w, n in every.items():
        bucket[zlib.crc32(w) % lm.VOCAB] += n
    share = {w: n / bucket[zlib.crc32(w) % lm.VOCAB] for w, n in every.items()}
    assert abs(share[b"the"] - 63 / 64) < 1e-12 and abs(share[b"atshsh"] - 1 / 64) < 1e-12
    counts = lm.count_words(docs)
    assert {bytes(r.word): r.n for r in counts.collect()} == every
    model = lm.fit(docs, counts=counts)
    want = sorted((r.doc_id, len(words(r.text)), lm.score_text(model, r.text)[1] + sum(np.log(share[w]) for w in words(r.text)))
                  for r in docs.collect())
    for out in (lm.score(docs, model, counts=counts), lm.report(docs)):
        assert np.allclose(sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in out.collect()), want)
    own = lm.report(messy)
    assert own.count() == messy.count() and all(np.isfinite(r.log_likelihood) for r in own.collect())
    assert {r.log_likelihood for r in lm.score(messy.filter("doc_id = 3"), model, counts=counts).collect()} == {-np.inf}


def test_training_predicts_every_position(spark):
    """Short texts, too: all are of fewer than 15 words."""
    for n in (0, 1, 2, 14, 15, 33):
        assert sorted(i for r in range(lm.ROUNDS) for i in lm.masked(n, r, lm.ROUNDS)) == list(range(n))
    texts = [x for x in ("red fox", "old blue sea", "hill") for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    plain, trained = lm.new_model(lm.count_buckets(docs, "text")), lm.fit(docs)
    assert (trained.gates != plain.gates).any() and (trained.vectors != plain.vectors).any() and trained.nodes.any()
    before, after = (lm.score_text(m, "old blue sea")[1] for m in (plain, trained))
    assert after > before


def lm_batch(n, seed):
    """A model with no zeros in it, and n targets, some buckets of which are frequent."""
    rng = np.random.default_rng(seed)
    m = lm.new_model(rng.integers(0, 500, lm.VOCAB).astype(float))
    m = m._replace(nodes=rng.normal(0, 0.3, m.nodes.shape).astype(np.float32), gates=rng.normal(1, 0.3, m.gates.shape).astype(np.float32),
                   bias=rng.normal(0, 0.3, m.bias.shape).astype(np.float32))
    drawn = (lm.VOCAB * rng.random((n, 2 * lm.SIDE + 1)) ** 4).astype(np.int64)
    around = drawn[:, 1:].copy()
    around[::9, 0] = lm.VOCAB   # padding
    return m, around, drawn[:, 0]


def test_gradients_against_plain_loops():
    m, around, target = lm_batch(700, 5)
    nodes, turns = lm.paths(m.rank[target])
    want = [np.zeros(p.shape) for p in m[:5]]
    for ctx, path, turn in zip(around, nodes, turns):
        h = np.tanh((m.vectors[ctx] * m.gates).sum(0) + m.bias)
        err = 1 / (1 + np.exp(-(m.nodes[path] @ h + m.node_bias[path]))) - turn
        d = (err @ m.nodes[path]) * (1 - h * h)
        want[1] += m.vectors[ctx] * d
        want[2] += d
        for place, gate in zip(ctx, m.gates):
            want[0][place] += d * gate
        want[3][path] += err[:, None] * h
        want[4][path] += err
    learner = lm.Learner(m)
    for n in (700, 3, 700):   # what it keeps between calls leaves nothing behind
        got = learner.gradients(around[:n], target[:n])
    assert all(np.allclose(g, w, rtol=1e-3, atol=1e-4) for g, w in zip(got, want))


def test_a_training_step_allocates_little():
    """Arrays that every step asks the system for anew cost a page fault in each page."""
    m, around, target = lm_batch(lm.BATCH, 6)
    learner = lm.Learner(m)
    learner.step(around, target)
    tracemalloc.start()
    try:
        learner.step(around, target)
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


def test_add_rows():
    rng = np.random.default_rng(2)
    at, rows, want = rng.integers(0, lm.VOCAB, 9000), rng.normal(size=(9000, lm.SIZE)), np.zeros((lm.VOCAB, lm.SIZE))
    np.add.at(want, at, rows)
    got = np.zeros_like(want)
    lm.add_rows(got, at, rows)
    assert np.allclose(got, want)


def test_add_rows_of_uneven_places():
    """One row of a place, up to and beyond those that are added place by place."""
    rng = np.random.default_rng(3)
    at = np.repeat(rng.integers(0, lm.VOCAB, 200), rng.integers(1, 3 * lm.FEW, 200))
    rng.shuffle(at)
    rows = rng.normal(size=(len(at), lm.SIZE))
    for n in (0, 1, 50, len(at)):
        want, got = np.zeros((2, lm.VOCAB, lm.SIZE))
        np.add.at(want, at[:n], rows[:n])
        lm.add_rows(got, at[:n], rows[:n])
        assert np.allclose(got, want)


def test_words_against_a_pattern(odd_texts):
    for byte_map, rule in ((ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (BLANKS, rb"[^\x20\x09-\x0D]+")):
        for text in [*odd_texts, "".join(map(chr, range(300))), " \x0b\x0c a\x1cb\x85c\u2028d ", "", None]:
            assert words(text, byte_map) == re.findall(rule, (text or "").encode().lower())


# -- queries and pipeline ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_lm_score", "op5_url_filter", "op6_token_codes", "op7_toxicity",
                                  "op8_simhash", "op10_bpe"])
def test_query_covers_its_table(spark, data, documents, name):
    want = spark.read.parquet(f"{data}/pages.parquet").count() if name == "op5_url_filter" else documents.count()
    assert QUERIES[name](spark, data).count() == want


def test_pipeline_equals_plain_stages(spark, data, messy, documents):
    odd = documents.withColumn("fp", F.lit("own")).unionByName(messy.withColumn("doc_id", -F.col("doc_id")), allowMissingColumns=True)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == odd.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == docs.select("doc_id").distinct().count()
    left = {r.doc_id: r.text for r in docs.collect()}
    groups = {r.doc_id: r.component_id for r in st.report(odd.filter("doc_id >= 0")).collect()}
    assert len({groups[i] for i in left if i in groups}) == len([i for i in left if i in groups])
    final = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()}
    assert final == {i: ids_by_library(BYTE, t) for i, t in left.items()}
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "n_tokens", "ids_sha256"]
