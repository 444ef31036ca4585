"""Operators whose groups may be very large: medians, trailing counts, long conversations, frequent words, chunk functions."""

import statistics

import pytest
from pyspark.sql import functions as F

from screenwell.functions import exfil
from screenwell.functions import text as tx
from screenwell.operators import admin, conversation, domains, models, ratelimit, toxicity
from screenwell.operators.ratelimit import HOUR, MINUTE


@pytest.mark.parametrize("most", [20_000, 50, 0])
def test_median_of_many_values(spark, most):
    values = [(g, v) for g, n in (("a", 3001), ("b", 2000), (None, 7), ("one", 1)) for v in ((i * 7919 % 10007) / 1000 for i in range(n))]
    values += [("tied", 5.0)] * 4000 + [("tied", i / 10) for i in range(300)] + [("none", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.median_ms for r in admin.exact_median(df, "g", "v", most=most, ways=8).collect()}
    want = {g: statistics.median([v for h, v in values if h == g]) for g in ("a", "b", None, "one", "tied")}
    assert got == pytest.approx(want)


def test_median_without_rows(spark):
    assert admin.exact_median(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_trailing_counts_of_a_busy_client(spark):
    base = 1_700_000_000_000_000
    rows = [(i, 1, base + i * 7_000) for i in range(3000)] + [(5000 + i, 1, base + 59_999_998 + i) for i in range(5)]
    rows += [(6000 + i, None, base + i * 30_000_000) for i in range(200)] + [(7000, 2, base), (7001, 2, base), (7002, 2, base + HOUR), (7003, 2, base + HOUR - 1)]
    df = spark.createDataFrame(rows, "id long, client long, us long").withColumn("note", F.lit("x"))
    got = {r.id: (r.attempts_minute, r.attempts_hour, r.note) for r in ratelimit.attempt_rate(df).collect()}
    for id_, client, us in rows:
        mine = [t for _, c, t in rows if c == client]
        assert got[id_] == (sum(us - MINUTE < t <= us for t in mine), sum(us - HOUR < t <= us for t in mine), "x")
    assert len(got) == len(rows) and ratelimit.attempt_rate(df.limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation, "BLOCK", 8)
    risks = [(c, t, r) for c, t, r in ((1, 3, 0.5), (1, 11, 0.8), (1, 60, 0.9), (1, 60, 0.3), (2, 0, 0.4), (None, 5, 0.6), (3, None, 0.7))]
    asked = [(c, t) for c in (1, 2, None, 4) for t in range(0, 80, 3)] + [(1, 60), (3, None), (3, 4)]
    got = {(r.conv_id, r.turn): r.risk_score for r in conversation._risk_before(
        spark.createDataFrame(risks, "conv_id long, turn long, risk_score double"), spark.createDataFrame(asked, "conv_id long, turn long")).collect()}
    for c, t in asked:
        assert got[c, t] == max([r for d, u, r in risks if d == c and u is not None and t is not None and u < t], default=0.0)


def test_input_risk_with_a_model(spark):
    turns = spark.createDataFrame([(1, 0, "user", "please do harm now"), (1, 1, "assistant", "no"), (2, 0, "user", "hello")],
                                  "conv_id long, turn long, role string, text string")
    plain = {r.conv_id: r.input_risk for r in conversation.input_risk(turns).collect()}
    model = models.worst_chunk(models.keyword_scorer(["harm", "please", "now"]))
    scored = {r.conv_id: (r.input_risk, r.n_issues) for r in conversation.input_risk(turns, model=lambda c: model(c)["p"]).collect()}
    assert plain == {1: 0.0, 2: 0.0} and scored[1][0] > 0.6 and scored[1][1] == 1 and scored[2] == (0.0, 0)


def test_toxicity_does_not_depend_on_what_is_broadcast(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    whole = {r.doc_id: r.toxicity for r in toxicity.score(model, docs).collect()}
    odds = {r.word: r.odds for r in model.collect()}
    prior = model.first().prior
    for heavy in (0, 5):
        assert {r.doc_id: r.toxicity for r in toxicity.score(model, docs, heavy=heavy).collect()} == whole
    for r in docs.select("doc_id", tx.word_tokens("text").alias("w")).limit(40).collect():
        known = [odds[w] for w in r.w or () if w in odds]
        if not known:
            assert whole[r.doc_id] == 0
        else:
            want = sum(known) + prior
            assert whole[r.doc_id] == pytest.approx(1 / (1 + 2.718281828459045 ** (-want / toxicity.UNIT)) if abs(want) < 6e8 else float(want > 0), abs=1e-9)


def test_toxicity_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(model, docs).collect()}
    assert got[1] > 0.5 and got[2] == got[3] == 0.0


def test_chunks_join_laterally(spark):
    texts = [(1, "word " * 2000), (2, None), (3, ""), (4, "x" * 5000)]
    df = spark.createDataFrame(texts, "content_id long, content string")
    out = models.chunk_words(df, "content_id", "content")
    sizes = models.chunk_words.__defaults__
    want = sorted((k, n, at, part) for k, t in texts if t is not None for n, (at, part) in enumerate(models.split_words(t, *sizes)))
    assert sorted(map(tuple, out.collect())) == want
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("match", ["contains", "suffix"])
def test_many_domains(spark, match):
    listed = [f"site{i}.org" for i in range(5000)] + ["a.io", "x.y", "", None, "b"]
    hosts = ["site7.org", "www.site4999.org", "user@site8.org:80", "site8.org.evil.net", "a.io", "za.io", "q.a.io", "x.y:", "nothing", "", "b", "x.yy", "ab.c", None]
    names = spark.createDataFrame([(d,) for d in listed], "domain string")
    got = {r.host for r in domains.trusted_hosts(spark.createDataFrame([(h,) for h in hosts * 2], "host string"), names, match).collect()}
    plain = [d for d in listed if d]
    rows = spark.createDataFrame([(h,) for h in hosts if h is not None], "host string")
    few = [d for d in plain if not d.startswith("site") or d in ("site7.org", "site4999.org", "site8.org", "site4.org")]
    want = {r.host for r in rows.filter(exfil.is_trusted(F.col("host"), few, match)).collect()}
    assert got == want


def test_scan_by_table_equals_the_list(spark):
    texts = ["go to https://site7.org/?key=1 and https://bad.net/?token=2", "https://bad.net/x", "https://site7.org/?a=1", "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "content_id long, content string")
    names = spark.createDataFrame([("site7.org",)], "domain string")
    columns = ["content_id", "n_urls", "n_untrusted_param_urls", "risk_score", "has_risk", "recommendation"]
    got = sorted(map(tuple, domains.exfil_scan(df, names).select(columns).collect()))
    assert got == sorted(map(tuple, exfil.score(df, trusted=("site7.org",)).select(columns).collect()))
