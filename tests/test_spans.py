"""Positions, overlap resolution, redaction and chunking against plain Python."""

import random
import re

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import pii
from screenwell.functions import spans as sp
from screenwell.functions import text as tx
from screenwell.operators import models, scan

TOKENS = ["a@b.co", "é😀", "555-867-5309", "123-45-6789", "4111-1111-1111-1111", "10.20.30.40", "x", "PX4411QZ",
          "1234-5678-9012-3456", "555.123.4567.89", "\n", "１２３", "-", "😀a@b.cd😀"]


def random_texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(TOKENS) + rnd.choice(["", " ", ""]) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def python_spans(text, custom=None):
    out = [(p.name, m.group(), m.start(), m.end(), p.weight, None) for p in cat.PII for m in re.finditer(p.regex, text)]
    for name, rx in (custom or {}).items():
        out += [("name", m.group(), m.start(), m.end(), .75, name) for m in re.finditer(rx, text)]
    return out


def keep_best(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[2], -s[4])):
        clash = next((k for k in kept if not (s[3] <= k[2] or s[2] >= k[3])), None)
        if clash is None:
            kept.append(s)
        elif s[4] > clash[4]:
            kept[kept.index(clash)] = s
    return sorted(kept, key=lambda s: s[2])


def blank(text, spans):
    for s in reversed(spans):
        text = text[:s[2]] + f"[{(s[5] or s[0]).upper()}_REDACTED]" + text[s[3]:]
    return text


def frame(spark, values):
    return tx.with_gates(spark.createDataFrame(list(enumerate(values)), "content_id bigint, content string"))


def test_spans_dedup_and_redaction(spark):
    values, custom = random_texts(3, 400), {"parcel": r"\bPX\d{4}[A-Z]{2}\b", "pair": r"\d{4}-\d{4}", "bad": "("}
    raw = frame(spark, values).select("content_id", "content", pii.regex_spans(custom=custom).alias("raw"))
    rows = raw.withColumn("kept", sp.dedup(F.col("raw"))).withColumn("red", sp.redact("content", F.col("kept"))).withColumn(
        "fixed", sp.redact_fixed("content", F.col("kept"), "#", ["email"])).orderBy("content_id").collect()
    good = {k: v for k, v in custom.items() if k != "bad"}
    for text, row in zip(values, rows):
        want = python_spans(text, good)
        assert [tuple(s) for s in row["raw"]] == want, text
        kept = keep_best(want)
        assert [tuple(s) for s in row["kept"]] == kept, text
        assert row["red"] == blank(text, kept), text
        fixed = text
        for s in reversed([k for k in kept if k[0] == "email"]):
            fixed = fixed[:s[2]] + "#" + fixed[s[3]:]
        assert row["fixed"] == fixed


def test_dedup_random_intervals(spark):
    rnd = random.Random(11)
    cases = []
    for i in range(400):
        spans = []
        for _ in range(rnd.randint(0, 9)):
            a = rnd.randint(0, 25)
            spans.append(("t", "v", a, a + rnd.randint(1, 8), rnd.choice([.5, .7, .9]), None))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, f"id int, s {sp.SPANS}").select("id", sp.dedup(F.col("s")).alias("k"))
    for (_, spans), row in zip(cases, df.orderBy("id").collect()):
        assert [tuple(x) for x in row["k"]] == keep_best(spans)


def test_filter_uses_custom_label_and_default_redact(spark):
    df = spark.createDataFrame([(1, "Parcel PX4411QZ"), (2, "fine")], "content_id bigint, content string")
    out = scan.content_filter(df, redact=F.lit(True), custom={"parcel": r"\bPX\d{4}[A-Z]{2}\b"}).orderBy("content_id").collect()
    assert out[0]["filtered_content"] == "Parcel [PARCEL_REDACTED]" and out[0]["is_safe"]
    assert out[1]["filtered_content"] is None


def test_weak_marker_makes_unsafe_and_patterns_are_named(spark):
    df = spark.createDataFrame([(1, "---")], "content_id bigint, content string")
    row = scan.content_filter(df).first()
    assert not row["is_safe"] and row["patterns"] == ["context_marker_manipulation"]


def test_filters_switch_detectors_off(spark):
    df = spark.createDataFrame([(1, "--- a@b.co")], "content_id bigint, content string")
    row = scan.content_filter(df, filters=F.array(F.lit("toxicity"))).first()
    assert row["is_safe"] and row["n_pii"] == 0 and row["patterns"] == [] and row["toxicity"] == 0


def test_fixed_chunks(spark):
    sizes = [0, 1, 1799, 1800, 1801, 3200, 3201, 3400, 5000]
    df = spark.createDataFrame([(n, "ab😀d" * (n // 4) + "x" * (n % 4)) for n in sizes], "n int, content string")
    for row in df.select("n", "content", sp.chunk_fixed("content").alias("c")).collect():
        t = row["content"]
        want = [t] if len(t) <= 1800 else [t[i:i + 1800] for i in range(0, len(t), 1600)]
        assert row["c"] == want
    assert len([r for r in df.filter("n = 3400").select(F.explode(sp.chunk_fixed("content"))).collect()]) == 3


def test_word_chunks_cover_and_end():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bb ", " ", "c" * rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 80)))
        size = rnd.randint(51, 120)
        parts = list(models.split_words(text, size, 50))
        covered = set()
        for off, part in parts:
            assert text[off:off + len(part)] == part and len(part) <= max(size, 0)
            covered.update(range(off, off + len(part)))
        assert covered == set(range(len(text)))
        assert [o for o, _ in parts] == sorted({o for o, _ in parts})


def test_word_chunks_with_a_space_inside_the_overlap():
    text = "ab " + "x" * 500
    assert len(list(models.split_words(text, 100, 50))) < 300


def test_entity_model_positions(spark):
    from screenwell.plans.documents import capitals_model
    text = "x " * 190 + "Anna Berg " + "y " * 200 + "Carl Dorn"
    df = spark.createDataFrame([(1, text)], "content_id bigint, content string")
    rows = models.entities(df, capitals_model, ["person name"]).collect()
    assert {(r["value"], r["type"]) for r in rows} == {("Anna Berg", "name"), ("Carl Dorn", "name")}
    assert all(text[r["start"]:r["end"]] == r["value"] for r in rows) and len(rows) == 2
