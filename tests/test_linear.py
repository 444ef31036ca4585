"""Foreign patterns: equal spans as `re`, bounded time."""

import random
import re
import time

import pytest

from screenwell.functions import linear, pii

PATTERNS = (r"a+b", r"(a|ab)(c|bcd)(d*)", r"a*?b", r"(?:a|b)+?c", r"\d+", r"\w+@\w+\.com", r"x*", r"(a*)*b", r"^a+", r"b+$", r"(?m)^a*$", r"\ba+\b", r"\Bb+",
            r"[^ab]+", r"(?i)AB+", r"(?s)a.*b", r"a.*b", r"a{2,}", r"(ab){1,3}c*", r"(?:ab|a)*", r"a??b*", r"\s+x", r"(?:)|a+", r"[a-c_]+\Z", r"\Aa+", r"(?P<n>a+)c",
            r"(?i:a+)B", r"(?a)\w+", r"\S+", r"a|b|ab+", r"(a|b|c){2,5}d*", r"a+?", r"(?:a+|b+)+c", r".{3,}")
BITS = ["a", "b", "c", "d", "x", "A", "B", " ", "\n", "1", "@", ".com", "_", "é", "ſ", "K"]


def plain(pattern, text):
    return [m.span() for m in re.finditer(pattern, text) if m.group()]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_re(pattern, monkeypatch):
    rnd = random.Random(pattern)
    monkeypatch.setattr(linear, "WAYS", 0)      # the automaton for all
    rx = linear.Pattern(pattern)
    for _ in range(300):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randrange(14)))
        assert list(rx.spans(text)) == plain(pattern, text), text


@pytest.mark.parametrize("pattern", [r"(a+)+$", r"(a|a)*b", r"(a|aa)+$", r"(.*a){12}b", r"a*a*a*a*b", r"(\w+\s?)+:", r"((a*)*)*b", r"a(.*b)?"])
def test_hostile_patterns_end(pattern):
    text = "a" * 100_000
    begin = time.perf_counter()
    spans = list(linear.compiled(pattern).spans(text + "!"))
    assert time.perf_counter() - begin < 5 and (spans == [] or pattern == r"(a|aa)+$" or spans[0][0] == 0)


def test_what_has_no_automaton():
    for pattern in (r"(a)\1", r"(?=a)b", r"(?<!a)b", r"(", r"a{3000}{3000}", r"(?>a+)b", r"(a)(?(1)b|c)"):
        assert linear.compiled(pattern) is None
    assert linear.compiled(r"ORD-\d{6}").plain and not linear.compiled(r"ORD-\d+").plain
    assert linear.compiled(r"(a|a){0,30}b").plain is None


def test_custom_spans_on_spark(spark):
    own = {"order": r"ORD-\d+", "bad": "(", "evil": r"(a+)+$", "look": "(?=a)a"}
    df = spark.createDataFrame([(1, "ORD-12 and ORD-7", own), (2, "a" * 100_000 + "!", own), (3, None, own), (4, "x", None), (5, "aaa", own)],
                               "id long, t string, p map<string,string>")
    begin = time.perf_counter()
    got = {r.id: [(s.label, s.start, s.end) for s in r.s] for r in df.select("id", pii.custom_spans("t", "p").alias("s")).collect()}
    assert got == {1: [("order", 0, 6), ("order", 11, 16)], 2: [], 3: [], 4: [], 5: [("evil", 0, 3)]}
    assert time.perf_counter() - begin < 20
