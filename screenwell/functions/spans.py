"""Match positions, overlap resolution and redaction inside one row.

Positions are code points.  Matches and the text between them come from the
same regex, so a running sum of their lengths gives every start without a
position function (Spark's counts UTF-16 units).  A row's span list is bounded
by that row's own text.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import text as tx
from screenwell.functions.arrays import bind, blocks, cut, running, running_sum

SPAN = "struct<type:string,value:string,start:int,end:int,confidence:double,label:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


class Rule(NamedTuple):
    """One pattern to look for; `when` tells on which rows it can match."""

    regex: str
    type: str
    confidence: float
    label: str | None = None
    when: Column | None = None


def match_spans(text: Column | str, rules: Iterable[Rule]) -> Column:
    """All matches of the rules, in rule order, as an array of spans.

    Matches and gaps of every rule are gathered first, then running sums of their
    lengths place them.
    """
    c = tx.col(text)

    def found(r: Rule) -> Column:
        hit = F.struct(F.regexp_extract_all(c, tx.rx(r.regex), F.lit(0)).alias("m"),
                       F.split(c, tx.java(r.regex), -1).alias("g"))
        return F.struct((hit if r.when is None else F.when(r.when, hit)).alias("hit"), F.lit(r.type).alias("type"),
                        F.lit(r.confidence).alias("confidence"), F.lit(r.label).cast("string").alias("label"))

    def place(rule: Column) -> Column:
        m, g = rule["hit"]["m"], rule["hit"]["g"]
        lengths = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)),
                             lambda value, gap: (F.char_length(value) + F.char_length(gap)).cast("long"))
        return bind(running_sum(lengths), lambda ends: F.transform(m, lambda value, i: F.struct(
            rule["type"], value, F.get(ends, i) - F.char_length(value), F.get(ends, i), rule["confidence"],
            rule["label"]).cast(SPAN)))

    present = F.filter(F.array(*map(found, rules)), lambda r: r["hit"].isNotNull())
    return F.flatten(F.transform(present, place))


def sort_spans(spans: Column) -> Column:
    """By start, then higher confidence, then original order."""
    keyed = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("a"), (-s["confidence"]).alias("b"), i.alias("c"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def dedup(spans: Column) -> Column:
    """Drop overlapping spans, keeping the more confident (the earlier on ties).

    Sorted spans fall into runs that no span reaches out of, and runs do not bear
    on each other.  Within a run the kept ones never overlap, so a new span can
    only collide with the last kept one.
    """
    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        clear = (F.size(acc) == 0) | (s["start"] >= F.coalesce(last["end"], F.lit(0)))
        return (F.when(clear, F.concat(acc, F.array(s)))
                .when(s["confidence"] > last["confidence"],
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s)))
                .otherwise(acc))

    def best(run):
        return F.when(F.size(run) == 1, run).otherwise(F.aggregate(run, no_spans(), step))

    return bind(sort_spans(spans), lambda s: F.flatten(F.transform(runs(s), best)))


def runs(spans: Column) -> Column:
    """Sorted spans as an array of arrays, cut where a span starts behind the end of all before."""
    reach = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b))

    def cut_at(ends):
        opens = F.array_compact(F.transform(spans, lambda s, i: F.when(
            (i == 0) | (s["start"] >= F.get(ends, i - 1)), i)))
        return bind(opens, lambda o: F.transform(o, lambda i, k: F.slice(
            spans, i + 1, F.coalesce(F.get(o, k + 1), F.size(spans)) - i)))

    return bind(reach, cut_at)


def redact(text: Column | str, spans: Column, token=None) -> Column:
    """Replace disjoint, sorted spans.  `token` maps a span to its replacement.

    Pieces between spans come from blocks of the text, so it is not walked from its
    start for each.
    """
    c = tx.col(text)
    token = token or typed_token

    def pieces(parts, m):
        def before(s, i):
            done = F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
            return F.concat(cut(parts, done, s["start"] - done), token(s))

        done = F.try_element_at(m, F.lit(-1))["end"]
        return F.concat(F.array_join(F.transform(m, before), ""), cut(parts, done, F.char_length(c) - done))

    return F.when(F.size(spans) == 0, c).otherwise(
        bind(blocks(c), lambda parts: bind(spans, lambda m: pieces(parts, m))))


def typed_token(span: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.coalesce(span["label"], span["type"])), F.lit("_REDACTED]"))


def redact_fixed(text: Column | str, spans: Column, token: str = "[REDACTED]",
                 types: list[str] | None = None) -> Column:
    """Replace spans, or those of the given types only, by one fixed text."""
    if types:
        spans = F.filter(spans, lambda s: s["type"].isin(*types))
    return redact(text, spans, lambda s: F.lit(token))


def merge(*sources: Column) -> Column:
    """Entities of several detectors, in source order, then de-duplicated."""
    return dedup(F.concat(*sources))


def chunk_fixed(text: Column | str, size: int = cat.CHUNK_SIZE, overlap: int = cat.CHUNK_OVERLAP) -> Column:
    """Overlapping windows of fixed length, as an array."""
    c = tx.col(text)
    n = F.char_length(c)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n <= size, F.array(c)).otherwise(
        F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size))))
