"""Personal-data columns: counts, spans, custom patterns, model labels."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import linear
from screenwell.functions import spans as sp
from screenwell.functions import text as tx

def _digits(text: Column | str) -> Column:
    """Three digits in a row: needed by phone, SSN and card numbers alike."""
    return tx.matches(text, r"\d{3}")


def _when(name: str, text: Column | str) -> Column:
    if name == "email":
        return tx.gate(name)
    if name == "ip_address":
        return tx.gate(name) & tx.matches(text, r"\d\.\d")
    if name == "ssn":
        return tx.gate(name) & _digits(text)
    return _digits(text)


def counts(text: str = "content") -> list[Column]:
    """One match count per built-in type (needs `with_gates`)."""
    return [tx.count_matches(text, p.regex, _when(p.name, text)).alias(f"n_{p.name}") for p in cat.PII]


def regex_spans(text: str = "content", custom: Mapping[str, str] | None = None) -> Column:
    """Raw spans of the built-in types, then of the custom patterns, undeduplicated.

    Needs `with_gates`.  A custom pattern that does not compile is skipped.
    """
    return sp.match_spans(text, rules(text, custom))


def rules(text: str = "content", custom: Mapping[str, str] | None = None) -> list[sp.Rule]:
    """The built-in types, then the custom patterns that compile."""
    own = dict(all_pack_patterns())
    return [sp.Rule(p.regex, p.name, p.weight, None, _when(p.name, text)) for p in cat.PII] + [
        sp.Rule(rx, cat.CUSTOM_PII_TYPE, cat.CUSTOM_PII_CONFIDENCE, name, tx.gate(name) if own.get(name) == rx else None)
        for name, rx in valid_patterns(custom).items()]


def valid_patterns(custom: Mapping[str, str] | None) -> dict[str, str]:
    """Those that compile, where the patterns come from and where they run."""
    good = {}
    for name, pattern in (custom or {}).items():
        try:
            re.compile(pattern)
            SparkSession.active().range(1).select(F.rlike(F.lit(""), tx.rx(pattern))).collect()
        except (re.error, PySparkException):
            continue
        good[name] = pattern
    return good


def custom_spans(text: Column | str, patterns: Column | str) -> Column:
    """Spans of each row's own patterns (a map of names to patterns; null and what does not compile count as none).

    The patterns are data, so they run where they compile: in one Arrow function over
    batches, each pattern compiled once per worker, in time that is bounded by the text's length (`linear`).
    """
    @F.pandas_udf(sp.SPANS)
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        def spans(t, own):
            pairs = own.items() if isinstance(own, dict) else own or ()
            return [{"type": cat.CUSTOM_PII_TYPE, "value": t[a:b], "start": a, "end": b,
                     "confidence": cat.CUSTOM_PII_CONFIDENCE, "label": name}
                    for name, pattern in pairs if t and pattern and (rx := linear.compiled(pattern))
                    for a, b in rx.spans(t)]

        return pd.Series([spans(t, own) for t, own in zip(texts, maps)], index=texts.index, dtype=object)

    return run(tx.col(text), tx.col(patterns))


def all_pack_patterns() -> list[tuple[str, str]]:
    return [kv for pack in cat.PACKS for kv in pack.patterns]


def detect(text: str = "content", engine: str = "regex", model: Column | None = None,
           custom: Mapping[str, str] | None = None) -> Column:
    """Spans by engine: `regex` (raw), `model` (given spans), `hybrid` (both, de-duplicated)."""
    if engine == "regex" or model is None:
        return regex_spans(text, custom)
    if engine == "model":
        return model
    if engine == "hybrid":
        return sp.merge(model, regex_spans(text, custom))
    raise ValueError(f"unknown engine {engine!r}")


def label_to_type(label: Column) -> Column:
    """Canonical type of a model's free-text label; first matching rule wins."""
    norm = F.replace(F.lower(label), F.lit(" "), F.lit("_"))
    first, *rest = cat.LABEL_RULES
    out = F.when(tx.any_of(norm.contains(f) for f in first[1]), F.lit(first[0]))
    for type_, fragments in rest:
        out = out.when(tx.any_of(norm.contains(f) for f in fragments), F.lit(type_))
    return out.otherwise(F.lit(cat.LABEL_DEFAULT))


def filter_type(type_: Column) -> Column:
    """The seven types the filter reports; all others count as names."""
    return F.when(type_.isin(*cat.FILTER_PII_TYPES), type_).otherwise(F.lit(cat.LABEL_DEFAULT))

