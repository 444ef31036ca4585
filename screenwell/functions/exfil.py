"""Data-exfiltration columns: sensitive data, indicators, URLs, redaction, score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import pii
from screenwell.functions import text as tx


def sensitive_counts(text: str = "content") -> list[Column]:
    return [tx.gated_count(text, p).alias(f"s_{p.name}") for p in cat.SENSITIVE]


def indicator_counts(text: str = "content") -> list[Column]:
    return [tx.gated_count(text, p).alias(f"x_{p.name}") for p in cat.EXFILTRATION]


def urls(text: Column | str) -> Column:
    c = tx.col(text)
    found = F.regexp_extract_all(c, tx.rx(cat.URL), F.lit(0))
    return F.when(c.contains("http"), found).otherwise(F.array().cast("array<string>"))


def netloc(url: Column) -> Column:
    """Authority part of the URL with port and user kept."""
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def param_names(url: Column) -> Column:
    """Names of the query parameters that carry a value."""
    pairs = F.filter(F.split(query_string(url), "&"), lambda p: F.rlike(p, F.lit("(?s)^[^=]*=.")))
    return F.transform(pairs, lambda p: F.url_decode(F.regexp_replace(
        F.substring_index(p, "=", 1), "%(?![0-9a-fA-F]{2})", "%25")))


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", "")


def is_trusted(host: Column, trusted: Sequence[str] = cat.TRUSTED_DOMAINS, match: str = "contains") -> Column:
    """Host on the allow list.

    The default is substring containment, so `example.com.evil.io` passes;
    `match="suffix"` accepts the domain itself and its subdomains only.
    """
    if match == "contains":
        return tx.any_of(host.contains(d) for d in trusted)
    bare = bare_host(host)
    return tx.any_of((bare == d) | bare.endswith("." + d) for d in trusted)


def analyze_url(url: Column, trusted: Sequence[str] = cat.TRUSTED_DOMAINS, match: str = "contains") -> Column:
    host = netloc(url)
    names = param_names(url)
    ok = is_trusted(host, trusted, match)
    suspicious = F.exists(names, lambda n: F.lower(n).isin(*cat.SUSPICIOUS_PARAMS))
    return F.struct(
        url.alias("url"), host.alias("domain"), ok.alias("is_trusted"),
        (F.size(names) > 0).alias("has_parameters"), suspicious.alias("has_suspicious_params"),
        F.when(~ok & suspicious, F.lit("high")).otherwise(F.lit("low")).alias("risk_level"))


def redact_sensitive(text: Column | str) -> Column:
    """Replace the sensitive patterns one after the other; order matters."""
    return reduce(lambda c, p: F.regexp_replace(c, tx.java(p.regex), f"[{p.name.upper()}_REDACTED]"),
                  cat.SENSITIVE, tx.col(text))


def score(df: DataFrame, text: str = "content", pii_tier: str = "none",
          model_spans: Column | None = None, trusted: Sequence[str] = cat.TRUSTED_DOMAINS,
          keep_counts: bool = False) -> DataFrame:
    """Exfiltration score of every row.

    Adds `n_sensitive`, `n_indicators`, `n_urls`, `n_untrusted_param_urls`,
    `risk_score`, `has_risk`, `recommendation`.  `pii_tier` may add personal data
    (`regex`, or `model` with `model_spans`) at severity 0.7; the default leaves
    it out because an address inside an e-mail command would otherwise always
    push a targeted command to the critical band.
    """
    scored = combined(counted(df, text, pii_tier, model_spans, trusted))
    return scored if keep_counts else without_counts(scored)


def without_counts(scored: DataFrame) -> DataFrame:
    return scored.drop(*_S_NAMES, *_X_NAMES, "n_pii_tier", "url_info", tx.LOWER, tx.UNGATED)


def counted(df: DataFrame, text: str = "content", pii_tier: str = "none", model_spans: Column | None = None,
            trusted: Sequence[str] = cat.TRUSTED_DOMAINS) -> DataFrame:
    """What the score is made of: match counts, URLs, and how many of these are untrusted and carry parameters."""
    gated = tx.with_gates(df, text)
    extra = F.lit(0)
    if pii_tier == "regex":
        extra = reduce(lambda a, b: a + b, pii.counts(text))
    elif pii_tier == "model":
        extra = F.size(model_spans) if model_spans is not None else F.lit(0)
    elif pii_tier != "none":
        raise ValueError(f"unknown pii_tier {pii_tier!r}")
    pinned = tx.pin(
        gated, *sensitive_counts(text), *indicator_counts(text), extra.alias("n_pii_tier"),
        F.transform(urls(text), lambda u: analyze_url(u, trusted)).alias("url_info"))
    return pinned.withColumn("n_urls", F.size("url_info")).withColumn("n_untrusted_param_urls", F.size(F.filter(
        "url_info", lambda u: ~u["is_trusted"] & u["has_parameters"])))


_S_NAMES = [f"s_{p.name}" for p in cat.SENSITIVE]
_X_NAMES = [f"x_{p.name}" for p in cat.EXFILTRATION]


def combined(counts: DataFrame) -> DataFrame:
    """The score of what `counted` has found."""
    tier = F.when(F.col("n_pii_tier") > 0, F.lit(cat.MODEL_PII_SEVERITY)).otherwise(F.lit(0.0))
    return (counts
            .withColumn("n_sensitive", F.expr(" + ".join([*_S_NAMES, "n_pii_tier"])))
            .withColumn("n_indicators", F.expr(" + ".join(_X_NAMES)))
            .withColumn("_base", F.greatest(tx.worst_weight("s_", cat.SENSITIVE), tx.worst_weight("x_", cat.EXFILTRATION), tier))
            .withColumn("_both", F.when(
                  (F.col("n_sensitive") > 0) & (F.col("n_indicators") > 0),
                  F.least(F.col("_base") * F.lit(1.3), F.lit(1.0))).otherwise(F.col("_base")))
            .withColumn("risk_score", F.when(
                  F.col("n_untrusted_param_urls") > 0,
                  F.greatest("_both", F.lit(cat.UNTRUSTED_URL_FLOOR))).otherwise(F.col("_both")))
            .withColumn("has_risk", F.col("risk_score") >= F.lit(0.6))
            .withColumn("recommendation", tx.ladder(F.col("risk_score"), cat.REC_EXFIL))
            .drop("_base", "_both"))


def sensitive_previews(text: str, p: cat.Pattern, when: Column) -> Column:
    """`name: match` for every match, long matches cut to 50 characters."""
    found = F.regexp_extract_all(tx.col(text), tx.rx(p.regex), F.lit(0))
    labelled = F.transform(found, lambda m: F.concat(F.lit(f"{p.name}: "), tx.preview(m, 50, "...")))
    return F.when(when, labelled).otherwise(F.array().cast("array<string>"))


def indicator_text(text: str = "content") -> Column:
    """Readable indicators of a row scored with keep_counts=True.

    `type: text` for sensitive data, `name (method)` per indicator match,
    `suspicious_url: host` for URLs that are untrusted or carry telling names.
    """
    parts = []
    for p in cat.SENSITIVE:
        parts.append(sensitive_previews(text, p, F.col(f"s_{p.name}") > 0))
    for p in cat.EXFILTRATION:
        parts.append(F.array_repeat(F.lit(f"{p.name} ({p.group})"), F.col(f"x_{p.name}")))
    shady = F.filter("url_info", lambda u: u["has_suspicious_params"] | ~u["is_trusted"])
    parts.append(F.transform(shady, lambda u: F.concat(F.lit("suspicious_url: "), u["domain"])))
    return F.concat(*parts)
