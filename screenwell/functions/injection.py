"""Prompt-injection and jailbreak columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import text as tx

_SCOPE_GATE = (("show", "what", "reveal", "print"),
               ("prompt", "instruction", "system", "configuration", "settings", "parameters"))
_INDIRECT_GATE = (("this", "an", "instruction", "context"), ("when", "if", "hidden", "ignore", "system"))


def pattern_counts(text: str = "content") -> list[Column]:
    return [tx.gated_count(text, p).alias(f"n_{p.name}") for p in cat.INJECTION]


def marker_count() -> Column:
    return tx.count_contained(cat.CONTEXT_MARKERS)


def marker_score(count: Column) -> Column:
    return (F.when(count >= 3, F.lit(0.8)).when(count == 2, F.lit(0.6))
            .when(count == 1, F.lit(0.3)).otherwise(F.lit(0.0)))


def scope_hit(text: str = "content") -> Column:
    return F.when(tx.opened(_SCOPE_GATE), tx.any_of(tx.matches(text, p) for p in cat.SCOPE)).otherwise(F.lit(False))


def scope_score(hit: Column) -> Column:
    return F.when(hit, F.lit(cat.SCOPE_SCORE)).otherwise(F.lit(0.0))


def indirect_hits(text: str = "content") -> Column:
    """Numbers of the zero-click patterns that match, in catalogue order."""
    found = F.array_compact(F.array(*[
        F.when(tx.matches(text, p), F.lit(i)) for i, p in enumerate(cat.INDIRECT)]))
    return F.when(tx.opened(_INDIRECT_GATE), found).otherwise(F.array().cast("array<int>"))


def jailbreak_hits() -> Column:
    return tx.contained(cat.JAILBREAK)


def jailbreak_confidence(n: Column) -> Column:
    return F.least(n * F.lit(0.5), F.lit(1.0))


def score(df: DataFrame, text: str = "content", keep_counts: bool = False) -> DataFrame:
    """Regex injection score of every row.

    Adds `n_detections`, `risk_score`, `is_injection`, `recommendation`.  The
    score is the highest severity seen plus 0.05 for every detection (each match
    counts, markers and scope count once), capped at 1.
    """
    names = [f"n_{p.name}" for p in cat.INJECTION]
    counted = tx.pin(
        tx.with_gates(df, text), *pattern_counts(text), marker_score(marker_count()).alias("marker_score"),
        scope_score(scope_hit(text)).alias("scope_score"))
    total = F.expr(" + ".join(names) + " + int(marker_score > 0) + int(scope_score > 0)")
    scored = (counted
              .withColumn("n_detections", total)
              .withColumn("max_severity", F.greatest(tx.worst_weight("n_", cat.INJECTION), "marker_score", "scope_score"))
              .withColumn("risk_score", F.when(
                  F.col("n_detections") > 0,
                  F.least(F.col("max_severity") + F.col("n_detections") * F.lit(cat.HIT_BONUS), F.lit(1.0)))
                  .otherwise(F.lit(0.0)))
              .withColumn("is_injection", F.col("risk_score") > F.lit(cat.INJECTION_THRESHOLD))
              .withColumn("recommendation", tx.ladder(F.col("risk_score"), cat.REC_REGEX)))
    return scored if keep_counts else scored.drop(*names, "max_severity", "marker_score", "scope_score",
                                                  tx.LOWER, tx.UNGATED)


def detected_names() -> Column:
    """Names of everything that fired, on a frame scored with keep_counts=True.

    A pattern name appears once per match, as each match is one detection.
    """
    parts = [F.array_repeat(F.lit(p.name), F.col(f"n_{p.name}")) for p in cat.INJECTION]
    parts.append(F.array_repeat(F.lit("context_marker_manipulation"), (F.col("marker_score") > 0).cast("int")))
    parts.append(F.array_repeat(F.lit("scope_violation"), (F.col("scope_score") > 0).cast("int")))
    return F.concat(*parts)
