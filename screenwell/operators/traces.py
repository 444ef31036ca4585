"""Traces and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwell.functions import fields
from screenwell.operators import admin, usage


def totals(spans: DataFrame) -> DataFrame:
    """Tokens, cost and latency per trace; absent values count as zero."""
    return spans.groupBy("trace_id").agg(
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("total_tokens"),
        F.sum(usage.span_cost(F.col("tokens_used"), F.col("model"))).alias("total_cost"),
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("total_latency_ms"))


def flagged(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """All spans, with `accepted`: whether their trace is there."""
    known = traces.select("trace_id").distinct().withColumn("accepted", F.lit(True))
    return spans.join(known, "trace_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def accepted(spans: DataFrame, traces: DataFrame) -> DataFrame:
    return spans.join(traces.select("trace_id"), "trace_id", "left_semi")


def rejected(spans: DataFrame, traces: DataFrame) -> DataFrame:
    return spans.join(traces.select("trace_id"), "trace_id", "left_anti")


def visible(traces: DataFrame, user_id: int | None) -> DataFrame:
    """Own traces and those without an owner."""
    return traces if user_id is None else traces.filter(F.col("user_id").isNull() | (F.col("user_id") == user_id))


def list_traces(traces: DataFrame, user_id: int | None = None, session_id: str | None = None,
                limit: int = 50, offset: int = 0) -> DataFrame:
    out = visible(traces, user_id)
    if session_id is not None:
        out = out.filter(F.col("session_id") == session_id)
    return admin.page(out, "created_at", "trace_id", limit, offset)


def trace_spans(traces: DataFrame, spans: DataFrame, user_id: int | None = None) -> DataFrame:
    """Spans of visible traces; `by_time` orders them."""
    return spans.join(visible(traces, user_id).select("trace_id"), "trace_id")


def by_time(spans: DataFrame) -> DataFrame:
    """Every trace's spans in time order.

    A range sort on (trace, time, span) may split one long trace over tasks.
    """
    return spans.orderBy("trace_id", "created_at", "span_id")


def patch(spans: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Apply one update per span: non-null fields overwrite, metadata maps merge."""
    up = updates.select(F.col("span_id"), *[F.col(c).alias(f"_{c}") for c in columns],
                        F.col("metadata").alias("_metadata"))
    joined = spans.join(up, "span_id", "left")
    new = [F.coalesce(f"_{c}", c).alias(c) for c in columns]
    keep = [c for c in spans.columns if c not in columns and c != "metadata"]
    return joined.select(*keep, *new, fields.overlay(F.col("metadata"), F.col("_metadata")).alias("metadata"))


def analytics_summary(traces: DataFrame, spans: DataFrame, keys: DataFrame, hourly: DataFrame,
                      user_id: int | None = None) -> DataFrame:
    """One row: trace activity next to key activity.

    Traces of all users count, key usage is the given user's (all when None).
    The one-row parts are stacked and folded into one row.
    """
    t = totals(spans).join(traces.select("trace_id"), "trace_id", "right").agg(
        F.count("*").alias("total_traces"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("trace_tokens"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("trace_cost"),
        F.coalesce(F.sum("total_latency_ms"), F.lit(0.0)).alias("latency"))
    s = spans.agg(F.count("*").alias("total_spans"))
    u = usage.total(keys, hourly, None, user_id)
    parts = t.unionByName(s, allowMissingColumns=True).unionByName(u, allowMissingColumns=True)
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return one.select(
        (F.col("total_traces") + F.col("total_requests")).alias("total_requests"), "total_traces", "total_spans",
        (F.col("trace_tokens") + F.col("total_tokens")).alias("total_tokens"),
        F.round(F.col("trace_cost") + F.col("total_cost"), 4).alias("total_cost"),
        F.round(F.col("latency") / F.greatest("total_traces", F.lit(1)), 2).alias("average_latency_ms"),
        F.col("total_requests").alias("api_key_requests"), "trace_tokens",
        F.round("trace_cost", 4).alias("trace_cost"), F.col("total_tokens").alias("api_key_tokens"),
        F.round("total_cost", 4).alias("api_key_cost"))
