"""Guarding whole conversations and retrieved context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import exfil
from screenwell.operators import scan


#: Turns of a block in the running maximum of `guard`.
BLOCK = 1024


def input_risk(turns: DataFrame, block_at: float = cat.GUARD_BLOCK, model: scan.Model | None = None) -> DataFrame:
    """Highest injection risk over a conversation's user turns, by the regexes or with a model's verdict."""
    user = scan.with_model(scan.injection_scan(turns.filter(F.col("role") == "user").select("conv_id", "text"), "text"),
                           F.col("text"), model)
    risk = F.coalesce(F.max(F.when(F.col("is_injection"), F.col("risk_score"))), F.lit(0.0))
    return (user.groupBy("conv_id")
            .agg(risk.alias("input_risk"), F.count_if("is_injection").alias("n_issues"))
            .withColumn("input_blocked", F.col("input_risk") >= F.lit(block_at)))


def issues(turns: DataFrame) -> DataFrame:
    """One row per offending user turn."""
    user = scan.injection_scan(turns.filter(F.col("role") == "user").select("conv_id", "turn", "text"), "text")
    return user.filter("is_injection").select("conv_id", "turn", "risk_score", "recommendation")


def guard(turns: DataFrame, block_at: float = cat.GUARD_BLOCK, model: scan.Model | None = None) -> DataFrame:
    """Verdict on every assistant turn.

    A response is dropped when a user turn before it reaches the block level or on
    its own BLOCK, and redacted on REDACT.  The risk so far is a running maximum in two levels, so a
    long conversation is not gathered.
    """
    user = scan.with_model(scan.injection_scan(
        turns.filter(F.col("role") == "user").select("conv_id", "turn", "text"), "text"), F.col("text"), model)
    answers = exfil.score(turns.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"), "text")
    so_far = _risk_before(user.filter("is_injection").select("conv_id", "turn", "risk_score"), answers.select("conv_id", "turn"))
    same = answers["conv_id"].eqNullSafe(so_far["conv_id"]) & answers["turn"].eqNullSafe(so_far["turn"])
    joined = answers.join(so_far.withColumnRenamed("risk_score", "input_risk"), same, "left").drop(so_far["conv_id"], so_far["turn"])
    blocked_in = F.col("input_risk") >= F.lit(block_at)
    redacts = F.col("has_risk") & (F.col("recommendation") == "REDACT")
    blocked_out = F.col("has_risk") & (F.col("recommendation") == "BLOCK")
    return joined.select(
        "conv_id", "turn", "input_risk",
        F.when(F.col("has_risk"), F.col("risk_score")).otherwise(F.lit(0.0)).alias("output_risk"),
        (blocked_in | blocked_out).alias("blocked"), (~blocked_in & redacts).alias("redacted"),
        F.when(blocked_in, F.lit("Input blocked by security policy"))
        .when(blocked_out, F.lit("Output blocked by security policy")).alias("error"),
        F.when(blocked_in | blocked_out, F.lit(None).cast("string"))
        .when(redacts, exfil.redact_sensitive("text")).otherwise(F.col("text")).alias("response"))


def _risk_before(risks: DataFrame, asked: DataFrame) -> DataFrame:
    """Highest risk before each asked turn of its conversation, 0 where there is none.

    Turns are cut into blocks of `BLOCK`: a window over the blocks' maxima (one row a block), and one inside each block.
    """
    points = risks.unionByName(asked.withColumn("risk_score", F.lit(None).cast("double"))).groupBy("conv_id", "turn").agg(
        F.max("risk_score").alias("risk")).withColumn("_block", F.floor(F.col("turn") / BLOCK))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    blocks = points.filter("turn is not null").groupBy("conv_id", "_block").agg(F.max("risk").alias("_top")).select(
        F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.max("_top").over(earlier).alias("_top"))
    ranked = points.withColumn("_in", F.max("risk").over(inside))
    return ranked.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left").select(
        "conv_id", "turn", F.coalesce(F.greatest("_in", "_top"), F.lit(0.0)).alias("risk_score"))


def history(turns: DataFrame) -> DataFrame:
    """Conversations as ordered turns; a range sort, so a very long one spreads over tasks."""
    return turns.orderBy("conv_id", "turn")


def retrieve_top_k(candidates: DataFrame, k: int = 2) -> DataFrame:
    """First k documents of every query; ranks are trimmed before the shuffle."""
    w = Window.partitionBy("query_id").orderBy("doc_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rag_context(candidates: DataFrame, k: int = 2) -> DataFrame:
    """Context of every query from its first k documents, poisoned ones left out.

    At most k documents are collected per query.
    """
    docs = scan.indirect_scan(retrieve_top_k(candidates, k), "content", "retrieval")
    clean = F.when(~F.col("is_indirect_injection"), F.struct(
        "rank", F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(":\n"), F.col("content")).alias("part")))
    return docs.groupBy("query_id").agg(
        F.count("*").alias("n_docs"), F.count_if("is_indirect_injection").alias("n_quarantined"),
        F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(clean)), lambda x: x["part"])).alias("context"))
