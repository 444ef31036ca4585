"""Statistics over analysis, incident and filter results.

The dashboards' rows (`security_row`, `filter_row`) come from stored partials: sums per day, to which each batch of new results
adds its own (`partials.merge`).  They read no result and no text, and cost the same however much was analysed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.operators import admin


KINDS = ("prompt_injection", "jailbreak", "data_exfiltration")


def analysis_partials(analysed: DataFrame, day: Column) -> DataFrame:
    """Sums per day of a batch of analyses."""
    hot = (F.col("risk_score") >= F.lit(cat.INCIDENT_RISK)) & (F.size("threats") > 0)
    kind = F.get("threats", F.lit(0))["threat_type"]
    return analysed.groupBy(day.alias("day")).agg(
        F.count("*").alias("analyses"), F.count_if(hot).alias("incidents"),
        *[F.count_if(hot & (kind == k)).alias(f"n_{k}") for k in KINDS],
        F.coalesce(F.sum("risk_score"), F.lit(0.0)).alias("risk"))


def incident_partials(incidents: DataFrame, day: Column, sign: int = 1) -> DataFrame:
    """Incidents per day and status; with `sign` -1 those that leave their status."""
    return incidents.groupBy(day.alias("day"), "status").agg((F.count("*") * sign).alias("incidents"))


def status_partials(before: DataFrame, after: DataFrame, key: str, day: Column) -> DataFrame:
    """What a batch of status changes adds: incidents leave their old status and enter the new one."""
    old = before.select(F.col(key), day.alias("day"), "status")
    moved = old.join(after.select(F.col(key), F.col("status").alias("now")), key).filter(~F.col("status").eqNullSafe(F.col("now")))
    sides = F.explode(F.array(F.struct(F.col("status").alias("status"), F.lit(-1).cast("long").alias("n")),
                              F.struct(F.col("now").alias("status"), F.lit(1).cast("long").alias("n")))).alias("s")
    return moved.select("day", sides).groupBy("day", F.col("s.status").alias("status")).agg(F.sum("s.n").alias("incidents"))


def filter_partials(filtered: DataFrame, day: Column, scored: Column) -> DataFrame:
    """Sums per day of a batch of filter results; only `scored` ones have a toxicity."""
    def of_type(t):
        return F.size(F.filter("entities", lambda e: e["type"] == t)).cast("long")

    return filtered.groupBy(day.alias("day")).agg(
        F.count("*").alias("results"), F.sum(F.col("n_pii").cast("long")).alias("pii"), F.count_if(~F.col("is_safe")).alias("unsafe"),
        *[F.sum(of_type(t)).alias(f"n_{t}") for t in cat.FILTER_PII_TYPES],
        F.coalesce(F.sum(F.when(scored, F.col("toxicity"))), F.lit(0.0)).alias("toxicity"), F.count_if(scored).alias("scored"))


def key_requests(keys: DataFrame, usage: DataFrame, endpoint: str, user_id: int | None = None) -> DataFrame:
    """One row: requests of active keys on an endpoint, and how many of the keys have any."""
    live = keys.filter("is_active") if user_id is None else keys.filter(F.col("is_active") & (F.col("user_id") == user_id))
    used = usage.filter(F.col("endpoint") == endpoint).groupBy("api_key_id").agg(F.sum("requests_count").alias("requests"))
    return live.join(used, live["id"] == used["api_key_id"]).filter("requests > 0").agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("api_key_requests"), F.count("*").alias("keys_used"))


def _one(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row aggregates side by side."""
    out = rows.withColumn("_", F.lit(1))
    for other in others:
        out = out.join(other.withColumn("_", F.lit(1)), "_")
    return out.drop("_")


def security_row(analyses: DataFrame, incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """The security statistics from stored partials and the requests of keys."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))

    own = analyses.agg(total("analyses").alias("own_analyses"), total("incidents").alias("total_incidents"),
                       *[total(f"n_{k}").alias(f"n_{k}") for k in KINDS],
                       F.coalesce(F.round(F.sum("risk") / F.sum("analyses"), 3), F.lit(0.0)).alias("average_risk_score"))
    open_ = incidents.filter("status = 'open'").agg(total("incidents").alias("open_incidents"))
    return _one(own, open_, requests).withColumn("total_analyses", F.col("own_analyses") + F.col("api_key_requests"))


def filter_row(results: DataFrame, requests: DataFrame) -> DataFrame:
    """The filter statistics from stored partials and the requests of keys."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))

    own = results.agg(total("results").alias("own_filtered"), total("pii").alias("total_pii"), total("unsafe").alias("unsafe_count"),
                      *[total(f"n_{t}").alias(f"n_{t}") for t in cat.FILTER_PII_TYPES],
                      F.coalesce(F.round(F.try_divide(F.sum("toxicity"), F.sum("scored")), 3), F.lit(0.0)).alias("average_toxicity"))
    return _one(own, requests).withColumn("total_filtered", F.col("own_filtered") + F.col("api_key_requests"))


def threat_distribution(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("threat_type").agg(F.count("*").alias("incidents"),
                                                F.count_if(F.col("status") == "open").alias("open_incidents"))


def key_breakdown(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Requests per active key and endpoint; keys without requests are left out.

    Usage is summed before it meets the keys.
    """
    used = usage.groupBy(F.col("api_key_id").alias("id"), "endpoint").agg(F.sum("requests_count").alias("requests"))
    return keys.filter("is_active").join(used.filter("requests > 0"), "id").select(
        "user_id", "id", "key_name", "endpoint", "requests")


def key_totals(breakdown: DataFrame) -> DataFrame:
    """Requests per user and endpoint by key, for the totals of `security_stats` and `filter_stats`."""
    return breakdown.groupBy("user_id", "endpoint").agg(F.sum("requests").alias("requests"))


def pii_distribution(filtered: DataFrame) -> DataFrame:
    """Entities per type, in long form."""
    return filtered.select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type")).agg(
        F.count("*").alias("entities"))


def filter_counters(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("redact").agg(F.count("*").alias("requests"), F.count_if(~F.col("is_safe")).alias("unsafe"))


def pii_count_histogram(filtered: DataFrame) -> DataFrame:
    return admin.histogram(filtered, F.col("n_pii"), cat.PII_COUNT_BUCKETS)
