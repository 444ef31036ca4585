"""Key usage: hourly roll-up, joins with keys and users, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import fields
from screenwell.operators import partials

PK = ("api_key_id", "endpoint", "date", "hour")


def hourly(events: DataFrame, requests: Column | None = None) -> DataFrame:
    """Usage events rolled up per key, endpoint, day and hour."""
    return events.groupBy(*PK).agg(
        F.sum(requests if requests is not None else F.lit(1)).cast("bigint").alias("requests_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_used"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd"))


def bucket(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts))


def merge_hourly(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: counters of equal keys add up."""
    return stored.unionByName(new).groupBy(*PK).agg(*[
        F.sum(c).alias(c) for c in ("requests_count", "tokens_used", "cost_usd")])


def upsert_hourly(path: str, new: DataFrame, batch: int, period: str = "yyyy-MM-dd") -> list[str]:
    """Upsert a batch of hourly counters into the stored roll-up at `path`: only the periods of its dates are read and rewritten."""
    counters = new.select(*PK, "requests_count", "tokens_used", "cost_usd")
    return partials.merge(path, counters, PK, F.date_format("date", period), batch)


def _totals(usage: DataFrame, *by: str) -> DataFrame:
    """Usage summed per key before any join, so a busy key crosses the shuffle as one row per task."""
    return usage.groupBy("api_key_id", *by).agg(
        F.sum("requests_count").alias("requests"), F.sum("tokens_used").alias("tokens"),
        F.sum("cost_usd").alias("cost"))


def by_key(keys: DataFrame, usage: DataFrame, endpoint: str, user_id: int | None = None) -> DataFrame:
    """Requests of every active key on one endpoint; keys without any are left out."""
    live = keys.filter("is_active")
    if user_id is not None:
        live = live.filter(F.col("user_id") == user_id)
    used = _totals(usage.filter(F.col("endpoint") == endpoint))
    return (live.join(used, live["id"] == used["api_key_id"]).filter(F.col("requests") > 0)
            .select("id", "user_id", "key_name", fields.key_preview(F.col("full_key")).alias("key_preview"), "requests"))


def total(keys: DataFrame, usage: DataFrame, endpoint: str | None = None, user_id: int | None = None) -> DataFrame:
    """One row of totals over active keys; zeros when nothing was used.

    With an endpoint the outer join degenerates to an inner one, so it is
    written as such; the totals are the same either way.
    """
    live = keys.filter("is_active")
    if user_id is not None:
        live = live.filter(F.col("user_id") == user_id)
    used = _totals(usage if endpoint is None else usage.filter(F.col("endpoint") == endpoint))
    return live.join(used, live["id"] == used["api_key_id"], "inner").agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("total_cost"))


def per_user(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Totals per user over active keys, zeros kept."""
    used = _totals(usage)
    live = keys.filter("is_active")
    return live.join(used, live["id"] == used["api_key_id"], "left").groupBy("user_id").agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("total_cost"))


def key_stats(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Every key with its usage, in one join."""
    used = _totals(usage)
    return keys.join(used, keys["id"] == used["api_key_id"], "left").select(
        "id", "user_id", "key_name", "is_active",
        F.coalesce("requests", F.lit(0)).alias("total_requests"), F.coalesce("tokens", F.lit(0)).alias("tokens_used"),
        F.coalesce("cost", F.lit(0)).cast("double").alias("cost_usd"))


def detail(usage: DataFrame, today: str) -> DataFrame:
    """Totals of every key, and its requests on one day."""
    day = F.to_date(F.lit(today))
    return usage.groupBy("api_key_id").agg(
        F.sum("requests_count").alias("total_requests"),
        F.sum(F.when(F.col("date") == day, F.col("requests_count")).otherwise(F.lit(0))).alias("requests_today"),
        F.sum("tokens_used").alias("tokens_used"), F.sum("cost_usd").cast("double").alias("cost_usd"))


def top_endpoints(usage: DataFrame, k: int = 10) -> DataFrame:
    """Per key its k busiest endpoints."""
    w = Window.partitionBy("api_key_id").orderBy(F.desc("requests"), "endpoint")
    return (_totals(usage, "endpoint").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("api_key_id", "endpoint", "requests", "tokens", "rank"))


def key_user(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Active keys with their user's address."""
    u = users.select(F.col("id").alias("user_id"), "email")
    return keys.filter("is_active").join(u, "user_id").select("id", "user_id", "email", "key_name", "expires_at")


def active(keys: DataFrame, now: str) -> DataFrame:
    return keys.filter(F.col("is_active") & ~fields.is_expired(F.col("expires_at"), fields.ntz(now)))


def over_quota(keys: DataFrame, limit: int = cat.MAX_ACTIVE_KEYS) -> DataFrame:
    """Users who may not create another key."""
    return keys.filter("is_active").groupBy("user_id").agg(F.count("*").alias("active_keys")).filter(
        F.col("active_keys") >= limit)


def llm_cost(spans: DataFrame, *by: str) -> DataFrame:
    """Tokens and cost per model, and further columns, from the price list."""
    keys = [*by, "model"]
    return spans.groupBy(*keys).agg(
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"),
        F.sum(span_cost(F.col("tokens_used"), F.col("model"))).alias("_c")).select(
        *keys, "tokens", F.round("_c", 6).alias("cost_usd"))


def span_cost(tokens: Column, model: Column) -> Column:
    prices = F.create_map(*[F.lit(x) for kv in cat.PRICE_PER_1K.items() for x in kv])
    return (F.coalesce(tokens, F.lit(0)) / F.lit(1000.0)) * F.coalesce(prices[model], F.lit(cat.DEFAULT_PRICE))
