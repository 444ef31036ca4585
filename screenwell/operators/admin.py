"""Dashboard statistics over users, keys and the audit log.  `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.sources import tables as tb
from screenwell.functions import fields


def since(ts: Column, now: str, interval: str) -> Column:
    return ts >= fields.ntz(now) - F.expr(f"interval {interval}")


def user_stats(users: DataFrame, now: str) -> DataFrame:
    c = F.col("created_at")
    return users.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"),
        F.count_if(since(c, now, "7 days")).alias("new_last_7d"),
        F.count_if(since(c, now, "30 days")).alias("new_last_30d"))


def key_stats(keys: DataFrame, now: str) -> DataFrame:
    return keys.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"),
                    F.count_if(since(F.col("created_at"), now, "7 days")).alias("created_last_7d"))


def request_stats(audit: DataFrame, now: str) -> DataFrame:
    """Volume, errors, failed logins and latency of the last 24 hours."""
    return audit.filter(since(F.col("timestamp"), now, "24 hours")).agg(
        F.count("*").alias("total_24h"), F.count_if(F.col("status_code") >= 400).alias("blocked_24h"),
        F.count_if(fields.event_type(F.col("status_code")) == "auth_failure").alias("auth_failures_24h"),
        F.round(F.avg("processing_time_ms"), 2).alias("avg_latency_ms"))


def top_endpoints(audit: DataFrame, now: str, k: int = 10) -> DataFrame:
    return (audit.filter(since(F.col("timestamp"), now, "24 hours")).groupBy("endpoint")
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "endpoint").limit(k))


def user_keys(users: DataFrame, keys: DataFrame, last_used: DataFrame, search: str | None = None) -> DataFrame:
    """Users with their key counts and the time any key was last used."""
    found = search_users(users, search) if search else users
    per_user = keys.join(last_used, keys["id"] == last_used["key_id"], "left").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("a"), F.max("last_used_at").alias("last_seen"))
    return found.join(per_user, found["id"] == per_user["user_id"], "left").select(
        found["id"], "email", "created_at", found["is_active"],
        F.coalesce("n", F.lit(0)).alias("key_count"), F.coalesce("a", F.lit(0)).alias("active_key_count"), "last_seen")


def search_users(users: DataFrame, text: str) -> DataFrame:
    return users.filter(F.lower("email").contains(text.lower()))


def page(df: DataFrame, by: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; the unique tie-break makes pages stable."""
    return df.orderBy(F.desc(by), F.desc(tie)).offset(offset).limit(limit)


def list_incidents(incidents: DataFrame, status: str | None = None, severity: str | None = None,
                   limit: int = 50, by: str = "detected_at") -> DataFrame:
    for name, value in (("status", status), ("severity", severity)):
        if value is not None:
            incidents = incidents.filter(F.col(name) == value)
    return page(incidents, by, "content_id", limit)


def list_audit(audit: DataFrame, user_id: int | None = None, event_type: str | None = None, first=None, last=None,
               limit: int = 100, offset: int = 0) -> DataFrame:
    """Audit rows of whole days, newest first."""
    if user_id is not None:
        audit = audit.filter(F.col("user_id") == user_id)
    audit = audit.filter(fields.inclusive_days(F.col("timestamp"), first, last))
    audit = audit.withColumn("event_type", fields.event_type(F.col("status_code")))
    if event_type is not None:
        audit = audit.filter(F.col("event_type") == event_type)
    return page(audit, "timestamp", "id", limit, offset)


def list_policies(policies: DataFrame, user_id: int | None = None, policy_type: str | None = None,
                  enabled: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    for name, value in (("user_id", user_id), ("policy_type", policy_type), ("enabled", enabled)):
        if value is not None:
            policies = policies.filter(F.col(name) == value)
    return page(policies, "created_at", "policy_id", limit, offset)


def histogram(df: DataFrame, value: Column, bounds=cat.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets: how many values are at most each bound.

    One pass, one partial row per task; the bounds are columns and only the
    final single row is turned into one row per bound.
    """
    counts = df.agg(*[F.count_if(value <= F.lit(b)).alias(f"le_{b}") for b in bounds],
                    F.count(value).alias("le_inf"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{b}").alias("n")) for b in bounds]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return counts.select(F.inline(F.array(*rows)))


def exact_median(df: DataFrame, by: str, value: str, most: int = 20_000, ways: int = 64) -> DataFrame:
    """Exact median per group by selection, with no group held in one place.

    Values are counted first.  While a group has more than `most` distinct values, splitters of about equal shares are taken
    from a sketch, the values between two splitters counted, and only the range that holds a middle rank
    is kept; the ranks before it are carried along.  What is left is ranked.
    """
    rows = tb.materialise(df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n")), "median")
    goal = rows.groupBy(by).agg(F.sum("n").alias("_t")).select(
        F.col(by).alias("_g"), F.floor((F.col("_t") - 1) / 2).alias("_lo"), F.floor(F.col("_t") / 2).alias("_hi"), F.lit(0).cast("long").alias("_before"))
    goal = tb.materialise(goal, "median")
    cuts = [i / ways for i in range(1, ways)]
    while (rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0) > max(most, 2):     # two values may be the middle ones
        marks = rows.groupBy(by).agg(F.percentile_approx(value, cuts, 10_000).alias("_marks"))
        placed = _of_group(rows, marks, by).withColumn(
            "_range", F.size(F.filter("_marks", lambda m: m < F.col(value)))).drop("_marks")
        order = Window.partitionBy("_g").orderBy("_range")     # a row for each range
        sizes = _of_group(placed.groupBy(by, "_range").agg(F.sum("n").alias("_n")).withColumnRenamed(by, "_g"), goal, "_g").withColumn(
            "_first", F.col("_before") + F.sum("_n").over(order) - F.col("_n"))
        kept = tb.materialise(sizes.filter((F.col("_hi") >= F.col("_first")) & (F.col("_lo") < F.col("_first") + F.col("_n"))), "median")
        goal = kept.groupBy("_g").agg(F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"), F.min("_first").alias("_before"))
        rows = tb.materialise(placed.join(kept.select("_g", F.col("_range").alias("_r")), placed[by].eqNullSafe(F.col("_g")) & (
            F.col("_range") == F.col("_r")), "left_semi").drop("_range"), "median")
    inner = Window.partitionBy(by).orderBy(value)
    ranked = _of_group(rows, goal.withColumnRenamed("_g", by), by).withColumn("_end", F.col("_before") + F.sum("n").over(inner)).withColumn(
        "_start", F.col("_end") - F.col("n"))

    def at(rank):
        return F.max(F.when((F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end")), F.col(value)))

    return ranked.groupBy(by).agg(((at("_lo") + at("_hi")) / 2).alias("median_ms"))


def _of_group(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Rows with the columns of their group, also where that is null."""
    other = groups.withColumnRenamed(by, "_by")
    return rows.join(other, rows[by].eqNullSafe(F.col("_by"))).drop("_by")


def latency_summary(df: DataFrame, by: str, latency: str, processing: Column, ok: Column) -> DataFrame:
    """Latency statistics per test case; the median is exact."""
    rest = df.groupBy(by).agg(
        F.round(F.avg(latency), 4).alias("mean_ms"), F.min(latency).alias("min_ms"), F.max(latency).alias("max_ms"),
        F.round(F.stddev_samp(latency), 4).alias("stdev_ms"),
        F.round(F.avg(latency) - F.avg(processing), 4).alias("overhead_ms"),
        F.round(F.count_if(ok) / F.count("*") * 100.0, 4).alias("success_rate"))
    return rest.join(exact_median(df, by, latency), by, "left")
