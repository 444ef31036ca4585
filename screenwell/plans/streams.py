"""Streaming jobs run to their end over the tables present; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.operators import ratelimit
from screenwell.plans import sqlkit as k
from screenwell.plans.registry import query
from screenwell.plans.relational import _ETYPE, _IP
from screenwell.sources import corpus
from screenwell.sources import tables as tb
from screenwell.streaming import jobs


def _content(spark, d):
    df = jobs.source(spark, d, "documents")
    kind = F.element_at(F.array(F.lit("input"), F.lit("output"), F.lit("system_prompt")), (F.col("doc_id") % 3 + 1).cast("int"))
    return df.select(F.col("doc_id").alias("content_id"), corpus.planted(F.col("text"), F.col("doc_id")).alias("content"),
                     kind.alias("context_type"), F.col("source").alias("trace_id"))


_ANA = k.with_(k.CONTENT, k.analyse("content"))


@query("stream_scan", _ANA + "SELECT content_id, threat_types, risk_score, risk_score < 0.5::DOUBLE AS is_safe FROM ana")
def stream_scan(spark, d):
    out = jobs.scan_stream(_content(spark, d)).select(
        "content_id", F.concat_ws(",", F.transform("threats", lambda t: t["threat_type"])).alias("threat_types"), "risk_score", "is_safe")
    return jobs.run_append(out)


@query("stream_incidents", _ANA + "SELECT content_id, split_part(threat_types, ',', 1) AS threat_type, risk_score FROM ana WHERE risk_score >= 0.7::DOUBLE")
def stream_incidents(spark, d):
    return jobs.run_append(jobs.incidents_stream(_content(spark, d)).select("content_id", "threat_type", "risk_score"))


@query("stream_usage_tumbling", """SELECT date_trunc('hour', ts) AS hour_start, user_id AS api_key_id, event_type AS endpoint, count(*) AS requests_count,
sum(CAST(value AS BIGINT))::BIGINT AS tokens_used FROM events GROUP BY ALL""")
def stream_usage_tumbling(spark, d):
    ev = jobs.source(spark, d, "events").select(
        "ts", F.col("user_id").alias("api_key_id"), F.col("event_type").alias("endpoint"), F.rint("value").cast("bigint").alias("tokens"))
    return jobs.run_update(jobs.usage_tumbling(ev), ["hour_start", "api_key_id", "endpoint"])


@query("stream_trace_totals", k.with_(k.SPANS) + f"""SELECT trace_id, sum(coalesce(tokens_used, 0))::BIGINT AS total_tokens, round(sum({k.SPAN_COST}), 9) AS total_cost,
sum(latency_ms) AS total_latency_ms, count(*) AS spans, max(created_at) + INTERVAL 1 HOUR AS closed_at FROM spans_t GROUP BY 1
HAVING max(created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM spans_t) - INTERVAL 10 MINUTE""")
def stream_trace_totals(spark, d):
    """Totals of the traces that the watermark has closed at the end of the table."""
    c = jobs.source(spark, d, "conversations")
    spans = c.select(F.col("conv_id").alias("trace_id"),
                     F.when(F.col("turn") % 5 != 4, F.size(F.split(F.trim("text"), " +"))).alias("tokens_used"),
                     F.element_at(F.array(*[F.lit(m) for m in corpus.MODELS]), (F.col("conv_id") % 5 + 1).cast("int")).alias("model"),
                     F.char_length("text").cast("double").alias("latency_ms"),
                     F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 500 as int), cast(turn as int))").alias("created_at"))
    return jobs.run_append(jobs.trace_totals(spans)).withColumn("total_cost", F.round("total_cost", 9))


def _audit(spark, d):
    e = F.col("event_type")
    return jobs.source(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id",
        F.create_map(*[F.lit(x) for kv in corpus.AUDIT_ENDPOINTS.items() for x in kv])[e].alias("endpoint"),
        F.when(e == "purchase", F.lit("POST")).otherwise(F.lit("GET")).alias("http_method"),
        F.when(e == "error", F.element_at(F.array(F.lit(401), F.lit(429), F.lit(500)), (F.col("event_id") % 3 + 1).cast("int")))
        .otherwise(F.lit(200)).alias("status_code"), F.col("value").alias("processing_time_ms"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(", 172.16.0.1")))
        .when(F.col("event_id") % 4 == 1, F.lit("")).alias("x_forwarded_for"),
        F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("192.168.1."), (F.col("user_id") % 250).cast("string")))
        .when(F.col("event_id") % 4 == 1, F.lit("")).alias("x_real_ip"),
        F.when(F.col("event_id") % 8 != 5, F.lit("203.0.113.9")).alias("peer"))


@query("stream_admin_24h", k.with_(k.AUDIT) + """SELECT w AS window_end, count(*) AS total, count(*) FILTER (WHERE status_code >= 400) AS blocked,
count(*) FILTER (WHERE status_code = 401) AS auth_failures, round(avg(processing_time_ms), 2) AS avg_latency_ms FROM (
SELECT *, unnest(list_transform(range(1, 25), lambda h: date_trunc('hour', timestamp) + to_hours(CAST(h AS INTEGER)))) AS w FROM audit) GROUP BY 1""")
def stream_admin_24h(spark, d):
    return jobs.run_update(jobs.admin_24h(_audit(spark, d)), ["window_end"])


@query("stream_audit", k.with_(k.AUDIT) + f"""SELECT id, timestamp, user_id, endpoint, http_method, {_IP} AS ip_address, status_code,
round(processing_time_ms, 2) AS processing_time_ms, {_ETYPE} AS event_type FROM audit WHERE endpoint NOT IN ({', '.join(k.q(p) for p in cat.AUDIT_SKIP_PATHS)})""")
def stream_audit(spark, d):
    return jobs.run_append(jobs.audit_stream(_audit(spark, d)))


_LIM = k.with_("a AS (SELECT event_id AS id, user_id AS client, epoch_us(ts) AS us, false AS oauth FROM events)", k.limiter("a", "1", "3"))


_PATHS = k.with_("a AS (SELECT event_id AS id, user_id % 5 AS client, epoch_us(ts) AS us, event_type = 'signup' AS oauth FROM events WHERE event_type <> 'error')",
                k.limiter("a", "1", "CASE WHEN oauth THEN 1 ELSE 3 END"))


@query("stream_rate_limit", _PATHS + "SELECT * FROM dec")
def stream_rate_limit(spark, d):
    """Online decisions under small limits: OAuth paths counted apart, exempt paths not at all."""
    requests = ratelimit.by_path(_audit(spark, d)).select(
        "id", F.col("timestamp").alias("ts"), (F.col("user_id") % 5).alias("client"), "oauth")
    return jobs.run_append(jobs.rate_limit(requests, 1, 3, 1, 1, oauth="oauth"))


@query("rate_state_ttl", _LIM + """, seen AS (SELECT client, max(us) AS latest FROM a GROUP BY 1), mark AS (SELECT max(us) // 1000 - 600000 AS ms FROM a)
SELECT CAST(client AS VARCHAR) AS client, count(*) AS held_before, latest // 1000 + 3600000 < any_value(ms) AS purged,
  CASE WHEN latest // 1000 + 3600000 < any_value(ms) THEN 0 ELSE count(*) END AS held_after
FROM dec JOIN a USING (id, client) JOIN seen USING (client), mark WHERE admitted AND us > latest - 4200000000 GROUP BY client, latest""")
def rate_state_ttl(spark, d):
    """State rows of each client after the requests were decided, and after the watermark has passed an idle hour."""
    requests = jobs.source(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("client"))
    root = tb.scratch(spark, "limiter")
    jobs.run_append(jobs.rate_limit(requests, 1, 3), root)
    before = jobs.limiter_state(spark, f"{root}/check", 0).withColumnRenamed("held", "held_before")
    after = jobs.limiter_state(spark, f"{root}/check", jobs.last_batch(spark, f"{root}/check")).withColumnRenamed("held", "held_after")
    return before.join(after, "client", "left").select(
        "client", "held_before", F.coalesce("held_after", F.lit(0)).alias("held_after"), F.col("held_after").isNull().alias("purged"))
