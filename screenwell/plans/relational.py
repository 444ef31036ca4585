"""Queries over keys, users, usage, traces, audit rows and their changes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import fields
from screenwell.operators import admin, changes, partials, policy, ratelimit, scan, stats, traces, usage
from screenwell.plans import sqlkit as k
from screenwell.plans.registry import query
from screenwell.sources import corpus
from screenwell.sources import tables as tb

U, A = corpus.NOW_USAGE, corpus.NOW_AUDIT
HOURLY = (k.USAGE_EVENTS, k.HOURLY)


def _hourly(spark, d):
    return usage.hourly(corpus.usage_events(spark, d), F.col("requests"))


# -- sources, sinks, upserts -------------------------------------------------------------


@query("src_tables", k.with_(k.USERS, k.KEYS, *HOURLY[-2:], k.POLICIES, k.AUDIT) + " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS rows, min({at})::TIMESTAMP AS first, max({at})::TIMESTAMP AS last FROM {table}" for name, table, at in (
        ("users", "users_t", "created_at"), ("api_keys", "keys_t", "created_at"), ("usage", "hourly", "date"),
        ("policies", "policies_t", "created_at"), ("audit", "audit", "timestamp"))))
def src_tables(spark, d):
    """The five relational tables: rows and the time they span."""
    def one(name, df, at):
        at = F.col(at).cast("timestamp_ntz")
        return df.agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).select(
            F.lit(name).alias("name"), "rows", "first", "last")

    parts = [one("users", corpus.users(spark, d), "created_at"), one("api_keys", corpus.api_keys(spark, d), "created_at"),
             one("usage", _hourly(spark, d), "date"), one("policies", corpus.policies(spark, d), "created_at"),
             one("audit", corpus.audit_log(spark, d), "timestamp")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("src_json_columns", """SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '-1') AS BIGINT) AS k, 0 AS bad FROM events""")
def src_json_columns(spark, d):
    """JSON columns as maps; broken JSON gives an empty map."""
    df = tb.table(spark, d, "events")
    good, bad = tb.json_map(F.col("props")), tb.json_map(F.concat(F.lit("{"), F.col("props")))
    return df.select("event_id", F.coalesce(good["k"].cast("bigint"), F.lit(-1)).alias("k"), F.size(bad).alias("bad"))


@query("json_rules", k.with_(k.POLICIES, k.RULES) + """SELECT policy_id, count(*) AS n_rules, max(priority) AS top,
'[' || string_agg('{"condition":"' || condition || '","action":"' || action || '","priority":' || priority || '}', ',' ORDER BY pos) || ']' AS encoded FROM rules_t GROUP BY 1""")
def json_rules(spark, d):
    p = policy.decode(corpus.policies(spark, d))
    return p.select("policy_id", F.size("rules").alias("n_rules"),
                    F.array_max(F.transform("rules", lambda r: r["priority"])).alias("top"), F.to_json("rules").alias("encoded"))


_RES = k.with_(k.CONTENT, k.analyse("content"))


@query("sink_results", _RES + "SELECT content_id, risk_score, CAST('2024-01-01' AS DATE) + CAST(content_id % 5 AS INTEGER) AS date FROM ana")
def sink_results(spark, d):
    """Analysis results written as Parquet by day and read back."""
    out = tb.scratch(spark, "results")
    res = scan.security_analyze(corpus.content(spark, d)).select(
        "content_id", "risk_score", F.expr("date_add(date'2024-01-01', cast(content_id % 5 as int))").alias("date"))
    tb.write_results(res, out)
    return spark.read.parquet(out)


@query("sink_incidents", _RES + "SELECT content_id, split_part(threat_types, ',', 1) AS threat_type, 'open' AS status FROM ana WHERE risk_score >= 0.7::DOUBLE")
def sink_incidents(spark, d):
    out = tb.scratch(spark, "incidents")
    tb.write_incidents(scan.incidents(scan.security_analyze(corpus.content(spark, d))), out)
    return spark.read.parquet(out).select("content_id", "threat_type", "status")


def _ip():
    return fields.client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))


_IP = "coalesce(CASE WHEN x_forwarded_for <> '' THEN trim(split_part(x_forwarded_for, ',', 1)) END, nullif(x_real_ip, ''), peer, 'unknown')"


@query("sink_audit", k.with_(k.AUDIT) + f"""SELECT CASE WHEN endpoint = '/health' THEN 'rejected' ELSE 'stored' END AS side, count(*) AS rows,
count(DISTINCT {_IP}) AS clients FROM audit GROUP BY 1""")
def sink_audit(spark, d):
    """Audit rows appended; rows without endpoint land in the side table."""
    root = tb.scratch(spark, "audit")
    df = corpus.audit_log(spark, d).withColumn("ip_address", _ip()).withColumn(
        "endpoint", F.when(F.col("endpoint") != "/health", F.col("endpoint")))
    tb.write_audit(df, root)
    return spark.read.parquet(root).groupBy("side").agg(F.count("*").alias("rows"), F.countDistinct("ip_address").alias("clients"))


@query("upsert_usage_hourly", k.with_(*HOURLY) + "SELECT api_key_id, endpoint, date, hour, requests_count, tokens_used, cost_usd::DOUBLE AS cost_usd FROM hourly")
def upsert_usage_hourly(spark, d):
    """A stored roll-up by month, two later batches that share months with it, and the last of them again."""
    ev, path = corpus.usage_events(spark, d), tb.scratch(spark, "usage-hourly")
    late, last = F.col("date") >= F.lit(dt.date(1999, 1, 1)), F.col("date") >= F.lit(dt.date(2001, 6, 1))
    odd = F.col("api_key_id") % 2 == 1
    batches = [ev.filter(~late), ev.filter(late & ~(last & odd)), ev.filter(last & odd)]
    for number, batch in enumerate([*batches, batches[-1]]):
        usage.upsert_hourly(path, usage.hourly(batch, F.col("requests")), min(number, len(batches) - 1), "yyyy-MM")
    return partials.read(spark, path).withColumn("cost_usd", F.col("cost_usd").cast("double"))


_DEF = """w AS (SELECT o_custkey AS key, o_orderkey AS seq, ['redact', 'toxicity_threshold', 'use_analyzer'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS name,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS v FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 'shared', o_orderstatus FROM orders)"""


def _writes(spark, d):
    name = F.element_at(F.array(F.lit("redact"), F.lit("toxicity_threshold"), F.lit("use_analyzer")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return tb.table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"),
        F.create_map(name, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")), F.lit("shared"), F.col("o_orderstatus")).alias("value"))


@query("upsert_defaults", k.with_(_DEF) + "SELECT key, name, arg_max(v, seq) AS value FROM w WHERE v IS NOT NULL GROUP BY ALL")
def upsert_defaults(spark, d):
    return changes.upsert_defaults(_writes(spark, d))


@query("merge_defaults", k.with_(_DEF) + """SELECT seq, max(CASE WHEN name = 'shared' THEN v END) AS shared, coalesce(max(CASE WHEN name <> 'shared' THEN v END), 'old') AS own,
'kept' AS other FROM w GROUP BY 1""")
def merge_defaults(spark, d):
    """One partial write laid over existing settings; nulls keep the old value."""
    w = _writes(spark, d)
    own = F.map_filter("value", lambda n, v: n != "shared")
    name = F.map_keys(own)[0]
    old = F.create_map(name, F.lit("old"), F.lit("shared"), F.lit("old"), F.lit("other"), F.lit("kept"))
    m = w.select("seq", name.alias("n"), fields.overlay(old, F.col("value")).alias("m"))
    return m.select("seq", F.col("m")["shared"].alias("shared"), F.col("m")[F.col("n")].alias("own"), F.col("m")["other"].alias("other"))


_CHG = """chg AS (SELECT o_custkey AS policy_id, o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'toggle' END AS op,
  'upd-' || o_orderkey AS name, o_orderkey % 2 = 0 AS enabled, o_custkey // 6 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS user_id FROM orders
  UNION ALL SELECT 10000000 + c_custkey, -1, 'create', 'new-' || c_custkey, c_acctbal >= 0, c_custkey // 6 FROM customer)"""


def _asker():
    """User who asks for a policy: its owner, but for every seventh order somebody else."""
    return F.call_function("div", F.col("o_custkey"), F.lit(6)) + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)


def _changes(spark, d):
    o = tb.table(spark, d, "orders").select(
        F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("delete")).when(F.col("o_orderkey") % 3 == 0, F.lit("update"))
        .otherwise(F.lit("toggle")).alias("op"),
        F.concat(F.lit("upd-"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 2 == 0).alias("enabled"),
        _asker().alias("user_id"),
        F.col("o_orderdate").alias("changed_at"))
    c = tb.table(spark, d, "customer").select(
        (F.col("c_custkey") + 10000000).alias("policy_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("op"),
        F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_acctbal") >= 0).alias("enabled"),
        F.call_function("div", F.col("c_custkey"), F.lit(6)).alias("user_id"), fields.ntz(U).alias("changed_at"))
    return o.unionByName(c).select("*", F.lit("compliance").alias("policy_type"), F.lit("[]").alias("rules_json"),
                                   F.lit("[]").alias("tags_json"))


@query("apply_policy_changes", k.with_(k.POLICIES, _CHG.replace("chg AS", "asked AS"),
                                       """chg AS (SELECT a.* FROM asked a LEFT JOIN policies_t p USING (policy_id)
  WHERE p.policy_id IS NULL OR p.user_id = a.user_id),
f AS (SELECT policy_id, any_value(user_id) AS user_id, count(*) FILTER (WHERE op = 'update') AS ups,
  max(seq) FILTER (WHERE op IN ('update', 'create')) AS wseq, bool_or(op = 'delete') AS deleted, bool_or(op = 'create') AS created FROM chg GROUP BY 1),
t AS (SELECT policy_id, count(*) FILTER (WHERE op = 'toggle' AND (wseq IS NULL OR seq > wseq)) % 2 = 1 AS flip, max(name) FILTER (WHERE seq = wseq) AS wname,
  bool_or(enabled) FILTER (WHERE seq = wseq) AS wen FROM chg JOIN f USING (policy_id) GROUP BY 1)""") + """
SELECT coalesce(p.policy_id, f.policy_id) AS policy_id, coalesce(p.user_id, f.user_id) AS user_id, coalesce(wname, p.name) AS name,
CASE WHEN coalesce(flip, false) THEN NOT coalesce(wen, p.enabled) ELSE coalesce(wen, p.enabled) END AS enabled,
coalesce(p.version, 1) + coalesce(ups, 0) AS version FROM policies_t p FULL JOIN f ON p.policy_id = f.policy_id LEFT JOIN t ON t.policy_id = f.policy_id
WHERE NOT coalesce(deleted, false) AND (p.policy_id IS NOT NULL OR created)""")
def apply_policy_changes(spark, d):
    return changes.apply_policy_changes(corpus.policies(spark, d), _changes(spark, d)).select(
        "policy_id", "user_id", "name", "enabled", "version")


@query("last_policy_change", k.with_(_CHG) + "SELECT policy_id, seq, op, name FROM chg QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY seq DESC) = 1")
def last_policy_change(spark, d):
    return changes.last_change(_changes(spark, d), "policy_id").select("policy_id", "seq", "op", "name")


@query("soft_delete_keys", k.with_(k.KEYS) + f"SELECT id, user_id, is_active AND NOT coalesce(expires_at < TIMESTAMP '{U}', false) AS is_active FROM keys_t")
def soft_delete_keys(spark, d):
    """Expired keys removed by their owner; removals asked for by another user have no effect."""
    keys = corpus.api_keys(spark, d)
    own = keys.filter(fields.is_expired(F.col("expires_at"), fields.ntz(U))).select("id", "user_id")
    wrong = keys.filter(F.col("expires_at").isNull()).select("id", (F.col("user_id") + 1).alias("user_id"))
    return changes.deactivate_keys(keys, own.unionByName(wrong)).select("id", "user_id", "is_active")


@query("latest_provider_key", """SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
lpad(CAST(arg_max(o_orderkey, o_orderkey) % 10000 AS VARCHAR), 4, '0') AS last_4, min(o_orderdate) AS created_at FROM orders GROUP BY ALL""")
def latest_provider_key(spark, d):
    w = tb.table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("openai")).otherwise(F.lit("anthropic")).alias("provider"),
        F.col("o_orderkey").alias("seq"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0").alias("last_4"),
        F.col("o_orderdate").alias("written_at"))
    return changes.latest_provider_key(w).select("user_id", "provider", "last_4", "created_at")


# -- filters and pages ----------------------------------------------------------------------


@query("list_traces", k.with_(k.TRACES) + """SELECT trace_id, session_id, created_at FROM traces_t WHERE (user_id IS NULL OR user_id = 3)
ORDER BY created_at DESC, trace_id DESC LIMIT 50""")
def list_traces(spark, d):
    return traces.list_traces(corpus.traces(spark, d), user_id=3).select("trace_id", "session_id", "created_at")


@query("list_policies", k.with_(k.POLICIES) + """SELECT policy_id, name, created_at FROM policies_t WHERE policy_type = 'compliance' AND enabled
ORDER BY created_at DESC, policy_id DESC LIMIT 200""")
def list_policies(spark, d):
    return admin.list_policies(corpus.policies(spark, d), policy_type="compliance", enabled=True, limit=200).select(
        "policy_id", "name", "created_at")


_ETYPE = "CASE status_code WHEN 401 THEN 'auth_failure' WHEN 429 THEN 'rate_limit_hit' ELSE 'api_request' END"


@query("list_audit", k.with_(k.AUDIT) + f"""SELECT id, timestamp, user_id, {_ETYPE} AS event_type FROM audit
WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' AND {_ETYPE} = 'auth_failure' ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 20""")
def list_audit(spark, d):
    return admin.list_audit(corpus.audit_log(spark, d), None, "auth_failure", "2024-01-05", "2024-01-20", 100, 20).select(
        "id", "timestamp", "user_id", "event_type")


@query("inclusive_days", k.with_(k.AUDIT) + "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM audit WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09 23:59:59.999999' GROUP BY 1")
def inclusive_days(spark, d):
    df = corpus.audit_log(spark, d).filter(fields.inclusive_days(F.col("timestamp"), "2024-01-03", "2024-01-09"))
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


@query("page_newest_first", k.with_(k.KEYS) + "SELECT id, user_id, created_at FROM keys_t ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def page_newest_first(spark, d):
    return admin.page(corpus.api_keys(spark, d).select("id", "user_id", "created_at"), "created_at", "id", 50, 100)


@query("search_users", k.with_(k.USERS) + "SELECT id, email FROM users_t WHERE lower(email) LIKE '%00007%'")
def search_users(spark, d):
    return admin.search_users(corpus.users(spark, d), "00007").select("id", "email")


@query("active_keys", k.with_(k.KEYS) + f"SELECT id, expires_at FROM keys_t WHERE is_active AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{U}')")
def active_keys(spark, d):
    return usage.active(corpus.api_keys(spark, d), U).select("id", "expires_at")


@query("key_expiry", k.with_(k.KEYS) + f"""SELECT id, created_at + to_days(CAST(30 + id % 365 AS INTEGER)) AS expires_at,
created_at + to_days(CAST(30 + id % 365 AS INTEGER)) < TIMESTAMP '2000-01-01' AS is_expired FROM keys_t""")
def key_expiry(spark, d):
    df = corpus.api_keys(spark, d).select("id", fields.expires_at(F.col("created_at"), F.col("id") % 365 + 30).alias("expires_at"))
    return df.withColumn("is_expired", fields.is_expired(F.col("expires_at"), fields.ntz("2000-01-01")))


@query("audit_skip_paths", k.with_(k.AUDIT) + f"SELECT id, endpoint FROM audit WHERE endpoint NOT IN ({', '.join(k.q(p) for p in cat.AUDIT_SKIP_PATHS)})")
def audit_skip_paths(spark, d):
    return corpus.audit_log(spark, d).filter(fields.audited(F.col("endpoint"))).select("id", "endpoint")


@query("audit_event_type", k.with_(k.AUDIT) + f"SELECT id, {_ETYPE} AS event_type FROM audit")
def audit_event_type(spark, d):
    return corpus.audit_log(spark, d).select("id", fields.event_type(F.col("status_code")).alias("event_type"))


@query("client_ip", k.with_(k.AUDIT) + f"SELECT id, {_IP} AS ip_address FROM audit")
def client_ip(spark, d):
    return corpus.audit_log(spark, d).select("id", _ip().alias("ip_address"))


_PARTS = r"list_filter(string_split_regex(auth_header, '\s+'), lambda x: x <> '')"


@query("token_shape_class", k.with_(k.AUDIT, f"p AS (SELECT id, auth_header, {_PARTS} AS parts FROM audit)") + f"""SELECT id, CASE WHEN auth_header IS NULL OR auth_header = '' THEN 'missing'
WHEN len(parts) <> 2 OR lower(parts[1]) <> 'bearer' THEN 'malformed' WHEN length(parts[2]) < 10 THEN 'too_short'
WHEN starts_with(parts[2], '{cat.SERVICE_KEY_PREFIX}') THEN 'service_key' WHEN contains(parts[2], '.') THEN 'jwt_like' ELSE 'unknown_format' END AS shape,
CASE WHEN starts_with(parts[2], '{cat.SERVICE_KEY_PREFIX}') THEN CASE WHEN length(parts[2]) >= 16 THEN substr(parts[2], 1, 12) || '****' || right(parts[2], 4)
ELSE '{cat.SERVICE_KEY_PREFIX}****' END END AS key_preview FROM p""")
def token_shape_class(spark, d):
    token = F.try_element_at(F.split("auth_header", " "), F.lit(2))
    return corpus.audit_log(spark, d).select(
        "id", fields.token_shape(F.col("auth_header")).alias("shape"), fields.audit_key_preview(token).alias("key_preview"))


_PK = """pk AS (SELECT o_orderkey AS id, ['openai', 'anthropic', 'cohere', 'huggingface', 'other'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS provider,
  ['sk-', 'sk-ant-', '', 'hf_', 'x-'][CAST(o_orderkey // 5 % 5 AS INTEGER) + 1] || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, CAST(o_orderkey % 40 AS INTEGER)) AS key FROM orders)"""


def _provider_keys(spark, d):
    o = F.col("o_orderkey")
    provider = F.element_at(F.array(*[F.lit(p) for p in ("openai", "anthropic", "cohere", "huggingface", "other")]), (o % 5 + 1).cast("int"))
    lead = F.element_at(F.array(*[F.lit(p) for p in ("sk-", "sk-ant-", "", "hf_", "x-")]), (F.floor(o / 5) % 5 + 1).cast("int"))
    return tb.table(spark, d, "orders").select(
        o.alias("id"), provider.alias("provider"),
        F.concat(lead, F.substr(F.sha2(o.cast("string"), 256), F.lit(1), (o % 40).cast("int"))).alias("key"))


@query("key_format_valid", k.with_(_PK) + """SELECT id, CASE provider WHEN 'openai' THEN starts_with(key, 'sk-') AND length(key) >= 20
WHEN 'anthropic' THEN starts_with(key, 'sk-ant-') AND length(key) >= 20 ELSE false END AS valid,
CASE provider WHEN 'openai' THEN starts_with(key, 'sk-') AND length(key) > 20 WHEN 'anthropic' THEN starts_with(key, 'sk-ant-') AND length(key) > 20
WHEN 'cohere' THEN length(key) > 20 WHEN 'huggingface' THEN starts_with(key, 'hf_') AND length(key) > 20 ELSE false END AS stored_valid FROM pk""")
def key_format_valid(spark, d):
    return _provider_keys(spark, d).select(
        "id", fields.key_format_valid(F.col("key"), F.col("provider")).alias("valid"),
        fields.stored_key_format_valid(F.col("key"), F.col("provider")).alias("stored_valid"))


@query("mask_key", k.with_(_PK) + """SELECT id, CASE WHEN length(key) < 8 THEN '****' ELSE substr(key, 1, 12) || '****' || right(key, 4) END AS preview,
CASE WHEN length(key) <= 4 THEN '****' ELSE '...' || right(key, 4) END AS tail,
CASE provider WHEN 'openai' THEN 'sk-****' WHEN 'anthropic' THEN 'sk-ant-****' ELSE '****' END || right(key, 4) AS masked FROM pk""")
def mask_key(spark, d):
    key, prov = F.col("key"), F.col("provider")
    return _provider_keys(spark, d).select(
        "id", fields.key_preview(key).alias("preview"), fields.mask_tail(key).alias("tail"),
        fields.mask_provider(fields.last_four(key), prov).alias("masked"))


@query("key_prefix", k.with_(k.KEYS) + "SELECT id, regexp_extract(full_key, '^[^_]*_[^_]*') || '_' AS prefix FROM keys_t")
def key_prefix(spark, d):
    return corpus.api_keys(spark, d).select("id", fields.key_prefix(F.col("full_key")).alias("prefix"))


@query("invalid_permissions", """WITH p AS (SELECT o_orderkey AS id, [['security:analyze', 'llm:chat'], ['admin:all', 'filter:pii'], ['root', 'admin:all', 'root'], []][CAST(o_orderkey % 4 AS INTEGER) + 1] AS r FROM orders)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: NOT list_contains(""" + k.lst(cat.PERMISSIONS) + """, x)))), ',') AS invalid FROM p""")
def invalid_permissions(spark, d):
    sets = F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in (
        ("security:analyze", "llm:chat"), ("admin:all", "filter:pii"), ("root", "admin:all", "root"), ())])
    df = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(sets, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("r"))
    return df.select("id", F.array_join(F.array_sort(fields.invalid_permissions(F.col("r"))), ",").alias("invalid"))


# -- joins ------------------------------------------------------------------------------------


@query("join_key_user", k.with_(k.KEYS, k.USERS) + "SELECT k.id, k.user_id, email, key_name, expires_at FROM keys_t k JOIN users_t u ON k.user_id = u.id WHERE k.is_active")
def join_key_user(spark, d):
    return usage.key_user(corpus.api_keys(spark, d), corpus.users(spark, d))


_PREVIEW = "substr(full_key, 1, 12) || '****' || right(full_key, 4)"
_BYKEY = f"""SELECT k.id, k.user_id, key_name, {_PREVIEW} AS key_preview, sum(requests_count)::BIGINT AS requests FROM keys_t k
LEFT JOIN hourly h ON k.id = h.api_key_id AND endpoint = '/filter' WHERE is_active GROUP BY ALL HAVING coalesce(sum(requests_count)::BIGINT, 0) > 0"""


@query("join_usage_by_key", k.with_(k.KEYS, *HOURLY) + _BYKEY)
def join_usage_by_key(spark, d):
    return usage.by_key(corpus.api_keys(spark, d), _hourly(spark, d), "/filter")


@query("breakdown_by_requests", k.with_(k.KEYS, *HOURLY, f"b AS ({_BYKEY.replace('/filter', '/security/analyze')})") +
       "SELECT id, user_id, key_name, requests FROM b ORDER BY user_id, requests DESC, id")
def breakdown_by_requests(spark, d):
    """Every user's keys by requests; a range sort, so one user's keys may spread over tasks."""
    b = usage.by_key(corpus.api_keys(spark, d), _hourly(spark, d), "/security/analyze")
    return b.select("id", "user_id", "key_name", "requests").orderBy("user_id", F.desc("requests"), "id")


@query("join_usage_total", k.with_(k.KEYS, *HOURLY) + """SELECT coalesce(sum(requests_count)::BIGINT, 0) AS total_requests, coalesce(sum(tokens_used)::BIGINT, 0) AS total_tokens,
coalesce(sum(cost_usd), 0)::DOUBLE AS total_cost FROM keys_t k LEFT JOIN hourly h ON k.id = h.api_key_id WHERE is_active AND endpoint = '/filter'""")
def join_usage_total(spark, d):
    return usage.total(corpus.api_keys(spark, d), _hourly(spark, d), "/filter")


@query("join_usage_summary", k.with_(k.KEYS, *HOURLY) + """SELECT user_id, coalesce(sum(requests_count)::BIGINT, 0) AS total_requests, coalesce(sum(tokens_used)::BIGINT, 0) AS total_tokens,
coalesce(sum(cost_usd), 0)::DOUBLE AS total_cost FROM keys_t k LEFT JOIN hourly h ON k.id = h.api_key_id WHERE is_active GROUP BY 1""")
def join_usage_summary(spark, d):
    return usage.per_user(corpus.api_keys(spark, d), _hourly(spark, d))


@query("join_user_keys", k.with_(k.USERS, k.KEYS, k.LAST_USED) + """SELECT u.id, email, u.created_at, u.is_active, count(k.id) AS key_count,
count(k.id) FILTER (WHERE k.is_active) AS active_key_count, max(last_used_at) AS last_seen FROM users_t u LEFT JOIN keys_t k ON k.user_id = u.id
LEFT JOIN last_used l ON l.key_id = k.id GROUP BY ALL""")
def join_user_keys(spark, d):
    return admin.user_keys(corpus.users(spark, d), corpus.api_keys(spark, d), corpus.last_used(spark, d))


@query("join_key_usage_stats", k.with_(k.KEYS, *HOURLY) + """SELECT k.id, user_id, key_name, is_active, coalesce(sum(requests_count)::BIGINT, 0) AS total_requests,
coalesce(sum(tokens_used)::BIGINT, 0) AS tokens_used, coalesce(sum(cost_usd), 0)::DOUBLE AS cost_usd FROM keys_t k LEFT JOIN hourly h ON k.id = h.api_key_id GROUP BY ALL""")
def join_key_usage_stats(spark, d):
    return usage.key_stats(corpus.api_keys(spark, d), _hourly(spark, d))


@query("join_pack_config", k.with_(k.KEYS, f"packs(template_pack, f, redact, threshold, analyzer, template) AS (VALUES {k.PACK_ROWS})") +
       "SELECT id, template_pack, array_to_string(f, ',') AS filters, redact, threshold, analyzer, template FROM keys_t LEFT JOIN packs USING (template_pack)")
def join_pack_config(spark, d):
    return scan.join_pack_config(corpus.api_keys(spark, d), spark).select(
        "id", "template_pack", F.when(F.col("pack_filters").isNotNull(), F.concat_ws(",", "pack_filters")).alias("filters"),
        F.col("pack_redact").alias("redact"), F.col("pack_threshold").alias("threshold"),
        F.col("pack_analyzer").alias("analyzer"), F.col("pack_template").alias("template"))


@query("policies_by_ids", k.with_(k.POLICIES) + """SELECT o_orderkey AS request_ord, user_id, policy_id, name FROM policies_t
JOIN orders ON policy_id = o_custkey WHERE enabled AND o_orderkey % 7 <> 0""")
def policies_by_ids(spark, d):
    """Requested policies, the requests coming as a table; every seventh asks for somebody else's."""
    wanted = tb.table(spark, d, "orders").select(
        F.col("o_custkey").alias("policy_id"), _asker().alias("user_id"), F.col("o_orderkey").alias("request_ord"))
    return policy.pick_from(corpus.policies(spark, d), wanted).select("request_ord", "user_id", "policy_id", "name")


def _some_traces(spark, d):
    return corpus.traces(spark, d).filter(F.col("user_id").isNotNull())


@query("semi_spans_with_trace", k.with_(k.SPANS, k.TRACES) + """SELECT span_id, EXISTS (SELECT 1 FROM traces_t t WHERE t.trace_id = s.trace_id AND user_id IS NOT NULL) AS accepted FROM spans_t s""")
def semi_spans_with_trace(spark, d):
    return traces.flagged(corpus.spans(spark, d), _some_traces(spark, d)).select("span_id", "accepted")


@query("trace_spans", k.with_(k.SPANS, k.TRACES) + "SELECT trace_id, span_id, parent_span_id, span_type FROM spans_t JOIN traces_t USING (trace_id) WHERE user_id IS NULL OR user_id = 3")
def trace_spans(spark, d):
    return traces.trace_spans(corpus.traces(spark, d), corpus.spans(spark, d), 3).select(
        "trace_id", "span_id", "parent_span_id", "span_type")


@query("spans_by_time", k.with_(k.SPANS) + "SELECT trace_id, span_id, created_at FROM spans_t ORDER BY trace_id, created_at, span_id")
def spans_by_time(spark, d):
    return traces.by_time(corpus.spans(spark, d)).select("trace_id", "span_id", "created_at")


# -- aggregates ---------------------------------------------------------------------------------


@query("trace_totals", k.with_(k.SPANS) + f"""SELECT trace_id, sum(coalesce(tokens_used, 0))::BIGINT AS total_tokens, round(sum({k.SPAN_COST}), 9) AS total_cost,
sum(latency_ms) AS total_latency_ms FROM spans_t GROUP BY 1""")
def trace_totals(spark, d):
    return traces.totals(corpus.spans(spark, d)).withColumn("total_cost", F.round("total_cost", 9))


_SUM = k.with_(k.SPANS, k.TRACES, k.KEYS, *HOURLY, f"""t AS (SELECT count(DISTINCT trace_id) AS n, count(*) AS s, sum(coalesce(tokens_used, 0))::BIGINT AS tok, sum({k.SPAN_COST}) AS cost,
  sum(latency_ms) AS lat FROM spans_t), u AS (SELECT sum(requests_count)::BIGINT AS r, sum(tokens_used)::BIGINT AS tok, sum(cost_usd)::DOUBLE AS cost FROM hourly JOIN keys_t ON id = api_key_id WHERE is_active)""")


@query("analytics_summary", _SUM + """SELECT n + r AS total_requests, n AS total_traces, s AS total_spans, t.tok + u.tok AS total_tokens, round(t.cost + u.cost, 4) AS total_cost,
round(lat / n, 2) AS average_latency_ms, r AS api_key_requests, t.tok AS trace_tokens, round(t.cost, 4) AS trace_cost, u.tok AS api_key_tokens, round(u.cost, 4) AS api_key_cost FROM t, u""")
def analytics_summary(spark, d):
    return traces.analytics_summary(corpus.traces(spark, d), corpus.spans(spark, d), corpus.api_keys(spark, d), _hourly(spark, d))


@query("usage_union", _SUM + """SELECT sum(requests)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost FROM (
SELECT n AS requests, tok AS tokens, cost FROM t UNION ALL SELECT r, tok, cost FROM u)""")
def usage_union(spark, d):
    """Dashboard activity and key activity added up."""
    t = traces.totals(corpus.spans(spark, d)).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("total_cost").alias("cost"))
    u = usage.total(corpus.api_keys(spark, d), _hourly(spark, d)).toDF("requests", "tokens", "cost")
    return t.unionByName(u).agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


@query("key_usage_detail", k.with_(*HOURLY) + """SELECT api_key_id, sum(requests_count)::BIGINT AS total_requests,
coalesce(sum(requests_count) FILTER (WHERE date = DATE '1998-06-01'), 0)::BIGINT AS requests_today, sum(tokens_used)::BIGINT AS tokens_used, sum(cost_usd)::DOUBLE AS cost_usd FROM hourly GROUP BY 1""")
def key_usage_detail(spark, d):
    return usage.detail(_hourly(spark, d), "1998-06-01")


@query("top_endpoints_by_requests", k.with_(*HOURLY) + """SELECT api_key_id, endpoint, sum(requests_count)::BIGINT AS requests, sum(tokens_used)::BIGINT AS tokens,
row_number() OVER (PARTITION BY api_key_id ORDER BY sum(requests_count)::BIGINT DESC, endpoint) AS rank FROM hourly GROUP BY 1, 2 QUALIFY rank <= 10""")
def top_endpoints_by_requests(spark, d):
    return usage.top_endpoints(_hourly(spark, d))


@query("admin_user_stats", k.with_(k.USERS) + f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
count(*) FILTER (WHERE created_at >= TIMESTAMP '{U}' - INTERVAL 7 DAY) AS new_last_7d, count(*) FILTER (WHERE created_at >= TIMESTAMP '{U}' - INTERVAL 30 DAY) AS new_last_30d FROM users_t""")
def admin_user_stats(spark, d):
    return admin.user_stats(corpus.users(spark, d), U)


@query("admin_key_stats", k.with_(k.KEYS) + f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-07-30' - INTERVAL 7 DAY) AS created_last_7d FROM keys_t""")
def admin_key_stats(spark, d):
    return admin.key_stats(corpus.api_keys(spark, d), "2001-07-30")


_DAY = f"timestamp >= TIMESTAMP '{A}' - INTERVAL 24 HOUR"


@query("admin_request_stats", k.with_(k.AUDIT) + f"""SELECT count(*) AS total_24h, count(*) FILTER (WHERE status_code >= 400) AS blocked_24h,
count(*) FILTER (WHERE status_code = 401) AS auth_failures_24h, round(avg(processing_time_ms), 2) AS avg_latency_ms FROM audit WHERE {_DAY}""")
def admin_request_stats(spark, d):
    return admin.request_stats(corpus.audit_log(spark, d), A)


@query("top_endpoints", k.with_(k.AUDIT) + f"SELECT endpoint, count(*) AS count FROM audit WHERE {_DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_endpoints(spark, d):
    return admin.top_endpoints(corpus.audit_log(spark, d), A)


@query("trailing_bounds", k.with_(k.AUDIT) + f"""SELECT endpoint, count(*) FILTER (WHERE {_DAY}) AS last_day, count(*) FILTER (WHERE timestamp >= TIMESTAMP '{A}' - INTERVAL 7 DAY) AS last_week,
count(*) FILTER (WHERE timestamp >= TIMESTAMP '{A}' - INTERVAL 30 DAY) AS last_month FROM audit GROUP BY 1""")
def trailing_bounds(spark, d):
    ts = F.col("timestamp")
    return corpus.audit_log(spark, d).groupBy("endpoint").agg(*[
        F.count_if(admin.since(ts, A, i)).alias(n) for n, i in (("last_day", "24 hours"), ("last_week", "7 days"), ("last_month", "30 days"))])


@query("bucket_date_hour", k.with_(k.AUDIT) + "SELECT CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM audit GROUP BY ALL")
def bucket_date_hour(spark, d):
    return usage.bucket(corpus.audit_log(spark, d), "timestamp").groupBy("date", "hour").agg(F.count("*").alias("n"))


@query("llm_cost", k.with_(k.SPANS, k.TRACES) + f"""SELECT user_id, model, sum(coalesce(tokens_used, 0))::BIGINT AS tokens,
round(sum({k.SPAN_COST}), 6) AS cost_usd FROM spans_t JOIN traces_t USING (trace_id) GROUP BY ALL""")
def llm_cost(spark, d):
    """Per user and model; spans know their user by their trace."""
    owner = corpus.traces(spark, d).select("trace_id", "user_id")
    return usage.llm_cost(corpus.spans(spark, d).join(owner, "trace_id"), "user_id")


@query("key_breakdown", k.with_(k.KEYS, *HOURLY) + """SELECT user_id, id, key_name, endpoint, sum(requests_count)::BIGINT AS requests
FROM keys_t JOIN hourly ON id = api_key_id WHERE is_active GROUP BY ALL HAVING sum(requests_count) > 0""")
def key_breakdown(spark, d):
    return stats.key_breakdown(corpus.api_keys(spark, d), _hourly(spark, d))


@query("latency_histogram", k.with_(k.AUDIT, "b AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 'inf'::DOUBLE]) AS le)") +
       "SELECT le::DOUBLE AS le, count(*) FILTER (WHERE processing_time_ms <= le) AS n FROM audit, b GROUP BY le")
def latency_histogram(spark, d):
    return admin.histogram(corpus.audit_log(spark, d), F.col("processing_time_ms"))


@query("key_quota_check", k.with_(k.KEYS) + "SELECT user_id, count(*) AS active_keys FROM keys_t WHERE is_active GROUP BY 1 HAVING count(*) >= 10")
def key_quota_check(spark, d):
    return usage.over_quota(corpus.api_keys(spark, d))


_LAT = """SELECT endpoint, round(avg(processing_time_ms), 4) AS mean_ms, median(processing_time_ms) AS median_ms, min(processing_time_ms) AS min_ms, max(processing_time_ms) AS max_ms,
round(stddev_samp(processing_time_ms), 4) AS stdev_ms, round(avg(processing_time_ms) - avg(processing_time_ms / 2), 4) AS overhead_ms,
round(count(*) FILTER (WHERE status_code < 400) / count(*) * 100.0, 4) AS success_rate FROM audit GROUP BY 1"""


def _latency(spark, d):
    return admin.latency_summary(corpus.audit_log(spark, d), "endpoint", "processing_time_ms",
                                 F.col("processing_time_ms") / 2, F.col("status_code") < 400)


@query("latency_summary", k.with_(k.AUDIT) + _LAT)
def latency_summary(spark, d):
    return _latency(spark, d)


@query("success_rate", k.with_(k.AUDIT) + f"SELECT endpoint, overhead_ms, success_rate FROM ({_LAT})")
def success_rate(spark, d):
    return _latency(spark, d).select("endpoint", "overhead_ms", "success_rate")


@query("round_n", k.with_(k.AUDIT, "a AS (SELECT user_id, sum(CAST(processing_time_ms AS DECIMAL(18, 2)))::DOUBLE / count(*) AS a FROM audit GROUP BY 1)") + """
SELECT user_id, round(a, 2) AS two, round(a, 3) AS three, round(a, 4) AS four FROM a""")
def round_n(spark, d):
    exact = F.sum(F.col("processing_time_ms").cast("decimal(18,2)")).cast("double") / F.count("*")
    return corpus.audit_log(spark, d).groupBy("user_id").agg(exact.alias("a")).select(
        "user_id", *[F.round("a", n).alias(w) for n, w in ((2, "two"), (3, "three"), (4, "four"))])


# -- patches, windows, ciphers --------------------------------------------------------------------


_PATCH = """b AS (SELECT conv_id * 100 + turn AS span_id, turn, role = 'assistant' AS up, 'active' AS status, CASE WHEN turn % 2 = 0 THEN 5 END AS tokens FROM conversations)"""


def _patched(spark, d):
    c = tb.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("span_id"), "turn", "role")
    base = c.select("span_id", F.lit("active").alias("status"), F.when(F.col("turn") % 2 == 0, F.lit(5)).alias("tokens"),
                    F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old")).alias("metadata"))
    up = c.filter(F.col("role") == "assistant").select(
        "span_id", F.when(F.col("turn") > 0, F.lit("completed")).alias("status"), F.when(F.col("turn") % 3 == 0, F.lit(9)).alias("tokens"),
        F.when(F.col("turn") % 2 == 1, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("new"))).alias("metadata"))
    return traces.patch(base, up, ["status", "tokens"])


@query("patch_non_null", k.with_(_PATCH) + """SELECT span_id, CASE WHEN turn > 0 AND up THEN 'completed' ELSE status END AS status,
CASE WHEN turn % 3 = 0 AND up THEN 9 ELSE tokens END AS tokens FROM b""")
def patch_non_null(spark, d):
    return _patched(spark, d).select("span_id", "status", "tokens")


@query("metadata_merge", k.with_(_PATCH) + """SELECT span_id, 'old' AS a, CASE WHEN turn % 2 = 1 AND up THEN 'new' ELSE 'old' END AS b,
CASE WHEN turn % 2 = 1 AND up THEN 'new' END AS c FROM b""")
def metadata_merge(spark, d):
    return _patched(spark, d).select("span_id", *[F.col("metadata")[n].alias(n) for n in "abc"])


def _attempts(spark, d):
    return tb.table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("client"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "signup").alias("oauth"))


@query("attempt_rate", """WITH a AS (SELECT event_id AS id, user_id % 5 AS client, epoch_us(ts) AS us FROM events)
SELECT id, client, count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS attempts_minute,
count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS attempts_hour FROM a""")
def attempt_rate(spark, d):
    return ratelimit.attempt_rate(_attempts(spark, d)).select("id", "client", "attempts_minute", "attempts_hour")


@query("rate_limit", k.with_("a AS (SELECT event_id AS id, user_id % 5 AS client, epoch_us(ts) AS us, event_type = 'signup' AS oauth FROM events WHERE event_type <> 'error')",
                            k.limiter("a", "1", "CASE WHEN oauth THEN 1 ELSE 3 END")) +
       "SELECT dec.*, us FROM dec JOIN a USING (id)")
def rate_limit(spark, d):
    """Batch decisions under small limits: OAuth paths counted apart, exempt paths not at all."""
    paths = ratelimit.by_path(corpus.audit_log(spark, d), "endpoint").select(
        "id", (F.col("user_id") % 5).alias("client"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "oauth")
    return ratelimit.decide(paths, 1, 3, 1, 1)


@query("encrypt_column", k.with_(k.KEYS) + "SELECT id, full_key AS plain, right(full_key, 4) AS last_4, 4 * ceil((length(full_key) + 28) / 3.0)::INTEGER AS stored_chars FROM keys_t")
def encrypt_column(spark, d):
    """Keys encrypted with a derived key, then decrypted again."""
    key = F.lit(fields.derive_key("example secret", b"example salt"))
    df = corpus.api_keys(spark, d).select("id", "full_key", fields.encrypt(F.col("full_key"), key).alias("stored"))
    return df.select("id", fields.decrypt(F.col("stored"), key).alias("plain"), fields.last_four(F.col("full_key")).alias("last_4"),
                     F.char_length("stored").alias("stored_chars"))
