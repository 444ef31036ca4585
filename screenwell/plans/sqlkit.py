"""Check SQL: the same results stated for a plain SQL engine over the same tables.

Fragments here are common table expressions the registered queries share.
"""

from __future__ import annotations

from collections.abc import Iterable

from screenwell import catalog as cat
from screenwell.sources import corpus


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lst(values: Iterable[str | None]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def at(values: Iterable[str | None], index: str) -> str:
    return f"{lst(values)}[CAST({index} AS INTEGER) + 1]"


def dbl(x: float) -> str:
    return f"{x!r}::DOUBLE"


def planted(text: str, id_: str, put: str | None = None) -> str:
    put = put or at(corpus.PHRASES, f"{id_} % {len(corpus.PHRASES)}")
    return (f"CASE ({id_} // 7) % 3 WHEN 0 THEN {text} || ' ' || {put} WHEN 1 THEN {put} || ' ' || {text} ELSE "
            f"substr({text}, 1, length({text}) // 2) || ' ' || {put} || ' ' || substr({text}, length({text}) // 2 + 1) END")


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


CONTENT = f"""content AS MATERIALIZED (SELECT doc_id AS content_id, {planted('text', 'doc_id')} AS content,
  {at(('input', 'output', 'system_prompt'), 'doc_id % 3')} AS context_type, source AS trace_id, lang,
  doc_id // 8 AS user_id FROM documents)"""
PAGES = f"pages_c AS MATERIALIZED (SELECT page_id AS content_id, url, {planted('html', 'page_id')} AS content FROM pages)"
TURNS = f"""turns AS MATERIALIZED (SELECT conv_id, turn, role, {planted('text', '(conv_id * 7 + turn)')} AS text
  FROM conversations)"""
_S = list(zip(*cat.SCENARIOS))
_SI = f"doc_id % {len(cat.SCENARIOS)}"
LABELLED = f"""labelled AS MATERIALIZED (SELECT doc_id, n_chars, {at(_S[0], _SI)} AS id, {at(_S[1], _SI)} AS name,
  {at(_S[2], _SI)} AS category, {planted('text', 'doc_id', at(_S[3], _SI))} AS test_input, {at(_S[4], _SI)} AS expected_threat,
  {at(_S[5], _SI)} AS expected_severity, {at([str(b) for b in _S[6]], _SI)} = 'True' AS should_block,
  {at(_S[7], _SI)} AS context_type FROM documents)"""
USERS = """users_t AS (SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_acctbal >= 0 AS is_active,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INTEGER)) AS created_at FROM customer)"""
KEYS = f"""keys_t AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'key-' || o_orderkey AS key_name,
  '{cat.SERVICE_KEY_PREFIX}live_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 43) AS full_key,
  o_orderstatus <> 'F' AS is_active, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 365 DAY END AS expires_at,
  {at([p.name for p in cat.PACKS] + [None], 'o_orderkey % 8')} AS template_pack FROM orders)"""
LAST_USED = "last_used AS (SELECT l_orderkey AS key_id, max(l_shipdate) AS last_used_at FROM lineitem GROUP BY 1)"
USAGE_EVENTS = f"""usage_events AS (SELECT l_orderkey AS api_key_id, {at(corpus.ENDPOINTS, 'l_linenumber % 3')} AS endpoint,
  CAST(l_quantity AS INTEGER) AS requests, l_partkey AS tokens, CAST(l_extendedprice / 10000 AS DECIMAL(10,6)) AS cost_usd,
  CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 24 AS INTEGER) AS hour FROM lineitem)"""
HOURLY = """hourly AS (SELECT api_key_id, endpoint, date, hour, sum(requests)::BIGINT AS requests_count, sum(tokens)::BIGINT AS tokens_used,
  sum(cost_usd) AS cost_usd FROM usage_events GROUP BY ALL)"""
_EV = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in corpus.AUDIT_ENDPOINTS.items())
AUDIT = f"""audit AS (SELECT event_id AS id, ts AS timestamp, user_id, CASE event_type {_EV} END AS endpoint,
  CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS http_method,
  CASE WHEN event_type = 'error' THEN [401, 429, 500][CAST(event_id % 3 AS INTEGER) + 1] ELSE 200 END AS status_code,
  value AS processing_time_ms, props AS metadata,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Basic abcdefghijk'
    WHEN 2 THEN 'Bearer {cat.SERVICE_KEY_PREFIX}live_' || sha256(CAST(user_id AS VARCHAR))
    WHEN 3 THEN 'Bearer eyJhbGci.eyJzdWIi.sig' WHEN 4 THEN 'bearer short' ELSE 'Bearer opaque-token-value' END AS auth_header,
  CASE event_id % 4 WHEN 0 THEN ' 10.0.0.' || (user_id % 250) || ', 172.16.0.1' WHEN 1 THEN '' END AS x_forwarded_for,
  CASE event_id % 4 WHEN 2 THEN '192.168.1.' || (user_id % 250) WHEN 1 THEN '' END AS x_real_ip,
  CASE WHEN event_id % 8 <> 5 THEN '203.0.113.9' END AS peer FROM events)"""
SPANS = f"""spans_t AS (SELECT conv_id AS trace_id, conv_id * 100 + turn AS span_id,
  CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent_span_id,
  {at(('llm', 'retrieval', 'tool', 'agent'), 'turn % 4')} AS span_type,
  CASE WHEN turn % 5 <> 4 THEN len(string_split_regex(trim(text), ' +')) END AS tokens_used,
  {at(corpus.MODELS, 'conv_id % 5')} AS model, CAST(length(text) AS DOUBLE) AS latency_ms,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 500 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at
  FROM conversations)"""
TRACES = """traces_t AS (SELECT conv_id AS trace_id, CASE WHEN conv_id % 9 <> 0 THEN conv_id % 10 END AS user_id,
  'session-' || (conv_id % 4) AS session_id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 500 AS INTEGER)) AS created_at
  FROM (SELECT DISTINCT conv_id FROM conversations))"""
PRICE = "CASE model " + " ".join(f"WHEN {q(m)} THEN {dbl(p)}" for m, p in cat.PRICE_PER_1K.items()) + f" ELSE {dbl(cat.DEFAULT_PRICE)} END"
SPAN_COST = f"(coalesce(tokens_used, 0) / 1000.0::DOUBLE) * ({PRICE})"

MIXED = ("Mixed", (("profanity", "flag", 5), ("contains_card_data", "block", 5), ("unknown_rule", "block", 9),
                   ("contains_phi", "alert", 5), ("contains_pii", "redact", 1)), ("mixed",))
_KINDS = [*cat.TEMPLATES.values(), MIXED]
POLICIES = f"""policies_t AS (SELECT c_custkey AS policy_id, c_custkey // 6 AS user_id,
  {at([k[0] for k in _KINDS], 'c_custkey % 6')} AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'compliance' ELSE 'data_governance' END AS policy_type, c_acctbal >= 0 AS enabled,
  1 AS version, CAST(c_custkey % 6 AS INTEGER) AS kind,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INTEGER)) AS created_at FROM customer)"""
_RULE_ROWS = ", ".join(
    f"({k}, {i}, {q(c)}, {q(a)}, {p})" for k, (_, rules, _) in enumerate(_KINDS) for i, (c, a, p) in enumerate(rules))
RULES = f"""rules_t AS (SELECT policy_id, user_id, name, enabled, created_at, pos, condition, action, priority,
  CAST(row_number() OVER (PARTITION BY policy_id ORDER BY priority DESC, pos) - 1 AS INTEGER) AS rule_index
  FROM policies_t JOIN (VALUES {_RULE_ROWS}) r(kind, pos, condition, action, priority) USING (kind))"""
TEMPLATE_ROWS = ", ".join(
    f"({t}, {q(key)}, {q(name)}, {i}, {q(c)}, {q(a)})"
    for t, (key, (name, rules, _)) in enumerate(cat.TEMPLATES.items())
    for i, (c, a, _) in enumerate(sorted(rules, key=lambda r: -r[2])))
PACK_ROWS = ", ".join(
    f"({q(p.name)}, {lst(p.filters)}, {p.redact}, {dbl(p.toxicity_threshold)}, {p.use_analyzer}, {q(p.template)})"
    for p in cat.PACKS)


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def plain_letters(text: str) -> str:
    """Accented letters replaced by a plain one of equal length.

    Word boundaries of the SQL engine know ASCII only; upper-case codes next to
    an accented letter need the stand-in.
    """
    letters = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
    return f"regexp_replace({text}, '{letters}', 'a', 'g')"


def hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def any_hit(text: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(hit(text, p) for p in patterns) + ")"


def any_word(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + ")"


def n_words(text: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), {q(w)})::INT" for w in words) + ")"


def found_words(text: str, words: Iterable[str]) -> str:
    return f"list_filter({lst(words)}, lambda w: contains(lower({text}), w))"


def ladder(score: str, steps) -> str:
    return "CASE " + " ".join(
        f"WHEN {score} >= {dbl(b)} THEN {q(v)}" if b is not None else f"ELSE {q(v)}" for b, v in steps) + " END"


def total(prefix: str, patterns) -> str:
    return "(" + " + ".join(f"{prefix}{p.name}" for p in patterns) + ")"


def worst(prefix: str, patterns) -> str:
    return ", ".join(f"CASE WHEN {prefix}{p.name} > 0 THEN {dbl(p.weight)} ELSE 0.0::DOUBLE END" for p in patterns)


def injection(src: str, text: str = "content", out: str = "inj") -> str:
    """CTEs scoring every row of `src`; the last one is named `out`."""
    counts = ", ".join(f"{count(text, p.regex)} AS n_{p.name}" for p in cat.INJECTION)
    return f"""{out}_a AS (SELECT *, {counts}, {n_words(text, cat.CONTEXT_MARKERS)} AS n_markers,
  {any_hit(text, cat.SCOPE)} AS scope_hit FROM {src}),
{out}_b AS (SELECT *, CASE WHEN n_markers >= 3 THEN 0.8::DOUBLE WHEN n_markers = 2 THEN 0.6::DOUBLE
  WHEN n_markers = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS marker_score,
  CASE WHEN scope_hit THEN {dbl(cat.SCOPE_SCORE)} ELSE 0.0::DOUBLE END AS scope_score FROM {out}_a),
{out}_c AS (SELECT *, {total('n_', cat.INJECTION)} + (marker_score > 0)::INT + (scope_score > 0)::INT AS n_detections,
  greatest({worst('n_', cat.INJECTION)}, marker_score, scope_score) AS max_severity FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN n_detections > 0 THEN least(max_severity + n_detections * {dbl(cat.HIT_BONUS)}, 1.0::DOUBLE)
  ELSE 0.0::DOUBLE END AS risk_score FROM {out}_c),
{out} AS (SELECT *, risk_score > 0.5::DOUBLE AS is_injection, {ladder('risk_score', cat.REC_REGEX)} AS recommendation
  FROM {out}_d)"""


NETLOC = "regexp_extract({u}, '^https?://([^/?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def netloc(u: str) -> str:
    return NETLOC.format(u=u)


def params(u: str) -> str:
    """Names of the parameters with a value, as written."""
    return (f"list_transform(list_filter(string_split({QUERY.format(u=u)}, '&'), "
            f"lambda p: regexp_matches(p, '^[^=]*=(.|\\n)')), lambda p: url_decode(split_part(p, '=', 1)))")


def trusted(u: str, domains=cat.TRUSTED_DOMAINS) -> str:
    return "(" + " OR ".join(f"contains({netloc(u)}, {q(d)})" for d in domains) + ")"


def suspicious(u: str) -> str:
    return f"len(list_filter({params(u)}, lambda n: list_contains({lst(cat.SUSPICIOUS_PARAMS)}, lower(n)))) > 0"


def urls(text: str) -> str:
    return f"regexp_extract_all({text}, {q(cat.URL)})"


def exfil(src: str, text: str = "content", out: str = "exf", domains=cat.TRUSTED_DOMAINS, extra: str = "0") -> str:
    counts = ", ".join([f"{count(text, p.regex)} AS s_{p.name}" for p in cat.SENSITIVE]
                       + [f"{count(text, p.regex)} AS x_{p.name}" for p in cat.EXFILTRATION])
    return f"""{out}_a AS (SELECT *, {counts}, {extra} AS n_tier, {urls(text)} AS urls FROM {src}),
{out}_b AS (SELECT *, {total('s_', cat.SENSITIVE)} + n_tier AS n_sensitive, {total('x_', cat.EXFILTRATION)} AS n_indicators,
  len(urls) AS n_urls,
  len(list_filter(urls, lambda u: NOT {trusted('u', domains)} AND len({params('u')}) > 0)) AS n_untrusted_param_urls
  FROM {out}_a),
{out}_c AS (SELECT *, greatest({worst('s_', cat.SENSITIVE)}, {worst('x_', cat.EXFILTRATION)},
  CASE WHEN n_tier > 0 THEN {dbl(cat.MODEL_PII_SEVERITY)} ELSE 0.0::DOUBLE END) AS base FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN n_sensitive > 0 AND n_indicators > 0 THEN least(base * 1.3::DOUBLE, 1.0::DOUBLE)
  ELSE base END AS with_both FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN n_untrusted_param_urls > 0 THEN greatest(with_both, {dbl(cat.UNTRUSTED_URL_FLOOR)}) ELSE with_both END
  AS risk_score FROM {out}_d),
{out} AS (SELECT *, risk_score >= 0.6::DOUBLE AS has_risk, {ladder('risk_score', cat.REC_EXFIL)} AS recommendation FROM {out}_e)"""


def redact_sensitive(text: str) -> str:
    out = text
    for p in cat.SENSITIVE:
        out = f"regexp_replace({out}, {q(p.regex)}, '[{p.name.upper()}_REDACTED]', 'g')"
    return out


def analyse(src: str, text: str = "content", out: str = "ana", model: str | None = None) -> str:
    """CTEs for the routed analysis: risk, safety, ordered threat types, first severity."""
    inj = injection(f"{out}_in", "t_in", f"{out}_i")
    exf = exfil(f"{out}_j", "t_out", f"{out}_x")
    sev = "CASE recommendation WHEN 'BLOCK' THEN 'critical' WHEN 'REDACT' THEN 'high' WHEN 'FLAG' THEN 'medium' ELSE 'low' END"
    risk, hit_ = "risk_score", "is_injection"
    if model:   # probability of t_in; rows that are not scanned have an empty one
        risk = f"CASE WHEN t_in <> '' THEN {model} * 0.7::DOUBLE + risk_score * 0.3::DOUBLE ELSE risk_score END"
        hit_ = f"(t_in <> '' AND {model} >= 0.75::DOUBLE)"
    return f"""{out}_in AS (SELECT *, CASE WHEN context_type IN ('input', 'system_prompt') THEN {text} ELSE '' END AS t_in,
  CASE WHEN context_type = 'output' THEN {text} ELSE '' END AS t_out FROM {src}),
{inj},
{out}_j AS (SELECT * EXCLUDE (risk_score, is_injection, recommendation), {risk} AS inj_risk, {hit_} AS inj_hit,
  recommendation AS inj_rec, {n_words('t_in', cat.JAILBREAK)} AS n_jb FROM {out}_i),
{exf},
{out} AS (SELECT * EXCLUDE (risk_score),
  CASE WHEN inj_hit THEN {ladder('inj_risk', cat.SEVERITY)} END AS inj_sev, {sev} AS ex_sev, risk_score AS ex_risk,
  least(n_jb * 0.5::DOUBLE, 1.0::DOUBLE) AS jb_conf,
  greatest(CASE WHEN inj_hit THEN inj_risk ELSE 0.0::DOUBLE END, CASE WHEN n_jb > 0 THEN least(n_jb * 0.5::DOUBLE, 1.0::DOUBLE)
    ELSE 0.0::DOUBLE END, CASE WHEN has_risk THEN risk_score ELSE 0.0::DOUBLE END) AS risk_score,
  concat_ws(',', CASE WHEN inj_hit THEN 'prompt_injection' END, CASE WHEN n_jb > 0 THEN 'jailbreak' END,
    CASE WHEN has_risk THEN 'data_exfiltration' END) AS threat_types FROM {out}_x)"""


def span_list(text: str, pattern: str, type_: str, confidence: float, label: str | None = None) -> str:
    m, g = f"regexp_extract_all({text}, {q(pattern)})", f"string_split_regex({text}, {q(pattern)})"
    start = (f"CAST(list_sum(list_transform({g}[1:i], lambda x: length(x))) + "
             f"coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0) AS INTEGER)")
    lab = f"{q(label)}::VARCHAR"
    return (f"list_transform(range(1, len({m}) + 1), lambda i: {{'start': {start}, 'neg': {dbl(-confidence)}, "
            f"'type': {q(type_)}, 'value': {m}[i], 'label': {lab}, 'len': CAST(length({m}[i]) AS INTEGER)}})")


SPAN_TYPE = 'STRUCT("start" INTEGER, neg DOUBLE, ord INTEGER, "type" VARCHAR, "value" VARCHAR, label VARCHAR, len INTEGER)'


def spans(src: str, text: str, patterns, out: str = "sp") -> str:
    """CTE with `raw` spans of (pattern, type, confidence, label, guard) in order, and `ents` de-duplicated.

    Sorted by start, confidence, order; each span meets the last kept one only.
    """
    parts = []
    for p in patterns:
        pattern, type_, conf, label, *guard = p
        e = span_list(guard[1] if len(guard) > 1 else text, pattern, type_, conf, label)
        parts.append(f"CASE WHEN {guard[0]} THEN {e} ELSE [] END" if guard else e)
    keyed = ("list_transform(range(1, len(raw) + 1), lambda i: {'start': raw[i].start, 'neg': raw[i].neg, "
             "'ord': CAST(i AS INTEGER), 'type': raw[i].type, 'value': raw[i].value, 'label': raw[i].label, 'len': raw[i].len})")
    fold = ("list_reduce(list_transform(list_sort(keyed), lambda s: [s]), lambda acc, x: CASE "
            "WHEN acc[-1].start + acc[-1].len <= x[1].start THEN list_concat(acc, x) "
            "WHEN x[1].neg < acc[-1].neg THEN list_concat(acc[:-2], x) ELSE acc END)")
    return f"""{out}_a AS (SELECT *, list_concat({', '.join(parts)}) AS raw FROM {src}),
{out}_b AS (SELECT *, {keyed} AS keyed FROM {out}_a),
{out} AS (SELECT *, CASE WHEN len(keyed) = 0 THEN keyed ELSE {fold} END AS ents FROM {out}_b)"""


PII_PARTS = [(p.regex, p.name, p.weight, None) for p in cat.PII]


def redact(text: str, ents: str, token: str) -> str:
    """Replace disjoint sorted spans; `token` is SQL over a span `e`."""
    pieces = (f"list_transform(range(1, len({ents}) + 1), lambda i: substr({text}, CASE WHEN i = 1 THEN 1 "
              f"ELSE {ents}[i-1].start + {ents}[i-1].len + 1 END, {ents}[i].start - CASE WHEN i = 1 THEN 0 "
              f"ELSE {ents}[i-1].start + {ents}[i-1].len END) || {token.replace('e.', f'{ents}[i].')})")
    return (f"CASE WHEN len({ents}) = 0 THEN {text} ELSE array_to_string({pieces}, '') || "
            f"substr({text}, {ents}[-1].start + {ents}[-1].len + 1) END")


TYPED = "'[' || upper(coalesce(e.label, e.type)) || '_REDACTED]'"


def word_chunks(src: str, key: str, text: str, out: str = "wc") -> str:
    """CTE of word-aligned chunks by recursion over the position."""
    size, overlap = cat.WORD_CHUNK_SIZE, cat.WORD_CHUNK_OVERLAP
    window = f"substr({text}, pos + 1, {size})"
    before = f"length(regexp_extract({window}, '(?s)^(.*) ', 1))"
    stop = (f"CASE WHEN pos + {size} >= length({text}) THEN length({text}) "
            f"WHEN contains({window}, ' ') AND {before} > 0 THEN pos + {before} ELSE pos + {size} END")
    return f"""{out}_r AS (SELECT {key}, {text}, 0::BIGINT AS pos, 0 AS chunk_no, CASE WHEN length({text}) <= {size}
  THEN length({text}) ELSE {stop.replace('pos', '0')} END AS stop FROM {src}
  UNION ALL SELECT {key}, {text}, pos, chunk_no, {stop} FROM (
    SELECT {key}, {text}, greatest(stop - {overlap}, pos + 1) AS pos, chunk_no + 1 AS chunk_no FROM {out}_r WHERE stop < length({text}))),
{out} AS (SELECT {key}, chunk_no, pos AS "offset", substr({text}, pos + 1, stop - pos) AS chunk, stop FROM {out}_r)"""


def limiter(src: str, per_minute: str, per_hour: str, out: str = "dec") -> str:
    """CTE of decisions on attempts (id, client, us, oauth), folded in time order per client."""
    recent = "list_filter(acc.adm, lambda t: t > x.us - 3600000000)"
    minute = "len(list_filter(acc.adm, lambda t: t > x.us - 60000000))"
    ok = f"({minute} < x.m AND len({recent}) < x.h)"
    row = (f"{{'id': x.id, 'admitted': {ok}, 'retry_after': CASE WHEN {ok} THEN NULL WHEN {minute} >= x.m THEN 60 ELSE 3600 END, "
           f"'remaining_minute': CASE WHEN {ok} THEN CAST(x.m - {minute} - 1 AS INTEGER) END, "
           f"'remaining_hour': CASE WHEN {ok} THEN CAST(x.h - len({recent}) - 1 AS INTEGER) END}}")
    none = ("{'adm': CAST([] AS BIGINT[]), 'out': CAST([] AS STRUCT(id BIGINT, admitted BOOLEAN, retry_after INTEGER, "
            "remaining_minute INTEGER, remaining_hour INTEGER)[])}")
    return f"""{out}_l AS (SELECT client, oauth, list({{'id': id, 'us': us, 'm': {per_minute}, 'h': {per_hour}}} ORDER BY us, id) AS xs
  FROM {src} GROUP BY 1, 2),
{out}_f AS (SELECT client, oauth, list_reduce(xs, lambda acc, x: {{'adm': CASE WHEN {ok} THEN list_append({recent}, x.us) ELSE {recent} END,
  'out': list_append(acc.out, {row})}}, {none}) AS r FROM {out}_l),
{out} AS (SELECT client, oauth, unnest(r.out, recursive := true) FROM {out}_f)"""


def conditions(text: str, retention: str = "false", unauthorized: str = "false") -> dict[str, str]:
    prof = f"len(list_intersect(regexp_extract_all(lower({text}), '[a-z]+'), {lst(cat.PROFANITY)})) > 0"
    return {
        "contains_pii": f"({hit(text, cat.SSN)} OR {hit(text, cat.CARD)} OR {any_word(text, cat.PII_WORDS)})",
        "contains_phi": any_word(text, cat.PHI_WORDS),
        "contains_card_data": f"({hit(text, cat.CARD)} OR {hit(text, cat.PAN)})",
        "contains_cvv": hit(text, cat.CVV),
        "unencrypted_pan": hit(text, cat.PAN),
        "audit_log_required": "true",
        "encryption_required": hit(text, cat.CLEARTEXT_SECRET),
        "data_retention_exceeded": retention,
        "unauthorized_access": unauthorized,
        "data_sale_opt_out": any_word(text, cat.OPT_OUT_WORDS),
        "right_to_delete": any_word(text, cat.DELETE_WORDS),
        "profanity": prof,
    }


def condition_rows(src: str, text: str = "content", out: str = "conds", **ctx: str) -> str:
    """CTE with one row per content row and condition that holds."""
    c = conditions(text, **ctx)
    flags = ", ".join(f"{v} AS c_{k}" for k, v in c.items())
    rows = " UNION ALL ".join(f"SELECT content_id, {q(k)} AS condition FROM {out}_w WHERE c_{k}" for k in c)
    return f"{out}_w AS MATERIALIZED (SELECT content_id, {flags} FROM {src}),\n{out} AS ({rows})"
