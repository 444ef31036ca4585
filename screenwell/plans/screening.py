"""Queries that screen text: detectors, scores, policies, whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import exfil, injection, pii
from screenwell.functions import policy as pf
from screenwell.functions import spans as sp
from screenwell.functions import text as tx
from screenwell.operators import changes, conversation, domains, evaluate, models, partials, policy, scan, stats, toxicity, usage
from screenwell.plans import sqlkit as k
from screenwell.plans.registry import query
from screenwell.sources import corpus
from screenwell.sources import tables as tb

# -- injection -------------------------------------------------------------------


@query("inj_pattern_flags", k.with_(k.CONTENT) + "SELECT content_id, " + ", ".join(
    f"{k.count('content', p.regex)} AS n_{p.name}" for p in cat.INJECTION) + " FROM content")
def inj_pattern_flags(spark, d):
    return tx.with_gates(corpus.content(spark, d)).select("content_id", *injection.pattern_counts())


@query("inj_context_markers", k.with_(k.CONTENT, f"m AS (SELECT content_id, {k.n_words('content', cat.CONTEXT_MARKERS)} AS n_markers FROM content)") + """
SELECT content_id, n_markers, CASE WHEN n_markers >= 3 THEN 0.8::DOUBLE WHEN n_markers = 2 THEN 0.6::DOUBLE
  WHEN n_markers = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS marker_score FROM m""")
def inj_context_markers(spark, d):
    return tx.with_gates(corpus.content(spark, d)).select(
        "content_id", injection.marker_count().alias("n_markers")).withColumn(
        "marker_score", injection.marker_score(F.col("n_markers")))


@query("inj_scope_violation", k.with_(k.CONTENT) + f"""SELECT content_id, {k.any_hit('content', cat.SCOPE)} AS scope_violation,
CASE WHEN {k.any_hit('content', cat.SCOPE)} THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS scope_score FROM content""")
def inj_scope_violation(spark, d):
    return models.scope_only(corpus.content(spark, d)).select(
        "content_id", "scope_violation", injection.scope_score(F.col("scope_violation")).alias("scope_score"))


_IND = "[" + ", ".join(f"CASE WHEN {k.hit('content', p)} THEN {i} END" for i, p in enumerate(cat.INDIRECT)) + "]"


@query("inj_indirect", k.with_(k.CONTENT, f"f AS (SELECT content_id, list_filter({_IND}, lambda x: x IS NOT NULL) AS ids FROM content)") + """
SELECT content_id, array_to_string(ids, ',') AS patterns, len(ids) > 0 AS is_indirect_injection, 'document' AS scan_source,
  CASE WHEN len(ids) > 0 THEN 'QUARANTINE' ELSE 'SAFE' END AS verdict FROM f""")
def inj_indirect(spark, d):
    out = scan.indirect_scan(corpus.content(spark, d), source="document")
    return out.select("content_id", F.concat_ws(",", F.col("indirect").cast("array<string>")).alias("patterns"),
                      "is_indirect_injection", "scan_source", "verdict")


@query("jailbreak_phrases", k.with_(k.CONTENT, f"f AS (SELECT content_id, {k.found_words('content', cat.JAILBREAK)} AS w FROM content)") + """
SELECT content_id, array_to_string(w, ',') AS phrases, least(len(w) * 0.5::DOUBLE, 1.0::DOUBLE) AS confidence FROM f""")
def jailbreak_phrases(spark, d):
    return scan.jailbreak_scan(corpus.content(spark, d)).select(
        "content_id", F.concat_ws(",", "jailbreak").alias("phrases"), F.col("jailbreak_confidence").alias("confidence"))


@query("inj_risk_score", k.with_(k.CONTENT, k.injection("content")) + "SELECT content_id, n_detections, max_severity, risk_score FROM inj")
def inj_risk_score(spark, d):
    return scan.injection_scan(corpus.content(spark, d), keep_counts=True).select(
        "content_id", "n_detections", "max_severity", "risk_score")


@query("injection_scan", k.with_(k.CONTENT, k.injection("content")) +
       "SELECT content_id, n_detections, risk_score, is_injection, recommendation FROM inj")
def injection_scan(spark, d):
    return scan.injection_scan(corpus.content(spark, d)).select(
        "content_id", "n_detections", "risk_score", "is_injection", "recommendation")


@query("rec_regex", k.with_(k.TURNS, k.injection("turns", "text")) + """
SELECT recommendation, count(*) AS turns, round(avg(risk_score), 6) AS avg_risk FROM inj GROUP BY 1""")
def rec_regex(spark, d):
    """Flagship: turns by recommendation."""
    return scan.injection_scan(corpus.turns(spark, d), "text").groupBy("recommendation").agg(
        F.count("*").alias("turns"), F.round(F.avg("risk_score"), 6).alias("avg_risk"))


# -- model tiers -------------------------------------------------------------------

MODEL_WORDS = ("ignore", "instructions", "mode", "system", "reveal", "secret")
LOADER = models.keyword_scorer(MODEL_WORDS)


def _model(text: str) -> str:
    return f"(1.0::DOUBLE - pow(0.5::DOUBLE, {k.n_words(text, MODEL_WORDS)}))"


_CHUNKS = """ch AS (SELECT * EXCLUDE (content, starts), unnest(starts) AS s, content FROM (SELECT *, CASE WHEN length(content) <= 1800 THEN [0]
  ELSE range(0, length(content), 1600) END AS starts FROM {src})),
chunks AS (SELECT * EXCLUDE (content, s), CAST(s // 1600 AS INTEGER) AS chunk_no, substr(content, s + 1, 1800) AS chunk FROM ch)"""


@query("chunk_fixed", k.with_(k.CONTENT, _CHUNKS.format(src="content")) + """
SELECT content_id, chunk_no, length(chunk) AS n_chars, substr(sha256(chunk), 1, 16) AS chunk_hash FROM chunks""")
def chunk_fixed(spark, d):
    return models.chunks(corpus.content(spark, d).select("content_id", "content")).select(
        "content_id", "chunk_no", F.char_length("chunk").alias("n_chars"), tx.content_hash("chunk").alias("chunk_hash"))


@query("chunk_max", k.with_(k.CONTENT, _CHUNKS.format(src="content")) + f"""
SELECT content_id, max(p) AS model_score, CAST(arg_max(chunk_no, p - chunk_no * 1e-9) AS INTEGER) AS worst_chunk,
count(*) AS chunks_scanned FROM (SELECT content_id, chunk_no, {_model('chunk')} AS p FROM chunks) GROUP BY 1""")
def chunk_max(spark, d):
    return models.chunk_max(corpus.content(spark, d), LOADER)


@query("scorer_interface", k.with_(k.CONTENT) + f"SELECT content_id, {_model('content')} AS p FROM content")
def scorer_interface(spark, d):
    return corpus.content(spark, d).select("content_id", models.as_udf(LOADER)(F.col("content")).alias("p"))


@query("batch_scorer", k.with_(k.CONTENT) + f"""SELECT content_id, {_model('content')} AS p,
{_model('content')} >= 0.75::DOUBLE AS is_injection FROM content""")
def batch_scorer(spark, d):
    out = corpus.content(spark, d).select(
        "content_id", models.as_udf(LOADER, batch=512)(F.col("content")).alias("p"))
    return out.withColumn("is_injection", models.verdict(F.col("p")))


_HYBRID = k.with_(k.CONTENT, k.injection("content"), _CHUNKS.format(src="(SELECT content_id, content FROM content)"),
                  f"md AS (SELECT content_id, max({_model('chunk')}) AS model_score, count(*) AS chunks_scanned FROM chunks GROUP BY 1)",
                  """hy AS (SELECT content_id, risk_score AS regex_score, model_score, chunks_scanned,
  model_score * 0.7::DOUBLE + risk_score * 0.3::DOUBLE AS risk_score FROM inj JOIN md USING (content_id))""")


@query("injection_scan_hybrid", _HYBRID + f"""SELECT *, model_score >= 0.75::DOUBLE AS is_injection,
{k.ladder('risk_score', cat.REC_HYBRID)} AS recommendation, 'hybrid' AS detector FROM hy""")
def injection_scan_hybrid(spark, d):
    return models.injection_hybrid(corpus.content(spark, d), LOADER)


@query("hybrid_merge", _HYBRID + "SELECT content_id, round(risk_score, 9) AS combined FROM hy")
def hybrid_merge(spark, d):
    return models.injection_hybrid(corpus.content(spark, d), LOADER).select(
        "content_id", F.round("risk_score", 9).alias("combined"))


@query("rec_hybrid", _HYBRID + f"SELECT {k.ladder('risk_score', cat.REC_HYBRID)} AS recommendation, count(*) AS n FROM hy GROUP BY 1")
def rec_hybrid(spark, d):
    return models.injection_hybrid(corpus.content(spark, d), LOADER).groupBy("recommendation").agg(F.count("*").alias("n"))


@query("injection_scan_batch", k.with_(k.CONTENT, k.injection("content"), _CHUNKS.format(src="(SELECT content_id, content FROM content)"),
  f"md AS (SELECT content_id, max({_model('chunk')}) AS worst FROM chunks GROUP BY 1)", """b AS (SELECT content_id, risk_score AS regex_score,
  is_injection, recommendation, CASE WHEN risk_score >= 0.3::DOUBLE THEN worst END AS model_score FROM inj JOIN md USING (content_id))""",
  "c AS (SELECT *, model_score * 0.7::DOUBLE + regex_score * 0.3::DOUBLE AS combined FROM b)") + f"""
SELECT content_id, regex_score, model_score, coalesce(combined, regex_score) AS risk_score,
coalesce(model_score >= 0.75::DOUBLE, is_injection) AS is_injection,
CASE WHEN model_score IS NULL THEN recommendation ELSE {k.ladder('combined', cat.REC_HYBRID)} END AS recommendation,
CASE WHEN model_score IS NULL THEN 'regex' ELSE 'hybrid' END AS detector FROM c""")
def injection_scan_batch(spark, d):
    return models.injection_batch(corpus.content(spark, d), LOADER)


@query("model_label_flip", k.with_(k.CONTENT, f"""m AS (SELECT content_id, {_model('content')} AS p FROM content),
t AS (SELECT content_id, CASE WHEN p >= 0.5::DOUBLE THEN 'INJECTION' ELSE 'SAFE' END AS label, greatest(p, 1.0::DOUBLE - p) AS score FROM m),
f AS (SELECT *, CASE WHEN label = 'INJECTION' THEN score ELSE 1.0::DOUBLE - score END AS p FROM t)""") + """
SELECT content_id, label, p, p >= 0.75::DOUBLE AS is_injection FROM f""")
def model_label_flip(spark, d):
    p = models.as_udf(LOADER)(F.col("content"))
    top = corpus.content(spark, d).select("content_id", p.alias("_p")).select(
        "content_id", F.when(F.col("_p") >= 0.5, F.lit("INJECTION")).otherwise(F.lit("SAFE")).alias("label"),
        F.greatest(F.col("_p"), F.lit(1.0) - F.col("_p")).alias("score"))
    return top.select("content_id", "label", models.flip(F.col("label"), F.col("score")).alias("p")).withColumn(
        "is_injection", models.verdict(F.col("p")))


# -- exfiltration ------------------------------------------------------------------


@query("exfil_pattern_flags", k.with_(k.CONTENT) + "SELECT content_id, " + ", ".join(
    [f"{k.count('content', p.regex)} AS s_{p.name}" for p in cat.SENSITIVE]
    + [f"{k.count('content', p.regex)} AS x_{p.name}" for p in cat.EXFILTRATION]) + " FROM content")
def exfil_pattern_flags(spark, d):
    return tx.with_gates(corpus.content(spark, d)).select(
        "content_id", *exfil.sensitive_counts(), *exfil.indicator_counts())


_EXF_COLS = "content_id, n_sensitive, n_indicators, n_urls, n_untrusted_param_urls, risk_score, has_risk, recommendation"


@query("exfil_scan", k.with_(k.CONTENT, k.exfil("content")) + f"SELECT {_EXF_COLS} FROM exf")
def exfil_scan(spark, d):
    return scan.exfil_scan(corpus.content(spark, d)).select(*_EXF_COLS.split(", "))


_PII_TOTAL = "(" + " + ".join(k.count("content", p.regex) for p in cat.PII) + ")"


@query("exfil_risk_score", k.with_(k.CONTENT, k.exfil("content", extra=_PII_TOTAL)) +
       "SELECT content_id, n_sensitive, risk_score, recommendation FROM exf")
def exfil_risk_score(spark, d):
    """Exfiltration score with the personal-data tier switched on."""
    return scan.exfil_scan(corpus.content(spark, d), pii_tier="regex").select(
        "content_id", "n_sensitive", "risk_score", "recommendation")


@query("rec_exfil", k.with_(k.TURNS, k.exfil("turns", "text")) + "SELECT role, recommendation, count(*) AS n FROM exf GROUP BY ALL")
def rec_exfil(spark, d):
    return scan.exfil_scan(corpus.turns(spark, d), "text").groupBy("role", "recommendation").agg(F.count("*").alias("n"))


_URLROWS = f"u AS (SELECT content_id, unnest({k.urls('content')}) AS url FROM content)"


@query("url_extract", k.with_(k.CONTENT, _URLROWS) + "SELECT content_id, url FROM u")
def url_extract(spark, d):
    return corpus.content(spark, d).select("content_id", F.explode(exfil.urls("content")).alias("url"))


@query("url_analyze", k.with_(k.CONTENT, _URLROWS) + f"""SELECT content_id, url, {k.netloc('url')} AS domain, {k.trusted('url')} AS is_trusted,
len({k.params('url')}) > 0 AS has_parameters, {k.suspicious('url')} AS has_suspicious_params,
CASE WHEN NOT {k.trusted('url')} AND {k.suspicious('url')} THEN 'high' ELSE 'low' END AS risk_level FROM u""")
def url_analyze(spark, d):
    rows = corpus.content(spark, d).select("content_id", F.explode(exfil.urls("content")).alias("u"))
    return rows.select("content_id", exfil.analyze_url(F.col("u")).alias("a")).select("content_id", "a.*")


_BARE = "regexp_replace(regexp_replace(domain, '^[^@]*@', ''), ':[0-9]*$', '')"


@query("url_trusted_domain", k.with_(k.CONTENT, _URLROWS, f"h AS (SELECT content_id, url, {k.netloc('url')} AS domain, {k.trusted('url')} AS by_substring FROM u)") + f"""
SELECT content_id, url, domain, by_substring, ({_BARE} = 'example.com' OR ends_with({_BARE}, '.example.com') OR {_BARE} = 'trusted.org'
 OR ends_with({_BARE}, '.trusted.org')) AS by_suffix FROM h""")
def url_trusted_domain(spark, d):
    rows = corpus.content(spark, d).select("content_id", F.explode(exfil.urls("content")).alias("url")).withColumn(
        "domain", exfil.netloc(F.col("url")))
    return rows.withColumn("by_substring", exfil.is_trusted(F.col("domain"))).withColumn(
        "by_suffix", exfil.is_trusted(F.col("domain"), match="suffix"))


@query("trusted_domains", k.with_(k.CONTENT, k.exfil("content")) + f""", dom AS (
SELECT unnest({k.lst((*cat.TRUSTED_DOMAINS, "evil.io"))}) AS d UNION SELECT {k.netloc("url")} FROM pages WHERE page_id % 3 = 0 AND {k.netloc("url")} <> ''),
pu AS (SELECT content_id, {k.netloc("u")} AS h FROM (SELECT content_id, unnest(urls) AS u FROM exf_a) WHERE len({k.params("u")}) > 0),
bad AS (SELECT content_id, count(*) AS n FROM pu WHERE NOT EXISTS (SELECT 1 FROM dom WHERE contains(h, d)) GROUP BY 1)
SELECT content_id, CAST(coalesce(n, 0) AS INTEGER) AS n_untrusted_param_urls,
CASE WHEN n > 0 THEN greatest(with_both, {k.dbl(cat.UNTRUSTED_URL_FLOOR)}) ELSE with_both END AS risk_score FROM exf_d LEFT JOIN bad USING (content_id)""")
def trusted_domains(spark, d):
    """Exfiltration score under an allow list in a table: the given domains, an added one, and every third page's host."""
    given = spark.createDataFrame([(x,) for x in (*cat.TRUSTED_DOMAINS, "evil.io")], "domain string")
    hosts = tb.table(spark, d, "pages").filter("page_id % 3 = 0").select(exfil.netloc(F.col("url")).alias("domain"))
    return domains.exfil_scan(corpus.content(spark, d), given.unionByName(hosts)).select(
        "content_id", "n_untrusted_param_urls", "risk_score")


@query("secret_redact", k.with_(k.CONTENT, f"r AS (SELECT content_id, content, {k.redact_sensitive('content')} AS x FROM content)") + """
SELECT content_id, x <> content AS changed, length(x) AS n_chars, substr(sha256(x), 1, 16) AS redacted_hash FROM r""")
def secret_redact(spark, d):
    out = corpus.content(spark, d).withColumn("x", exfil.redact_sensitive("content"))
    return out.select("content_id", (F.col("x") != F.col("content")).alias("changed"),
                      F.char_length("x").alias("n_chars"), tx.content_hash("x").alias("redacted_hash"))


_IND_SENS = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(content, {k.q(p.regex)}), lambda m: '{p.name}: ' || CASE WHEN length(m) > 50 THEN substr(m, 1, 50) || '...' ELSE m END)"
    for p in cat.SENSITIVE) + ")"
_IND_X = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(content, {k.q(p.regex)}), lambda m: '{p.name} ({p.group})')" for p in cat.EXFILTRATION) + ")"
_IND_U = (f"list_transform(list_filter({k.urls('content')}, lambda u: ({k.suspicious('u')}) OR NOT {k.trusted('u')}), "
          f"lambda u: 'suspicious_url: ' || {k.netloc('u')})")


@query("threat_indicator_text", k.with_(k.CONTENT) + f"""SELECT content_id,
array_to_string(list_concat({_IND_SENS}, {_IND_X}, {_IND_U}), '|') AS indicators FROM content""")
def threat_indicator_text(spark, d):
    out = scan.exfil_scan(corpus.content(spark, d), keep_counts=True)
    return out.select("content_id", F.concat_ws("|", exfil.indicator_text()).alias("indicators"))


@query("truncate_preview", k.with_(k.CONTENT) + f"""SELECT content_id, unnest({_IND_SENS}) AS preview FROM content
UNION ALL SELECT content_id, substr(content, 1, 200) FROM content""")
def truncate_preview(spark, d):
    """Matches cut to 50 characters with an ellipsis, contents to 200."""
    out = tx.with_gates(corpus.content(spark, d))
    parts = [exfil.sensitive_previews("content", p, tx.gate(p.name)) for p in cat.SENSITIVE]
    return out.select("content_id", F.explode(F.concat(*parts, F.array(tx.preview(F.col("content"), 200)))).alias("preview"))


# -- routed analysis ---------------------------------------------------------------

_ANA = k.with_(k.CONTENT, k.analyse("content"))


@query("route_by_context", _ANA + """SELECT context_type, count(*) AS rows, count(*) FILTER (WHERE inj_hit) AS injections,
count(*) FILTER (WHERE n_jb > 0) AS jailbreaks, count(*) FILTER (WHERE has_risk) AS exfiltrations FROM ana GROUP BY 1""")
def route_by_context(spark, d):
    out = scan.security_analyze(corpus.content(spark, d))

    def n(kind):
        return F.count_if(F.exists("threats", lambda t: t["threat_type"] == kind))

    return out.groupBy("context_type").agg(
        F.count("*").alias("rows"), n("prompt_injection").alias("injections"), n("jailbreak").alias("jailbreaks"),
        n("data_exfiltration").alias("exfiltrations"))


def _kinds():
    return F.concat_ws(",", F.transform("threats", lambda t: t["threat_type"]))



@query("security_analyze", _ANA + """SELECT content_id, threat_types, risk_score, risk_score < 0.5::DOUBLE AS is_safe,
substr(sha256(content), 1, 16) AS content_hash FROM ana""")
def security_analyze(spark, d):
    return scan.security_analyze(corpus.content(spark, d)).select(
        "content_id", _kinds().alias("threat_types"), "risk_score", "is_safe", "content_hash")


@query("analysis_risk", _ANA + "SELECT lang, max(risk_score) AS worst, count(*) FILTER (WHERE risk_score < 0.5::DOUBLE) AS safe FROM ana GROUP BY 1")
def analysis_risk(spark, d):
    return scan.security_analyze(corpus.content(spark, d)).groupBy("lang").agg(
        F.max("risk_score").alias("worst"), F.count_if("is_safe").alias("safe"))


@query("merge_threats", _ANA + "SELECT threat_types, count(*) AS n FROM ana GROUP BY 1")
def merge_threats(spark, d):
    return scan.security_analyze(corpus.content(spark, d)).groupBy(_kinds().alias("threat_types")).agg(F.count("*").alias("n"))


_SEV = """SELECT content_id, CASE WHEN inj_hit THEN inj_sev WHEN n_jb > 0 THEN 'high' ELSE ex_sev END AS severity,
CASE WHEN inj_hit THEN CASE WHEN contains(inj_rec, 'BLOCK') THEN 'block' ELSE 'flag' END WHEN n_jb > 0 THEN 'block'
ELSE lower(recommendation) END AS action FROM ana WHERE threat_types <> ''"""


@query("severity_of", _ANA + _SEV)
def severity_of(spark, d):
    first = F.col("threats")[0]
    return scan.security_analyze(corpus.content(spark, d)).filter(F.size("threats") > 0).select(
        "content_id", first["severity"].alias("severity"), first["recommended_action"].alias("action"))


_INC = k.with_(k.CONTENT, k.analyse("content"), """inc AS (SELECT content_id, split_part(threat_types, ',', 1) AS threat_type,
  CASE WHEN inj_hit THEN inj_sev WHEN n_jb > 0 THEN 'high' ELSE ex_sev END AS severity, risk_score,
  substr(content, 1, 200) AS content_preview, trace_id, 'open' AS status, user_id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(content_id % 500 AS INTEGER)) AS detected_at FROM ana WHERE risk_score >= 0.7::DOUBLE)""")


def _detected_at():
    return F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(content_id % 500 as int))")


def _incidents(spark, d):
    return scan.incidents(scan.security_analyze(corpus.content(spark, d)), detected_at=_detected_at())


@query("incidents", _INC + "SELECT * FROM inc")
def incidents(spark, d):
    return _incidents(spark, d).drop("metadata")


@query("list_incidents", _INC + """SELECT content_id, threat_type, severity, detected_at FROM inc
WHERE status = 'open' AND severity = 'critical' ORDER BY detected_at DESC, content_id DESC LIMIT 50""")
def list_incidents(spark, d):
    from screenwell.operators import admin
    return admin.list_incidents(_incidents(spark, d), "open", "critical").select(
        "content_id", "threat_type", "severity", "detected_at")


@query("incident_status", _INC + """SELECT content_id, threat_type, CASE WHEN toxic = 1 THEN 'resolved' WHEN quality = 0 THEN 'false_positive'
ELSE 'open' END AS status FROM inc LEFT JOIN labels ON doc_id = content_id""")
def incident_status(spark, d):
    """Incidents reviewed with the labels; a status nobody knows changes nothing."""
    return changes.set_incident_status(_incidents(spark, d), _review(spark, d)).select("content_id", "threat_type", "status")


def _review(spark, d):
    return tb.table(spark, d, "labels").select(
        F.col("doc_id").alias("content_id"), F.lit(1).alias("seq"), F.when(F.col("toxic") == 1, F.lit("resolved"))
        .when(F.col("quality") == 0, F.lit("false_positive")).otherwise(F.lit("looks fine")).alias("status"))


_REQUESTS = """(SELECT coalesce(sum(requests_count), 0)::BIGINT AS api_key_requests, count(DISTINCT id) FILTER (WHERE requests_count > 0) AS keys_used
  FROM keys_t JOIN hourly ON id = api_key_id WHERE is_active AND endpoint = '{}') AS req"""

def _day():
    return F.to_date(_detected_at())


def _requests(spark, d, endpoint):
    return stats.key_requests(corpus.api_keys(spark, d), usage.hourly(corpus.usage_events(spark, d), F.col("requests")), endpoint)


@query("security_stats", _INC + ", " + ", ".join((k.KEYS, k.USAGE_EVENTS, k.HOURLY)) + """, own AS (
SELECT count(*) AS own_analyses, count(*) FILTER (WHERE risk_score >= 0.7::DOUBLE) AS total_incidents,
count(*) FILTER (WHERE risk_score >= 0.7::DOUBLE AND inj_hit) AS n_prompt_injection,
count(*) FILTER (WHERE risk_score >= 0.7::DOUBLE AND NOT inj_hit AND n_jb > 0) AS n_jailbreak,
count(*) FILTER (WHERE risk_score >= 0.7::DOUBLE AND NOT inj_hit AND n_jb = 0) AS n_data_exfiltration,
coalesce(round(avg(risk_score), 3), 0.0::DOUBLE) AS average_risk_score FROM ana),
op AS (SELECT count(*) AS open_incidents FROM inc LEFT JOIN labels ON doc_id = content_id
  WHERE CASE WHEN toxic = 1 THEN 'resolved' WHEN quality = 0 THEN 'false_positive' ELSE 'open' END = 'open')
SELECT own.*, open_incidents, req.*, own_analyses + api_key_requests AS total_analyses FROM own, op, """ + _REQUESTS.format("/security/analyze"))
def security_stats(spark, d):
    """The row from partials that two batches of results and one of status changes have filled.

    A batch is analysed once; its results are written, with the beginnings of the texts, for the partials and the incidents.
    """
    path = tb.scratch(spark, "security-partials")
    day = F.date_format("day", "yyyy-MM-dd")
    batches = []
    for number in (0, 1):
        done = scan.security_analyze(corpus.content(spark, d).filter(F.col("content_id") % 2 == number))
        batches.append(tb.materialise(done.select(
            "content_id", tx.preview(F.col("content"), 200).alias("content"), "trace_id", "user_id", "threats", "risk_score"), "analyses"))
        days = tb.materialise(stats.analysis_partials(batches[-1], _day()), "analysis-days")
        partials.merge(f"{path}/analyses", days, ["day"], day, number)
    found = tb.materialise(scan.incidents(batches[0].unionByName(batches[1]), detected_at=_detected_at()).select(
        "content_id", "threat_type", "status", "detected_at"), "incidents")
    partials.merge(f"{path}/incidents", stats.incident_partials(found, F.to_date("detected_at")), ["day", "status"], day, 0)
    reviewed = changes.set_incident_status(found, _review(spark, d))
    moves = stats.status_partials(found, reviewed, "content_id", F.to_date("detected_at"))
    partials.merge(f"{path}/incidents", moves, ["day", "status"], day, 1)
    return stats.security_row(partials.read(spark, f"{path}/analyses"), partials.read(spark, f"{path}/incidents"),
                              _requests(spark, d, "/security/analyze"))


@query("threat_distribution", _INC + "SELECT threat_type, count(*) AS incidents, count(*) FILTER (WHERE status = 'open') AS open_incidents FROM inc GROUP BY 1")
def threat_distribution(spark, d):
    return stats.threat_distribution(_incidents(spark, d))


# -- content filter ----------------------------------------------------------------

_FILT = k.with_(k.CONTENT, k.injection("content"), k.spans("inj", "content", k.PII_PARTS), f"""fil AS (SELECT content_id, content, ents,
  len(ents) AS n_pii, n_detections, content_id % 2 = 0 AS redact,
  NOT ((len(ents) > 0 AND content_id % 2 <> 0) OR n_detections > 0) AS is_safe,
  CASE WHEN content_id % 2 = 0 AND len(ents) > 0 THEN {k.redact('content', 'ents', k.TYPED)} END AS filtered_content FROM sp)""")


def _filtered(spark, d):
    return scan.content_filter(corpus.content(spark, d), redact=F.col("content_id") % 2 == 0)


@query("content_filter", _FILT + """SELECT content_id, n_pii, n_detections AS n_patterns, redact, is_safe,
substr(sha256(filtered_content), 1, 16) AS filtered_hash FROM fil""")
def content_filter(spark, d):
    return _filtered(spark, d).select(
        "content_id", "n_pii", F.size("patterns").alias("n_patterns"), "redact", "is_safe",
        tx.content_hash("filtered_content").alias("filtered_hash"))


@query("filter_stats", _FILT + ", " + ", ".join((k.KEYS, k.USAGE_EVENTS, k.HOURLY)) + """, own AS (
SELECT count(*) AS own_filtered, sum(n_pii)::BIGINT AS total_pii,
count(*) FILTER (WHERE NOT (is_safe AND coalesce(toxic, 0)::DOUBLE <= 0.7::DOUBLE)) AS unsafe_count, """ + ", ".join(
    f"sum(len(list_filter(ents, lambda e: e.type = '{t}')))::BIGINT AS n_{t}" for t in cat.FILTER_PII_TYPES) + """,
coalesce(round(avg(toxic), 3), 0.0::DOUBLE) AS average_toxicity FROM fil LEFT JOIN labels ON content_id = doc_id)
SELECT own.*, req.*, own_filtered + api_key_requests AS total_filtered FROM own, """ + _REQUESTS.format("/filter"))
def filter_stats(spark, d):
    """The row from partials that two batches of results have filled; toxicity as labelled, where it is."""
    path = tb.scratch(spark, "filter-partials")
    scores = tb.table(spark, d, "labels").select(F.col("doc_id").alias("content_id"), F.col("toxic").cast("double").alias("tox"))
    for number in (0, 1):
        df = corpus.content(spark, d).filter(F.col("content_id") % 2 == number).join(scores, "content_id", "left")
        done = scan.content_filter(df, redact=F.col("content_id") % 2 == 0, toxicity=F.coalesce("tox", F.lit(0.0)))
        days = tb.materialise(stats.filter_partials(done, _day(), F.col("tox").isNotNull()), "filter-days")   # one filter run a batch
        partials.merge(path, days, ["day"], F.date_format("day", "yyyy-MM-dd"), number)
    return stats.filter_row(partials.read(spark, path), _requests(spark, d, "/filter"))


@query("filter_counters", _FILT + "SELECT redact, count(*) AS requests, count(*) FILTER (WHERE NOT is_safe) AS unsafe FROM fil GROUP BY 1")
def filter_counters(spark, d):
    return stats.filter_counters(_filtered(spark, d))


@query("pii_distribution", _FILT + ", e AS (SELECT unnest(ents) AS e FROM fil) SELECT e.type AS type, count(*) AS entities FROM e GROUP BY 1")
def pii_distribution(spark, d):
    return stats.pii_distribution(_filtered(spark, d))


@query("pii_count_histogram", _FILT + ", b AS (SELECT unnest([0, 1, 2, 3, 5, 8, 13, 'inf'::DOUBLE]) AS le) SELECT le::DOUBLE AS le, count(*) FILTER (WHERE n_pii <= le) AS n FROM fil, b GROUP BY le")
def pii_count_histogram(spark, d):
    return stats.pii_count_histogram(_filtered(spark, d))


def _worst(text: str) -> str:
    """Model probability of the worst chunk of a text."""
    return (f"list_max(list_transform(CASE WHEN length({text}) <= 1800 THEN [0] ELSE range(0, length({text}), 1600) END, "
            f"lambda s: {_model(f'substr({text}, s + 1, 1800)')}))")


def _hybrid():
    worst = models.worst_chunk(LOADER)
    return lambda c: worst(c)["p"]


@query("security_analyze_hybrid", k.with_(k.CONTENT, k.analyse("content", model=_worst("t_in"))) +
       "SELECT content_id, threat_types, round(risk_score, 9) AS risk_score, risk_score < 0.5::DOUBLE AS is_safe FROM ana")
def security_analyze_hybrid(spark, d):
    """The analysis with the model's verdict on inputs."""
    out = scan.security_analyze(corpus.content(spark, d), model=_hybrid())
    return out.select("content_id", F.concat_ws(",", F.transform("threats", lambda t: t["threat_type"])).alias("threat_types"),
                      F.round("risk_score", 9).alias("risk_score"), "is_safe")


@query("content_filter_scored", _FILT + f""", x AS (SELECT fil.*, coalesce(toxic, 0)::DOUBLE AS toxicity, {_worst('content')} >= 0.75::DOUBLE AS fired
  FROM fil LEFT JOIN labels ON content_id = doc_id)
SELECT content_id, toxicity, n_detections + fired::INT AS n_patterns, is_safe AND toxicity <= 0.7::DOUBLE AND NOT fired AS is_safe FROM x""")
def content_filter_scored(spark, d):
    """The filter with labelled toxicity and the injection model."""
    scores = tb.table(spark, d, "labels").select(F.col("doc_id").alias("content_id"), F.col("toxic").cast("double").alias("tox"))
    df = corpus.content(spark, d).join(scores, "content_id", "left")
    out = scan.content_filter(df, redact=F.col("content_id") % 2 == 0, toxicity=F.coalesce("tox", F.lit(0.0)), model=_hybrid())
    return out.select("content_id", "toxicity", F.size("patterns").alias("n_patterns"), "is_safe")


_PACK = "['default','customer_support','code_assistant','rag','healthcare','financial','creative_writing',NULL][CAST(content_id % 8 AS INTEGER) + 1]"
_REQ = "CASE content_id % 5 WHEN 0 THEN true WHEN 1 THEN false END"
_OWN = {"iban": "[A-Z]{2}[0-9]{6,}", "ref": "[Rr]ef [0-9]+"}
_CAPITALS = "[A-Z][a-z]+ [A-Z][a-z]+"
_PACK_PARTS = [(_CAPITALS, "name", 0.8, None, "analyzer")] + k.PII_PARTS + [
    (rx, cat.CUSTOM_PII_TYPE, cat.CUSTOM_PII_CONFIDENCE, name, f"pack = '{p.name}'" + (" AND own IS NULL" if name in _OWN else ""),
     k.plain_letters("t") if p.name == "financial" else "t") for p in cat.PACKS for name, rx in p.patterns] + [
    (rx, cat.CUSTOM_PII_TYPE, cat.CUSTOM_PII_CONFIDENCE, name, "own IS NOT NULL") for name, rx in _OWN.items()]


@query("content_filter_packs", k.with_(k.CONTENT, f"packs(pack, pack_filters, pack_redact, pack_threshold, pack_analyzer, pack_template) AS (VALUES {k.PACK_ROWS})",
       f"""c0 AS (SELECT content.*, {_PACK} AS pack, {_REQ} AS req_redact, CASE content_id % 7 WHEN 0 THEN ['pii'] WHEN 1 THEN ['pii', 'toxicity'] END AS req_filters,
  CASE WHEN content_id % 3 = 0 THEN 1.0::DOUBLE END AS req_threshold, content_id % 4 = 0 AS req_analyzer,
  CASE WHEN content_id % 6 = 0 THEN 1 END AS own, coalesce(toxic, 0)::DOUBLE AS tox FROM content LEFT JOIN labels ON doc_id = content_id)""",
       f"""c1 AS (SELECT c0.*, coalesce(req_redact, pack_redact, content_id % 9 = 0) AS redact,
  coalesce(req_filters, pack_filters, {k.lst(cat.DEFAULT_FILTERS)}) AS filters, req_analyzer OR coalesce(pack_analyzer, false) AS analyzer,
  coalesce(req_threshold, pack_threshold, 0.7::DOUBLE) AS threshold FROM c0 LEFT JOIN packs USING (pack)),
c2 AS (SELECT *, CASE WHEN list_contains(filters, 'pii') THEN content ELSE '' END AS t FROM c1)""",
       k.injection("c2"), k.spans("inj", "t", _PACK_PARTS)) + f"""
SELECT content_id, pack, redact, threshold, CASE WHEN list_contains(filters, 'toxicity') THEN tox END AS toxicity, len(ents) AS n_pii,
CASE WHEN list_contains(filters, 'prompt_injection') THEN n_detections ELSE 0 END AS n_patterns,
NOT ((len(ents) > 0 AND NOT redact) OR (n_detections > 0 AND list_contains(filters, 'prompt_injection'))
  OR (list_contains(filters, 'toxicity') AND tox > threshold)) AS is_safe,
CASE WHEN redact AND len(ents) > 0 THEN substr(sha256({k.redact('content', 'ents', k.TYPED)}), 1, 16) END AS filtered_hash FROM sp""")
def content_filter_packs(spark, d):
    """Filter under each row's request, pack and organisation settings, patterns, analyzer and toxicity."""
    pack = F.element_at(F.array(*[F.lit(p.name) for p in cat.PACKS], F.lit(None).cast("string")),
                        (F.col("content_id") % 8 + 1).cast("int"))
    req = F.when(F.col("content_id") % 5 == 0, F.lit(True)).when(F.col("content_id") % 5 == 1, F.lit(False))
    scores = tb.table(spark, d, "labels").select(F.col("doc_id").alias("content_id"), F.col("toxic").cast("double").alias("tox"))
    df = scan.join_pack_config(corpus.content(spark, d).withColumn("pack", pack).withColumn("req_redact", req), spark, "pack")
    df = df.join(scores, "content_id", "left").withColumns({
        "req_filters": F.when(F.col("content_id") % 7 == 0, F.array(F.lit("pii"))).when(
            F.col("content_id") % 7 == 1, F.array(F.lit("pii"), F.lit("toxicity"))),
        "req_threshold": F.when(F.col("content_id") % 3 == 0, F.lit(1.0)), "req_analyzer": F.col("content_id") % 4 == 0,
        "org_redact": F.col("content_id") % 9 == 0, "org_threshold": F.lit(None).cast("double"), "org_analyzer": F.lit(None).cast("boolean"),
        "own": F.when(F.col("content_id") % 6 == 0, F.create_map(*[F.lit(x) for kv in _OWN.items() for x in kv]))})
    names = sp.match_spans("content", [sp.Rule(_CAPITALS, "name", 0.8, None, None)])
    out = scan.content_filter(scan.resolve_settings(df), filters=F.col("filters"), redact=F.col("redact"), toxicity=F.coalesce("tox", F.lit(0.0)),
                              toxicity_threshold=F.col("threshold"), pack=F.col("pack"), patterns=F.col("own"), model_spans=names,
                              analyzer=F.col("analyzer"))
    return out.select("content_id", "pack", "redact", F.col("toxicity_threshold").alias("threshold"), "toxicity", "n_pii",
                      F.size("patterns").alias("n_patterns"), "is_safe",
                      tx.content_hash("filtered_content").alias("filtered_hash"))


# -- policies ----------------------------------------------------------------------

_COND = k.conditions("content")


def _cond(name: str, *keys: str):
    sql = k.with_(k.CONTENT) + "SELECT content_id, " + ", ".join(f"{_COND[c]} AS {c}" for c in keys) + " FROM content"

    @query(name, sql)
    def run(spark, d):
        df = tx.with_gates(corpus.content(spark, d))
        conds = pf.conditions("content")
        return df.select("content_id", *[conds[c].alias(c) for c in keys])

    return run


_cond("cond_contains_card", "contains_card_data")
_cond("cond_cvv", "contains_cvv")
_cond("cond_unencrypted_pan", "unencrypted_pan")
_cond("cond_pii", "contains_pii")
_cond("cond_phi", "contains_phi")
_cond("cond_encryption_required", "encryption_required")
_cond("cond_opt_out", "data_sale_opt_out")
_cond("cond_right_to_delete", "right_to_delete")
_cond("cond_profanity", "profanity")

_RET, _UNA = "(content_id % 10 = 0)", "(content_id % 15 = 0)"


def _context():
    return F.when(F.col("content_id") % 4 != 3, F.create_map(
        F.lit("data_retention_exceeded"), F.col("content_id") % 10 == 0,
        F.lit("unauthorized_access"), F.col("content_id") % 15 == 0))


_CTX = {"retention": f"({_RET} AND content_id % 4 <> 3)", "unauthorized": f"({_UNA} AND content_id % 4 <> 3)"}


@query("cond_context_flags", k.with_(k.CONTENT) + f"SELECT content_id, {_CTX['retention']} AS retention, {_CTX['unauthorized']} AS unauthorized FROM content")
def cond_context_flags(spark, d):
    return corpus.content(spark, d).withColumn("ctx", _context()).select(
        "content_id", pf.flag("ctx", "data_retention_exceeded").alias("retention"),
        pf.flag("ctx", "unauthorized_access").alias("unauthorized"))


@query("cond_always", k.with_(k.CONTENT) + "SELECT content_id, true AS audit_log_required, false AS unknown_condition FROM content")
def cond_always(spark, d):
    rules = F.array(*[F.struct(F.lit(c).alias("condition")) for c in ("audit_log_required", "no_such_condition")])
    df = tx.with_gates(corpus.content(spark, d))
    fired = pf.firing(rules, pf.holding(pf.conditions("content")))
    names = F.transform(fired, lambda r: r["condition"])
    return df.select("content_id", F.array_contains(names, "audit_log_required").alias("audit_log_required"),
                     F.array_contains(names, "no_such_condition").alias("unknown_condition"))


_POL = k.with_(k.CONTENT, k.condition_rows("content", **_CTX), k.POLICIES, k.RULES,
               """pol AS (SELECT policy_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, policy_id DESC) AS INTEGER)
  AS policy_ord FROM policies_t WHERE enabled)""",
               """viol AS (SELECT content_id, policy_id, name AS policy_name, policy_ord, rule_index, condition, action
  FROM content JOIN pol USING (user_id) JOIN rules_t USING (policy_id) JOIN conds USING (content_id, condition))""")
_VERDICT = """SELECT content_id, coalesce(n, 0) AS n_violations, coalesce(allowed, true) AS allowed, modified_content, coalesce(actions, '') AS actions FROM content LEFT JOIN (
SELECT content_id, count(*) AS n, NOT bool_or(action = 'block') AS allowed,
CASE WHEN arg_max(action, policy_ord * 1000 + rule_index) FILTER (WHERE action IN ('redact', 'block')) = 'redact' THEN '[REDACTED]' END AS modified_content,
string_agg(policy_name || ': ' || action, '|' ORDER BY policy_ord, rule_index) AS actions FROM viol GROUP BY 1) USING (content_id)"""


def _actions():
    return F.concat_ws("|", F.transform("violations", lambda v: F.concat(v["policy_name"], F.lit(": "), v["action"])))


def _evaluated(spark, d):
    df = corpus.content(spark, d).withColumn("ctx", _context())
    return policy.evaluate(df, policy.decode(corpus.policies(spark, d)), context="ctx")


@query("policy_evaluate", _POL + _VERDICT)
def policy_evaluate(spark, d):
    return _evaluated(spark, d).select("content_id", F.size("violations").alias("n_violations"), "allowed",
                                       "modified_content", _actions().alias("actions"))


_ASKED = k.with_(k.CONTENT, k.spans("content", "content", k.PII_PARTS, out="psp"), k.condition_rows("content", **_CTX), k.POLICIES, k.RULES,
                 """asked AS (SELECT o_custkey // 6 AS user_id, o_custkey AS policy_id, CAST(min(o_orderkey) AS INTEGER) AS policy_ord FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)""",
                 """held AS (SELECT content_id, condition FROM conds WHERE condition <> 'contains_pii' UNION
  SELECT content_id, 'contains_pii' FROM psp WHERE len(ents) > 0 UNION
  SELECT content_id, 'contains_phi' FROM psp WHERE len(list_filter(ents, lambda e: lower(e.type) IN (""" + ", ".join(map(k.q, cat.PHI_TYPES)) + """))) > 0)""",
                 """viol AS (SELECT content_id, policy_id, name AS policy_name, policy_ord, rule_index, condition, action
  FROM content JOIN asked USING (user_id) JOIN rules_t USING (policy_id) JOIN held USING (content_id, condition)
  WHERE enabled AND rules_t.user_id = asked.user_id)""")


@query("policy_evaluate_requested", _ASKED + """SELECT content_id, count(*) AS n_violations, NOT bool_or(action = 'block') AS allowed FROM viol GROUP BY 1
UNION ALL SELECT content_id, 0, true FROM content WHERE content_id NOT IN (SELECT content_id FROM viol)""")
def policy_evaluate_requested(spark, d):
    """Policies by ids that each owner requests, with detected spans as personal data."""
    requested = tb.table(spark, d, "orders").filter("o_orderkey % 3 = 0").groupBy(
        F.floor(F.col("o_custkey") / 6).alias("user_id"), F.col("o_custkey").alias("policy_id")).agg(F.min("o_orderkey").alias("request_ord"))
    df = tx.with_gates(corpus.content(spark, d).withColumn("ctx", _context()))
    found = tx.without_gates(tx.pin(df, sp.dedup(pii.regex_spans()).alias("found")))
    out = policy.evaluate(found, policy.decode(corpus.policies(spark, d)), context="ctx", requested=requested,
                          pii_mode="entities", entities=F.col("found"))
    return out.select("content_id", F.size("violations").alias("n_violations"), "allowed")


@query("join_policy_content", _POL + "SELECT content_id, policy_id, policy_ord, rule_index, condition, action FROM viol")
def join_policy_content(spark, d):
    return policy.violations(_evaluated(spark, d)).select(
        "content_id", "policy_id", "policy_ord", "rule_index", "condition", "action")


@query("policy_redact_all", _POL + f"SELECT modified_content, allowed, count(*) AS n FROM ({_VERDICT}) GROUP BY ALL")
def policy_redact_all(spark, d):
    return _evaluated(spark, d).groupBy("modified_content", "allowed").agg(F.count("*").alias("n"))


_TPL = k.with_(k.CONTENT, k.condition_rows("content", **_CTX),
               f"tpl(policy_ord, policy_id, policy_name, rule_index, condition, action) AS (VALUES {k.TEMPLATE_ROWS})",
               "viol AS (SELECT * FROM content JOIN conds USING (content_id) JOIN tpl USING (condition))")


@query("compliance_evaluate", _TPL + _VERDICT)
def compliance_evaluate(spark, d):
    df = corpus.content(spark, d).withColumn("ctx", _context())
    return policy.compliance_evaluate(df, context="ctx").select(
        "content_id", F.size("violations").alias("n_violations"), "allowed", "modified_content", _actions().alias("actions"))


@query("rule_rank", k.with_(k.POLICIES, k.RULES) + "SELECT policy_id, rule_index, condition, action, priority FROM rules_t")
def rule_rank(spark, d):
    return policy.rule_rank(policy.decode(corpus.policies(spark, d)))


# -- conversations and retrieval -----------------------------------------------------

_CONV = k.with_(k.TURNS, "user_turns AS (SELECT * FROM turns WHERE role = 'user')", k.injection("user_turns", "text"),
                """cin AS (SELECT conv_id, coalesce(max(risk_score) FILTER (WHERE is_injection), 0.0::DOUBLE) AS input_risk,
  count(*) FILTER (WHERE is_injection) AS n_issues FROM inj GROUP BY 1)""",
                "answers AS (SELECT * FROM turns WHERE role = 'assistant')", k.exfil("answers", "text"))


@query("conversation_input_risk", _CONV + "SELECT conv_id, input_risk, n_issues, input_risk >= 0.75::DOUBLE AS input_blocked FROM cin")
def conversation_input_risk(spark, d):
    return conversation.input_risk(corpus.turns(spark, d))


@query("conversation_issues", _CONV + "SELECT conv_id, turn, risk_score, recommendation FROM inj WHERE is_injection")
def conversation_issues(spark, d):
    return conversation.issues(corpus.turns(spark, d))


@query("guard_conversation", _CONV + f""", g AS (SELECT exf.*, coalesce(input_risk, 0.0::DOUBLE) AS input_risk,
  coalesce(input_risk >= 0.75::DOUBLE, false) AS b_in, has_risk AND recommendation = 'BLOCK' AS b_out,
  has_risk AND recommendation = 'REDACT' AS red FROM exf LEFT JOIN (SELECT e.conv_id, e.turn, max(i.risk_score) AS input_risk
    FROM exf e JOIN inj i ON i.conv_id = e.conv_id AND i.turn < e.turn WHERE i.is_injection GROUP BY ALL) USING (conv_id, turn))
SELECT conv_id, turn, input_risk, CASE WHEN has_risk THEN risk_score ELSE 0.0::DOUBLE END AS output_risk, b_in OR b_out AS blocked,
NOT b_in AND red AS redacted, CASE WHEN b_in THEN 'Input blocked by security policy' WHEN b_out THEN 'Output blocked by security policy' END AS error,
CASE WHEN b_in OR b_out THEN NULL WHEN red THEN {k.redact_sensitive('text')} ELSE text END AS response FROM g""")
def guard_conversation(spark, d):
    return conversation.guard(corpus.turns(spark, d))


_CAND = "cand AS (SELECT content_id // 5 AS query_id, content_id AS doc_id, content FROM content)"


def _candidates(spark, d):
    return corpus.content(spark, d).select(F.call_function("div", F.col("content_id"), F.lit(5)).alias("query_id"),
                                           F.col("content_id").alias("doc_id"), "content")


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM cand QUALIFY rank <= {k})"


@query("retrieve_top_k", k.with_(k.CONTENT, _CAND, _TOP.format(k=2)) + "SELECT query_id, doc_id, rank FROM top")
def retrieve_top_k(spark, d):
    return conversation.retrieve_top_k(_candidates(spark, d).select("query_id", "doc_id")).select("query_id", "doc_id", "rank")


@query("rag_context_scan", k.with_(k.CONTENT, _CAND, _TOP.format(k=3), f"t AS (SELECT *, {k.any_hit('content', cat.INDIRECT)} AS bad FROM top)") + """
SELECT query_id, count(*) AS n_docs, count(*) FILTER (WHERE bad) AS n_quarantined,
substr(sha256(coalesce(string_agg('Document ' || rank || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE NOT bad), '')), 1, 16) AS context_hash
FROM t GROUP BY 1""")
def rag_context_scan(spark, d):
    return conversation.rag_context(_candidates(spark, d), 3).select(
        "query_id", "n_docs", "n_quarantined", tx.content_hash("context").alias("context_hash"))


@query("page_scan", k.with_(k.PAGES, k.exfil("pages_c")) + f"""SELECT content_id, url, {k.any_hit('content', cat.INDIRECT)} AS is_indirect_injection,
n_urls, n_indicators, n_sensitive, risk_score FROM exf""")
def page_scan(spark, d):
    """Web pages: zero-click instructions, links and exfiltration indicators."""
    out = scan.exfil_scan(scan.indirect_scan(corpus.pages(spark, d), source="web"))
    return out.select("content_id", "url", "is_indirect_injection", "n_urls", "n_indicators", "n_sensitive", "risk_score")


# -- labelled data -------------------------------------------------------------------

_PII_LAB = "(" + " + ".join(k.count("test_input", p.regex) for p in cat.PII) + ")"
_EVAL = k.with_(k.LABELLED, k.analyse("labelled", "test_input"), f"""ev AS (SELECT *, {_PII_LAB} AS n_pii, risk_score >= 0.5::DOUBLE AS blocked,
  CASE WHEN category IN ('prompt_injection', 'jailbreak', 'data_exfiltration', 'credential_exfiltration')
    THEN list_contains(string_split(threat_types, ','), expected_threat) AND (risk_score >= 0.5::DOUBLE) = should_block
  WHEN category = 'pii_detection' THEN {_PII_LAB} > 0 WHEN category = 'toxicity' THEN false = should_block
  ELSE risk_score < 0.5::DOUBLE AND threat_types = '' END AS passed FROM ana)""")


@query("scenario_evaluate", _EVAL + "SELECT doc_id, id, category, threat_types, risk_score, blocked, n_pii, passed FROM ev")
def scenario_evaluate(spark, d):
    return evaluate.evaluate(corpus.labelled(spark, d)).select(
        "doc_id", "id", "category", "threat_types", "risk_score", "blocked", "n_pii", "passed")


@query("scenario_run_summary", _EVAL + """SELECT category, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
count(*) FILTER (WHERE NOT passed) AS failed FROM ev GROUP BY 1""")
def scenario_run_summary(spark, d):
    return evaluate.run_summary(evaluate.evaluate(corpus.labelled(spark, d)), "category")


@query("list_scenarios", k.with_(k.LABELLED) + "SELECT doc_id, id, name FROM labelled WHERE category = 'jailbreak'")
def list_scenarios(spark, d):
    return evaluate.select_scenarios(corpus.labelled(spark, d), category="jailbreak").select("doc_id", "id", "name")


@query("scenarios_by_ids", k.with_(k.LABELLED) + "SELECT doc_id, id, test_input FROM labelled WHERE id IN ('pi-001', 'de-004', 'tox-003')")
def scenarios_by_ids(spark, d):
    return evaluate.select_scenarios(corpus.labelled(spark, d), ids=["pi-001", "de-004", "tox-003"]).select(
        "doc_id", "id", "test_input")


@query("scenario_categories", k.with_(k.LABELLED) + """SELECT category, count(*) AS count,
(SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT id AS x FROM labelled l2 WHERE l2.category = l1.category)) AS ids FROM labelled l1 GROUP BY 1""")
def scenario_categories(spark, d):
    out = evaluate.categories(corpus.labelled(spark, d))
    return out.select("category", "count", F.concat_ws(",", F.transform("scenarios", lambda s: s["id"])).alias("ids"))


@query("label_evaluate", k.with_(k.CONTENT, k.injection("content"), """c AS (SELECT is_injection AS p, toxic = 1 AS a FROM inj JOIN labels ON content_id = doc_id),
n AS (SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn,
  count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM c)""") + """
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM n""")
def label_evaluate(spark, d):
    content = corpus.content(spark, d).withColumnRenamed("content_id", "doc_id")
    return evaluate.label_evaluate(content, tb.table(spark, d, "labels"), scan.injection_scan,
                                   F.col("is_injection"), F.col("toxic") == 1)


_HELD = "doc_id % 4 <> 0"   # every fourth document's label is kept from training


@query("toxicity_score", f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents),
l AS (SELECT doc_id, toxic = 1 AS y FROM labels SEMI JOIN documents USING (doc_id) WHERE {_HELD}),
t AS (SELECT count(*) FILTER (WHERE y) AS n1, count(*) FILTER (WHERE NOT y) AS n0 FROM l),
m AS (SELECT word, count(*) FILTER (WHERE y) AS w1, count(*) FILTER (WHERE NOT y) AS w0 FROM w JOIN l USING (doc_id) GROUP BY 1),
o AS (SELECT word, CAST(round(ln((w1 + 1.0::DOUBLE) / (n1 + 2.0::DOUBLE)) * 1000000 - ln((w0 + 1.0::DOUBLE) / (n0 + 2.0::DOUBLE)) * 1000000) AS BIGINT) AS odds FROM m, t),
s AS (SELECT doc_id, sum(odds) AS odds FROM w JOIN o USING (word) GROUP BY 1),
p AS (SELECT d.doc_id, CASE WHEN s.odds IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-(s.odds
  + CAST(round(ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE)) * 1000000) AS BIGINT)) / 1000000.0::DOUBLE)) END AS s FROM documents d LEFT JOIN s USING (doc_id), t)
SELECT doc_id, round(s, 4) AS toxicity, CASE WHEN s > 0.5 THEN 'toxic' ELSE 'not_toxic' END AS label, round(s, 4) > {cat.DEFAULT_TOXICITY}::DOUBLE AS is_toxic FROM p""")
def toxicity_score(spark, d):
    """Naive Bayes trained on the labelled documents but every fourth, applied to all."""
    texts = tb.table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(texts, tb.table(spark, d, "labels").filter(_HELD))
    out = toxicity.score(model, texts)
    return out.select("doc_id", toxicity.toxicity_label(F.col("toxicity")).alias("t")).select("doc_id", "t.*")


@query("toxicity_label", f"SELECT doc_id, round(s, 4) AS toxicity, CASE WHEN s > 0.5::DOUBLE THEN 'toxic' ELSE 'not_toxic' END AS label, round(s, 4) > 0.6::DOUBLE AS is_toxic FROM (SELECT doc_id, {_model('text')} AS s FROM documents)")
def toxicity_label(spark, d):
    """Score, label and verdict from a plugged-in scorer."""
    df = tb.table(spark, d, "documents").select(
        "doc_id", models.as_udf(LOADER)(F.col("text")).alias("s"))
    return df.select("doc_id", toxicity.toxicity_label(F.col("s"), 0.6).alias("t")).select("doc_id", "t.*")


@query("src_static_catalogs", k.with_(k.CONTENT, "hits AS (" + " UNION ALL ".join(
    f"SELECT '{fam}' AS family, '{p.name}' AS name, {k.dbl(p.weight)} AS weight, {k.count('content', p.regex)} AS n FROM content"
    for fam, ps in (("injection", cat.INJECTION), ("sensitive", cat.SENSITIVE), ("exfiltration", cat.EXFILTRATION), ("pii", cat.PII)) for p in ps) + ")") + """
SELECT family, name, weight, count(*) FILTER (WHERE n > 0) AS rows_hit, sum(n)::BIGINT AS matches FROM hits GROUP BY ALL""")
def src_static_catalogs(spark, d):
    """Every catalogue pattern with the rows it hits: one pass, then one row per pattern."""
    families = (("injection", "n_", cat.INJECTION), ("sensitive", "s_", cat.SENSITIVE),
                ("exfiltration", "x_", cat.EXFILTRATION), ("pii", "n_", cat.PII))
    df = tx.with_gates(corpus.content(spark, d)).select(
        *injection.pattern_counts(), *exfil.sensitive_counts(), *exfil.indicator_counts(), *pii.counts())
    cols = [(fam, p, f"{pre}{p.name}") for fam, pre, ps in families for p in ps]
    one = df.agg(*[e for _, _, c in cols for e in (F.count_if(F.col(c) > 0).alias(f"r_{c}"), F.sum(c).alias(f"m_{c}"))])
    rows = [F.struct(F.lit(fam).alias("family"), F.lit(p.name).alias("name"), F.lit(p.weight).alias("weight"),
                     F.col(f"r_{c}").alias("rows_hit"), F.col(f"m_{c}").alias("matches")) for fam, p, c in cols]
    return one.select(F.inline(F.array(*rows)))
