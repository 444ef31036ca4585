"""Queries over single texts: sources, personal data, spans, redaction, small scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import fields, pii
from screenwell.functions import spans as sp
from screenwell.functions import text as tx
from screenwell.operators import conversation, models, scan
from screenwell.plans import sqlkit as k
from screenwell.plans.registry import query
from screenwell.sources import corpus
from screenwell.sources import tables as tb

# -- sources -------------------------------------------------------------------------


@query("src_content", k.with_(k.CONTENT) + "SELECT content_id, content, context_type, trace_id FROM content")
def src_content(spark, d):
    return tb.normalise_content(corpus.content(spark, d)).drop("metadata")


@query("src_conversation", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def src_conversation(spark, d):
    return tb.read_conversation(tb.table(spark, d, "conversations"), "user")


@query("conversation_history", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def conversation_history(spark, d):
    return conversation.history(tb.read_conversation(tb.table(spark, d, "conversations")))


# -- personal data ---------------------------------------------------------------------


@query("pii_regex", k.with_(k.CONTENT) + "SELECT content_id, " + ", ".join(
    f"{k.count('content', p.regex)} AS n_{p.name}" for p in cat.PII) + " FROM content")
def pii_regex(spark, d):
    return tx.with_gates(corpus.content(spark, d)).select("content_id", *pii.counts())


_OUT = 'e.type AS type, e.value AS value, e.start AS "start", e.start + e.len AS "end", -e.neg AS confidence'


def _spans(spark, d, custom=None):
    return tx.with_gates(corpus.content(spark, d)).select("content_id", "content", pii.regex_spans(custom=custom).alias("raw"))


@query("match_spans", k.with_(k.CONTENT, k.spans("content", "content", k.PII_PARTS), "x AS (SELECT content_id, unnest(raw) AS e FROM sp)") +
       f"SELECT content_id, {_OUT} FROM x")
def match_spans(spark, d):
    return _spans(spark, d).select("content_id", F.inline("raw")).drop("label")


@query("pii_dedup", k.with_(k.CONTENT, k.spans("content", "content", k.PII_PARTS), "x AS (SELECT content_id, unnest(ents) AS e FROM sp)") +
       f"SELECT content_id, {_OUT} FROM x")
def pii_dedup(spark, d):
    return _spans(spark, d).select("content_id", F.inline(sp.dedup(F.col("raw")))).drop("label")


@query("pii_detect", k.with_(k.PAGES, k.spans("pages_c", "content", k.PII_PARTS), "x AS (SELECT content_id, unnest(ents) AS e FROM sp)") +
       "SELECT content_id, e.type AS type, count(*) AS n, max(-e.neg) AS best FROM x GROUP BY ALL")
def pii_detect(spark, d):
    """Hybrid engine over web pages; without an entity model its regex half remains."""
    df = tx.with_gates(corpus.pages(spark, d))
    found = pii.detect(engine="hybrid", model=sp.no_spans())
    return df.select("content_id", F.explode(found).alias("e")).groupBy("content_id", F.col("e.type").alias("type")).agg(
        F.count("*").alias("n"), F.max("e.confidence").alias("best"))


_IDX = "list_transform(range(1, len(raw) + 1), lambda i: {'start': raw[i].start, 'neg': raw[i].neg, 'ord': i, 'type': raw[i].type})"


@query("sort_entities", k.with_(k.CONTENT, k.spans("content", "content", k.PII_PARTS)) + f"""
SELECT content_id, array_to_string(list_transform(list_sort({_IDX}), lambda s: s.type || '@' || s.start), ',') AS ordered FROM sp""")
def sort_entities(spark, d):
    return _spans(spark, d).select("content_id", F.concat_ws(",", F.transform(
        sp.sort_spans(F.col("raw")), lambda s: F.concat(s["type"], F.lit("@"), s["start"].cast("string")))).alias("ordered"))


def _redaction(name, token_sql, spark_expr, parts=k.PII_PARTS, custom=None, pick=None):
    ents = pick or "ents"
    sql = k.with_(k.CONTENT, k.spans("content", "content", parts), f"r AS (SELECT content_id, {k.redact('content', 'picked', token_sql)} AS x FROM (SELECT *, {ents} AS picked FROM sp))")

    @query(name, sql + " SELECT content_id, length(x) AS n_chars, substr(sha256(x), 1, 16) AS redacted_hash FROM r")
    def run(spark, d):
        out = _spans(spark, d, custom).withColumn("ents", sp.dedup(F.col("raw"))).withColumn("x", spark_expr())
        return out.select("content_id", F.char_length("x").alias("n_chars"), tx.content_hash("x").alias("redacted_hash"))


_redaction("pii_redact_typed", k.TYPED, lambda: sp.redact("content", F.col("ents")))
_redaction("pii_redact_fixed", "'[REDACTED]'", lambda: sp.redact_fixed("content", F.col("ents"), types=["email", "ssn"]),
           pick="list_filter(ents, lambda e: e.type IN ('email', 'ssn'))")

CUSTOM = {"parcel": r"\bPX\d{4}[A-Z]{2}\b", "icd_code": r"\b[A-Z]\d{2}\.\d\b", "exp_date": r"\b\d{2}/\d{2}\b", "broken": "("}
_CUSTOM_PARTS = k.PII_PARTS + [(v, "name", 0.75, n) for n, v in CUSTOM.items() if n != "broken"]


@query("pii_custom", k.with_(k.CONTENT, k.spans("content", "content", _CUSTOM_PARTS), "x AS (SELECT content_id, unnest(raw) AS e FROM sp)") +
       f"SELECT content_id, {_OUT}, e.label AS label FROM x WHERE e.label IS NOT NULL")
def pii_custom(spark, d):
    """Extra named patterns; one that does not compile is skipped."""
    return _spans(spark, d, CUSTOM).select("content_id", F.inline("raw")).filter(F.col("label").isNotNull())


_PACK_SQL = ", ".join(f"{k.count(k.plain_letters('content') if p.name == 'financial' else 'content', rx)} AS n_{name}" for p in cat.PACKS for name, rx in p.patterns)


@query("custom_patterns", k.with_(k.CONTENT) + f"SELECT content_id, {_PACK_SQL} FROM content")
def custom_patterns(spark, d):
    """Match counts of all patterns the use-case packs bring along."""
    return tx.with_gates(corpus.content(spark, d)).select("content_id", *[
        tx.count_matches("content", rx, tx.gate(name)).alias(f"n_{name}") for name, rx in pii.all_pack_patterns()])


_ROW_MAPS = ({"parcel": CUSTOM["parcel"], "exp_date": CUSTOM["exp_date"]}, {"ref": r"[A-Z]{3}\d{3}", "broken": "("}, None)
_ROW_PARTS = [(rx, cat.CUSTOM_PII_TYPE, cat.CUSTOM_PII_CONFIDENCE, n, f"content_id % 3 = {i}", k.plain_letters("content"))
              for i, m in enumerate(_ROW_MAPS) for n, rx in (m or {}).items() if n != "broken"]


@query("custom_patterns_by_row", k.with_(k.CONTENT, k.spans("content", "content", k.PII_PARTS + _ROW_PARTS)) +
       "SELECT content_id, len(ents) AS n_pii, len(list_filter(ents, lambda e: e.label IS NOT NULL)) AS n_own FROM sp")
def custom_patterns_by_row(spark, d):
    """The filter under each row's own patterns, which come as a column; one that does not compile is skipped."""
    maps = [F.lit(None).cast("map<string,string>") if m is None else F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
            for m in _ROW_MAPS]
    own = F.element_at(F.array(*maps), (F.col("content_id") % len(maps) + 1).cast("int"))
    out = scan.content_filter(corpus.content(spark, d).withColumn("own", own), patterns=F.col("own"))
    return out.select("content_id", "n_pii", F.size(F.filter("entities", lambda e: e["label"].isNotNull())).alias("n_own"))


_MODEL_SPANS = r"(?i)\b(?:mr|ms|dr|jane|john)\b\.? [A-Z][a-z]+"


@query("merge_entity_sources", k.with_(k.CONTENT, k.spans("content", "content", [(_MODEL_SPANS, "name", 0.9, "person name"), *k.PII_PARTS])) +
       ", x AS (SELECT content_id, unnest(ents) AS e FROM sp) SELECT content_id, coalesce(e.label, e.type) AS label, count(*) AS n FROM x GROUP BY ALL")
def merge_entity_sources(spark, d):
    """Entities of a model-like source merged with the regex ones."""
    df = tx.with_gates(corpus.content(spark, d))
    source = sp.match_spans("content", [sp.Rule(_MODEL_SPANS, "name", 0.9, "person name")])
    merged = df.select("content_id", F.explode(pii.detect(engine="hybrid", model=source)).alias("e"))
    return merged.groupBy("content_id", F.coalesce("e.label", "e.type").alias("label")).agg(F.count("*").alias("n"))


_LABELS = ("Email Address", "mobile phone", "social security number", "credit card", "IP address", "full name", "street address",
           "date of birth", "passport number", "driver license", "bank account", "medical record", "organization", "zip code")


def _label_sql(c: str) -> str:
    n = f"replace(lower({c}), ' ', '_')"
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({n}, {k.q(f)})" for f in frags) + f" THEN {k.q(t)}" for t, frags in cat.LABEL_RULES) + f" ELSE {k.q(cat.LABEL_DEFAULT)} END"


@query("label_to_type", f"""WITH l AS (SELECT doc_id, {k.at(_LABELS, f'doc_id % {len(_LABELS)}')} AS label FROM documents),
t AS (SELECT doc_id, label, {_label_sql('label')} AS type FROM l)
SELECT *, CASE WHEN type IN ('email','phone','ssn','credit_card','ip_address','name','address') THEN type ELSE 'name' END AS filter_type FROM t""")
def label_to_type(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("doc_id") % len(_LABELS) + 1).cast("int"))
    out = tb.table(spark, d, "documents").select("doc_id", label.alias("label")).withColumn(
        "type", pii.label_to_type(F.col("label")))
    return out.withColumn("filter_type", pii.filter_type(F.col("type")))


_INJ_PARTS = [(p.regex, p.name, p.weight, None) for p in cat.INJECTION]


@query("spans_table", k.with_(k.CONTENT, k.spans("content", "content", _INJ_PARTS), "x AS (SELECT content_id, unnest(raw) AS e FROM sp)") +
       'SELECT content_id, e.type AS name, -e.neg AS severity, e.value AS matched_text, e.start AS "start", e.start + e.len AS "end" FROM x')
def spans_table(spark, d):
    return models.spans_table(corpus.content(spark, d))


_EXF_PARTS = [(p.regex, p.name, p.weight, p.group) for p in (*cat.SENSITIVE, *cat.EXFILTRATION)]


@query("exfil_spans", k.with_(k.CONTENT, k.spans("content", "content", _EXF_PARTS), "x AS (SELECT content_id, unnest(raw) AS e FROM sp)") + f"""
SELECT content_id, CASE WHEN s THEN 'sensitive' ELSE 'indicator' END AS kind, e.type AS name, e.label AS "group", -e.neg AS severity,
CASE WHEN s AND length(e.value) > 50 THEN substr(e.value, 1, 50) || '...' ELSE substr(e.value, 1, 100) END AS matched_text,
e.start AS "start", e.start + e.len AS "end" FROM (SELECT *, list_contains({k.lst([p.name for p in cat.SENSITIVE])}, e.type) AS s FROM x)""")
def exfil_spans(spark, d):
    return models.exfil_spans(corpus.content(spark, d))


# -- chunks and entity models ------------------------------------------------------------


@query("chunk_words", k.with_(k.word_chunks("documents", "doc_id", "text")) +
       'SELECT doc_id, chunk_no, "offset", length(chunk) AS n_chars, substr(sha256(chunk), 1, 16) AS chunk_hash FROM wc')
def chunk_words(spark, d):
    parts = models.chunk_words(tb.table(spark, d, "documents"), "doc_id", "text")
    return parts.select("doc_id", "chunk_no", "offset", F.char_length("chunk").alias("n_chars"),
                        tx.content_hash("chunk").alias("chunk_hash"))


def capitals_model():
    """A toy entity model: runs of capitalised words count as person names."""
    import re
    name = re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+")

    def predict(chunk, labels, threshold):
        return [(labels[0], m.group(), m.start(), m.end(), 0.8) for m in name.finditer(chunk)]

    return predict


@query("entity_model", k.with_(k.CONTENT, k.word_chunks("content", "content_id", "content"),
                              "e AS (SELECT content_id, \"offset\", unnest(" + k.span_list("chunk", "[A-Z][a-z]+ [A-Z][a-z]+", "name", 0.8) + ") AS e FROM wc)",
                              'u AS (SELECT DISTINCT content_id, e.value, "offset" + e.start AS "start" FROM e)') +
       'SELECT content_id, \'name\' AS type, count(*) AS n, min("start") AS first FROM u GROUP BY 1')
def entity_model(spark, d):
    """Entities of a pluggable model, found chunk by chunk and de-duplicated by position."""
    found = models.entities(corpus.content(spark, d), capitals_model, ["person name"])
    return found.groupBy("content_id", "type").agg(F.count("*").alias("n"), F.min("start").alias("first"))


# -- small scalars -----------------------------------------------------------------------


@query("content_hash", k.with_(k.CONTENT) + "SELECT content_id, substr(sha256(content), 1, 16) AS content_hash FROM content")
def content_hash(spark, d):
    return corpus.content(spark, d).select("content_id", tx.content_hash("content").alias("content_hash"))


@query("word_tokens", k.with_(k.CONTENT) + """SELECT content_id, len(w) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM (
SELECT content_id, list_distinct(regexp_extract_all(lower(content), '[a-z]+')) AS w FROM content)""")
def word_tokens(spark, d):
    return corpus.content(spark, d).select("content_id", tx.word_tokens("content").alias("w")).select(
        "content_id", F.size("w").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query("size_limit", k.with_(k.CONTENT) + "SELECT content_id, strlen(content) AS n_bytes, length(content) <= 8000 AS demo_ok FROM content WHERE strlen(content) <= 10000000")
def size_limit(spark, d):
    df = corpus.content(spark, d).filter(fields.within_bytes(F.col("content")))
    return df.select("content_id", F.octet_length("content").alias("n_bytes"), fields.within_chars(F.col("content")).alias("demo_ok"))


_REQ = "CASE content_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"


def _req(col):
    return F.when(F.col(col) % 3 == 0, F.lit(True)).when(F.col(col) % 3 == 1, F.lit(False))


@query("demo_config", k.with_(k.CONTENT) + f"SELECT content_id, coalesce({_REQ}, true) AS redact FROM content WHERE length(content) <= 8000")
def demo_config(spark, d):
    df = corpus.content(spark, d).withColumn("req_redact", _req("content_id"))
    return scan.demo_settings(df).select("content_id", "redact")


_SETTINGS = f"""packs(template_pack, pack_filters, pack_redact, pack_threshold, pack_analyzer, pack_template) AS (VALUES {k.PACK_ROWS}),
s AS (SELECT id, template_pack, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS req_redact,
  CASE id % 4 WHEN 0 THEN ['pii'] WHEN 1 THEN {k.lst(reversed(cat.DEFAULT_FILTERS))} END AS req_filters,
  CASE id % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE END AS req_threshold,
  CASE WHEN id % 2 = 0 THEN true END AS org_redact, CASE WHEN id % 7 = 0 THEN 0.5::DOUBLE END AS org_threshold, id % 11 = 0 AS org_analyzer,
  pack_filters, pack_redact, pack_threshold, pack_analyzer FROM keys_t LEFT JOIN packs USING (template_pack))"""


def _settings(spark, d):
    i = F.col("id")
    df = scan.join_pack_config(corpus.api_keys(spark, d), spark)
    return (df.withColumn("req_redact", _req("id"))
            .withColumn("req_filters", F.when(i % 4 == 0, F.array(F.lit("pii"))).when(
                i % 4 == 1, F.array(*[F.lit(f) for f in reversed(cat.DEFAULT_FILTERS)])))
            .withColumn("req_threshold", F.when(i % 5 == 0, F.lit(0.9)).when(i % 5 == 1, F.lit(0.7)))
            .withColumn("req_analyzer", F.lit(None).cast("boolean"))
            .withColumn("org_redact", F.when(i % 2 == 0, F.lit(True)))
            .withColumn("org_threshold", F.when(i % 7 == 0, F.lit(0.5)))
            .withColumn("org_analyzer", i % 11 == 0))


@query("effective_config", k.with_(k.KEYS, _SETTINGS) + f"""
SELECT id, coalesce(req_redact, pack_redact, org_redact, false) AS redact,
array_to_string(coalesce(req_filters, pack_filters, {k.lst(cat.DEFAULT_FILTERS)}), ',') AS filters,
coalesce(req_threshold, pack_threshold, org_threshold, 0.7::DOUBLE) AS threshold, coalesce(pack_analyzer, false) OR org_analyzer AS analyzer FROM s""")
def effective_config(spark, d):
    return scan.resolve_settings(_settings(spark, d)).select(
        "id", "redact", F.concat_ws(",", "filters").alias("filters"), "threshold", "analyzer")


@query("effective_config_equality", k.with_(k.KEYS, _SETTINGS, f"g AS (SELECT *, coalesce(req_filters, {k.lst(cat.DEFAULT_FILTERS)}) AS gf, coalesce(req_threshold, 0.7::DOUBLE) AS gt FROM s)") + f"""
SELECT id, array_to_string(CASE WHEN pack_filters IS NOT NULL AND len(list_intersect(gf, {k.lst(cat.DEFAULT_FILTERS)})) = 3 AND len(gf) = 3 THEN pack_filters ELSE gf END, ',') AS filters,
CASE WHEN pack_threshold IS NOT NULL AND gt = 0.7::DOUBLE THEN pack_threshold ELSE gt END AS threshold FROM g""")
def effective_config_equality(spark, d):
    """The variant in which a request equal to the defaults counts as unset."""
    return scan.resolve_settings(_settings(spark, d), "equality").select(
        "id", F.concat_ws(",", "filters").alias("filters"), "threshold")


@query("filters_equal_default", k.with_(k.KEYS, _SETTINGS) + f"""SELECT id, len(list_intersect(f, {k.lst(cat.DEFAULT_FILTERS)})) = 3 AND len(f) = 3 AS is_default
FROM (SELECT id, coalesce(req_filters, pack_filters) AS f FROM s) WHERE f IS NOT NULL""")
def filters_equal_default(spark, d):
    df = _settings(spark, d).withColumn("f", F.coalesce("req_filters", "pack_filters")).filter(F.col("f").isNotNull())
    default = F.array(*[F.lit(f) for f in cat.DEFAULT_FILTERS])
    return df.select("id", fields.same_set(F.col("f"), default).alias("is_default"))


@query("merge_patterns", k.with_(k.KEYS) + """SELECT id, n, CASE WHEN n = 'iban' AND id % 2 = 0 THEN 'X' WHEN n = 'mine' THEN 'Y'
ELSE 'pack' END AS origin FROM (SELECT id, unnest(list_concat(
  CASE template_pack WHEN 'code_assistant' THEN ['api_key_pattern', 'private_key_header', 'aws_access_key', 'generic_secret'] WHEN 'financial' THEN ['iban', 'swift_bic', 'routing_number'] ELSE [] END,
  CASE WHEN id % 2 = 0 THEN (CASE WHEN template_pack = 'financial' THEN ['mine'] ELSE ['mine', 'iban'] END) ELSE [] END)) AS n FROM keys_t)""")
def merge_patterns(spark, d):
    """Pack patterns overridden by those of the request."""
    df = scan.join_pack_config(corpus.api_keys(spark, d), spark)
    req = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("mine"), F.lit("Y"), F.lit("iban"), F.lit("X")))
    out = df.select("id", F.explode(fields.overlay(
        F.coalesce("pack_patterns", F.create_map().cast("map<string,string>")), req)).alias("n", "pattern"))
    return out.select("id", "n", F.when(F.col("pattern").isin("X", "Y"), F.col("pattern")).otherwise(F.lit("pack")).alias("origin"))
