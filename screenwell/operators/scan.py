"""Row-local screening of content: no shuffle, one pass over the text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import exfil, fields, injection, pii
from screenwell.functions import spans as sp
from screenwell.functions import text as tx

#: Injection probability of a text column; null texts cost nothing (`models.worst_chunk`).
Model = Callable[[Column], Column]

THREAT = ("struct<threat_type:string,severity:string,confidence:double,"
          "indicators:array<string>,recommended_action:string>")


def injection_scan(df: DataFrame, text: str = "content", keep_counts: bool = False) -> DataFrame:
    """Regex injection score, verdict (> 0.5) and recommendation."""
    return injection.score(df, text, keep_counts)


def with_model(df: DataFrame, text: Column, model: Model | None) -> DataFrame:
    """Turn regex scores into those of the hybrid engine; the model decides the verdict.  Rows of null `text` keep theirs."""
    if model is None:
        return df
    df = df.withColumn("_p", model(text))
    used = F.col("_p").isNotNull()
    df = df.withColumn("risk_score", F.when(
        used, F.col("_p") * F.lit(cat.MODEL_WEIGHT) + F.col("risk_score") * F.lit(cat.REGEX_WEIGHT)).otherwise(F.col("risk_score")))
    df = df.withColumn("is_injection", F.coalesce(F.col("_p") >= F.lit(cat.MODEL_THRESHOLD), F.col("is_injection")))
    return df.withColumn("recommendation", F.when(used, tx.ladder(F.col("risk_score"), cat.REC_HYBRID)).otherwise(
        F.col("recommendation"))).drop("_p")


def exfil_scan(df: DataFrame, text: str = "content", pii_tier: str = "none", **options) -> DataFrame:
    """Exfiltration score, risk flag (>= 0.6) and recommendation."""
    return exfil.score(df, text, pii_tier, **options)


def indirect_scan(df: DataFrame, text: str = "content", source: str = "unknown") -> DataFrame:
    """Zero-click instructions hidden in content that is processed later."""
    return (tx.without_gates(tx.pin(tx.with_gates(df, text), injection.indirect_hits(text).alias("indirect")))
            .withColumn("is_indirect_injection", F.size("indirect") > 0)
            .withColumn("scan_source", F.lit(source))
            .withColumn("verdict", F.when(F.size("indirect") > 0, F.lit("QUARANTINE")).otherwise(F.lit("SAFE"))))


def jailbreak_scan(df: DataFrame, text: str = "content") -> DataFrame:
    """Jailbreak phrases; each adds 0.5 to the confidence."""
    found = tx.with_gates(df, text).withColumn("jailbreak", injection.jailbreak_hits())
    return tx.without_gates(found).withColumn(
        "jailbreak_confidence", injection.jailbreak_confidence(F.size("jailbreak")))


def security_analyze(df: DataFrame, text: str = "content", model: Model | None = None) -> DataFrame:
    """Threats, risk and verdict of every content row, routed by `context_type`.

    Inputs and system prompts are scanned for injection and jailbreaks, outputs
    for exfiltration, anything else for nothing.  Text a row is not scanned for
    is blanked first, which closes all gates.  With a `model` the hybrid engine judges
    injections; without, the regex engine always reports its own here.
    """
    inbound = F.col("context_type").isin("input", "system_prompt")
    outbound = F.col("context_type") == "output"
    blank = F.lit("")
    df = df.withColumn("_in", F.when(inbound, F.col(text)).otherwise(blank)) \
           .withColumn("_out", F.when(outbound, F.col(text)).otherwise(blank))
    df = with_model(injection.score(df, "_in", keep_counts=True), F.when(inbound, F.col(text)), model)
    names = injection.detected_names()
    if model is not None:
        names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(cat.FALLBACK_INDICATOR)))
    df = (df.withColumn("_inj", F.when(F.col("is_injection"), _threat(
                "prompt_injection", tx.ladder(F.col("risk_score"), cat.SEVERITY), F.col("risk_score"),
                names,
                F.when(F.col("recommendation").contains("BLOCK"), F.lit("block")).otherwise(F.lit("flag")))))
            .withColumn("_jb_hits", injection.jailbreak_hits())
            .withColumn("_jb", F.when(F.size("_jb_hits") > 0, _threat(
                "jailbreak", F.lit("high"), injection.jailbreak_confidence(F.size("_jb_hits")),
                F.col("_jb_hits"), F.lit("block")))))
    helper = [f"n_{p.name}" for p in cat.INJECTION] + [
        "n_detections", "max_severity", "marker_score", "scope_score", "risk_score", "is_injection",
        "recommendation", tx.LOWER, tx.UNGATED, "_in", "_jb_hits"]
    df = exfil.score(df.drop(*helper), "_out", keep_counts=True)
    severity = F.create_map(*[F.lit(x) for kv in cat.EXFIL_SEVERITY.items() for x in kv])[F.col("recommendation")]
    df = df.withColumn("_ex", F.when(F.col("has_risk"), _threat(
        "data_exfiltration", severity, F.col("risk_score"), exfil.indicator_text("_out"),
        F.lower("recommendation"))))
    helper = ([f"s_{p.name}" for p in cat.SENSITIVE] + [f"x_{p.name}" for p in cat.EXFILTRATION] + [
        "n_pii_tier", "url_info", "n_sensitive", "n_indicators", "n_urls", "n_untrusted_param_urls",
        "risk_score", "has_risk", "recommendation", tx.LOWER, tx.UNGATED, "_out"])
    df = tx.pin(df.drop(*helper), merge_threats(F.col("_inj"), F.col("_jb"), F.col("_ex")).alias("threats"))
    return (df.drop("_inj", "_jb", "_ex")
            .withColumn("risk_score", analysis_risk(F.col("threats")))
            .withColumn("is_safe", F.col("risk_score") < F.lit(cat.SAFE_RISK))
            .withColumn("content_hash", tx.content_hash(text)))


def _threat(kind: str, severity: Column, confidence: Column, indicators: Column, action: Column) -> Column:
    return F.struct(F.lit(kind).alias("threat_type"), severity.alias("severity"), confidence.alias("confidence"),
                    indicators.alias("indicators"), action.alias("recommended_action")).cast(THREAT)


def merge_threats(*threats: Column) -> Column:
    """Threats in the given order, absent ones left out."""
    return F.array_compact(F.array(*threats))


def analysis_risk(threats: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(threats, lambda t: t["confidence"])), F.lit(0.0))


def incidents(analysed: DataFrame, text: str = "content", minimum: float = cat.INCIDENT_RISK,
              detected_at: Column | None = None) -> DataFrame:
    """Open incidents of analysed rows; the first threat names type and severity.

    `user_id` and `metadata` are null where the analysed rows have none, `detected_at`
    where no time is given.
    """
    hot = analysed.filter((F.col("risk_score") >= F.lit(minimum)) & (F.size("threats") > 0))
    first = F.col("threats")[0]
    return hot.select(
        "content_id", first["threat_type"].alias("threat_type"), first["severity"].alias("severity"),
        "risk_score", tx.preview(F.col(text), 200).alias("content_preview"), "trace_id",
        F.lit("open").alias("status"),
        F.col("user_id") if "user_id" in analysed.columns else F.lit(None).cast("bigint").alias("user_id"),
        (F.lit(None) if detected_at is None else detected_at).cast("timestamp_ntz").alias("detected_at"),
        F.col("metadata") if "metadata" in analysed.columns else F.lit(None).cast("map<string,string>").alias("metadata"))


def content_filter(df: DataFrame, text: str = "content", *, filters: Column | None = None,
                   redact: Column | None = None, toxicity_threshold: Column | None = None,
                   toxicity: Column | None = None, custom: Mapping[str, str] | None = None,
                   pack: Column | None = None, model_spans: Column | None = None, model: Model | None = None,
                   patterns: Column | None = None, analyzer: Column | None = None) -> DataFrame:
    """PII, toxicity and injection verdict of every row.

    Settings are columns, so they may differ by row.  `pack` names the use-case
    pack whose custom patterns apply, `patterns` is a row's own map of them; a pattern of the row takes the place of one of
    its pack that has the same name.  `model_spans` are an analyzer's; with `analyzer` only rows where it holds have them.  Pattern names come from whichever
    injection result exists, so a regex-only run reports them too; a `model` that
    finds an injection adds its own name.  Any matched pattern, even a weak marker,
    makes a row unsafe.  Redaction always works on
    de-duplicated spans.
    """
    default = F.array(*[F.lit(f) for f in cat.DEFAULT_FILTERS])
    df = (df.withColumn("_filters", filters if filters is not None else default)
            .withColumn("_redact", redact if redact is not None else F.lit(False))
            .withColumn("_threshold", toxicity_threshold if toxicity_threshold is not None else F.lit(cat.DEFAULT_TOXICITY))
            .withColumn("toxicity", F.when(F.array_contains("_filters", "toxicity"),
                                           toxicity if toxicity is not None else F.lit(0.0))))
    wants_pii, wants_inj = (F.array_contains("_filters", f) for f in ("pii", "prompt_injection"))
    df = df.withColumn("_inj", F.when(wants_inj, F.col(text)).otherwise(F.lit("")))
    df = injection.score(df, "_inj", keep_counts=True).withColumn("patterns", injection.detected_names())
    if model is not None:
        fired = model(F.when(wants_inj, F.col(text))) >= F.lit(cat.MODEL_THRESHOLD)
        df = df.withColumn("patterns", F.concat("patterns", F.when(fired, F.array(F.lit(cat.MODEL_SENTINEL))).otherwise(
            F.array().cast("array<string>"))))
    df = df.drop(*[f"n_{p.name}" for p in cat.INJECTION], "max_severity", "marker_score", "scope_score",
                 tx.LOWER, tx.UNGATED, "_inj")
    df = df.withColumn("_pii", F.when(wants_pii, F.col(text)).otherwise(F.lit("")))
    rules = pii.rules("_pii", custom)
    if pack is not None:
        def of_pack(p, name):
            own = F.lit(False) if patterns is None else F.coalesce(F.map_contains_key(patterns, name), F.lit(False))
            return (pack == p.name) & ~own & tx.gate(name)

        rules += [sp.Rule(rx, cat.CUSTOM_PII_TYPE, cat.CUSTOM_PII_CONFIDENCE, name, of_pack(p, name))
                  for p in cat.PACKS for name, rx in p.patterns]
    if model_spans is not None:   # as of old, spans of texts that are not filtered for personal data do not count
        asked = wants_pii if analyzer is None else wants_pii & F.coalesce(analyzer, F.lit(False))
        model_spans = F.when(asked, model_spans).otherwise(F.array().cast(sp.SPANS))
    found = [sp.match_spans("_pii", rules)] if model_spans is None else [model_spans, sp.match_spans("_pii", rules)]
    if patterns is not None:
        df = df.withColumn("_own", pii.custom_spans("_pii", patterns))
        found.append(F.col("_own"))
    df = tx.without_gates(tx.pin(tx.with_gates(df, "_pii"), sp.merge(*found).alias("entities"))).drop("_pii", "_own")
    df = df.withColumn("filtered_content", F.when(
        F.col("_redact") & (F.size("entities") > 0), sp.redact(text, F.col("entities"))))
    unsafe = (((F.size("entities") > 0) & ~F.col("_redact"))
              | F.coalesce(F.col("toxicity") > F.col("_threshold"), F.lit(False))
              | (F.size("patterns") > 0))
    return (df.withColumn("is_safe", ~unsafe).withColumn("n_pii", F.size("entities"))
            .withColumn("filters_applied", F.col("_filters")).withColumn("redact", F.col("_redact"))
            .withColumn("toxicity_threshold", F.col("_threshold")).drop("_filters", "_redact", "_threshold"))


def pack_table(spark) -> DataFrame:
    """The use-case packs as a table (seven rows, safe to broadcast)."""
    rows = [(p.name, list(p.filters), p.redact, p.toxicity_threshold, p.use_analyzer, dict(p.patterns), p.template)
            for p in cat.PACKS]
    return spark.createDataFrame(
        rows, "pack string, pack_filters array<string>, pack_redact boolean, pack_threshold double, "
              "pack_analyzer boolean, pack_patterns map<string,string>, pack_template string")


def join_pack_config(df: DataFrame, spark, pack_col: str = "template_pack") -> DataFrame:
    """Key rows with the settings of their pack; keys without a pack get nulls."""
    packs = pack_table(spark).withColumnRenamed("pack", pack_col)
    return df.join(F.broadcast(packs), pack_col, "left")


def resolve_settings(df: DataFrame, mode: str = "null") -> DataFrame:
    """Settings in force: request, then pack, then organisation default, then system.

    Expects `req_*`, `pack_*` and `org_*` columns.
    """
    return (df.withColumn("redact", fields.effective_redact(F.col("req_redact"), F.col("pack_redact"), F.col("org_redact")))
            .withColumn("filters", fields.effective_filters(F.col("req_filters"), F.col("pack_filters"), mode))
            .withColumn("threshold", fields.effective_threshold(
                F.col("req_threshold"), F.col("pack_threshold"), F.col("org_threshold"), mode))
            .withColumn("analyzer", fields.effective_analyzer(
                F.col("req_analyzer"), F.col("pack_analyzer"), F.col("org_analyzer"))))


def demo_settings(df: DataFrame, text: str = "content", limit: int = cat.DEMO_MAX_CHARS) -> DataFrame:
    """Playground settings: short content only, redaction on unless refused."""
    return df.filter(fields.within_chars(F.col(text), limit)).withColumn(
        "redact", F.coalesce("req_redact", F.lit(True)))
