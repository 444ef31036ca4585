"""Rule conditions and row-local rule evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import text as tx


REDACTED = "[REDACTED]"


def contains_card(text: str) -> Column:
    return F.when(tx.matches(text, r"\d[ -]?\d"), tx.matches(text, cat.CARD) | tx.matches(text, cat.PAN)).otherwise(F.lit(False))


def unencrypted_pan(text: str) -> Column:
    """Any sixteen-digit number: a match never holds a mask character."""
    return tx.matches(text, cat.PAN)


def contains_cvv(text: str) -> Column:
    return F.when(tx.opened((("cvv", "cvc", "csc", "security"),)),
                  tx.matches(text, cat.CVV)).otherwise(F.lit(False))


def contains_pii(text: str, mode: str = "rules", entities: Column | None = None) -> Column:
    """`rules`: number formats or keywords; `entities`: any detected span."""
    if mode == "entities":
        return F.size(entities) > 0
    return tx.contains_any(cat.PII_WORDS) | tx.matches(text, cat.SSN) | tx.matches(text, cat.CARD)


def contains_phi(mode: str = "rules", entities: Column | None = None) -> Column:
    words = tx.contains_any(cat.PHI_WORDS)
    if mode == "entities":
        return F.exists(entities, lambda e: F.lower(e["type"]).isin(*cat.PHI_TYPES)) | words
    return words


def encryption_required(text: str) -> Column:
    return F.when(tx.opened((("password", "passwd", "secret", "api", "access"),)),
                  tx.matches(text, cat.CLEARTEXT_SECRET)).otherwise(F.lit(False))


def profanity(text: str) -> Column:
    return F.when(tx.contains_any(cat.PROFANITY), F.arrays_overlap(
        tx.word_tokens(text), F.array(*[F.lit(w) for w in cat.PROFANITY]))).otherwise(F.lit(False))


def flag(context: Column | str, key: str) -> Column:
    return F.coalesce(tx.col(context)[key], F.lit(False))


#: All conditions that `conditions` knows.
NAMES = ("contains_pii", "contains_phi", "contains_card_data", "contains_cvv", "unencrypted_pan", "audit_log_required", "encryption_required",
         "data_retention_exceeded", "unauthorized_access", "data_sale_opt_out", "right_to_delete", "profanity")


def conditions(text: str = "content", context: Column | str | None = None, pii_mode: str = "rules",
               entities: Column | None = None) -> dict[str, Column]:
    """Every known condition as a boolean column (needs `with_gates`)."""
    ctx = {k: flag(context, k) if context is not None else F.lit(False)
           for k in ("data_retention_exceeded", "unauthorized_access")}
    return {
        "contains_pii": contains_pii(text, pii_mode, entities),
        "contains_phi": contains_phi(pii_mode, entities),
        "contains_card_data": contains_card(text),
        "contains_cvv": contains_cvv(text),
        "unencrypted_pan": unencrypted_pan(text),
        "audit_log_required": F.lit(True),
        "encryption_required": encryption_required(text),
        **ctx,
        "data_sale_opt_out": tx.contains_any(cat.OPT_OUT_WORDS),
        "right_to_delete": tx.contains_any(cat.DELETE_WORDS),
        "profanity": profanity(text),
    }


def holding(conds: dict[str, Column]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in conds.items()]).cast("array<string>"))


def ranked_rules(rules: Column) -> Column:
    """Rules by falling priority, stable, each with its `rule_index` in that order."""
    keyed = F.transform(rules, lambda r, i: F.struct(
        (-r["priority"]).alias("a"), i.alias("b"), r.alias("rule")))
    return F.transform(F.array_sort(keyed), lambda k, i: F.struct(
        i.cast("int").alias("rule_index"), k["rule"]["condition"].alias("condition"),
        k["rule"]["action"].alias("action"), k["rule"]["priority"].alias("priority")))


def firing(rules: Column, holding: Column) -> Column:
    """The rules whose condition is among those that hold; unknown conditions never are."""
    return F.filter(rules, lambda r: F.array_contains(holding, r["condition"]))


def allowed(fired: Column) -> Column:
    return ~F.exists(fired, lambda r: r["action"] == "block")


def modified_content(unchanged: Column, fired: Column) -> Column:
    """Last redact or block in evaluation order decides; null when that changes nothing.

    `unchanged` tells that the content already is the redaction text.
    """
    acting = F.filter(fired, lambda r: r["action"].isin("redact", "block"))
    last = F.try_element_at(F.transform(acting, lambda r: r["action"]), F.lit(-1))
    return F.when((last == "redact") & ~unchanged, F.lit(REDACTED))
