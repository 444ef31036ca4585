"""Policies over content: one join on the owner, everything else inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import policy as pf
from screenwell.functions import text as tx
from screenwell.sources import tables as tb


def decode(policies: DataFrame) -> DataFrame:
    """Stored policies with their JSON rules and tags decoded."""
    return policies.withColumn("rules", tb.json_rules(F.col("rules_json"))).withColumn(
        "tags", tb.json_tags(F.col("tags_json")))


def rule_rank(policies: DataFrame) -> DataFrame:
    """One row per rule with its index in evaluation order.

    The rules live in the policy's own row, so ranking needs no shuffle.
    """
    return policies.select("policy_id", F.inline(pf.ranked_rules(F.col("rules"))))


def rules_by_user(policies: DataFrame) -> DataFrame:
    """Per user the rules of all enabled policies, in evaluation order: the newest policy first.

    A column `request_ord`, where there is one, sets the order of policies instead.
    The list is one owner's own policies, as every evaluation of that owner needs them.
    """
    order = [F.col("request_ord")] if "request_ord" in policies.columns else [F.desc("created_at"), F.desc("policy_id")]
    newest = Window.partitionBy("user_id").orderBy(*order)
    kept = policies.filter("enabled").withColumn("policy_ord", F.row_number().over(newest))
    ranked = F.transform(pf.ranked_rules(F.col("rules")), lambda r: F.struct(
        F.col("policy_ord").alias("policy_ord"), r["rule_index"].alias("rule_index"),
        F.col("policy_id").alias("policy_id"), F.col("name").alias("policy_name"),
        r["condition"].alias("condition"), r["action"].alias("action")))
    return kept.groupBy("user_id").agg(F.array_sort(F.flatten(F.collect_list(ranked))).alias("rules"))


def evaluate(content: DataFrame, policies: DataFrame, text: str = "content", context: Column | str | None = None,
             requested: DataFrame | None = None, pii_mode: str = "rules", entities: Column | None = None) -> DataFrame:
    """Violations, verdict and modified content of every row under its owner's policies.

    Rows whose owner has no policy are allowed.  With `requested` (user_id, policy_id, request_ord) only the policies that an owner asks
    for count, in that order; those of another owner do not.  With `pii_mode` "entities" personal data are the
    spans of `entities`.  Each side is reduced before they meet: content to the names of the conditions that hold (the text itself
    need not travel), policies to one row per owner.  Only conditions that some rule names are
    worked out.  A busy owner skews only the content side, which Spark splits.
    """
    if requested is not None:
        policies = pick_from(policies, requested)
    checked = _checked(content, text, context, named_conditions(policies), pii_mode, entities)
    return _verdict(checked.join(rules_by_user(policies), "user_id", "left"))


def named_conditions(policies: DataFrame) -> set[str]:
    """The known conditions that rules of enabled policies name: at most one row for each of them comes to the driver."""
    names = policies.filter("enabled").select(F.explode("rules.condition").alias("c")).filter(F.col("c").isin(*pf.NAMES)).distinct()
    return {r["c"] for r in names.collect()}


def _checked(content: DataFrame, text: str, context: Column | str | None, names: set[str], pii_mode: str = "rules",
             entities: Column | None = None) -> DataFrame:
    gated = tx.with_gates(content, text)
    wanted = {k: v for k, v in pf.conditions(text, context, pii_mode, entities).items() if k in names}
    return tx.without_gates(tx.pin(gated, pf.holding(wanted).alias("holding"), (F.col(text) == pf.REDACTED).alias("_same")))


def _verdict(df: DataFrame) -> DataFrame:
    none = F.array().cast(df.schema["rules"].dataType)
    fired = pf.firing(F.coalesce("rules", none), F.col("holding"))
    return (df.withColumn("violations", fired)
            .withColumn("allowed", pf.allowed(F.col("violations")))
            .withColumn("modified_content", pf.modified_content(F.col("_same"), F.col("violations")))
            .drop("rules", "holding", "_same"))


def violations(evaluated: DataFrame) -> DataFrame:
    """One row per fired rule."""
    return evaluated.select("content_id", F.inline("violations"))


def template_rules(templates: Sequence[str] = tuple(cat.TEMPLATES)) -> Column:
    """Rules of the built-in compliance templates as an array literal."""
    out = []
    for t_ord, key in enumerate(templates):
        name, rules, _ = cat.TEMPLATES[key]
        ranked = sorted(rules, key=lambda r: -r[2])
        out += [F.struct(F.lit(t_ord).alias("policy_ord"), F.lit(i).alias("rule_index"),
                         F.lit(key).alias("policy_id"), F.lit(name).alias("policy_name"),
                         F.lit(c).alias("condition"), F.lit(a).alias("action"))
                for i, (c, a, _) in enumerate(ranked)]
    return F.array(*out)


def compliance_evaluate(content: DataFrame, text: str = "content", context: Column | str | None = None,
                        templates: Sequence[str] = tuple(cat.TEMPLATES)) -> DataFrame:
    """Every content row against the built-in templates; no join at all."""
    names = {condition for key in templates for condition, _, _ in cat.TEMPLATES[key][1]}
    return _verdict(_checked(content, text, context, names).withColumn("rules", template_rules(templates)))


def pick(policies: DataFrame, ids: Sequence[int], user_id: int | None = None) -> DataFrame:
    """Requested enabled policies, in request order."""
    order = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("policy_id"))
    out = policies.filter(F.col("policy_id").isin(list(ids)) & F.col("enabled"))
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    return out.withColumn("request_ord", order).orderBy("request_ord")


def pick_from(policies: DataFrame, requested: DataFrame) -> DataFrame:
    """Enabled policies that their own user requests, where requests come as a table (user_id, policy_id, request_ord).

    What is requested by another user is left out.  `evaluate` takes the result: it follows `request_ord`.
    """
    return policies.filter("enabled").join(requested, ["user_id", "policy_id"])


def from_templates(spark: SparkSession) -> DataFrame:
    rows = [(k, n, [dict(zip(("condition", "action", "priority"), r)) for r in rules], list(tags))
            for k, (n, rules, tags) in cat.TEMPLATES.items()]
    return spark.createDataFrame(rows, f"template string, name string, rules {tb.RULE_SCHEMA}, tags array<string>")
