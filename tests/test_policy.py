"""Rule order, last-writer redaction, unknown conditions, ownership."""

import json

from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import policy as pf
from screenwell.functions import text as tx
from screenwell.operators import policy

SCHEMA = ("policy_id bigint, user_id bigint, name string, policy_type string, rules_json string, tags_json string, "
          "enabled boolean, version int, created_at string")


def make(spark, *rows):
    out = [(i, u, n, "compliance", json.dumps([dict(zip(("condition", "action", "priority"), r)) for r in rules]), "[]", e, 1,
            f"2024-01-{day:02d}") for i, u, n, rules, e, day in rows]
    df = spark.createDataFrame(out, SCHEMA).withColumn("created_at", F.to_timestamp_ntz("created_at"))
    return policy.decode(df)


def content(spark, *rows):
    return spark.createDataFrame(list(rows), "content_id bigint, user_id bigint, content string")


def test_order_and_modified_content(spark):
    ps = make(spark,
              (1, 7, "A", [("profanity", "flag", 1), ("contains_cvv", "block", 5), ("audit_log_required", "flag", 1)], True, 2),
              (2, 7, "B", [("contains_pii", "redact", 3)], True, 1),
              (3, 7, "Off", [("audit_log_required", "block", 9)], False, 3),
              (4, 8, "Other", [("audit_log_required", "block", 9)], True, 3))
    out = {r["content_id"]: r for r in policy.evaluate(content(
        spark, (1, 7, "cvv: 123 and ssn 123-45-6789"), (2, 7, "cvv 456"), (3, 7, "calm"), (4, 9, "cvv: 123"), (5, 8, "calm")), ps).collect()}
    assert [(v["policy_id"], v["rule_index"], v["action"]) for v in out[1]["violations"]] == [(1, 0, "block"), (1, 2, "flag"), (2, 0, "redact")]
    assert not out[1]["allowed"] and out[1]["modified_content"] == "[REDACTED]"     # later redact wins over block
    assert not out[2]["allowed"] and out[2]["modified_content"] is None
    assert out[3]["allowed"] and out[3]["modified_content"] is None and len(out[3]["violations"]) == 1
    assert out[4]["allowed"] and out[4]["violations"] == []
    assert not out[5]["allowed"]


def test_rule_rank_is_stable(spark):
    ps = make(spark, (1, 1, "A", [("a", "flag", 5), ("b", "flag", 9), ("c", "flag", 5), ("d", "flag", 5)], True, 1))
    rows = policy.rule_rank(ps).orderBy("rule_index").collect()
    assert [r["condition"] for r in rows] == ["b", "a", "c", "d"]


def test_unknown_condition_never_fires(spark):
    ps = make(spark, (1, 1, "A", [("no_such_thing", "block", 5)], True, 1))
    assert policy.evaluate(content(spark, (1, 1, "x")), ps).first()["allowed"]


def test_conditions(spark):
    cases = {
        "contains_pii": ("my passport", "ssn 123-45-6789", "4111 1111 1111 1111"), "contains_phi": ("ICD-10 code", "Patient A"),
        "contains_card_data": ("4111-1111-1111-1111", "1 2 3 4 5 6 7 8 9 0 1 2 3"), "contains_cvv": ("CVV: 123", "security  code 1234"),
        "unencrypted_pan": ("4111111111111111",), "encryption_required": ("password=abcdef", "api-key : zzzzzz"),
        "data_sale_opt_out": ("Opt-Out now",), "right_to_delete": ("please forget me",), "profanity": ("oh Shit!",),
        "audit_log_required": ("anything",),
    }
    rows = [(i, t) for i, t in enumerate([t for ts in cases.values() for t in ts] + ["a shitake dish, masked ****1234"])]
    df = tx.with_gates(spark.createDataFrame(rows, "content_id bigint, content string"))
    got = df.select("content", *[c.alias(n) for n, c in pf.conditions().items()]).collect()
    by_text = {r["content"]: r for r in got}
    for name, ts in cases.items():
        assert all(by_text[t][name] for t in ts), name
    clean = by_text["a shitake dish, masked ****1234"]
    assert [n for n in pf.conditions() if clean[n]] == ["audit_log_required"]


def test_entity_mode(spark):
    df = spark.createDataFrame([(1, "x")], "content_id bigint, content string").withColumn(
        "e", F.expr("array(named_struct('type', 'medical'))"))
    row = tx.with_gates(df).select(pf.contains_pii("content", "entities", F.col("e")).alias("a"),
                                   pf.contains_phi("entities", F.col("e")).alias("b")).first()
    assert row["a"] and row["b"]


def test_templates_and_packs():
    assert set(cat.TEMPLATES) == {"gdpr", "hipaa", "soc2", "pci_dss", "ccpa"}
    assert len(cat.PACKS) == 7


def test_pick_in_request_order(spark):
    ps = make(spark, *[(i, 1, f"P{i}", [("a", "flag", 1)], i != 2, 1) for i in range(5)])
    assert [r["policy_id"] for r in policy.pick(ps, [3, 2, 0]).collect()] == [3, 0]


def test_templates_become_policies(spark):
    ps = {r["template"]: r for r in policy.from_templates(spark).collect()}
    assert [r["action"] for r in ps["pci_dss"]["rules"]] == ["block", "block", "redact", "flag"]
    assert ps["gdpr"]["tags"] == ["gdpr", "compliance", "eu"]


def test_compliance_needs_context(spark):
    df = content(spark, (1, 1, "calm words")).withColumn("ctx", F.expr("map('unauthorized_access', true)"))
    row = policy.compliance_evaluate(df, context="ctx", templates=("hipaa", "gdpr")).first()
    assert [(v["policy_id"], v["condition"]) for v in row["violations"]] == [("hipaa", "unauthorized_access")]
    assert not row["allowed"]
