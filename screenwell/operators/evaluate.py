"""Detectors against labelled data: scenarios and document labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import pii
from screenwell.functions import text as tx
from screenwell.operators import scan

ANALYSED = ("prompt_injection", "jailbreak", "data_exfiltration", "credential_exfiltration")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(cat.SCENARIOS), "id string, name string, category string, test_input string, expected_threat string, "
                             "expected_severity string, should_block boolean, context_type string")


def select_scenarios(df: DataFrame, ids: list[str] | None = None, category: str | None = None) -> DataFrame:
    """By id list, else by category, else all."""
    if ids is not None:
        return df.filter(F.col("id").isin(ids))
    return df if category is None else df.filter(F.col("category") == category)


def evaluate(df: DataFrame, toxicity: Column | None = None) -> DataFrame:
    """Run the scans over labelled rows and compare with the expectation of their category.

    Attacks pass when the expected threat is found and blocking (risk >= 0.5)
    agrees; personal data passes when any is found; toxicity when the score
    (0 without a model) reaches 0.7 exactly where it should block; everything
    else when it is safe and free of threats.
    """
    analysed = scan.security_analyze(df, "test_input")
    kinds = F.transform("threats", lambda t: t["threat_type"])
    n_pii = sum(pii.counts("test_input")[1:], pii.counts("test_input")[0])
    counted = tx.without_gates(tx.with_gates(analysed, "test_input").withColumn("n_pii", n_pii))
    attack = F.col("category").isin(*ANALYSED)
    found = F.when(F.col("expected_threat").isNull(), F.size("threats") == 0).otherwise(
        F.array_contains(kinds, F.col("expected_threat")))
    blocked = F.col("risk_score") >= F.lit(0.5)
    tox = toxicity if toxicity is not None else F.lit(0.0)
    passed = (F.when(attack, found & (blocked == F.col("should_block")))
              .when(F.col("category") == "pii_detection", F.col("n_pii") > 0)
              .when(F.col("category") == "toxicity", (tox >= F.lit(0.7)) == F.col("should_block"))
              .otherwise(F.col("is_safe") & (F.size("threats") == 0)))
    return counted.withColumn("threat_types", F.concat_ws(",", kinds)).withColumn("blocked", blocked).withColumn(
        "passed", passed)


def run_summary(evaluated: DataFrame, *by: str) -> DataFrame:
    return evaluated.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"),
                                      F.count_if(~F.col("passed")).alias("failed"))


def categories(df: DataFrame) -> DataFrame:
    """Rows per category and the distinct scenarios in it.

    Distinct (id, name) pairs come from the fixed scenario list, so the set stays small.
    """
    return df.groupBy("category").agg(
        F.count("*").alias("count"), F.sort_array(F.collect_set(F.struct("id", "name"))).alias("scenarios"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
            F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")]


def label_evaluate(content: DataFrame, labels: DataFrame, detector: Callable[[DataFrame], DataFrame],
                   predicted: Column, actual: Column, key: str = "doc_id") -> DataFrame:
    """Confusion counts, precision and recall of a detector against labels.

    Labels are joined first, so only labelled texts are scanned.
    """
    c = detector(content.join(labels, key)).agg(*confusion(predicted, actual))
    return c.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn(
        "recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))
