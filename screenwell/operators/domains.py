"""Allow lists of domains kept as a table, of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell.functions import exfil
from screenwell.sources import tables as tb


def trusted_hosts(hosts: DataFrame, domains: DataFrame, match: str = "contains") -> DataFrame:
    """Those of `hosts` (host) that the allow list (domain) covers, each once.

    `suffix`: a host meets the list by its own name and those of its parents.  `contains`: by each of its substrings
    that is as long as some domain.  Either is an equi-join, so the list may have any number of rows; a host has at most as many
    keys as characters and lengths.  Null and empty domains cover nothing.
    """
    names = domains.select("domain").filter("domain <> ''").distinct()
    host = F.col("host")
    if match == "suffix":
        labels = F.split(exfil.bare_host(host), r"\.")
        keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    elif match == "contains":
        lengths = sorted(r[0] for r in names.select(F.char_length("domain")).distinct().collect())   # no more than the longest name has characters
        none = F.array().cast("array<string>")
        keys = F.flatten(F.array(*[F.when(F.char_length(host) >= n, _parts(host, n)).otherwise(none) for n in lengths])) if lengths else none
    else:
        raise ValueError(f"unknown match {match!r}")
    met = hosts.select("host").distinct().select("host", F.explode(F.array_distinct(keys)).alias("key"))
    return met.join(names, F.col("key") == F.col("domain"), "left_semi").select("host").distinct()


def _parts(text: Column, n: int) -> Column:
    """All substrings of `n` characters, of a text that has so many."""
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))


def exfil_scan(df: DataFrame, domains: DataFrame, text: str = "content", pii_tier: str = "none", match: str = "contains") -> DataFrame:
    """The exfiltration scan under an allow list in a table: the columns of `df` but the text, and those of the score.

    Texts are read once and stay where they are; hosts of URLs with parameters meet the list, and numbers come back.
    """
    found = tb.materialise(exfil.counted(df.withColumn("_row", F.monotonically_increasing_id()), text, pii_tier, trusted=()).drop(text), "exfil")
    asked = found.select("_row", F.explode(F.filter("url_info", lambda u: u["has_parameters"])).alias("u")).select(
        "_row", F.col("u.domain").alias("host"))
    covered = trusted_hosts(asked, domains, match)
    untrusted = asked.join(covered, "host", "left_anti").groupBy("_row").agg(F.count("*").cast("int").alias("_n"))
    counts = found.join(untrusted, "_row", "left").withColumn("n_untrusted_param_urls", F.coalesce("_n", F.lit(0))).drop("_n", "_row")
    return exfil.without_counts(exfil.combined(counts))
