r"""Secret scan with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger is a Parquet folder that is only
appended to; a row holds a blob, the rule versions it was read with, and what they found.  A run subtracts the
ledger from the blobs it sees, fetches one text for each blob that lacks a rule version, reads it with the
missing rules only, appends, and joins the ledger's findings back to all paths of the blob.

Spans are code points, end exclusive; matches of one rule are leftmost and do not overlap.  They are placed by running
sums over match and gap lengths, n log n in the matches of a text.

Size.  Texts are moved once, for unseen blobs; copies are reduced to a hash first.  Only blobs with findings
are joined to the paths, by shuffle, where adaptive execution splits a blob that many paths share.

Edge cases.  A null text counts as empty; it has no findings.  Null keys are allowed, repeated rows give a row each.
An empty table leaves an empty batch in the ledger and gives no rows.  Other columns are not read by `scan`;
`redact` passes them through.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwell.functions.arrays import bind, blocks, cut, running, running_sum
from screenwell.functions.text import pin
from screenwell.llm.common import free_name, named, parted, recount, shared_folder, written


class Rule(NamedTuple):
    """A regex, a version to raise when it changes, literals one of which every match holds, a length of a group."""

    kind: str
    regex: str
    version: int = 1
    literals: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", literals=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
    # To the END line; without one, as far as letters of a key go.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/= \t\r\n:,.-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
         r"|[A-Za-z0-9+/= \t\r\n]*)", version=2, literals=("PRIVATE KEY-----",)),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", literals=("xox",)),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", literals=("AIza",)),
    Rule("pay_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", literals=("k_live_", "k_test_")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", literals=("eyJ",)),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/@]{1,128}@", literals=("://",)),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}", literals=("earer ",)),
)
SPAN = "struct<start:int,rule:int,end:int>"
FINDING = "struct<id:string,start:int,end:int>"
_LEDGER = f"blob string, scanned array<string>, findings array<{FINDING}>"


def matches(text: Column, rule: Rule) -> Column:
    """Starts and ends of a rule's matches; the regex runs again only where it matches at all."""
    regex = F.lit(rule.regex)
    gate = F.rlike(text, regex)
    for has in rule.literals[:1]:
        any_literal = text.contains(has)
        for other in rule.literals[1:]:
            any_literal = any_literal | text.contains(other)
        gate = any_literal & gate
    parts = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("g"),
                     F.split(text, rule.regex, -1).alias("gap"))

    def place(p):
        reach = running_sum(F.zip_with(p["m"], F.slice(p["gap"], F.lit(1), F.size(p["m"])),
                                       lambda m, g: (F.char_length(m) + F.char_length(g)).cast("long")))
        spans = F.zip_with(reach, p["m"], lambda end, m: F.struct(
            F.lit(rule.id).alias("id"), (end - F.char_length(m)).cast("int").alias("start"), end.cast("int").alias("end")))
        if rule.least == 1:
            return spans
        long_enough = F.zip_with(spans, p["g"], lambda s, g: F.when(F.char_length(g) >= rule.least, s))
        return F.array_compact(long_enough)

    none = F.array().cast(f"array<{FINDING}>")
    return F.when(gate, bind(parts, place)).otherwise(none)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where there is no ledger yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def addressed(paths: DataFrame, key: str, text: str) -> DataFrame:
    return paths.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("text")).withColumn(
        "blob", F.sha2("text", 256))


def update(paths: DataFrame, ledger_path: str, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Bring the ledger up to date; gives (key, blob) of every path."""
    spark = paths.sparkSession
    texts = addressed(paths, key, text)
    index = written(texts.select("key", "blob"), "blobs")
    done = ledger(spark, ledger_path).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("scanned"))
    wanted = F.array(*[F.lit(r.id) for r in rules])
    todo = F.array_except(wanted, F.coalesce("scanned", F.array().cast("array<string>")))
    unseen = (index.groupBy("blob").agg(F.min("key").alias("at")).join(done, "blob", "left")
              .select("at", F.col("blob").alias("unseen"), todo.alias("todo")).filter(F.size("todo") > 0))
    # A text is fetched by its hash and a key that holds it, so neither null keys nor copies meet in one task.
    fetched = texts.join(unseen.hint("shuffle_hash"), texts["key"].eqNullSafe(unseen["at"]) & (
        F.col("blob") == F.col("unseen"))).select("blob", "todo", "text")
    found = [F.when(F.array_contains("todo", r.id), matches(F.col("text"), r)).otherwise(
        F.array().cast(f"array<{FINDING}>")) for r in rules]
    (fetched.select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("findings"))
     .dropDuplicates(["blob"]).write.mode("append").parquet(ledger_path))
    return index


def blob_findings(spark: SparkSession, ledger_path: str, rules: Sequence[Rule]) -> DataFrame:
    """blob, spans (start, rule's place in `rules`, end; by start, then rule): blobs with findings of these rules."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    rows = ledger(spark, ledger_path).filter(F.size("findings") > 0)
    one = rows.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("f"))
    current = F.filter("f", lambda x: F.array_contains(ids, x["id"]))
    spans = F.array_sort(F.array_distinct(F.transform(current, lambda x: F.struct(
        x["start"].alias("start"), (F.array_position(ids, x["id"]) - 1).cast("int").alias("rule"), x["end"].alias("end")))))
    return written(one.select("blob", spans.cast(f"array<{SPAN}>").alias("spans")), "findings")


def scan(paths: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text",
         rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per path: key and spans, after the ledger was brought up to date."""
    index = update(paths, ledger_path, key, text, rules)
    found = blob_findings(paths.sparkSession, ledger_path, rules)
    return index.join(found, "blob", "left").select(
        F.col("key").alias(key), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def report(paths: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text",
           rules: Sequence[Rule] = RULES, base: int = 3) -> DataFrame:
    """Per path: counts of the first `base` rules, the digest of their spans, and all spans as a string."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    own = F.filter("spans", lambda s: s["rule"] < base)
    return scan(paths, ledger_path, key, text, rules).select(
        key, *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text",
           rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns of `documents`, with secrets replaced by `[REDACTED:kind]`; n_chars, if there, follows.

    Spans that overlap are one piece, named by the first of them.  Null texts stay null.
    """
    blob, spans = free_name(documents, "blob"), free_name(documents, "spans")
    update(documents, ledger_path, key, text, rules)
    found = blob_findings(documents.sparkSession, ledger_path, rules).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans))
    df = documents.withColumn(blob, F.sha2(F.coalesce(named(text), F.lit("")), 256))
    clean, perhaps = parted(df, blob, found, blob)   # texts without findings are not moved again
    new, order = free_name(df, "new_text"), [named(c) for c in documents.columns]
    out = pin(perhaps.join(found, blob, "left"), F.when(
        named(text).isNotNull() & (F.size(spans) > 0), replaced(named(text), F.col(spans), rules)).otherwise(named(text)).alias(new))
    changed = out.select(*[F.col(new).alias(c) if c == text else named(c) for c in documents.columns])
    return recount(clean.select(*order).union(changed), text)


def replaced(text: Column, spans: Column, rules: Sequence[Rule]) -> Column:
    """The text with sorted spans replaced; pieces come from blocks of it, so long texts are not walked again."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def merged(s):
        """Disjoint spans: one opens where no earlier span reaches, and ends where the reach before the next is."""
        reach = running(F.transform(s, lambda x: x["end"].cast("long")), lambda a, b: F.greatest(a, b))

        def join(r):
            opens = F.array_compact(F.transform(s, lambda x, i: F.when(
                (i == 0) | (x["start"] >= F.get(r, i - 1)), i)))
            return bind(opens, lambda o: F.transform(o, lambda i, k: F.struct(
                F.get(s, i)["start"].alias("start"), F.get(s, i)["rule"].alias("rule"),
                F.get(r, F.coalesce(F.get(o, k + 1), F.size(s)) - 1).cast("int").alias("end"))))

        return bind(reach, join)

    def pieces(parts, m):
        before = F.transform(m, lambda x, i: F.concat(
            cut(parts, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)),
                x["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))),
            F.lit("[REDACTED:"), F.get(kinds, x["rule"]), F.lit("]")))
        done = F.try_element_at(m, F.lit(-1))["end"]
        return F.concat(F.array_join(before, ""), cut(parts, done, F.char_length(text) - done))

    return bind(spans, lambda s: bind(merged(s), lambda m: bind(blocks(text), lambda parts: pieces(parts, m))))


def fresh_ledger(spark: SparkSession) -> str:
    """The name of a ledger that does not exist yet, in the shared folder."""
    return shared_folder(spark, "secret-ledger")
