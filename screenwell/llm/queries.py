"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenwell.llm import (block_lstm, bpe_cuts, decontaminate, license_scan, lm_score, merkle_manifest, quality_rules, secret_ledger, simhash_trie,
                            term_pipeline, token_codes, toxicity_gru, url_filter)
from screenwell.llm.common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(table(spark, sf_dir, "documents"), secret_ledger.fresh_ledger(spark))


def _secret_sql() -> str:
    """Every rule's matches, placed by sums of the match and gap lengths before them."""
    parts = []
    for at, r in enumerate(secret_ledger.RULES):
        regex = r.regex.replace("'", "''")
        if r.kind == "assign":   # letters in either case without Unicode folding
            key = "password|passwd|secret|token|api_?key"
            either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in key)
            regex = regex.replace("(?i)", "").replace(key, either)
        parts.append(f"""
  SELECT doc_id, {at} AS rule, '{r.kind}' AS kind, unnest(list_transform(generate_series(1, len(m)), lambda i: {{
    'e': list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(gap[1:i], lambda x: length(x))),
    'n': length(m[i]), 'g': length(g[i])}})) AS p, {r.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {r.group}) AS g,
    regexp_split_to_array(t, '{regex}') AS gap FROM doc)""")
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(secret_ledger.RULES[:3]))
    names = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secret_ledger.RULES[:3])
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
span AS ({" UNION ALL ".join(parts)}),
ok AS (SELECT doc_id, rule, CAST(p.e - p.n AS BIGINT) AS s,
    kind || ':' || CAST(p.e - p.n AS BIGINT) || ':' || CAST(p.e AS BIGINT) AS x FROM span WHERE p.g >= least),
one AS (SELECT doc_id, {counts}, string_agg(x, ',' ORDER BY s, rule) FILTER (rule < 3) AS base,
    string_agg(x, ',' ORDER BY s, rule) AS spans FROM ok GROUP BY doc_id)
SELECT doc.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN one USING (doc_id)
"""


CHECKS["op2_secret_scan"] = _secret_sql()


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    """The counts by lists in a row, repeated windows by grouping, the thresholds as written."""
    blank = r"[ \t-\r]".replace("\\\\", "\\")
    stops = ", ".join(f"'{w}'" for s in quality_rules.STOPS for w in (s, s.capitalize()))
    limits = " AND ".join(f"{r.part} * 1000 >= {round(r.low * 1000)} * {r.whole} AND "
                          f"{r.part} * 1000 <= {round(r.high * 1000)} * {r.whole}" for r in quality_rules.RULES)
    failed = (f"(n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words)")
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM doc WHERE len(ws) > 2),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM
  (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY doc_id),
counts AS (SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(ws, lambda x: x IN ({stops}))) AS BIGINT) AS n_stops,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM doc LEFT JOIN rep USING (doc_id))
SELECT *, {failed} AS base_failed, NOT {failed} AND {limits} AS kept FROM counts
"""


CHECKS["op4_quality_rules"] = _quality_sql()


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-codes")
    token_codes.write(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json")
    return token_codes.digests(spark, path)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.report(table(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHECKS["op9_decontaminate"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k,
    unnest(list_transform(generate_series(1, len(ws) - least(10, len(ws)) + 1),
      lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS w
  FROM item WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, k, unnest(list_transform(generate_series(1, len(ws) - k + 1),
      lambda i: {'i': i, 'w': array_to_string(ws[i:i + k - 1], ' ')})) AS p
  FROM doc, sizes WHERE len(ws) >= k),
found AS (SELECT doc_id, p.i AS i, win.k AS k, item_id FROM place JOIN win ON place.k = win.k AND p.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM
  (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_cuts.round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_lstm.report(table(spark, sf_dir, "pages"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHECKS["op12_ranked_search"] = r"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM doc WHERE len(ws) > 0),
item AS (SELECT row_number() OVER () AS place, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
asked AS (SELECT place, t, count(*) AS q FROM (SELECT place, unnest(ws) AS t FROM item) GROUP BY place, t),
list AS (SELECT row, t, count(*) AS tf, any_value(n) AS n FROM (SELECT row, len(ws) AS n, unnest(ws) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY row, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM list, size GROUP BY t),
score AS (SELECT place, row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS s
  FROM asked JOIN list USING (t) JOIN weight USING (t), size GROUP BY place, row),
best AS (SELECT place, doc_id, s, row_number() OVER (PARTITION BY place ORDER BY s DESC, doc_id NULLS LAST, row) AS r
  FROM score JOIN doc USING (row) WHERE s > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, s AS score FROM best JOIN item USING (place) WHERE r <= 10
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.report(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """Level by level with plain grouping; up to 16 ** levels rows in a source and 16 ** upper sources."""
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                         for c in merkle_manifest.FIELDS[:-1])
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY {by}r // 16 ORDER BY r ROWS BETWEEN {a} AND {b}), '')"

    def tree(name: str, by: str, height: int) -> list[str]:
        """CTEs: name0 (by, r, n, h) -> name{height}, and the steps name_s{k} of the nodes below level k."""
        out, key = [], f"{by}, " if by else ""
        for k in range(1, height + 1):
            low = f"{name}{k - 1}"
            left = side.format(by=key, a="UNBOUNDED PRECEDING", b="1 PRECEDING")
            right = side.format(by=key, a="1 FOLLOWING", b="UNBOUNDED FOLLOWING")
            out.append(f"{name}_s{k} AS (SELECT {key}r, {left} AS l, {right} AS g FROM {low})")
            out.append(f"{name}{k} AS MATERIALIZED (SELECT {key}r // 16 AS r, max(n) AS n, CASE WHEN max(n) > {16 ** (k - 1)} "
                       f"THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h FROM {low} GROUP BY {key}r // 16)")
        return out

    proof, joins = [], []
    steps = [("t", "d", k) for k in range(1, levels + 1)] + [("u", "v", k) for k in range(1, upper + 1)]
    for name, at, k in steps:
        s, go = f"{name}_s{k}", f"{at}.n > {16 ** (k - 1)}"
        same = f"{s}.source IS NOT DISTINCT FROM d.source AND " if name == "t" else ""
        joins.append(f"LEFT JOIN {s} ON {same}{s}.r = {at}.r // {16 ** (k - 1)}")
        proof.append(f"CASE WHEN {go} THEN {s}.l || {s}.g ELSE '' END")
    folds = []
    for i, (name, _, k) in enumerate(steps, 1):
        n = "n" if name == "t" else "vn"
        folds.append(f"f{i} AS (SELECT *, CASE WHEN {n} > {16 ** (k - 1)} THEN sha256(l{i} || f{i - 1} || g{i}) "
                     f"ELSE f{i - 1} END AS f{i} FROM f{i - 1})")
    sides = ", ".join(f"{n}_s{k}.l AS l{i}, {n}_s{k}.g AS g{i}" for i, (n, _, k) in enumerate(steps, 1))
    final = f"f{len(steps)}"
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
doc AS (SELECT doc_id, source, {fields} AS f, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS code FROM documents, crc),
leaves AS (SELECT doc_id, source, sha256(f || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN code % 5 = 0 THEN sha256(f || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM doc),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
t0 AS (SELECT source, r, n, h FROM d),
{", ".join(tree("t", "source", levels))},
v AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t{levels}),
u0 AS (SELECT r, n, h FROM v),
{", ".join(tree("u", "", upper))},
f0 AS (SELECT d.doc_id, d.h AS leaf, v.h AS subroot, (SELECT h FROM u{upper}) AS root, d.n AS n, v.n AS vn,
    {" || ".join(proof)} AS proof, {sides}, coalesce(d.tampered, d.h) AS f0
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, {final} AS folded_root, {final} = root AS verified FROM {final}
"""


CHECKS["op13_merkle_manifest"] = _merkle_sql()
