"""License scan by ordered signature rules.

A text's words (`common.words`) are joined by single blanks and read by the rules of `license_rules` whose keyword
is among the words.  Overlaps are settled by intervals: a detection that lies inside another one of the same or a
better priority is suppressed; of equal intervals with equal priority the earlier rule stays.  Partly overlapping
detections both stay.  Three base phrases are always looked for and never suppressed.

Edge cases.  Null and empty texts have no words, no places and score 0.  Repeated documents give a row each, an empty
table no rows, and other columns of the input are not read.  Cost is linear in the text for each rule let through
and n log n in the detections; one text is held at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import map_rows, words
from screenwell.llm.license_rules import Rule, load

#: Fixed phrases and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))
#: Belief that a text carries a label found with this priority, and for a base phrase.
WEIGHTS = {1: 0.95, 2: 0.9, 3: 0.8, 4: 0.75, 5: 0.6, 6: 0.3}
BASE_WEIGHT = 0.5

_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("detections", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("score", T.DoubleType()),
]


def resolve(found: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Those of (start, end, priority, rule) not inside one of the same or a better priority, by start."""
    reach = dict.fromkeys(sorted({f[2] for f in found}), -1)
    kept = []
    for start, end, priority, rule in sorted(found, key=lambda f: (f[0], -f[1], f[2], f[3])):
        if all(end > far for p, far in reach.items() if p <= priority):
            kept.append((start, end, priority, rule))
            reach[priority] = max(reach[priority], end)
    return kept


class Scanner:
    """The rules by keyword; one is made per task."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = list(rules)
        self.by_word: dict[bytes, list[int]] = {}
        for at, rule in enumerate(rules):
            self.by_word.setdefault(rule.keyword, []).append(at)

    def __call__(self, text: str | None) -> tuple:
        ws = words(text)
        have = set(ws)
        flat = b" " + b" ".join(ws) + b" "
        base = []
        for phrase, label in BASE:
            if have.issuperset(phrase.split()):
                at = flat.find(b" " + phrase + b" ")
                while at >= 0:
                    base.append((at, label))
                    at = flat.find(b" " + phrase + b" ", at + 1)
        found = [(*m.span(), self.rules[r].priority, r) for w in self.by_word.keys() & have
                 for r in self.by_word[w] for m in self.rules[r].regex.finditer(flat)]
        kept = resolve(found)
        index = word_index(flat, sorted({x for x, _ in base} | {x for f in kept for x in f[:2]}))
        doubt = 1.0
        best = {}
        for _, _, priority, r in kept:
            label = self.rules[r].label
            best[label] = max(best.get(label, 0), WEIGHTS[priority])
        for weight in (*best.values(), *[BASE_WEIGHT for _ in {label for _, label in base}]):
            doubt *= 1 - weight
        return (len(ws), [{"label": label, "word": index[at]} for at, label in sorted(base)],
                [{"label": self.rules[r].label, "priority": p, "start": index[a], "end": index[b]}
                 for a, b, p, r in kept], 1.0 - doubt)


def word_index(flat: bytes, places: Sequence[int]) -> dict[int, int]:
    """Number of the word that begins at (or behind the blank at) each of the ascending places; ends are exclusive."""
    out, count, done = {}, 0, 0
    for at in places:
        count += flat.count(b" ", done, at)
        done = at
        out[at] = count - 1 if flat[at:at + 1] != b" " else count
    return out


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per document: n_words, base (label, word), detections (label, priority, start and end word), score."""
    chosen = list(load() if rules is None else rules)

    def make():
        scanner = Scanner(chosen)
        return lambda texts: map(scanner, texts)

    df = documents.select(F.col(key), F.col(text).alias("scanned text"))
    return map_rows(df, _FOUND, make, [key])


def report(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with counts, places and labels as strings."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("base", lambda x: x["label"])
    places = F.transform("base", lambda x: x["word"])
    return scan(documents, key, text).select(
        key, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"), "score")
