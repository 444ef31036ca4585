"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

Words are runs of other characters than blank and tab to carriage return.  `RULES` bounds ratios of counts; a row
passes a rule when `low <= value <= high`.  Rules that measure words apply to texts that have any.

Counts: word_chars (code points in words), n_symbols, n_upper (A-Z), n_stops (stop words of four languages),
n_lines (with a word), n_dup_lines (equal to an earlier line), n_repeat_words (words in three-word windows that
occur twice or more, the first included).  Windows are compared by 64-bit hashes of their three words.

Edge cases.  A null or empty text has no words, fails and is not kept.  Repeated documents give a row each, an empty
table no rows.  Result columns replace none of the input: `measure` gives the key and results only, and `keep`
returns the input's own columns.  Time in one text is n log n.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell.functions.arrays import bind
from screenwell.functions.text import pin
from screenwell.llm.common import named

BLANK = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
#: Percent of words in repeated windows that fails a text.
MAX_REPEAT = 50
STOPS = ("the and of to in is that for with as are was it on be by this from at or an "
         "der die und das von mit den auf ist im ein eine für als auch dem des zu sich nicht "
         "le la les de des et en un une du que qui dans pour est par au sur pas se "
         "el los las del y es por con una su para lo al se como").split()


class Limit(NamedTuple):
    """`low <= part / whole <= high`."""

    name: str
    part: str
    whole: str
    low: float
    high: float


#: Wide enough that plain prose of any of the languages passes.
RULES = (
    Limit("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Limit("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Limit("upper_per_char", "n_upper", "word_chars", 0.0, 0.4),
    Limit("stop_words", "n_stops", "n_words", 0.02, 1.0),
    Limit("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Limit("repeated_words", "n_repeat_words", "n_words", 0.0, 0.4),
)


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the windows' hashes in order."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        same = lambda j: F.get(s, j)["h"]
        return F.array_sort(F.array_compact(F.transform(s, lambda x, j: F.when(
            F.coalesce(x["h"] == same(j - 1), F.lit(False)) | F.coalesce(x["h"] == same(j + 1), F.lit(False)), x["i"]))))

    def covered(at):
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        bind(by_hash, lambda s: bind(places(s), covered)))


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """`df` (which has no columns called like the counts) with the counts of `text`."""
    t = F.coalesce(F.col(text), F.lit(""))
    ws = F.array_remove(F.split(t, BLANK + "+"), "")
    df = pin(df, ws.alias("ws"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANK[1:-1]}]")).alias("lines"))
    windows = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 2, F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(w, F.get("ws", i + 1), F.get("ws", i + 2)))
    df = pin(df, hashes.alias("hashes"))
    lost = lambda pattern: (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))).cast("long")
    stops = [*STOPS, *[w.capitalize() for w in STOPS]]
    return pin(
        df, F.size("ws").cast("long").alias("n_words"), F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        lost("[#*$%&|<>]+").alias("n_symbols"), lost("[A-Z]+").alias("n_upper"),
        F.size(F.filter("ws", lambda w: w.isin(stops))).cast("long").alias("n_stops"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("hashes")).alias("n_repeat_words")).drop("ws", "lines", "hashes")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def passes(rules: Sequence[Limit] = RULES) -> Column:
    """The table as one condition over the counts; integers are compared, so nothing is rounded."""
    out = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 1000, F.col(r.whole)
        out = out & (part >= round(r.low * 1000) * whole) & (part <= round(r.high * 1000) * whole)
    return out


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Limit] = RULES) -> DataFrame:
    """Per document: counts, base_failed and kept."""
    df = with_counts(documents.select(named(key).alias("key"), named(text).alias("text")), "text").drop("text")
    return df.withColumnRenamed("key", key).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~base_failed() & passes(rules))


def keep(documents: DataFrame, text: str = "text", rules: Sequence[Limit] = RULES) -> DataFrame:
    """Documents that pass, with their own columns."""
    packed = documents.select(F.struct(*[named(c) for c in documents.columns]).alias("row"),
                              named(text).alias("text"))
    return with_counts(packed, "text").filter(~base_failed() & passes(rules)).select("row.*")
