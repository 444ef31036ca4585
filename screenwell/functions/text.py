"""Text predicates built from Catalyst expressions.

Regexes keep the semantics of the patterns' original dialect by running with
UNIX_LINES and UNICODE_CHARACTER_CLASS, and with white space, word characters and
word boundaries spelt out (`java`).  Java regexes over long texts are the
dominant cost of a scan, so each one stands behind a gate: plain substring
tests on the lower-cased text which must hold for the regex to match at all.
Three letters (long s, dotted and dotless i) match ASCII letters case-blindly
without lower-casing to them; texts holding one skip the gates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat

DIALECT = "(?dU)"
LOWER = "_lower"
UNGATED = "_ungated"
_ODD_LETTERS = ("ſ", "İ", "ı")
_CLASSES = {"\\s": r"\s\x1c-\x1f", "\\w": r"\p{L}\p{N}_"}
_ALONE = {"\\s": r"[\s\x1c-\x1f]", "\\S": r"[^\s\x1c-\x1f]", "\\w": r"[\p{L}\p{N}_]", "\\W": r"[^\p{L}\p{N}_]"}
_W = r"[a-zA-Z0-9_\p{L}\p{N}]"   # ASCII first, where most characters are settled
_NO_WORD_BEFORE, _NO_WORD_AFTER = rf"(?<!{_W})", rf"(?!{_W})"
_EDGE = rf"(?:(?={_W}){_NO_WORD_BEFORE}|(?<={_W}){_NO_WORD_AFTER})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _class_parts(inside: str) -> tuple[str, str]:
    """Word and other members of a character class without its brackets."""
    items = re.findall(r"\\.|.-[^\]]|.", inside, re.S)
    word = [x for x in items if x in ("\\d", "\\w") or (x[0].isalnum() and x[-1].isalnum()) or x == "_"]
    return "".join(word), "".join(x if x[0] == "\\" or x[0].isalnum() else "\\" + x for x in items if x not in word)


def _starts(pattern: str, i: int) -> tuple[str, str, int, bool] | None:
    """What a match of the atom at `i` may begin with: word characters and others (members of a class), the atom's end,
    and whether it may be empty.  None where that is not plain to see."""
    c = pattern[i:i + 1]
    if c == "[":
        end = pattern.find("]", i + 2) + 1
        if pattern[i + 1] == "^" or not end or "[" in pattern[i + 1:end]:
            return None
        word, other = _class_parts(pattern[i + 1:end - 1])
    elif c == "(":
        if pattern[i + 1:i + 2] == "?" and pattern[i + 2:i + 3] != ":":
            return None
        at, word, other = i + (3 if pattern[i + 1:i + 2] == "?" else 1), "", ""
        while True:
            found = _sequence(pattern, at)
            if not found:
                return None
            word, other, depth = word + found[0], other + found[1], 0
            while depth or pattern[at] not in "|)":   # to the end of this alternative
                if pattern[at] == "[":
                    at = pattern.find("]", at + 2)
                depth += (pattern[at] == "(") - (pattern[at] == ")")
                at += 2 if pattern[at] == "\\" else 1
            at += 1
            if pattern[at - 1] == ")":
                break
        end = at
    elif c == "\\":
        end, two = i + 2, pattern[i:i + 2]
        if two in ("\\d", "\\w"):
            word, other = two, ""
        elif two[1:].isalnum():
            return None
        else:
            word, other = "", two
    elif c.isalnum():
        word, other, end = c, "", i + 1
    else:
        return None
    return word, other, end, pattern[end:end + 1] in ("?", "*") or pattern.startswith(("{0,", "{0}"), end)


def _sequence(pattern: str, i: int) -> tuple[str, str] | None:
    """What a match of the pattern from `i` on may begin with, past atoms that may be empty."""
    word = other = ""
    while True:
        found = _starts(pattern, i)
        if not found:
            return None
        word, other = word + found[0], other + found[1]
        if not found[3]:
            return word, other
        i = found[2] + 1
        if pattern[i - 1] == "{":
            return None


def _edge_before(pattern: str, i: int) -> str:
    """The boundary in front of position `i`: the next character is settled first, as it rules out most places."""
    found = _sequence(pattern, i)
    if not found:
        return _EDGE
    word, other = (re.sub(r"\\w", r"\\p{L}\\p{N}_", x) for x in found)
    sides = ([f"(?=[{word}]){_NO_WORD_BEFORE}"] if word else []) + ([f"(?=[{other}])(?<={_W})"] if other else [])
    return sides[0] if len(sides) == 1 else "(?:" + "|".join(sides) + ")"


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """The pattern for Java: its white space lacks four separators, and its word characters include marks."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] != "\\" or len(two) < 2:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
        if two == "\\b" and not inside:
            before = pattern[i - 3:i - 2]
            literal = before.isalnum() and pattern[i - 4:i - 3] != "\\"
            out.append(_NO_WORD_AFTER if literal else _edge_before(pattern, i))
        else:
            out.append((_CLASSES if inside else _ALONE).get(two, two))
    return DIALECT + "".join(out)


def rx(pattern: str) -> Column:
    """Pattern literal in the dialect of the catalogue."""
    return F.lit(java(pattern))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def with_gates(df: DataFrame, text: str = "content") -> DataFrame:
    """Add the two helper columns the gated predicates read.

    They are projected once; Catalyst does not inline an expression this costly
    into the many predicates above it.
    """
    return df.withColumn(LOWER, F.lower(text)).withColumn(
        UNGATED, any_of(F.col(text).contains(x) for x in _ODD_LETTERS))


def without_gates(df: DataFrame) -> DataFrame:
    return df.drop(LOWER, UNGATED)


def pin(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are computed here and nowhere else.

    A later filter on something derived from them would be pushed down by
    substituting their expressions, once per use; over a few dozen regexes that
    makes plans explode.  Predicates do not pass the one-row generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def gate(name: str) -> Column:
    """True where the named pattern can match (needs `with_gates`)."""
    groups = cat.GATES.get(name)
    if not groups:
        return F.lit(True)
    return opened(groups)


def opened(groups: Sequence[Sequence[str]]) -> Column:
    """At least one word of every group occurs, or the text skips the gates."""
    return F.expr(f"{UNGATED} OR (" + " AND ".join(f"({_either(g)})" for g in groups) + ")")


def _has(word: str) -> str:
    return f"contains({LOWER}, r'{word}')"


def _either(words: Sequence[str]) -> str:
    return " OR ".join(map(_has, words))


def matches(text: Column | str, pattern: str) -> Column:
    return F.rlike(col(text), rx(pattern))


def count_matches(text: Column | str, pattern: str, when: Column | None = None) -> Column:
    """Number of non-overlapping matches; the regex runs only where `when` holds."""
    n = F.regexp_count(col(text), rx(pattern))
    return n if when is None else F.when(when, n).otherwise(F.lit(0))


def gated_count(text: Column | str, p: cat.Pattern) -> Column:
    return count_matches(text, p.regex, gate(p.name))


def contains_any(words: Sequence[str]) -> Column:
    """One of the words occurs (this and the next two need `with_gates`)."""
    return F.expr(_either(words))


def count_contained(words: Sequence[str]) -> Column:
    """How many of the words occur at least once."""
    return F.expr(" + ".join(f"int({_has(w)})" for w in words))


def contained(words: Sequence[str]) -> Column:
    """The words that occur, in list order."""
    return F.expr("array_compact(array(" + ", ".join(f"if({_has(w)}, r'{w}', null)" for w in words) + "))")


def worst_weight(prefix: str, patterns: Sequence[cat.Pattern]) -> Column:
    """Highest weight among patterns whose count column is positive, else 0."""
    cases = ", ".join(f"if({prefix}{p.name} > 0, {p.weight!r}D, 0D)" for p in patterns)
    return F.expr(f"greatest(0D, {cases})")


def ladder(score: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """First label whose lower bound the score reaches; a None bound is the default."""
    *bounded, (_, default) = steps
    first, *rest = bounded
    out = F.when(score >= F.lit(first[0]), F.lit(first[1]))
    for bound, label in rest:
        out = out.when(score >= F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(default))


def word_tokens(text: Column | str) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), F.lit(0)))


def content_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text).cast("binary"), 256), 1, 16)


def preview(text: Column, limit: int, ellipsis: str = "") -> Column:
    """First `limit` characters, marked when something was cut."""
    cut = F.substring(text, 1, limit)
    if not ellipsis:
        return cut
    return F.when(F.char_length(text) > limit, F.concat(cut, F.lit(ellipsis))).otherwise(text)
