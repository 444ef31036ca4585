"""Benchmark decontamination with a generalised suffix automaton over item words.

A window is `size` consecutive words of an item, or the whole item when it has fewer (but some).  The automaton of
all items reads a document's words once and knows after each the longest matching suffix; that tells every window
ending there.  Words are as in `common.words`.

Edge cases.  A null or empty text has no words and no hit; an item without words has no window.  Items of null id
mark words but are not counted or listed.  Repeated items and ids count once; repeated documents give a row each.
An empty benchmark hits nothing; an empty document table gives no rows.  Columns of the input that are called like
results are not read.

Size.  Items are packed into automata of at most `shard_words` words, which bounds what is broadcast and what a task
holds.  A benchmark that needs more than one automaton costs a pass over the documents for each; found spans
and ids are carried along with the rows, so no pass shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import ALNUM, free_name, map_rows, named, recount, words, written

SIZE = 10
SHARD_WORDS = 200_000
MAX_COVERAGE = 0.8
_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], size: int = SIZE) -> None:
        self.size = size
        self.word_ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ids: list[str | None] = []
        sequences = []
        for item, ws in items:
            if ws:
                self.ids.append(item)
                sequences.append([self.word_ids.setdefault(w, len(self.word_ids)) for w in ws])
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._mark(sequences)

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            return self._fit(last, w)
        new = self._state({}, -1, length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        link[new] = 0 if p < 0 else self._fit(p, w)
        return new

    def _fit(self, p: int, w: int) -> int:
        """The state of p's longest word sequence followed by w, cut off its state when that holds longer ones."""
        step, link, length = self.step, self.link, self.length
        q = step[p][w]
        if length[q] == length[p] + 1:
            return q
        twin = self._state(dict(step[q]), link[q], length[p] + 1)
        link[q] = twin
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = twin
            p = link[p]
        return twin

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _mark(self, sequences: list[list[int]]) -> None:
        """`windows[s]`: (words, item numbers) of the windows that end where state s is reached, its own last."""
        own: dict[int, dict[int, set[int]]] = {}
        for number, seq in enumerate(sequences):
            k, state = min(self.size, len(seq)), 0
            for at, w in enumerate(seq):
                state = self.step[state][w]
                if at + 1 >= k:
                    while self.length[self.link[state]] >= k:
                        state = self.link[state]
                    own.setdefault(state, {}).setdefault(k, set()).add(number)
        self.windows: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            here = tuple((k, tuple(sorted(n))) for k, n in sorted(own.get(s, {}).items()))
            self.windows[s] = self.windows[self.link[s]] + here

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (merged, ascending) that lie inside windows, and the numbers of their items."""
        step, link, length, windows = self.step, self.link, self.length, self.windows
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        state = matched = 0
        for at, w in enumerate(map(self.word_ids.get, ws)):
            if w is None:
                state = matched = 0
                continue
            while w not in step[state]:
                state = link[state]
                if state < 0:
                    break
                matched = length[state]
            if state < 0:
                state = matched = 0
                continue
            state = step[state][w]
            matched += 1
            for k, numbers in windows[state]:
                if k <= matched:
                    items.update(numbers)
                    start = at + 1 - k
                    while found and found[-1][1] >= start:
                        start = min(start, found.pop()[0])
                    found.append((start, at + 1))
        return found, items


def shards(benchmark: DataFrame, item: str, text: str, size: int, shard_words: int) -> Iterator[Automaton]:
    """Automata over all items, none built from more than `shard_words` words (or from more than one item)."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator()
    pack, held = [], 0
    for row in rows:
        ws = words(row["t"])
        if pack and held + len(ws) > shard_words:
            yield Automaton(pack, size)
            pack, held = [], 0
        pack.append((row["i"], ws))
        held += len(ws)
    yield Automaton(pack, size)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
          T.StructField("items", T.ArrayType(T.StringType()))]


def find(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = SIZE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: key, n_words, spans (starts and ends of hit word ranges in turn), items (their ids, sorted)."""
    spark = documents.sparkSession
    df = documents.select(named(key).alias("key"), named(text).alias("text"))
    frame = df.withColumns({"spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    automata = shards(benchmark, item, item_text, size, shard_words)
    automaton = next(automata)
    while automaton is not None:
        following = next(automata, None)
        held = spark.sparkContext.broadcast(automaton)

        def make(held=held):
            auto = held.value

            def scan(texts, spans, items):
                for t, s, i in zip(texts, spans, items):
                    ws = words(t)
                    got, numbers = auto.spans(ws)
                    if s:
                        got = merged([*got, *zip(s[::2], s[1::2])])
                    ids = {auto.ids[n] for n in numbers} - {None}
                    yield len(ws), [x for span in got for x in span], sorted(ids.union(i))

            return scan

        if following is None:
            return map_rows(frame, _FOUND, make, ["key"]).withColumnRenamed("key", key)
        frame = written(map_rows(frame.withColumn("whole", F.col("text")), _FOUND[1:], make_pair(make),
                                 ["key", "whole"]).withColumnRenamed("whole", "text"), "decontaminate")
        automaton = following
    raise AssertionError("shards gives one automaton at least")


def make_pair(make):
    """The scan without the word count, for a pass that another one follows."""
    def inner():
        scan = make()
        return lambda *columns: (row[1:] for row in scan(*columns))

    return inner


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit (words inside windows), n_items, items_sha256, contaminated."""
    found = find(documents, benchmark, **options)
    starts_ends = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(starts_ends, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        found.columns[0], "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]], total: int, max_coverage: float) -> str | None:
    """The text without the words of `spans`; null when fewer are left than the limit allows of `total` words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
    keep, done = [], 0
    for a, b in spans:
        keep.append(raw[done:at[a][0]])
        done = at[b - 1][1]
    left = len(at) - sum(b - a for a, b in spans)
    return b"".join([*keep, raw[done:]]).decode() if left >= (1 - max_coverage) * total else None


def cut_alone(text: str, auto: Automaton, max_coverage: float) -> str | None:
    """`cut` by one automaton of all items, read again until no window is left."""
    total = None
    while text is not None:
        ws = words(text)
        total = len(ws) if total is None else total
        spans, _ = auto.spans(ws)
        if not spans:
            break
        text = cut(text, spans, total, max_coverage)
    return text


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text", size: int = SIZE, max_coverage: float = MAX_COVERAGE,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of `documents`; spans of hit words are removed, documents mostly of such words dropped.

    n_chars, if there, follows.  Texts without hits pass unchanged.  What is left is read again until no window is in
    it, as a cut brings words together.  The limit is of the words that a document had at first.

    With more than one automaton the spans of all are gathered, as in `find`, and cut at once; such a round is repeated
    for the documents that it changed, which gives the same as one automaton.
    """
    spark, order = documents.sparkSession, documents.columns
    automata = shards(benchmark, item, item_text, size, shard_words)
    first, second = next(automata), next(automata, None)
    new, had = free_name(documents, "cut_text"), free_name(documents, "had_text")
    source = free_name(documents, "read_text")
    if second is None:
        held = spark.sparkContext.broadcast(first)

        def make():
            auto = held.value
            return lambda texts: ((t if not t else cut_alone(t, auto, max_coverage), bool(t)) for t in texts)

        made = map_rows(documents.withColumn(source, named(text)),
                        [T.StructField(new, T.StringType()), T.StructField(had, T.BooleanType())], make, order)
        return recount(made.filter(F.col(new).isNotNull() | ~F.col(had)).select(
            *[F.col(new).alias(c) if c == text else named(c) for c in order]), text)
    del first, second, automata   # `find` makes them again, one at a time
    total, row = free_name(documents, "first_total"), free_name(documents, "other_columns")
    others = [named(c) for c in order if c != text] or [F.lit(0).alias("none")]

    def cut_all():
        return lambda ts, totals, ns, ss: (
            (t if not s else cut(t, list(zip(s[::2], s[1::2])), n if m is None else m, max_coverage), n if m is None else m, bool(s))
            for t, m, n, s in zip(ts, totals, ns, ss))

    out, todo = [], documents.select(F.struct(*others).alias(row), named(text).alias(source), F.lit(None).cast("long").alias(total))
    while True:
        found = find(todo.select(F.struct(row, source, total).alias("key"), F.col(source).alias("text")), benchmark, "key", "text",
                     item, item_text, size, shard_words)
        read = found.select(F.col("key")[row].alias(row), F.col("key")[source].alias("t"), F.col("key")[total].alias("m"),
                            "n_words", "spans")
        made = written(map_rows(read, [T.StructField(source, T.StringType()), T.StructField(total, T.LongType()),
                                       T.StructField(had, T.BooleanType())], cut_all, [row]), "decontaminate")
        out.append(made.filter(~F.col(had)))
        todo = made.filter(F.col(had) & F.col(source).isNotNull()).drop(had)
        if todo.isEmpty():
            break
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return recount(done.select(*[F.col(source).alias(c) if c == text else F.col(row)[c].alias(c) for c in order]), text)
