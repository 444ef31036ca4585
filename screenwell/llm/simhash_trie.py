"""SimHash near-duplicates: a binary-trie self-join of fingerprints within a Hamming distance.

Fingerprints.  Words are split at blanks (tab to carriage return too), A-Z lower-cased; each run of `SHINGLE` words, joined by
single blanks, is hashed (XXH64, seed 42); a bit is set when it is set in more than half of the hashes.

Links.  Two fingerprints at distance `d` agree in one of `d + 1` blocks of bits.  So each distinct fingerprint is
sent once per block, rotated to begin with it, and those that share the block form a trie that stands below it.
Inside, pairs of trie nodes are walked down together, all pairs of a level at once: the differing bits add up, and a
pair is dropped when they exceed `d`.  A node is a range of the sorted fingerprints.  Small pairs are compared
directly.  A trie of more than `SPLIT` fingerprints is dealt out as parts, and each pair of parts is a
task of its own.

Documents with equal fingerprints are one node.  A task returns, for what it has linked, only a star per connected
group, at most one row per fingerprint and block; `components` joins the stars.

Edge cases.  Null, empty and blank texts have fingerprint zero and are linked like any other.  Texts of fewer words
are one shingle.  Null keys stand last in the order that picks a group's key (a group with no other has a null
one); repeated rows give a row each.  An empty table gives no rows.  Columns of the input are not read by `report`
and passed through by `distinct`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.common import BLANKS, free_name, map_rows, named, parted, words, written
from screenwell.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints in one part of a trie; two parts meet in a task.
SPLIT = 8192
#: Node pairs walked down at a time.
WIDTH = 1 << 17
#: Pairs of fingerprints below which two nodes are compared directly.
LEAF = 32
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, as a signed integer."""
    ws = words(text, BLANKS)
    if not ws:
        return 0
    flat, ends, at = b" ".join(ws), [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    last = max(1, len(ws) - size + 1)
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[:last], ends[min(size, len(ws)) - 1:])], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):   # the bits of many shingles are not held at once
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """All columns of `df` and the fingerprint (long) of `text`."""
    read = free_name(df, "fingerprinted")
    return map_rows(df.withColumn(read, named(text)), [T.StructField(name, T.LongType())],
                    lambda: lambda texts: ((fingerprint(t),) for t in texts), df.columns)


# -- the join of a trie with itself ----------------------------------------------------------


def link_tries(values: np.ndarray, roots: list[tuple[int, int, int, int]], budget: int, skip: int,
               link: Callable[[np.ndarray, np.ndarray], None], width: int = WIDTH) -> None:
    """Report index pairs at distance `budget` or less under pairs of roots.

    `roots` are (from, to, from, to): two ranges of `values`, each sorted; a range twice is a join with itself, of
    each pair once.  All values of a root pair agree in their first `skip` bits.
    """
    ones: dict[int, np.ndarray] = {}

    def zeros_end(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the values with a set bit begin in each range."""
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return hi - (ones[depth][hi] - ones[depth][lo])

    start = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(skip, *start.T, np.zeros(len(start), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > width:
            stack += [(depth, *[x[i:i + width] for x in (a0, a1, b0, b1, err)]) for i in range(0, len(a0), width)]
            continue
        pairs = (a1 - a0) * (b1 - b0)
        small = (pairs <= LEAF) | (depth >= 64)
        if small.any():
            _compare(values, a0[small], a1[small], b0[small], b1[small], pairs[small], budget, link)
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        am, bm = zeros_end(depth, a0, a1), zeros_end(depth, b0, b1)
        own = a0 == b0
        both = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        cross = tuple(x[~own] for x in (am, a1, b0, bm, err + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*both, cross))
        live = (a1 > a0) & (b1 > b0) & (err <= budget)
        if live.any():
            stack.append((depth + 1, *[x[live] for x in (a0, a1, b0, b1, err)]))


def _compare(values, a0, a1, b0, b1, pairs, budget, link, most: int = 1 << 20) -> None:
    """All pairs of fingerprints of each pair of ranges; a range against itself gives each pair once."""
    begin = 0
    reach = np.cumsum(pairs)
    while begin < len(pairs):
        before = int(reach[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(reach, before + most, "right")))
        n = pairs[begin:end]
        which = np.repeat(np.arange(begin, end), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[which]
        i, j = a0[which] + offset // wide, b0[which] + offset % wide
        once = (a0[which] != b0[which]) | (i < j)
        i, j = i[once], j[once]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        if near.any():
            link(i[near], j[near])
        begin = end


class Stars:
    """Connected groups of indexes, each named by its least."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[i], p[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up


def task_stars(ids: np.ndarray, sides: np.ndarray, fps: np.ndarray, shifts: np.ndarray, skip: int, budget: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its group's representative) over whole tasks of ids; side 0 alone is joined with itself."""
    turned = (fps << shifts) | (fps >> ((np.uint64(64) - shifts) & np.uint64(63)))
    order = np.lexsort((turned, sides, ids))
    ids, sides, fps, turned = ids[order], sides[order], fps[order], turned[order]
    edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (sides[1:] != sides[:-1])]))
    ends = np.append(edges[1:], len(ids))
    roots, at = [], 0
    while at < len(edges):
        lo, hi = int(edges[at]), int(ends[at])
        if at + 1 < len(edges) and ids[edges[at + 1]] == ids[lo]:
            roots.append((lo, hi, int(edges[at + 1]), int(ends[at + 1])))
            at += 2
        else:
            if sides[lo] == 0:
                roots.append((lo, hi, lo, hi))
            at += 1
    stars = Stars(len(fps))
    if roots:
        link_tries(turned, roots, budget, skip, stars.link)
    inner = stars.parent != np.arange(len(fps))
    return fps[inner], fps[stars.parent[inner]]


# -- on Spark ------------------------------------------------------------------------------------


def star_links(fingerprints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """Distinct fingerprints (one long column, fp) -> links (a, b) that connect all within the distance."""
    count = distance + 1
    sizes = [64 // count + (i < 64 % count) for i in range(count)]
    begins = [sum(sizes[:i]) for i in range(count)]
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(
        f"shiftrightunsigned(shiftleft(fp, {b}), {64 - n})").alias("bits")) for i, (b, n) in enumerate(zip(begins, sizes))])
    parts = fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.bits")
    counts = parts.groupBy("block", "bits").agg(F.ceil(F.count("*") / split).cast("int").alias("n")).filter("n > 1")
    dealt = parts.join(counts, ["block", "bits"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn(
        "part", F.pmod(F.hash("fp"), F.col("n")))
    # Part p of n meets itself and every other: (p, p), (p, later), (earlier, p).
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda q: F.struct(
        F.least("part", q).alias("i"), F.greatest("part", q).alias("j"), (q < F.col("part")).cast("int").alias("side")))
    tasks = dealt.select("fp", "block", "bits", F.explode(meets).alias("m")).select(
        "block", "bits", "m.i", "m.j", "m.side", "fp")
    spread = tasks.repartition("block", "bits", "i", "j").sortWithinPartitions("block", "bits", "i", "j")
    shift = np.array(begins, np.uint64)
    skip = min(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_tasks(batches, ["block", "bits", "i", "j"], 4 * split):
            ids = np.cumsum(np.concatenate([[0], np.any(
                [np.diff(group[c].astype(np.int64)) != 0 for c in ("block", "bits", "i", "j")], axis=0)]))
            a, b = task_stars(ids, group["side"], group["fp"].view(np.uint64), shift[group["block"]], skip, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def whole_tasks(batches: Iterator[pa.RecordBatch], by: list[str], least: int) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as columns, regrouped so that equal values of `by` stay together; `least` rows or more at a time."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in held}
        n = len(held[by[0]])
        if n >= least:
            last = np.all([held[c] == held[c][-1] for c in by], axis=0)
            cut = n - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield {k: v[:cut] for k, v in held.items()}
                held = {k: v[cut:] for k, v in held.items()}
    if held is not None and len(held[by[0]]):
        yield held


def groups(fingerprints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """(fp, key) of all documents, written -> (fp, root, component_id): one fingerprint and the least key of its group."""
    least = written(fingerprints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    roots = written(components(star_links(least.select("fp"), distance, split)), "components")
    rooted = written(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", "root"), "rooted")
    linked = rooted.filter("root is not null")
    # Written before the join, so that adaptive execution may split a root that many fingerprints share.
    ids = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return written(linked.join(ids, "root").select("fp", "root", "component_id").unionByName(rooted.filter("root is null").select(
        "fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))), "groups")


def report(documents: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per document: key, fingerprint (hexadecimal), component_id (the least key of its connected group)."""
    df = documents.select(named(key).alias("key"), named(text).alias("text"))
    prints = written(with_fingerprints(df, "text", "fp").select("key", "fp"), "prints")
    return prints.join(groups(prints, distance), "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct(documents: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The documents, with their own columns, but one of each connected group: that of the least key.

    Of several rows with that key the first written stays; a group without keys keeps its first row.
    """
    fp, row = free_name(documents, "fp"), free_name(documents, "row_at")
    texts = written(with_fingerprints(documents, text, fp).withColumn(row, F.monotonically_increasing_id()), "texts")
    prints = texts.select(F.col(fp).alias("fp"), named(key).alias("key"), F.col(row).alias("at"))
    least = prints.groupBy("fp", "key").agg(F.min("at").alias("at"))   # few rows of a text with many copies go on
    stays = least.join(groups(prints, distance), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "at"))["at"].alias("stays"))
    stays = written(stays, "stays")
    leaves = written(texts.select(F.col(row).alias("at")).join(stays, F.col("at") == F.col("stays"), "left_anti"), "leaves")
    sure, perhaps = parted(texts, row, leaves, "at")   # only texts that may leave are moved
    rest = perhaps.join(leaves.hint("shuffle_hash"), perhaps[row] == leaves["at"], "left_anti")
    return sure.union(rest).select(*[named(c) for c in documents.columns])
