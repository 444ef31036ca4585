"""Ranked search by pipelined term partitioning: bundles of items visit the owners of their terms one after the other.

Scores.  Every term of an item has an integer weight from its document frequency, every occurrence an integer contribution
by its frequency and the document's length (`WEIGHT`, `SLOPE`, `GAIN`); a document's score is the sum.

Shards.  A map over the documents counts each text's terms once and writes posting lists of up to `SHARD` neighbouring
documents: one row per shard and term, which holds places in the shard and frequencies.  Terms that no item has are left out by
a bitmap of `BITS` hashed positions, whatever the number of items; the join with the items' terms is exact.

Owners.  Terms are owned by their document frequency: `OWNERS` stages, the rarest terms first.  At each stage, the
bundle of up to `BUNDLE` items of a shard (its accumulators: item, place, score so far) meets the owner's posting lists of that
shard in a cogroup, adds their contributions and travels on.  A group holds one bundle and one shard, so its size is
bounded however frequent a term is.

Pruning without loss.  After a stage the tenth best sums of each item, over all shards, are a floor under the tenth best final score.
An accumulator that cannot reach it with the most that the later owners may add is dropped, and no
new one is opened for an item once a document without any sum so far cannot reach it.  Equal scores are kept.

Edge cases.  Null, blank and empty texts have no terms: such documents do not count and such items give no rows.  Repeated
documents and items are rows of their own.  Ties go by ascending key, null keys last, then by place.  Without
documents or items there are no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from screenwell.llm.common import map_rows, named, sliced, words, written

#: Documents and terms (with repeats) of a shard; items of a bundle.
SHARD, SHARD_TERMS, BUNDLE = 4096, 2_000_000, 256
#: Largest document frequency of each owner, as one part in so many; the last owner has the rest.
OWNERS = (1024, 64, 8)
#: Positions of the bitmap, a power of two.
BITS = 1 << 22
#: Fixed values of the score.
WEIGHT, GAIN, SLOPE, PIVOT = 1000, 1_000_000_000, 75, 100
#: Above any contribution of a weight of one.
MOST = GAIN // WEIGHT
_WORD = 32768


# -- items ----------------------------------------------------------------------------------------


def item_terms(items: DataFrame, key: str, text: str, bundle: int = BUNDLE) -> DataFrame:
    """(bundle, slot, key, terms, counts) of every item, written; bundles are numbered from 0 without a gap but empty ones."""
    df = items.select(named(key).alias("key"), named(text).alias("text"))
    parts = max(1, -(-df.count() // bundle))

    def make():
        part, slot = TaskContext.get().partitionId(), -1

        def rows(texts):
            nonlocal slot
            for t in texts:
                slot += 1
                counts = Counter(words(t))
                yield part, slot, [w.decode() for w in counts], list(counts.values())

        return rows

    fields = [T.StructField("bundle", T.IntegerType()), T.StructField("slot", T.IntegerType()),
              T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    return written(map_rows(df.repartition(parts), fields, make, ["key"]), "items")


def bitmap(terms: DataFrame) -> bytes:
    """Hashed positions of all terms, `BITS` / 8 bytes."""
    at = F.crc32("term").bitwiseAND(F.lit(BITS - 1))
    rows = terms.groupBy(F.floor(at / _WORD).alias("word")).agg(F.bitmap_construct_agg(at % _WORD).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for row in rows:
        out[row["word"] * _WORD // 8:(row["word"] + 1) * _WORD // 8] = row["bits"]
    return bytes(out)


# -- documents ------------------------------------------------------------------------------------


def postings(documents: DataFrame, key: str, text: str, wanted: bytes, shard: int = SHARD) -> DataFrame:
    """Posting lists (shard, term, places, counts), and one row a shard with a null term, its keys and lengths in `counts`.

    Documents without terms are left out.
    """
    df = documents.select(named(key).alias("key"), named(text).alias("text"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("places", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType())),
                           T.StructField("keys", T.ArrayType(df.schema["key"].dataType))])
    arrow = to_arrow_schema(schema)

    def lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        return listed(flat, ends, arrow.field("places").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        names: list[bytes] = []
        which, places, counts, lengths, keys, total = array("i"), array("i"), array("i"), array("i"), [], 0

        def close() -> pa.RecordBatch:
            ids, n = np.frombuffer(which, np.int32), len(names)
            order = np.argsort(ids, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))])
            own = len(ids) + len(lengths)
            columns = [
                pa.array(np.full(n + 1, number), pa.int64()), pa.array([*[w.decode() for w in names], None], pa.string()),
                lists(np.frombuffer(places, np.int32)[order], np.append(ends, len(ids))),
                lists(np.concatenate([np.frombuffer(counts, np.int32)[order], np.frombuffer(lengths, np.int32)]), np.append(ends, own)),
                pa.array([*[None] * n, keys], arrow.field("keys").type)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def new(word: bytes) -> int:
            at = zlib.crc32(word) & (BITS - 1)
            if not wanted[at >> 3] >> (at & 7) & 1:
                return -1
            names.append(word)
            return len(names) - 1

        for batch in batches:
            for piece in sliced(batch, 4 << 20):
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ws = words(t)
                    if not ws:
                        continue
                    for w, n in Counter(ws).items():
                        i = known.get(w)
                        if i is None:
                            i = known[w] = new(w)
                        if i >= 0:
                            which.append(i)
                            places.append(len(keys))
                            counts.append(n)
                    lengths.append(len(ws))
                    keys.append(k)
                    total += len(ws)
                    if len(keys) >= shard or total >= SHARD_TERMS:
                        yield close()
                        number += 1
                        known, names, total = {}, [], 0
                        which, places, counts, lengths, keys = array("i"), array("i"), array("i"), array("i"), []
        if keys:
            yield close()

    return written(df.mapInArrow(run, schema), "postings")


def listed(flat: np.ndarray, ends: np.ndarray, kind: pa.ListType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind.value_type)).cast(kind)


# -- stages ---------------------------------------------------------------------------------------


def contributions(counts: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    """What occurrences of one term add, given the documents' length terms."""
    return weight * (GAIN * counts // (WEIGHT * counts + 8 * m))


def length_terms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return PIVOT - SLOPE + SLOPE * lengths * n_docs // n_terms


def tops(slots: np.ndarray, sums: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest sums of every slot, largest first (of equal ones that of the least `ties`), slots ascending."""
    order = np.lexsort((ties, -sums, slots))
    first = np.searchsorted(slots[order], slots[order])
    return order[np.arange(len(order)) - first < k]


def visit(slots: np.ndarray, places: np.ndarray, sums: np.ndarray, terms: list, m: np.ndarray, before: np.ndarray, after: np.ndarray,
          floor: np.ndarray, ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One bundle at one owner of one shard: accumulators (slot, place, sum) after it, and the indexes of each slot's k best.

    `terms` are (places, counts, weight, slots, repeats); `before` and `after` say what each slot may still gain
    with and without this owner; `floor` is what a document must reach; `ties` orders the shard's documents.
    """
    width = len(m)
    opened = np.flatnonzero(before >= floor)
    line = np.full(len(floor), -1)
    line[opened] = np.arange(len(opened))
    dense = np.zeros((len(opened), width), np.int64)
    inside = line[slots] >= 0
    dense[line[slots[inside]], places[inside]] = sums[inside]
    s, p, v = slots[~inside], places[~inside], sums[~inside].copy()
    column = np.zeros(width, np.int64)
    for at, counts, weight, whose, repeats in terms:
        gain = contributions(counts, m[at], weight)
        lines = line[whose]
        into = lines >= 0
        if into.any():
            dense[np.ix_(lines[into], at)] += repeats[into, None] * gain
        if len(s) and not into.all():
            often = np.zeros(len(floor), np.int64)
            often[whose] = repeats
            column[at] = gain
            v += often[s] * column[p]
            column[at] = 0
    i, j = np.nonzero(dense)
    s, p, v = np.concatenate([s, opened[i]]), np.concatenate([p, j]), np.concatenate([v, dense[i, j]])
    best = tops(s, v, ties[p], k)
    local = np.zeros(len(floor), np.int64)
    whose, n = np.unique(s[best], return_counts=True)
    ends = np.cumsum(n)
    local[whose[n == k]] = v[best][ends[n == k] - 1]
    live = v + after[s] >= np.maximum(floor, local)[s]
    kept = np.flatnonzero(live)
    back = np.full(len(s), -1)
    back[kept] = np.arange(len(kept))
    best = back[best]
    return s[kept], p[kept], v[kept], best[best >= 0]


_STATE = [T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())),
          T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("best", T.ArrayType(T.IntegerType()))]


def stage(state: DataFrame, lists: DataFrame, owner: int, last: bool, n_docs: int, n_terms: int, bundle: int, k: int) -> DataFrame:
    """State (bundle, shard, lengths, keys, slots, places, sums; rest, floors) cogrouped with an owner's lists.

    `best` of the result are the indexes of each slot's k best accumulators.
    """
    schema = T.StructType([f for f in state.schema.fields if f.name in ("bundle", "shard", "lengths", "keys")] + _STATE)
    arrow = to_arrow_schema(schema)

    def flat(column: pa.ChunkedArray, i: int, kind) -> np.ndarray:
        return column[i].values.to_numpy(zero_copy_only=False).astype(kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        lengths, slots, places, sums = (flat(left[c], 0, np.int64) for c in ("lengths", "slots", "places", "sums"))
        rest = np.zeros((owner + 2, bundle), np.int64)
        for slot, gains in left["rest"][0].as_py() or ():
            rest[:, slot] = gains[:owner + 2]
        floor = np.zeros(bundle, np.int64)
        for slot, least in left["floors"][0].as_py() or ():
            floor[slot] = least
        terms = [(flat(right["places"], i, np.int64), flat(right["counts"], i, np.int64), right["weight"][i].as_py(),
                  flat(right["whose"], i, np.int64), flat(right["repeats"], i, np.int64)) for i in range(right.num_rows)]
        ties = np.arange(len(lengths))
        if last:
            keys = left["keys"][0].as_py()
            ties[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))] = np.arange(len(keys))
        out = visit(slots, places, sums, terms, length_terms(lengths, n_docs, n_terms), rest[owner], rest[owner + 1],
                    np.maximum(floor, 1), ties, k)
        made = [listed(x, np.array([0, len(x)]), f.type) for x, f in zip(out, [arrow.field(f.name) for f in _STATE])]
        return pa.Table.from_arrays([*[left[n].combine_chunks() for n in arrow.names[:4]], *made], schema=arrow)

    return state.groupBy("bundle", "shard").cogroup(lists.groupBy("of_bundle", "of_shard")).applyInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 10, shard: int = SHARD, bundle: int = BUNDLE,
           owners: Sequence[int] = OWNERS) -> DataFrame:
    """Per item and rank: item, rank (from 1), key, score (long, above 0): the k best documents."""
    asked = item_terms(items, item, item_text, bundle)
    pairs = asked.select("bundle", "slot", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "bundle", "slot", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    lists = postings(documents, key, text, bitmap(pairs), shard)
    shards = lists.filter("term is null").select("shard", F.col("counts").alias("lengths"), "keys")
    size = shards.agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("l")).first()
    n_docs, n_terms = size["n"] or 0, size["l"] or 1
    found = lists.filter("term is not null").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(WEIGHT * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    owner = sum(((F.col("df") * part > n_docs).cast("int") for part in owners), F.lit(0))
    width = pairs.agg(F.max("bundle"), F.max("slot")).first()
    bundles, bundle = (width[0] or 0) + 1, max(bundle, (width[1] or 0) + 1)
    terms = written(pairs.join(found, "term").withColumn("weight", weight).withColumn("owner", owner).groupBy(
        "bundle", "owner", "term", "weight").agg(F.collect_list(F.struct("slot", "n")).alias("asked")).select(
        "bundle", "owner", "term", "weight", F.col("asked.slot").alias("whose"), F.col("asked.n").alias("repeats")), "terms")
    later = [F.sum(F.when(F.col("owner") >= i, F.col("weight") * F.col("n") * MOST).otherwise(0)).alias(f"g{i}")
             for i in range(len(owners) + 2)]
    rest = terms.select("bundle", "owner", "weight", F.explode(F.arrays_zip("whose", "repeats")).alias("t")).select(
        "bundle", "owner", "weight", F.col("t.whose").alias("slot"), F.col("t.repeats").alias("n")).groupBy(
        "bundle", "slot").agg(*later).groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct(
            "slot", F.array(*[f"g{i}" for i in range(len(owners) + 2)])))).alias("rest"))
    rest = written(rest, "gains")
    none = F.array()
    state = shards.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).withColumns(
        {f.name: none.cast(f.dataType) for f in _STATE})
    floors = None
    for i in range(len(owners) + 1):
        if floors is None:
            known = rest.withColumn("floors", F.lit(None).cast("map<int,bigint>"))
        else:   # a written table of a row for each bundle, whose size Spark knows before it plans the join
            known = written(rest.join(floors, "bundle", "left"), "known")
        own = lists.join(terms.filter(F.col("owner") == i), "term").select(
            F.col("bundle").alias("of_bundle"), F.col("shard").alias("of_shard"), "places", "counts", "weight", "whose", "repeats")
        state = written(stage(state.drop("best").join(known, "bundle"), own, i, i == len(owners), n_docs, n_terms, bundle, k), "visited")
        if i < len(owners):
            floors = written(_floors(state, k), "floors")
    return _ranked(state, asked, key, item, k)


def _best(state: DataFrame, *more: str) -> DataFrame:
    """The k best accumulators of every slot of every shard."""
    at = F.explode("best").alias("at")
    return state.select("bundle", "shard", "slots", "places", "sums", *more, at).select(
        "bundle", "shard", F.get("slots", "at").alias("slot"), F.get("sums", "at").alias("score"),
        F.get("places", "at").alias("place"), *[F.get(c, F.get("places", "at")).alias(c) for c in more])


def _floors(state: DataFrame, k: int) -> DataFrame:
    """(bundle, floors): the k-th best sum of each slot over all shards, where it has so many."""
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), "shard", "place")
    last = _best(state).select("bundle", "slot", "score", F.row_number().over(order).alias("rank")).filter(
        F.col("rank") == k)
    return last.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))


def _ranked(state: DataFrame, asked: DataFrame, key: str, item: str, k: int) -> DataFrame:
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.col("keys").asc_nulls_last(), "shard", "place")
    final = _best(state, "keys").select("bundle", "slot", "keys", "score", F.row_number().over(order).alias("rank")).filter(
        F.col("rank") <= k)
    return final.join(asked.select("bundle", "slot", F.col("key").alias("item")), ["bundle", "slot"]).select(
        F.col("item").alias(item), "rank", F.col("keys").alias(key), "score")
