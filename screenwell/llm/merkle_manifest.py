"""Merkle manifest of a data set: a tree over each source, a tree over the sources, and a proof for every row.

Leaves.  A leaf is the SHA-256 of a row's fields, each `-` if null, else its UTF-8 byte count, `:` and its value.  Texts are
hashed where they are read and do not travel.  Leaves of a source ascend by key; every `FAN` consecutive nodes (the
last run may hold fewer, even one) become the hash of their digests, while a level has more than one node.

Roll-up.  A leaf's rank, taken from a range-sorted table, is written in digits of base `FAN`.  A block holds `FAN ** 3`
neighbours.  Inside it the digit columns are grouped away one after the other, lowest first, and each step nests the
structs of the step before, so one shuffle by block serves three levels.  Blocks are then the leaves of the
next round, until a tree has one node.  A nested row is bounded by the block, however large a source is.

Proofs.  Going down, a block meets the steps above it by grouping both under its number; transforms add the siblings of
each nested level and explodes unfold it.  Nothing is joined.  A step is the digests left and right of a node's place, and
the lone node of a run has two empty sides.

Edge cases.  A null source is a source of its own, before the others; null keys come first in their source.  Repeated rows
are leaves of their own; rows that differ only beyond the key stand in the order of their leaf digests.  Null, empty and long
texts are hashed as they are.  A source of one row has its leaf as subroot, a table of one source its
subroot as root.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwell.llm.common import named, written

FAN = 16
#: Leaves of a block: three digits.
BLOCK = FAN ** 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(values: Sequence[Column]) -> Column:
    """The leaf of a row of fields."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in texts]), 256)


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds r, the place of a row in its `tree` by `order` (nulls first) from 0, and n, the rows of the tree.

    Rows are range-sorted by tree and order, so a large tree is spread; places come from a table of the counts of each
    written part, which has no more rows than parts and trees.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(
        "part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    starts = counts.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), "first", F.sum("rows").over(tree).alias("n"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return rows.join(starts, (F.col("part") == F.col("in")) & F.col("tree").eqNullSafe(F.col("of"))).select(
        *df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("r"), "n")


# -- up -------------------------------------------------------------------------------------------


def _joined(children: Column, hashed: Column) -> Column:
    return F.when(hashed, F.sha2(F.array_join(children["h"], ""), 256)).otherwise(F.get(children, F.lit(0))["h"])


def rollup(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, r, n, h, body) of one level -> blocks (tree, block, n, h, kids), three levels up.

    `n` is the node count of the tree at the lower level; a level is hashed only if the one below has several nodes.
    """
    digit = [F.shiftright("r", 4 * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{k}") for k in range(3)]
    rows = nodes.select("tree", F.shiftright("r", 12).alias("block"), "n", *digit, "h", "body").repartition("tree", "block")
    inside = ["tree", "block", "d2", "d1"]
    child, held = F.struct("d0", "h", "body"), 1
    while len(inside) > 1:
        rows = rows.groupBy(*inside).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(child)).alias("kids"))
        rows = rows.withColumn("h", _joined(F.col("kids"), F.col("n") > held))
        child, held = F.struct(inside[-1], "h", "kids"), held * FAN
        inside = inside[:-1]
    return rows.select("tree", "block", "n", "h", "kids")


def rolled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written blocks of every round, and the tops (tree, h) of all trees."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    rounds: list[DataFrame] = []
    while largest > 1 or not rounds:
        rounds.append(written(rollup(nodes), "blocks"))
        nodes = rounds[-1].select("tree", F.col("block").alias("r"), F.ceil(F.col("n") / BLOCK).alias("n"), "h",
                                  F.lit(None).cast("boolean").alias("body"))
        largest = -(-largest // BLOCK)
    return rounds, nodes.select("tree", "h")


# -- down -----------------------------------------------------------------------------------------


def _step(digests: Column, i: Column) -> Column:
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"),
                    F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("right"))


def unfolded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks and what is `above` them (tree, block, path, known) -> their nodes (tree, r, h, body, path, known).

    A path holds the steps from a node to the top, the nearest first.
    """
    kids = dict(blocks.dtypes)["kids"]
    met = blocks.select("tree", "block", "n", "kids", F.lit(None).cast(STEPS).alias("path"),
                        F.lit(None).cast(above.schema["known"].dataType).alias("known"))
    rest = above.select("tree", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(kids).alias("kids"), "path", "known")
    rows = met.unionByName(rest).groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "known")])
    rows = rows.withColumn("r", F.col("block"))
    for k in (2, 1, 0):
        inner = "body" if k == 0 else "kids"
        nodes = F.transform("kids", lambda x, i: F.struct(
            (F.col("r") * FAN + x[f"d{k}"]).alias("r"), x["h"].alias("h"), x[inner].alias(inner),
            F.concat(F.when(F.col("n") > FAN ** k, F.array(_step(F.col("kids")["h"], i))).otherwise(
                F.array().cast(STEPS)), F.col("path")).alias("path")))
        rows = rows.select("tree", "n", "known", F.explode(nodes).alias("x")).select("tree", "n", "known", "x.*")
    return rows.select("tree", "r", "h", "body", "path", "known")


def paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """All rounds downwards from `tops` (tree, path, known)."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for i in range(len(rounds) - 1, -1, -1):
        nodes = unfolded(rounds[i], above)
        above = nodes.select("tree", F.col("r").alias("block"), "path", "known")
    return nodes


def manifest(leaves: DataFrame, order: Sequence[str] = ("key",)) -> DataFrame:
    """Leaves (tree, h, body, and the columns of `order`) -> (body, leaf, subroot, root, path) of every row."""
    rounds, subroots = rolled(ranked(leaves, [*order, "h"]).select("tree", "r", "n", "h", "body"))
    sources = ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("body"), "h"), ["body"])
    upper, root = rolled(sources)
    start = root.select("tree", F.array().cast(STEPS).alias("path"), F.struct(F.col("h").alias("root")).alias("known"))
    tops = paths(upper, start).select(F.col("body").alias("tree"), "path", F.struct(
        "known.root", F.col("h").alias("subroot")).alias("known"))
    return paths(rounds, tops).select("body", F.col("h").alias("leaf"), "known.subroot", "known.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of a proof give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def report(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
           fields: Sequence[str] = FIELDS, every: int = 5) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, and folded_root and verified after a tampering of some rows.

    Tampering lower-cases the A-Z of the text where `every` divides the CRC-32 of the decimal key; a null key's row is not
    touched.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(named(text), upper, upper.lower())
    chosen = F.coalesce(F.crc32(named(key).cast("string")) % every == 0, F.lit(False))
    other = digest([lowered if f == text else named(f) for f in fields])
    leaves = documents.select(
        named(source).alias("tree"), named(key).alias("key"), digest([named(f) for f in fields]).alias("h"),
        F.struct(named(key).alias("key"), F.when(chosen, other).alias("tampered")).alias("body"))
    back = folded(F.coalesce("body.tampered", "leaf"), F.col("path"))
    rows = manifest(leaves).select(F.col("body.key").alias(key), "leaf", "subroot", "root",
                                   proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
