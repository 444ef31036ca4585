"""Shared by the operators: byte words, Arrow batch maps, tables in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from screenwell.sources.tables import scratch, table  # noqa: F401

#: Byte map of the alphanumeric word rule: A-Z lower-cased, ASCII other than a-z and 0-9 blank, the rest as it is.
#: UTF-8 bytes from 0x80 on belong to words, so the map keeps every position.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Byte map of the blank-separated word rule: A-Z lower-cased, tab to carriage return blank.
BLANKS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def words(text: str | None, byte_map: bytes = ALNUM) -> list[bytes]:
    """Words of a whole text as UTF-8 bytes; null has none."""
    return text.encode().translate(byte_map).split() if text else []   # of ASCII white space the maps leave blanks alone


def map_rows(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[..., Iterable[tuple]]],
             keep: list[str] | None = None, done: Callable[[], None] | None = None, target: int = 16 << 20) -> DataFrame:
    """Rows of `df` (its columns are the arguments) through a Python function, in Arrow batches.

    `make` runs once per task and gives the function, which is called once per batch with one list per
    column and yields one tuple per output row.  Columns in `keep` pass through
    untouched in front of the new ones; then it must yield exactly one tuple per input row, in order.
    `done` is called at the task's end: workers live on and should not hold what the task gathered, nor the memory of
    batches that are through.  The lists are of about `target` bytes of the batch.
    """
    keep = keep or []
    args = [i for i, c in enumerate(df.columns) if c not in keep]
    kept = [i for i, c in enumerate(df.columns) if c in keep]
    inside = [f"c{i}" for i in range(len(df.columns))]   # Arrow maps resolve names, which dots would break
    schema = T.StructType([*[T.StructField(inside[i], df.schema[i].dataType) for i in kept],
                           *[T.StructField(f"new{i}", f.dataType) for i, f in enumerate(fields)]])
    new = to_arrow_schema(T.StructType(schema.fields[len(kept):]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in sliced(batch, target):
                rows = list(fn(*[part.column(i).to_pylist() for i in args]))
                columns = list(zip(*rows)) if rows else [()] * len(new)
                made = [pa.array(c, f.type) for c, f in zip(columns, new)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *made],
                                                 names=[*[inside[i] for i in kept], *new.names])
                del rows, columns, made
            batch = part = None
            pa.default_memory_pool().release_unused()
        if done:
            done()

    return df.toDF(*inside).mapInArrow(run, schema).toDF(*[df.columns[i] for i in kept], *[f.name for f in fields])


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def tokenizer_file(name: str) -> str:
    """Path of a tokenizer's file where this runs: `name` itself if there is such a file, else that of the public tokenizer."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def sliced(batch: pa.RecordBatch, target: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Views of a batch of about `target` bytes, so that few texts are Python objects at a time."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * target / max(batch.nbytes, target)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that the cluster names."""
    return scratch(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it: lineage is cut, several readers share one run."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores, such that no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def recount(df: DataFrame, text: str = "text", column: str = "n_chars") -> DataFrame:
    """Set the length column, where there is one, to the text's length."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.length(F.coalesce(named(text), F.lit(""))).cast(df.schema[column].dataType))


#: 64-bit words of the bitmap in `parted`: 16 million bits, so what is broadcast is bounded.
GATE_WORDS = 1 << 18


def parted(df: DataFrame, column: str, some: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose `column` is surely not among the `value`s of `some`, and the others, by a broadcast bitmap of hashes.

    The second part holds all rows that are among them and few more, while `some` has fewer values than the bitmap bits; so a join
    with `some` need not move the first part.  Beyond that more rows than needed are in the second.
    """
    word, bit, bits = (free_name(df, f"gate_{x}") for x in ("word", "bit", "bits"))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(GATE_WORDS - 1)).cast("int")
    inner = lambda c: F.shiftright(F.xxhash64(c), 40).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))
    marks = written(some.select(place(named(value)).alias(word), inner(named(value)).alias(bit)).groupBy(word).agg(
        F.bit_or(one).alias(bits)), "gate")
    read = df.withColumn(word, place(named(column))).join(F.broadcast(marks), word, "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(bits), inner(named(column))).bitwiseAND(F.lit(1)), F.lit(0)) == 1
    columns = [named(c) for c in df.columns]
    return read.filter(~hit).select(*columns), read.filter(hit).select(*columns)
