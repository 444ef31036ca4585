"""Token ids as directly addressable codes, in segments that any Spark job can read.

An id is split into chunks of `BITS` bits, lowest first.  Level 0 holds the lowest chunk of every id, level 1 the
next chunk of those ids that have one, and so on.  Each level but the last has a bitmap that says which of its
chunks continue, and a rank directory: the number of set bits before each block of `BLOCK` bits.  Token i is read by
following chunk i of level 0 to chunk rank(i) of level 1, without decoding anything else.

Segment, little-endian: magic `DAC1`, number of ids n (u64), levels L (u32); then for each level its length m (u64),
m chunk bytes, and, but for the last, the bitmap (ceil(m / 8) bytes, lowest bit first) and the directory
(ceil(m / BLOCK) + 1 u64).

Files.  `write` makes a Parquet folder with one row per segment: part and before (ids of the part in front of it;
their order is that of the keys), the keys and lengths of the segment's documents, and the code.  Segments hold whole documents and are closed at
`SEGMENT` ids, which bounds what a task holds (a longer document makes a longer segment).

Edge cases.  Null and empty texts are the end id alone.  Null keys come first, as Spark sorts them.
Repeated keys stay neighbours, in no fixed order among themselves.  An empty table makes no segment, and reading
that gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.chunks import Known
from screenwell.llm.common import sliced, tokenizer_file

BITS = 8
BLOCK = 512
SEGMENT = 1 << 20
MAGIC = b"DAC1"


# -- the code ------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype="<u4")
    levels = []
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> BITS
    out = [MAGIC, np.uint64(len(ids)).tobytes(), np.uint32(len(levels)).tobytes()]
    for at, (chunks, more) in enumerate(levels):
        out += [np.uint64(len(chunks)).tobytes(), chunks.tobytes()]
        if at < len(levels) - 1:
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64)
            out += [np.packbits(more, bitorder="little").tobytes(),
                    np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()]
    return b"".join(out)


class Codes:
    """A segment opened for reading: `len`, `[i]` without decoding a block, and ranges of neighbours."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a code segment")
        self.n = int(np.frombuffer(data, "<u8", 1, 4)[0])
        count = int(np.frombuffer(data, "<u4", 1, 12)[0])
        self.levels, at = [], 16
        for level in range(count):
            m = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, m, at + 8)
            at += 8 + m
            bitmap = ranks = None
            if level < count - 1:
                bitmap = np.frombuffer(data, np.uint8, -(-m // 8), at)
                at += len(bitmap)
                ranks = np.frombuffer(data, "<u8", -(-m // BLOCK) + 1, at)
                at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        first = block * BLOCK // 8
        ones = int(np.bitwise_count(bitmap[first:i // 8]).sum()) + int(ranks[block])
        return ones + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * level
            if bitmap is None or not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """Ids start up to end; each level is entered by rank, then read on."""
        out = np.zeros(max(0, end - start), "<u4")
        where, a, b = np.arange(len(out)), start, end
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= chunks[a:b].astype("<u4") << np.uint32(BITS * level)
            if bitmap is None:
                break
            more = np.unpackbits(bitmap[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a].astype(bool)
            where = where[more]
            a = self._rank(level, a)
            b = a + len(where)
        return out


# -- ids of texts -----------------------------------------------------------------------


#: Latin letters (but the one whose lower case takes a mark), then a run of ASCII signs or none: not the apostrophe, which may
#: begin an ending of its own, nor those of special tokens.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=?@[-`{}~]*)\\Z")
#: The rule by which a word of letters is one pre-token, lower-cased and then read as bytes.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """The tokenizers library over pieces between blanks, which its rules drop and never match across.

    Pieces repeat, so they are kept for a while, and the library sees a batch's new ones at once.  Where the file's rule
    is the one above, a word of letters goes to the library's merges alone, apart from the stops behind it.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        from screenwell.llm.bpe_cuts import byte_letters

        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # the task's cores are Spark's to share out
        path = tokenizer_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        plain = (spec["model"]["type"] == "BPE" and normal == _NORMAL and [r["type"] for r in rules] == ["Split", "ByteLevel"]
                 and rules[0]["pattern"] == {"Regex": _SPLIT} and not rules[1]["add_prefix_space"] and not rules[1]["use_regex"])
        self.merges, self.letter = self.tokenizer.model if plain else None, byte_letters()
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if len(self._encode(["a  b\nc"])[0]) > len(self._encode(["a b c"])[0]) or self._encode([" "]) != [b""]:
            raise ValueError(f"{path} keeps white space in its tokens")
        self.pieces, self.stops = Known(most // 2), {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in batch]

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters."""
        letters = word.lower()
        if not word.isascii():
            letters = "".join([self.letter[b] for b in letters.encode()])
        return array("I", [t.id for t in self.merges.tokenize(letters)]).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        cut = []
        for text in texts:
            if text and text.isascii() and "<" not in text:   # the file lower-cases, but not special tokens
                text = text.lower()
            cut.append(text.replace("\n", " ").split(" ") if text else [])
        others, known, merge, ends, plain = [], self.pieces, self._word, self.stops, _PLAIN.match
        for piece in known.missing(set().union(*cut)):
            found = plain(piece) if self.merges else None
            if not found:
                others.append(piece)
                continue
            word, stops = found.groups()
            if stops and stops not in ends:
                if len(ends) > 10_000:
                    ends.clear()
                ends[stops], = self._encode([stops])
            known[piece] = merge(word) + ends[stops] if stops else merge(word)
        known.update(zip(others, self._encode(others)))
        of = self.pieces.__getitem__
        return [b"".join(map(of, pieces)) for pieces in cut]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(path)


# -- files -----------------------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end: bytes, target: int, schema: pa.Schema
              ) -> Iterator[pa.RecordBatch]:
    enc, part = encoder(tokenizer), TaskContext.get().partitionId()
    keys: list = []
    lengths: list[int] = []
    held: list[bytes] = []
    before = size = 0

    def close() -> pa.RecordBatch:
        code = pack(np.frombuffer(b"".join(held), "<u4"))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (part, before, size, list(keys), list(lengths), code), schema)], schema=schema)

    for batch in batches:
        for piece in sliced(batch, 4 << 20):
            for key, ids in zip(piece.column(0).to_pylist(), enc(piece.column(1).to_pylist())):
                ids += end
                keys.append(key)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= target:
                    yield close()
                    keys, lengths, held, before, size = [], [], [], before + size, 0
    if keys:
        yield close()


def write(documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
          segment: int = SEGMENT) -> None:
    """Encode every text, append `end_id`, and write segments in ascending key order below `path`."""
    spark = documents.sparkSession
    df = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(df.schema["key"].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("code", T.BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _segments(batches, tokenizer, end, segment, to_arrow_schema(schema))

    (df.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)
     .write.parquet(path))


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part; as many entries as tasks have written."""
    rows = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, out = 0, {}
    for row in sorted(rows):
        out[row["part"]] = base
        base += row["n"]
    return out


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document: key, start (ids of all documents before it), ids (binary, unsigned 32-bit)."""
    return _documents(spark, path, key, T.StructField("ids", T.BinaryType()), lambda ids: ids.tobytes())


def _documents(spark, path, key, field, make) -> DataFrame:
    segments, base = spark.read.parquet(path), part_starts(spark, path)
    kind = segments.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                codes = Codes(batch.column(4)[i].as_buffer().to_pybytes())
                lengths = batch.column(3)[i].values.to_numpy()
                start = base[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                ends = np.cumsum(lengths)
                values = [make(codes.between(int(e - n), int(e))) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[i].values.cast(arrow[0].type), pa.array(start + ends - lengths),
                     pa.array(lengths), pa.array(values, arrow[3].type)], schema=arrow)

    return segments.select("part", "before", "keys", "lengths", "code").mapInArrow(run, schema)


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    return _documents(spark, path, key, T.StructField("ids_crc32", T.LongType()), lambda ids: zlib.crc32(ids.tobytes()))
