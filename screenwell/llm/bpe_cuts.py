"""Byte-level BPE by forced boundaries.

A merge can only join two symbols whose concatenation is a token, so two neighbouring bytes that stand side by side
in no token of the vocabulary are never joined: between them is a certain cut.  A pre-token is split at these cuts,
the fragments are encoded alone by rank-ordered merges, and their ids are concatenated.  Cuts are looked for in many
pre-tokens at once.  Fragments, pre-tokens and
blank-separated pieces of text repeat, so the latest of each are kept; pieces never share a pre-token.

Pre-tokens come from the tokenizer file's own rule and special tokens are recognised anywhere in a text, as the file
says.  Decoding joins the tokens' bytes and reads them as UTF-8 with replacement of what is not.

Edge cases.  Null and empty texts have no ids and decode to the empty text.  Repeated documents give a row each, an
empty table no rows; other columns are not read.  A very long text is cut the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwell.llm.chunks import Known, lone_blanks
from screenwell.llm.common import map_rows, named, tokenizer_file

#: Fragments that the library encodes at a time.
LOT = 1024
#: Bytes of text that are Python objects at a time, with their ids; a longer text counts alone.
SLICE = 4 << 20
#: A blank or none, Latin letters, stops or none.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)\\Z")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


#: What stands after a pre-token and at a cut where many are one text; neither is a byte's letter.
END, CUT = "\n", "\t"


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, most: int = 120_000) -> None:
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # the task's cores are Spark's to share out
        path = tokenizer_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Merges alone, by rank: it sees single fragments.
        self.merger = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letter = byte_letters()
        value = {letter: byte for byte, letter in enumerate(self.letter)}
        #: By the codes of two neighbours, whether there is a certain cut between them; never beside `END`, which is no byte's letter.
        self.apart = np.zeros((max(map(ord, self.letter)) + 1,) * 2, bool)
        self.apart[np.ix_(*[sorted(map(ord, self.letter))] * 2)] = True
        for a, b in {token[i:i + 2] for token in vocab for i in range(len(token) - 1)}:
            self.apart[ord(a), ord(b)] = False
        self.bytes_of = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.most = most
        self.forget()

    def forget(self) -> None:
        """Drop what was looked up; the vocabulary stays."""
        self.fragments, self.pretokens, self.pieces = Known(self.most), Known(self.most), Known(self.most // 2)

    def cut(self, pretokens: list[str]) -> list[str]:
        """Pre-tokens with a `CUT` at each certain cut, which are looked for in all at once."""
        whole = END.join(pretokens)
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        at = (np.flatnonzero(self.apart[codes[:-1], codes[1:]]) + 1).tolist()
        return CUT.join([whole[i:j] for i, j in zip([0, *at], [*at, len(whole)])]).split(END) if pretokens else []

    def cuts(self, letters: str) -> list[str]:
        """Fragments between certain cuts of a pre-token."""
        return self.cut([letters])[0].split(CUT)

    def _parts(self, piece: str) -> list[str | int]:
        """Pre-tokens (in byte letters) and special ids of a piece that shares no pre-token with its neighbours."""
        plain = _PLAIN.match(piece)
        if plain:   # a word and its stops are two pre-tokens; no need to ask the rule
            word, stops = plain.groups()
            if word.isascii():
                word = word.replace(" ", self.letter[32])   # other letters stand for themselves
            else:
                letter = self.letter
                word = "".join([letter[b] for b in word.encode()])
            return [word, stops] if stops else [word]
        out: list[str | int] = []
        for part in self.special_at.split(piece) if self.special_at else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [letters for letters, _ in self.pre.pre_tokenize_str(part)]
        return out

    def merge(self, ask: list[str], known: Known) -> None:
        """Put the ids of fragments, or of pre-tokens without a cut, among the known."""
        for at in range(0, len(ask), LOT):   # the library's results are large beside their ids
            lot = ask[at:at + LOT]
            known.update((f, packed(e.ids)) for f, e in zip(lot, self.merger.encode_batch_fast(lot, add_special_tokens=False)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit each; a batch's new pieces are worked out together."""
        cut = []
        for text in texts:
            first, *rest = lone_blanks(text or "")
            cut.append([first, *[" " + piece for piece in rest]])
        parts, blank = {}, self.letter[32]
        for piece in self.pieces.missing(set().union(*cut)):
            word = piece[1:]
            plain = word.isascii() and word.isalpha() and piece[0] == " "   # one pre-token, whose letters stand for themselves
            parts[piece] = blank + word if plain else self._parts(piece)
        new = list(self.pretokens.missing({p for ps in parts.values() for p in ([ps] if isinstance(ps, str) else ps) if isinstance(p, str)}))
        fragments = {letters: marked.split(CUT) for letters, marked in zip(new, self.cut(new)) if CUT in marked}
        self.merge([letters for letters in new if letters not in fragments], self.pretokens)
        self.merge(list(self.fragments.missing({f for fs in fragments.values() for f in fs})), self.fragments)
        of = self.fragments.__getitem__
        self.pretokens.update((letters, b"".join(map(of, fs))) for letters, fs in fragments.items())
        ids = self.pretokens
        self.pieces.update((piece, ids[ps] if isinstance(ps, str) else b"".join(
            [ids[p] if isinstance(p, str) else packed([p]) for p in ps])) for piece, ps in parts.items())
        of = self.pieces.__getitem__
        return [b"".join(map(of, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec per worker process, kept between tasks."""
    return Codec(path)


def few(texts: list, most: int = 1 << 20) -> Iterator[list]:
    """Texts in turn, about `most` characters (or one text) at a time."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens and ids (binary, little-endian unsigned 32-bit integers)."""
    def make():
        enc = codec(tokenizer).encode
        return lambda texts: ((len(ids) // 4, ids) for some in few(texts) for ids in enc(some))

    df = documents.select(named(key), named(text).alias("encoded text"))
    return map_rows(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], make, [key],
                    lambda: codec(tokenizer).forget(), SLICE)


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: text, the decoded ids (null: empty)."""
    def make():
        dec = codec(tokenizer).decode
        return lambda rows: ((dec(b or b""),) for b in rows)

    return map_rows(encoded.select(F.col(key), F.col(ids).alias("decoded ids")),
                    [T.StructField("text", T.StringType())], make, [key])


def round_trip(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; ids and decoded text stay inside the task."""
    def make():
        c = codec(tokenizer)

        def digest(texts):
            for some in few(texts):
                for ids in c.encode(some):
                    yield (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                           hashlib.sha256(c.decode(ids).encode()).hexdigest())

        return digest

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return map_rows(documents.select(named(key), named(text).alias("encoded text")), fields, make, [key],
                    lambda: codec(tokenizer).forget(), SLICE)
