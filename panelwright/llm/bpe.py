"""Byte-level BPE through a sentencepiece model made from a rank file (operator 7).

A rank file lists byte strings, the lower rank merged first. Each byte becomes one character, so the
byte strings become pieces of a sentencepiece BPE model, scored by minus their rank: sentencepiece
merges the highest score first and the leftmost of equals, which is the order of the rank file. The
model is written here as protocol buffer bytes, with identity normalisation and no added prefix, so a
piece's position, its id and its rank are one number.

Nothing is shuffled: each Arrow batch splits its texts into pre-tokens, encodes the pre-tokens it has
not met yet and joins the packed ids. Every worker builds the model once from the rank file's bytes,
which the task closure carries (a fixed vocabulary of under 1 MB).

Null and empty texts have no tokens and decode to no bytes. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelwright.llm.common import steps
from panelwright.sources.session import ship

#: Characters U+0100 to U+01FF stand for the bytes 0 to 255: letters all, none of them white space.
FIRST_CHAR = 0x100
#: Pre-tokens whose ids a task keeps before it starts afresh, and the longest of them.
CACHED, CACHED_CHARS = 100_000, 32


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's byte strings and ranks; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} are not consecutive from 0")
    return ranks


_CHARS = {b: FIRST_CHAR + b for b in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARS)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the unknown piece follows them."""
    normal, unknown = 1, 2
    out = bytearray()
    for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = _block(1, to_chars(data).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal)
        out += _block(1, piece)
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    bpe = 2
    out += _block(2, _number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, len(ranks)))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes texts to packed ids and back; one per worker process."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()
        self.pieces = [to_bytes(self.model.id_to_piece(i)) for i in range(self.unknown)]
        self.whole = {piece: struct.pack("<I", i) for i, piece in enumerate(self.pieces)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: a piece of the vocabulary is itself, others are merged. Short ones are kept."""
        rest, found = [], {}
        for token in tokens:
            ids = self.whole.get(token.encode())
            if ids is None:
                rest.append(token)
            else:
                found[token] = ids
        for token, ids in zip(rest, self.model.encode([to_chars(t.encode()) for t in rest], num_threads=1), strict=True):
            if self.unknown in ids:
                raise ValueError(f"a byte of {token!r} is not in the vocabulary")
            found[token] = struct.pack(f"<{len(ids)}I", *ids)
        self.known.update((t, ids) for t, ids in found.items() if len(t) <= CACHED_CHARS)
        return found

    def encode(self, texts) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; new pre-tokens are merged in one call."""
        split = [self.split(t or "") for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        if new := set().union(*split).difference(known):
            found = self._learn(new)
            known = known if all(len(t) <= CACHED_CHARS for t in found) else ChainMap(known, found)
        return [b"".join(map(known.__getitem__, tokens)) for tokens in split]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def coded(df: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True) -> DataFrame:
    """df with ``token_ids`` (array<int>), ``ids_sha256`` of the ids as little-endian unsigned 32-bit integers, and, unless
    decode is false, ``decoded``: the bytes that the ids stand for.

    Columns of these names in df are replaced. Batches go out in small steps, so a worker holds
    the ids of few texts at a time.
    """
    model = serialise_model(read_ranks(path))
    base = df.drop("token_ids", "ids_sha256", "decoded")
    out = T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType())])
    if decode:
        out.add("decoded", T.BinaryType())

    names = out.names

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model, pattern)
        one.known.clear()
        for batch in batches:
            for at, n in steps(batch.column(text)):
                part = batch.slice(at, n)
                packed = one.encode(part.column(text).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                made = [ids, pa.array([hashlib.sha256(x).hexdigest() for x in packed])]
                if decode:
                    made.append(pa.array([one.decode(np.frombuffer(x, "<i4").tolist()) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)
        one.known.clear()

    ship(df.sparkSession)
    return base.mapInArrow(code, out)
