"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

A rank file (token bytes -> rank) already holds a whole BPE model: the merge of two neighbours is allowed when their
concatenation is a token, and the lowest rank goes first. A sentencepiece BPE model says the same with scores: it merges
the neighbours whose concatenation is the piece of highest score. So the model is serialised directly, nothing is
trained: every token becomes a piece, its bytes mapped one by one to printable characters, its score the negative rank,
its piece id the rank. The normaliser is the identity: no dummy prefix, no white-space rules.

Texts are split by the tokenizer's pattern; each match (pre-token) is encoded by itself. A pre-token that is a token as a
whole is that token, as in the rank file's own library. Encoded pre-tokens are kept in a bounded cache of the worker.

Defined results: null text -> encoded as the empty text (no ids, decoded to no bytes); repeated rows and ties are encoded
alike, row by row; bytes that are not UTF-8 are read as U+FFFD; extra columns pass through untouched, and a column that
has the name of an output is replaced. Texts have no length limit; a batch holds as many rows as Arrow gives.
"""

from __future__ import annotations

import base64
import struct
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvox.llm._texts import Chunked
from sparvox.runtime import workers_see_package

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 stays, the rest moves above U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256))
    return [chr(b) if b in keep else chr(256 + next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the positions of the tokens in rank order; the last is <unk>.

    Ranks must be below 2**24, so that a 32-bit score holds each exactly.
    """
    if ranks and max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks of 2**24 and above have no exact 32-bit score")
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.rank_of_piece = [r for _, r in sorted((r, r) for r in ranks.values())]
        self.straight = self.rank_of_piece == list(range(len(ranks)))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters()))
        self.space = self.table[0x20]
        #: Tokens by the characters of their bytes.
        self.whole = {t.decode("latin-1").translate(self.table): struct.pack("<I", r) for t, r in ranks.items()}
        known = pattern == PATTERN
        #: Only the known pattern is sure to have a match's edge wherever texts are cut.
        self.texts = Chunked(self.find, self._encode_pretokens).encode if known else lambda texts: map(b"".join, map(self._encode_pretokens, map(self.find, texts)))

    def _piece(self, pretoken: str) -> str:
        """The pre-token's bytes as the characters that pieces are made of."""
        if pretoken.isascii() and pretoken.isprintable():
            return pretoken.replace(" ", self.space)
        return pretoken.encode("utf-8", "replace").decode("latin-1").translate(self.table)

    def _encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, each encoded by itself; a pre-token that is a token is that token."""
        pieces = list(map(self._piece, pretokens))
        ids = list(map(self.whole.get, pieces))
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, run in zip(rest, self.model.encode([pieces[i] for i in rest], num_threads=1)):
            ids[i] = array("I", run if self.straight else [self.rank_of_piece[r] for r in run]).tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        return list(self.texts(texts))

    def decode(self, ids: bytes) -> bytes:
        """The bytes whose encoding the ids are: the inverse of the vocabulary's mapping, token by token."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_array(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    return pa.array(codec(path, pattern).encode([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()]), pa.binary())


def decode_array(ids: pa.Array, path: str, pattern: str) -> pa.Array:
    decode = codec(path, pattern).decode
    return pa.array([decode(i) if i else b"" for i in ids.to_pylist()], pa.binary())


def encode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """Adds column ids: binary, the text's token ids as little-endian unsigned 32-bit integers."""
    workers_see_package(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        from sparvox.llm import byte_bpe

        return byte_bpe.encode_array(texts, path, pattern)

    return df.withColumn(ids, F.arrow_udf(run, "binary")(df[text].cast("binary")))


def decode(df: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded", pattern: str = PATTERN) -> DataFrame:
    """Adds column decoded: binary, the bytes that the ids stand for. An id outside the vocabulary is an error."""
    workers_see_package(df.sparkSession)

    def run(values: pa.Array) -> pa.Array:
        from sparvox.llm import byte_bpe

        return byte_bpe.decode_array(values, path, pattern)

    return df.withColumn(decoded, F.arrow_udf(run, "binary")(df[ids]))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode and decode."""
    both = decode(encode(df.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
