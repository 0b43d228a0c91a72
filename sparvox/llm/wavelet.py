"""Token-ID output as one wavelet matrix per shard.

A shard file holds the ids of a run of documents, in ascending id order, as bit-planes: the first plane has every token's
highest bit in text order; the tokens with a 0 there then go before those with a 1, each part in order, and the next
plane has their next bit, and so on. With a count of ones before every 512 bits, rank and select take a plane's few
bytes, so the file alone answers: the token at a place, how often a token occurs in a range, where its k-th occurrence is.
Planes and directories are compressed (Zstandard) in independent blocks, read only as asked for.

File layout: 8 bytes of magic; the header's length (unsigned 64-bit, little-endian); the header, JSON: n (tokens), bits,
zeros (per plane), docs, and for each section (doc_ids, lengths, plane0.., rank0..) its blocks as [offset, stored size];
then the blocks.

write() lays out shards: documents are range-partitioned by id and sorted within partitions, and each task writes its run of
documents as one or more files (a new one after SHARD_TOKENS ids, so a task's memory has a bound; one longer document has
its own file). A file is written under a name of the attempt and then renamed, so a retried task leaves whole files.

Defined results: null text -> only the end id; null doc_id sorts first; rows with equal doc_id stay neighbours in an order
by text; an empty table gives no file; extra columns are not stored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvox.llm._texts import Chunked
from sparvox.llm.byte_bpe import PATTERN, byte_characters
from sparvox.runtime import cut, shared_path, workers_see_package

MAGIC = b"WVLTMTX1"
BLOCK_BITS = 1 << 19  # bits of a plane in a compressed block
SPAN = 512  # bits between counts of ones
RANKS_IN_BLOCK = 1 << 14
#: Ids after which a task starts a new file.
SHARD_TOKENS = 1 << 22
#: Bytes of text that a partition is meant to have.
PARTITION_BYTES = 8 << 20
NULL_ID = -(1 << 63)


def planes_of(values: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes from the highest bit down, and each plane's number of zeros."""
    planes, zeros = [], []
    for bit in range(bits - 1, -1, -1):
        ones = (values & values.dtype.type(1 << bit)).astype(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        high = np.flatnonzero(ones)
        low = np.flatnonzero(np.logical_not(ones, out=ones))
        zeros.append(len(low))
        values = np.concatenate((values.take(low), values.take(high)))
    return planes, zeros


def counts_of(plane: np.ndarray, n: int) -> np.ndarray:
    """Ones before every SPAN-th bit; the last entry counts all."""
    spans = -(-n // SPAN)
    padded = np.zeros(spans * SPAN // 8, np.uint8)
    padded[: len(plane)] = plane
    ones = np.bitwise_count(padded.reshape(spans, SPAN // 8)).sum(axis=1, dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones))).astype("<u8")


def serialise(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A shard file of documents with ids doc_ids, of lengths tokens each."""
    bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    planes, zeros = planes_of(tokens, bits)
    sections = {"doc_ids": (doc_ids.astype("<i8").tobytes(), 1 << 20), "lengths": (lengths.astype("<i8").tobytes(), 1 << 20)}
    for k, plane in enumerate(planes):
        sections[f"plane{k}"] = (plane.tobytes(), BLOCK_BITS // 8)
        sections[f"rank{k}"] = (counts_of(plane, len(tokens)).tobytes(), RANKS_IN_BLOCK * 8)
    where, body, at = {}, [], 0
    pack = zstandard.ZstdCompressor(level=1).compress
    for name, (raw, step) in sections.items():
        where[name] = []
        for i in range(0, len(raw), step):
            block = pack(raw[i : i + step])
            where[name].append([at, len(block)])
            body.append(block)
            at += len(block)
    head = json.dumps({"n": len(tokens), "bits": bits, "zeros": zeros, "docs": len(doc_ids), "sections": where}).encode()
    return b"".join((MAGIC, struct.pack("<Q", len(head)), head, *body))


class WaveletMatrix:
    """Reads a shard file; source has seek and read. Blocks are unpacked when first needed."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (size,) = struct.unpack("<Q", source.read(8))
        head = json.loads(source.read(size))
        self.n, self.bits, self.zeros, self.docs, self.sections = (head[k] for k in ("n", "bits", "zeros", "docs", "sections"))
        self.base = 16 + size
        self.inflate = zstandard.ZstdDecompressor().decompress
        self.block = lru_cache(maxsize=256)(self._block)

    def _block(self, section: str, k: int) -> bytes:
        at, size = self.sections[section][k]
        self.source.seek(self.base + at)
        return self.inflate(self.source.read(size))

    def _whole(self, section: str) -> bytes:
        return b"".join(self._block(section, k) for k in range(len(self.sections[section])))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Document ids and lengths, in order."""
        return np.frombuffer(self._whole("doc_ids"), "<i8"), np.frombuffer(self._whole("lengths"), "<i8")

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up: each step puts the two parts of a plane back in order."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(np.frombuffer(self._whole(f"plane{k}"), np.uint8), count=self.n, bitorder="little").view(bool)
            low, self_bit = self.zeros[k], out.dtype.type(1 << (self.bits - 1 - k))
            above = np.empty_like(out)
            above[np.flatnonzero(~ones)] = out[:low]
            above[np.flatnonzero(ones)] = out[low:] | self_bit
            out = above
        return out

    def _bit(self, k: int, i: int) -> int:
        return self.block(f"plane{k}", i // BLOCK_BITS)[i % BLOCK_BITS // 8] >> i % 8 & 1

    def _count(self, k: int, span: int) -> int:
        return struct.unpack_from("<Q", self.block(f"rank{k}", span // RANKS_IN_BLOCK), span % RANKS_IN_BLOCK * 8)[0]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before bit i."""
        span = i // SPAN
        found = self._count(k, span)
        if rest := i % SPAN:
            first = span * SPAN
            block = self.block(f"plane{k}", first // BLOCK_BITS)
            start = first % BLOCK_BITS // 8
            found += (int.from_bytes(block[start : start + SPAN // 8], "little") & (1 << rest) - 1).bit_count()
        return found

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit = self._bit(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return value

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """The range of the last order that holds the token's occurrences in [lo, hi)."""
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at places lo to hi - 1."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._narrow(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences before place i."""
        return self.count(token, 0, i)

    def _find(self, k: int, bit: int, nth: int) -> int:
        """The place in plane k of its nth (from 0) such bit."""
        lo, hi = 0, -(-self.n // SPAN) - 1
        before = lambda s: self._count(k, s) if bit else s * SPAN - self._count(k, s)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= nth else (lo, mid - 1)
        nth -= before(lo)
        i = lo * SPAN
        while True:
            if self._bit(k, i) == bit:
                if not nth:
                    return i
                nth -= 1
            i += 1

    def select(self, token: int, nth: int) -> int:
        """The place of the token's nth occurrence, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        lo, _ = self._narrow(token, 0, self.n)
        i = lo + nth
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._find(k, bit, i - self.zeros[k] if bit else i)
        return i


class Encoder:
    """The tokenizers library's ids of whole texts, chunks encoded once while cached.

    For a tokenizer that has only byte-level pre-tokens before a BPE model and nothing around it, chunks are split by the byte-level
    pattern and each pre-token goes to the library's model; any other tokenizer gets its chunks whole. Texts that hold an added
token's content go through the library whole, which gives them that token's id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre = parts.get("pre_tokenizer") or {}
        straight = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        straight = straight and parts["model"]["type"] == "BPE" and not parts.get("normalizer")
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_characters()))
        self.space = self.table[0x20]
        find = regex.compile(PATTERN).findall
        split = find if straight else (lambda c: [c])
        self.chunked = Chunked(split, self._pretokens if straight else self._whole, words=straight).encode
        added = parts.get("added_tokens") or []
        self.added = [a["content"] for a in added]
        # What is matched after a normaliser needn't be in the text as it stands.
        self.always = bool(parts.get("normalizer")) and any(a.get("normalized") for a in added)

    def encode(self, texts: list[str]) -> Iterable[bytes]:
        odd = [k for k, t in enumerate(texts) if self.always or any(c in t for c in self.added)]
        if not odd:
            return self.chunked(texts)
        rest = set(range(len(texts))).difference(odd)
        out = dict(zip(odd, self._whole([texts[k] for k in odd])))
        out |= zip(sorted(rest), self.chunked([texts[k] for k in sorted(rest)]))
        return [out[k] for k in range(len(texts))]

    def _pretokens(self, pretokens: list[str]) -> list[bytes]:
        tokenize, table = self.model.tokenize, self.table
        mapped = [p if p.isascii() and p.isprintable() else p.encode("utf-8", "replace").decode("latin-1").translate(table) for p in pretokens]
        pieces = "\n".join(mapped).replace(" ", self.space).split("\n") if mapped else []  # no piece holds a line feed
        return [array("I", [t.id for t in tokenize(p)]).tobytes() for p in pieces]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_batches(batches: Iterator[pa.RecordBatch], uri: str, tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    """Writes the batches' documents as shard files; gives a row for each file."""
    from pyarrow import fs
    from pyspark import TaskContext

    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
    tail = struct.pack("<I", end)
    ids: list[int] = []
    runs: list[np.ndarray] = []
    held = seq = 0

    def flush() -> pa.RecordBatch:
        name = f"{root}/shard-{part:06d}-{seq:06d}.wm"
        temporary = f"{name}.{uuid.uuid4().hex}"
        lengths = np.array([len(r) for r in runs])
        tokens = np.concatenate(runs)
        with system.open_output_stream(temporary) as out:
            out.write(serialise(np.array(ids), lengths, tokens.astype(np.uint16) if tokens.max() < 1 << 16 else tokens))
        system.move(temporary, name)
        return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "docs": [len(ids)], "tokens": [int(lengths.sum())]}, schema=MANIFEST)

    for batch in batches:
        texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for doc_id, raw in zip(batch.column(0).to_pylist(), encode(texts)):
            ids.append(NULL_ID if doc_id is None else doc_id)
            runs.append(np.frombuffer(raw + tail, "<u4"))
            held += len(runs[-1])
            if held >= SHARD_TOKENS:
                yield flush()
                ids, runs, held, seq = [], [], 0, seq + 1
    if ids:
        yield flush()


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def read_batches(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """For each manifest row (path, base): its documents with their place in all shards and the ids, from the file alone."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(uri)
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            with system.open_input_file(path) as source:
                matrix = WaveletMatrix(source)
                doc_ids, lengths = matrix.documents()
                tokens = matrix.tokens().astype("<u4")
            ends = np.cumsum(lengths)
            for k in range(0, len(doc_ids), 512):
                some = slice(k, k + 512)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([None if d == NULL_ID else d for d in doc_ids[some].tolist()], pa.int64()),
                        "start": pa.array((base + ends[some] - lengths[some]).tolist(), pa.int64()),
                        "ids": pa.array([tokens[e - n : e].tobytes() for e, n in zip(ends[some].tolist(), lengths[some].tolist())], pa.binary()),
                    }
                )


def write(df: DataFrame, uri: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Encodes every text, appends the end id, writes shards below uri. Returns the manifest: part, seq, path, docs, tokens, base.

    base is the number of ids in all files before, so a place in the whole output is a file and a place in it. The
    manifest has a row for each file (of some megabytes), so its running sum in one task stays small.
    """
    workers_see_package(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import wavelet

        return wavelet.write_batches(batches, uri, tokenizer, end)

    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = cut(ordered.mapInArrow(run, "part int, seq int, path string, docs long, tokens long"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, ids (binary, unsigned 32-bit little-endian) of every document in the manifest's files."""
    workers_see_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import wavelet

        return wavelet.read_batches(batches, uri)

    manifest = cut(manifest)
    files = max(1, manifest.count())
    return manifest.select("path", "base").repartition(files).mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """Writes df as shards in the shared folder and reads them: doc_id, start, n_tokens, ids_crc32."""
    spark = df.sparkSession
    uri = shared_path(spark, "wavelet")
    back = read(spark, write(df, uri, tokenizer), uri)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
