"""WARC archives: a writer of response and revisit records, and a sequential reader.

Each record is a gzip member of its own. The reader takes a file as a stream of blocks of BLOCK bytes, inflates it member by member with
an incremental zlib decompressor, reads the header up to its empty line, then exactly Content-Length bytes of block and the two line
ends, and checks the block's and the payload's SHA-1. It never seeks and holds one record at a time; a record that is cut
short, badly framed or whose digest differs is an error that names the file and the member's place in it.

Of records with equal payloads (equal digest and length) that with the largest page_id is the response, the others are revisits that
refer to it; payloads shorter than LEAST bytes are always responses. Which one it is comes from one row for each digest, so pages
meet it by a join on the digest. A digest with many copies is no hot task: digests on more than 1/HOT of all pages are at most HOT
rows, which are broadcast; the rest is shuffled.

Files are named by partition, written under the attempt's own name and then renamed, records in order of page_id: a lost executor's task is
just run again.

Defined results: null html: an empty payload; null page_id: written as a response, never referred to, read back as null; rows with the
same, largest page_id and equal payloads are all responses; null url: an empty target; empty tables give no files; extra columns aren't
written. Payloads of any length are written and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvox.runtime import cut, shared_path, workers_see_package

BLOCK = 1 << 16
#: Payloads of fewer bytes get no revisit records.
LEAST = 0
#: Digests with over 1/HOT of all rows are joined by broadcast.
HOT = 1000
ROWS_PER_FILE = 4096
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = 0x8B1E4E0C5D7A4F69 << 64


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN that carries the page's id; without one, it is random."""
    return (uuid.UUID(int=_NAMESPACE | page_id & (1 << 64) - 1) if page_id is not None else uuid.uuid4()).urn


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn).int
    if value >> 64 << 64 != _NAMESPACE:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response record with the payload, or a revisit record with its HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[5:5] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """The archive isn't what its framing or digests say."""


class Member:
    """Reads one gzip member of a stream; what lies behind it is left in rest."""

    def __init__(self, source, ahead: bytes):
        self.source, self.inflater, self.out, self.rest = source, zlib.decompressobj(31), bytearray(), b""
        self._feed(ahead)

    def _feed(self, data: bytes) -> None:
        self.out += self.inflater.decompress(data)
        if self.inflater.eof:
            self.rest = self.inflater.unused_data

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        data = self.source.read(BLOCK)
        if not data:
            raise Damaged("the file ends within a record")
        self._feed(data)
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)
            if not self._more():
                raise Damaged("the record's header doesn't end")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise Damaged("the record is shorter than its Content-Length")
        found = bytes(self.out[:n])
        del self.out[:n]
        return found

    def finish(self) -> bytes:
        """Checks that nothing follows the record in its member; gives the bytes behind the member."""
        while self._more():
            if len(self.out) > 4:
                break
        if bytes(self.out) != b"\r\n\r\n":
            raise Damaged("the record is longer than its Content-Length")
        return self.rest


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the fields by lower-cased name."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of an archive, in order, verified."""
    ahead = source.read(BLOCK)
    while ahead:
        member = Member(source, ahead)
        version, fields = headers(member.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise Damaged("not a WARC record")
        if not fields.get("content-length", "").isdigit():
            raise Damaged("no Content-Length")
        block = member.exactly(int(fields["content-length"]))
        ahead = member.finish() or source.read(BLOCK)
        if fields.get("warc-block-digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
            raise Damaged("the block's digest differs")
        yield fields, block


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length, digest and (of a response) bytes of a record's payload, verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = int(headers(head)[1]["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return length, digest, None
    if len(body) != length:
        raise Damaged("the payload isn't as long as its header says")
    if sha1(body) != digest:
        raise Damaged("the payload's digest differs")
    return length, digest, body


def digest_array(payloads: pa.Array) -> pa.Array:
    return pa.array([sha1(p or b"") for p in payloads.to_pylist()])


def write_batches(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Writes each partition's records to files of up to ROWS_PER_FILE; gives (path, records, bytes)."""
    from pyarrow import fs
    from pyspark import TaskContext

    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    part, seq, out, n, size, temporary = TaskContext.get().partitionId(), 0, None, 0, 0, ""

    def close() -> pa.RecordBatch:
        out.close()
        path = f"{root}/part-{part:06d}-{seq:06d}.warc.gz"
        system.move(temporary, path)
        return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to"))):
            if out is None:
                temporary = f"{root}/{uuid.uuid4().hex}.part"
                out = system.open_output_stream(temporary, compression=None)
            page_id, url, payload, digest, refers_to = row
            member = record(page_id, url, payload or b"", digest, refers_to)
            out.write(member)
            n, size = n + 1, size + len(member)
            if n >= ROWS_PER_FILE:
                yield close()
                out, n, size, seq = None, 0, 0, seq + 1
    if out is not None:
        yield close()


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_batches(batches: Iterator[pa.RecordBatch], uri: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(uri)
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())))
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held, k = [], 0, -1
            with system.open_input_stream(path, compression=None) as source:
                records = read_records(source)
                while True:
                    try:
                        k += 1
                        fields, block = next(records)
                        length, digest, body = payload_of(fields, block)
                    except StopIteration:
                        break
                    except (Damaged, zlib.error, KeyError, ValueError) as e:
                        raise Damaged(f"{path}, member {k}: {e}") from e
                    refers_to = page_of(fields["warc-refers-to"].strip("<>")) if "warc-refers-to" in fields else None
                    page_id = page_of(fields["warc-record-id"].strip("<>"))
                    rows.append((page_id, fields.get("warc-target-uri"), fields["warc-type"], refers_to, length, digest, body if payloads else None))
                    held += len(body or b"") if payloads else 64
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def write(df: DataFrame, uri: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Writes df's pages below uri; returns path, records, bytes of each file."""
    workers_see_package(df.sparkSession)

    def digests(payloads: pa.Array) -> pa.Array:
        from sparvox.llm import warc

        return warc.digest_array(payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import warc

        return warc.write_batches(batches, uri)

    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.arrow_udf(digests, "string")("payload")).withColumn("size", F.octet_length("payload"))
    pages = pages.withColumn("same", F.concat("digest", F.lit(":"), F.col("size").cast("string")))
    first = cut(pages.where(F.col("size") >= least).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")))
    rows = pages.count()
    repeated = first.where("n > 1")
    hot = F.broadcast(repeated.where(F.col("n") > rows / HOT).select("same", F.col("first").alias("hot_first")))
    with_hot = pages.join(hot, "same", "left")
    # A hot digest's rows have no match among the others: they go by page_id's hash instead of piling up.
    key = F.when(F.col("hot_first").isNull(), F.col("same")).otherwise(F.concat(F.lit("hot"), F.xxhash64("page_id").cast("string")))
    files = max(1, -(-rows // ROWS_PER_FILE))
    # Payloads are shuffled once, by the join's own key, into the partitions that become files.
    placed = with_hot.withColumn("key", key).repartition(files, "key")
    cold = repeated.where(F.col("n") <= rows / HOT).select(F.col("same").alias("key"), F.col("first").alias("cold_first")).repartition(files, "key")
    target = F.coalesce("hot_first", "cold_first")
    final = placed.join(cold, "key", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != target, target).alias("refers_to"))
    ordered = final.sortWithinPartitions("page_id", "digest", "url")
    return cut(ordered.mapInArrow(run, "path string, records long, bytes long"))


def read(spark: SparkSession, files: DataFrame, uri: str, *, payloads: bool = True) -> DataFrame:
    """A row (RECORD) for each record of the files, each file read from front to back; payloads: with the responses' bytes."""
    workers_see_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import warc

        return warc.read_batches(batches, uri, payloads)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, RECORD)


def round_trip(df: DataFrame) -> DataFrame:
    """Writes df's pages to the shared folder and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    uri = shared_path(df.sparkSession, "warc")
    files = write(df, uri)
    return read(df.sparkSession, files, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
