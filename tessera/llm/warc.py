"""WARC archives as a chunked record table.

A payload is cut where it is read, and travels as (record, chunk number) rows of ``chunk_bytes`` at most, in order, to the task that writes
it; the writer compresses and digests chunk by chunk, each record a gzip member of its own, and starts a new
file once one is large enough. A record is named by its page and its row, so names are unique where pages repeat. The reader streams the files back as (record, chunk number) rows, each with the digest
of the payload so far; neither side of the Python code holds a whole record.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, that with the smallest page_id is a response and the
others are revisits that refer to it. Equal payloads are found by digest; the rows of one digest are salted, so a
payload that a third of all pages share is spread over many tasks.

Files have unique names and count only if the task that wrote them is in the manifest, which is cut by a
checkpoint; a lost or repeated task leaves at most files that nobody reads.

Defined results: a null payload is empty; payloads below the limit are always responses; rows that share a page_id and payload are all
of the same type; a null page_id is written as such and read back as null, and is larger than any other; a null url
becomes the record's own name; an empty table writes no file and reads no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, scratch

MIN_REVISIT = 100
CHUNK_BYTES = 256 << 10
FILE_BYTES = 128 << 20
SALTS = 16
#: A date that does not depend on when the job runs.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page: int | None, row: int) -> str:
    """A record's name: its page, and its row, since pages may repeat."""
    return f"<urn:page:{'null' if page is None else page}:{row}>"


def _head(page: int | None, row: int, url: str | None, size: int, digest: str, refers: int | None, refers_row: int | None) -> bytes:
    """Record header and HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page, row)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers, refers_row)}"]
    block = len(http) + (size if refers is None else 0)
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n" + http).encode()


def _write(folder: str, file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = packer = sha = None
        name, records, size = "", 0, 0

        def manifest() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page, row, url, n, digest, refers, refers_row, chunk, chunks, data in zip(*(batch.column(c) for c in ("page_id", "row", "url", "n", "digest", "refers_to", "refers_row", "chunk", "chunks", "data")), strict=True):
                if chunk.as_py() == 0:
                    if out is not None and size >= file_bytes:
                        out.close()
                        yield manifest()
                        out = None
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packer, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
                    size += out.write(packer.compress(_head(page.as_py(), row.as_py(), url.as_py(), n.as_py(), digest.as_py(), refers.as_py(), refers_row.as_py()))) or 0
                body = data.as_buffer() if data.is_valid else b""
                sha.update(body)
                part = packer.compress(body)
                out.write(part)
                size += len(part)
                if chunk.as_py() == chunks.as_py() - 1:
                    if refers.as_py() is None and sha.hexdigest() != digest.as_py():
                        raise ValueError(f"page {page}: the chunks do not make up the payload")
                    part = packer.compress(b"\r\n\r\n") + packer.flush()
                    out.write(part)
                    size += len(part)
                    records += 1
        if out is not None:
            out.close()
            yield manifest()

    return run


CUT = "page_id long, row long, url string, n long, digest string, chunk int, chunks int, data binary"


def _cut_payloads(chunk_bytes: int):
    """A row for each chunk of each payload; chunks are views of the payload until they are sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        names = [part.split()[0] for part in CUT.split(", ")]
        for piece in (p for batch in batches for p in T.pieces([batch], "body", 4 * T.PIECE_BYTES)):
            rows: list[tuple] = []
            for page, row, url, body in zip(*(piece.column(c) for c in ("page_id", "row", "url", "body")), strict=True):
                payload = memoryview(body.as_buffer()) if body.is_valid else memoryview(b"")
                digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                chunks = max(1, -(-size // chunk_bytes))
                held = 0
                for k in range(chunks):
                    part = payload[k * chunk_bytes : (k + 1) * chunk_bytes]
                    rows.append((page.as_py(), row.as_py(), url.as_py(), size, digest, k, chunks, bytes(part)))
                    held += len(part)
                    if held >= 4 * T.PIECE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def write_warc(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) below ``folder``, a URI that all executors share; the manifest (path, records, bytes)."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body")).withColumn("row", F.monotonically_increasing_id())
    # only digests are compared; payloads travel as chunks, cut before any of them moves
    digests = named.select("page_id", "row", F.octet_length("body").alias("n"), F.sha2("body", 256).alias("digest"))
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("s")
    twins = digests.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(smallest, F.count("*").alias("copies")).where("copies > 1").select("digest", F.col("s.page_id").alias("first"), F.col("s.row").alias("first_row"))
    spread = cut(twins).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chunks = named.select("page_id", "row", "url", "body").mapInArrow(_cut_payloads(chunk_bytes), CUT)
    joined = chunks.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = joined.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("refers_row", F.when(revisit, F.col("first_row"))).where("refers_to is null or chunk = 0")
    first = F.col("refers_to").isNull()
    rows = marked.select("page_id", "row", "url", "n", "digest", "refers_to", "refers_row", "chunk", F.when(first, F.col("chunks")).otherwise(1).alias("chunks"), F.when(first, F.col("data")).alias("data"))
    return cut(rows.sortWithinPartitions("digest", "row", "chunk").mapInArrow(_write(folder, file_bytes), "path string, records long, bytes long"))


class _Stream:
    """The bytes of a file of gzip members, read and unpacked piece by piece."""

    def __init__(self, source: pa.NativeFile, piece: int):
        self.source, self.piece, self.raw, self.ready = source, piece, b"", b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data or self.raw, zlib.decompressobj(31)
            data = self.raw or self.source.read(self.piece)
            if not data:
                return False
            found = self.unpack.decompress(data, self.piece)
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if found:
                self.ready += found
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends inside a header")
                return None
        head, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces."""
        while size:
            if not self.ready and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null):\d+>", name)
    if not found:
        raise ValueError(f"not a record of this writer: {name}")
    return None if found[1] == "null" else int(found[1])


CHUNKS = "page_id long, chunk long, last boolean, payload_bytes long, payload_digest string, record_type string, refers_to long, data binary"


def _read(chunk_bytes: int, with_data: bool, last_only: bool):
    schema = pa.schema([("page_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("data", pa.binary())])

    def records(path: str) -> Iterator[tuple]:
        store, name = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as source:
            stream = _Stream(source, min(chunk_bytes, 64 << 10))
            while (head := stream.until(b"\r\n\r\n")) is not None:
                fields = _fields(head)
                kind, page = fields["warc-type"], _page(fields["warc-record-id"])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                http = stream.until(b"\r\n\r\n")
                size = int(fields["content-length"]) - len(http) - 4
                if kind == "revisit":
                    yield page, 0, True, int(_fields(http)["content-length"]), digest, kind, _page(fields["warc-refers-to"]), None
                else:
                    sha, done, chunk, held, got = hashlib.sha256(), 0, 0, [], 0
                    for part in stream.take(size):
                        sha.update(part)
                        done += len(part)
                        got += len(part)
                        if with_data:
                            held.append(part)
                        if got >= chunk_bytes and done < size:
                            if not last_only:
                                yield page, chunk, False, done, sha.hexdigest(), kind, None, b"".join(held) if with_data else None
                            chunk, held, got = chunk + 1, [], 0
                    if sha.hexdigest() != digest:
                        raise ValueError(f"page {page}: the payload does not have its digest")
                    yield page, chunk, True, done, digest, kind, None, b"".join(held) if with_data else None
                if b"".join(stream.take(4)) != b"\r\n\r\n":
                    raise ValueError(f"page {page}: no end of record")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in records(path):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4 * T.PIECE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True, last_only: bool = False) -> DataFrame:
    """The chunk table of the manifest's files; payload_bytes and payload_digest are those of the payload up to and with this chunk, of a revisit those of the payload it stands for."""
    return manifest.select("path").mapInArrow(_read(chunk_bytes, with_data, last_only), CHUNKS)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back: one row a record."""
    manifest = write_warc(pages, folder or scratch(pages.sparkSession, "warc"))
    return read_warc(manifest, with_data=False, last_only=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH named AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM named),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM digests WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN f.first END AS refers_to
FROM digests d LEFT JOIN firsts f USING (payload_digest)
"""
