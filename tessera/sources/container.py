"""The packet container: native columns for headers and payloads, and a cutter for whole streams.

``packets`` has stream_id, frame_no, kind ('I', 'P' or 'COPY') and the payloads mvs, ref_dir, layer0, layer1 and layer2, null where
absent. Projection to fewer layers on that table is column pruning.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.coding import grouped as variable_length

#: Fixed values of the format: the magic, the header after its two length bytes, and the frame kinds.
MAGIC = bytes((0x56, 0x45, 0x56, 0x43))
HEADER = struct.Struct(">BHHBHBB")
KINDS = {"P": 0, "COPY": 1, "I": 2}
HAS_DIRECTIONS = 0x10
PAYLOADS = ("mvs", "ref_dir", "layer0", "layer1", "layer2")
PACKETS = "stream_id string, frame_no long, kind string, " + ", ".join(f"{p} binary" for p in PAYLOADS)


class BadStream(ValueError):
    """The bytes are no stream, or end too early."""


def file_header(width: int, height: int, rate: int) -> bytes:
    body = HEADER.pack(1, width, height, 1, rate, 0, 0)
    return MAGIC + struct.pack(">H", len(body)) + body


def read_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, rate, and where the packets begin."""
    if data[:4] != MAGIC or len(data) < 6:
        raise BadStream("no magic")
    (size,) = struct.unpack_from(">H", data, 4)
    if size < HEADER.size or len(data) < 6 + size:
        raise BadStream("the header is too short")
    profile, width, height, _, rate, _, tables = HEADER.unpack_from(data, 6)
    if profile != 1 or tables:
        raise BadStream("unknown profile or tables")
    return width, height, rate, 6 + size


def read_variable_length(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for used in range(6):
        if at + used >= len(data):
            raise BadStream("a length is cut off")
        value = value << 7 | data[at + used] & 0x7F
        if data[at + used] < 0x80:
            return value, at + used + 1
    raise BadStream("a length is too long")


def layer_record(step_y: int, step_c: int, levels: bytes | None, planes: tuple[bytes, bytes, bytes]) -> bytes:
    parts = ([] if levels is None else [levels]) + list(planes)
    return struct.pack(">HH", step_y, step_c) + b"".join(variable_length(len(p)) + p for p in parts)


def read_layer_record(data: bytes, with_levels: bool) -> tuple[int, int, bytes | None, tuple[bytes, bytes, bytes]]:
    if len(data) < 4:
        raise BadStream("a layer is cut off")
    (y, c), at, parts = struct.unpack_from(">HH", data), 4, []
    for _ in range(4 if with_levels else 3):
        size, at = read_variable_length(data, at)
        if at + size > len(data):
            raise BadStream("a layer is cut off")
        parts.append(data[at : at + size])
        at += size
    return y, c, parts.pop(0) if with_levels else None, tuple(parts)


def packet_bytes() -> Column:
    """A packet's bytes from its columns, without Python: flags, five sizes, payloads."""
    size = lambda c: F.unhex(F.lpad(F.hex(F.coalesce(F.octet_length(c), F.lit(0))), 8, "0"))
    flag = F.when(F.col("kind") == "I", KINDS["I"]).otherwise(KINDS["P"]) + F.when(F.coalesce(F.octet_length("ref_dir"), F.lit(0)) > 0, HAS_DIRECTIONS).otherwise(0)
    whole = F.concat(F.unhex(F.lpad(F.hex(flag), 2, "0")), *(size(p) for p in PAYLOADS), *(F.coalesce(F.col(p), F.lit(b"")) for p in PAYLOADS))
    return F.when(F.col("kind") == "COPY", F.lit(b"\x01")).otherwise(whole)


def write_streams(packets: DataFrame, width: int, height: int, rate: int) -> DataFrame:
    """(stream_id, data): each stream's file; rows of a stream come to one task in order, one packet at a time."""
    head = file_header(width, height, rate)

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [row for b in batches for row in zip(b.column("frame_no").to_pylist(), b.column("packet").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"stream_id": pa.array([key[0].as_py()], pa.string()), "data": pa.array([head + b"".join(p for _, p in sorted(parts))], pa.binary())})

    return packets.select("stream_id", "frame_no", packet_bytes().alias("packet")).groupBy("stream_id").applyInArrow(join, "stream_id string, data binary")


def write_files(packets: DataFrame, folder: str, width: int, height: int, rate: int) -> DataFrame:
    """Writes a file for each stream below ``folder``, a URI that all executors share, packet by packet: (stream_id, path, bytes). A task holds one batch of packets, however long a stream is; a repeated task writes the same files again."""
    head = file_header(width, height, rate)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, out, size = None, None, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"stream_id": pa.array([now], pa.string()), "path": [f"{folder}/{now}.stream"], "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for stream, packet in zip(batch.column("stream_id").to_pylist(), batch.column("packet"), strict=True):
                if out is None or stream != now:
                    if out is not None:
                        yield done()
                    now, out, size = stream, store.open_output_stream(f"{root}/{stream}.stream", compression=None), len(head)
                    out.write(head)
                out.write(packet.as_buffer())
                size += len(packet.as_buffer())
        if out is not None:
            yield done()

    rows = packets.select("stream_id", "frame_no", packet_bytes().alias("packet")).repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    return rows.select("stream_id", "packet").mapInArrow(run, "stream_id string, path string, bytes long")


def cut_file(source: pa.NativeFile, strict: bool = True) -> Iterator[tuple]:
    """cut_stream() of an open file, packet by packet."""
    head = source.read(6)
    if len(head) < 6 or head[:4] != MAGIC:
        raise BadStream("no magic")
    read_header(head + source.read(struct.unpack(">H", head[4:])[0]))
    frame = 0
    while flag := source.read(1):
        kind = next((k for k, v in KINDS.items() if v == flag[0] & 0x0F), None)
        if kind is None:
            raise BadStream(f"unknown packet {flag[0]}")
        if kind == "COPY":
            yield frame, kind, (None,) * 5
        else:
            lengths = source.read(20)
            sizes = struct.unpack(">5I", lengths) if len(lengths) == 20 else ()
            parts = [source.read(n) if n else None for n in sizes]
            if not sizes or any(len(p or b"") != n for p, n in zip(parts, sizes, strict=True)):
                if strict:
                    raise BadStream("a packet is cut off")
                return
            if bool(flag[0] & HAS_DIRECTIONS) != bool(sizes[1]):
                raise BadStream("directions and their flag differ")
            yield frame, kind, tuple(parts)
        frame += 1


_PACKET_TYPES = (pa.string(), pa.int64(), pa.string(), *(pa.binary(),) * 5)


def read_files(files: DataFrame, strict: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """``packets`` of (stream_id, path), read packet by packet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "frame_no", "kind", *PAYLOADS]
        for batch in batches:
            for stream, path in zip(batch.column("stream_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for n, kind, parts in cut_file(source, strict):
                        rows.append((stream, n, kind, *parts))
                        size += 100 + sum(len(p or b"") for p in parts)
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKET_TYPES, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKET_TYPES, strict=True)], names)

    return files.select("stream_id", "path").mapInArrow(run, PACKETS)


def checked_streams(files: DataFrame) -> DataFrame:
    """(stream_id, frames, problem) of (stream_id, data): how many packets can be read, and what is wrong with the rest; bad streams are set aside, not raised."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                frames, problem = 0, None
                try:
                    for _ in cut_stream(data):
                        frames += 1
                except BadStream as e:
                    problem = str(e)
                out.append((stream, frames, problem))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["stream_id", "frames", "problem"])

    return files.select("stream_id", "data").mapInArrow(run, "stream_id string, frames long, problem string")


def cut_stream(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """(frame number, kind, payloads) of each packet; a truncated end is an error, or with ``strict`` off the end."""
    _, _, _, at = read_header(data)
    frame = 0
    while at < len(data):
        flag = data[at]
        kind = next((k for k, v in KINDS.items() if v == flag & 0x0F), None)
        if kind is None:
            raise BadStream(f"unknown packet {flag}")
        at += 1
        if kind == "COPY":
            yield frame, kind, (None,) * 5
        else:
            if at + 20 > len(data) or at + 20 + sum(sizes := struct.unpack_from(">5I", data, at)) > len(data):
                if strict:
                    raise BadStream("a packet is cut off")
                return
            if bool(flag & HAS_DIRECTIONS) != bool(sizes[1]):
                raise BadStream("directions and their flag differ")
            at += 20
            parts = []
            for size in sizes:
                parts.append(data[at : at + size] if size else None)
                at += size
            yield frame, kind, tuple(parts)
        frame += 1


def read_streams(files: DataFrame, strict: bool = True) -> DataFrame:
    """``packets`` of (stream_id, data), as read by Spark's binaryFile source or from write_streams()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                rows = [(stream, n, kind, *parts) for n, kind, parts in cut_stream(data, strict)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), *(pa.binary(),) * 5), strict=True)], ["stream_id", "frame_no", "kind", *PAYLOADS])

    return files.mapInArrow(run, PACKETS)


def keep_layers(packets: DataFrame, highest: int) -> DataFrame:
    """The layers up to ``highest``; the others are null, and a scan of a column format doesn't read them."""
    if highest not in (0, 1, 2):
        raise ValueError("the highest layer is 0, 1 or 2")
    return packets.select(*(F.lit(None).cast("binary").alias(c) if c in [f"layer{k}" for k in range(highest + 1, 3)] else F.col(c) for c in packets.columns))


def dropped_bytes(packets: DataFrame, highest: int) -> DataFrame:
    """(frames, kept_bytes, dropped_bytes) of a projection."""
    total = lambda names: sum((F.coalesce(F.sum(F.octet_length(n)), F.lit(0)) for n in names), F.lit(0).cast("long"))
    return packets.agg(F.count("*").alias("frames"), total([*PAYLOADS[:2], *(f"layer{k}" for k in range(highest + 1))]).cast("long").alias("kept_bytes"), total([f"layer{k}" for k in range(highest + 1, 3)]).cast("long").alias("dropped_bytes"))


RECORDS = "key long, step_y int, step_c int, levels binary, y binary, cb binary, cr binary"


def write_layers(layers: DataFrame) -> DataFrame:
    """(key, record) of ``layers``: steps, levels, which may be null, and the payloads of three planes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("step_y", "step_c", "levels", "y", "cb", "cr")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([layer_record(sy, sc, levels, planes) for sy, sc, levels, *planes in rows], pa.binary())], ["key", "record"])

    return layers.select("key", "step_y", "step_c", "levels", "y", "cb", "cr").mapInArrow(run, "key long, record binary")


def read_layers(records: DataFrame, with_levels: bool) -> DataFrame:
    """Inverse of write_layers()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, sy, sc, levels, *planes) for k, (sy, sc, levels, planes) in zip(b.column("key").to_pylist(), (read_layer_record(r, with_levels) for r in b.column("record").to_pylist()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), *(pa.binary(),) * 4), strict=True)], ["key", "step_y", "step_c", "levels", "y", "cb", "cr"])

    return records.select("key", "record").mapInArrow(run, RECORDS)


def vector_count(width: Column, height: Column) -> Column:
    """Motion vectors of a frame: blocks of 8x8 at a quarter of its size, every division rounded up."""
    up = lambda v, n: F.floor((v + (n - 1)) / n)
    blocks = lambda v: up(up(up(v, 2), 2), 8)
    return (blocks(width) * blocks(height)).cast("long")
