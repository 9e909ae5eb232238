"""PNG pictures: 8-bit RGB and RGBA, not interlaced, as rows and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {2: 3, 6: 4}
PICTURES = "frame_no long, width int, height int, rgba binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """A picture whose rows are not filtered."""
    if len(rgba) != width * height * 4 or not width or not height:
        raise ValueError("a picture has four bytes a sample, and samples")
    lines = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    body = np.concatenate([np.zeros((height, 1), np.uint8), lines], 1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for k, v in enumerate(line.tolist(), step):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            # the neighbour nearest to their plane; left, then above, then the corner win ties
            guess = min((a, b, c), key=lambda n, p=a + b - c: abs(p - n))
        out[k] = (v + guess) & 0xFF
    return out[step:].astype(np.uint8)


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA samples; a picture without alpha is opaque."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, body = 8, None, []
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(content) != size or zlib.crc32(kind + content) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit colour without interlace is read")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    above, lines = np.zeros(width * step, np.uint8), []
    for line in raw:
        if line[0] > 4:
            raise ValueError("an unknown filter")
        above = _unfiltered(int(line[0]), line[1:], above, step)
        lines.append(above)
    samples = np.stack(lines).reshape(height, width, step)
    if step == 3:
        samples = np.concatenate([samples, np.full((height, width, 1), 255, np.uint8)], 2)
    return width, height, samples.tobytes()


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each of (frame_no, width, height, rgba) below ``folder``, a URI that all executors share: (frame_no, path, bytes). A repeated task writes the same files again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for frame, width, height, rgba in zip(*(batch.column(c).to_pylist() for c in ("frame_no", "width", "height", "rgba")), strict=True):
                data = encode(width, height, rgba)
                with store.open_output_stream(f"{root}/{frame:012d}.png", compression=None) as f:
                    f.write(data)
                out.append((frame, f"{folder}/{frame:012d}.png", len(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["frame_no", "path", "bytes"])

    return pictures.mapInArrow(run, "frame_no long, path string, bytes long")


def read_pictures(files: DataFrame) -> DataFrame:
    """Pictures of Spark's binaryFile rows (path, content); a file's number is its frame."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(path.rsplit("/", 1)[1].split(".")[0]), *decode(content)) for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["frame_no", "width", "height", "rgba"])

    return files.select("path", "content").mapInArrow(run, PICTURES)
