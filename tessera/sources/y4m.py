"""Y4M as a Spark data source: ``spark.dataSource.register(Y4M)``, then ``spark.read.format("y4m").load(path)``.

Frames have one length, so a file is read in slices of frames by several tasks, each with an offset of its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

SIGNATURE, MARK = b"YUV4MPEG2 ", b"FRAME\n"
SCHEMA = "frame_no long, width int, height int, fps int, y binary, cb binary, cr binary"


def parse_header(head: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, rate as a fraction, and the header's length."""
    line, end, _ = head.partition(b"\n")
    if not end or not line.startswith(SIGNATURE):
        raise ValueError("not a Y4M file")
    tags = {t[:1]: t[1:] for t in line.decode("ascii").split()[1:]}
    width, height = int(tags.get("W", 0)), int(tags.get("H", 0))
    rate = re.fullmatch(r"(\d+):(\d+)", tags.get("F", "30:1"))
    if width <= 0 or height <= 0 or not rate or not int(rate[2]):
        raise ValueError("a Y4M header without width, height or a rate")
    return width, height, int(rate[1]), int(rate[2]), len(line) + 1


def plane_sizes(width: int, height: int) -> tuple[int, int, int]:
    chroma = ((width + 1) // 2) * ((height + 1) // 2)
    return width * height, chroma, chroma


class _Slice(InputPartition):
    def __init__(self, path: str, skip: int, first: int, count: int):
        self.path, self.skip, self.first, self.count = path, skip, first, count


def _open(path: str):
    store, name = pafs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Reader(DataSourceReader):
    """Of a folder, the files in order of their names; their frames are numbered on."""

    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames

    def _files(self) -> list[str]:
        store, name = pafs.FileSystem.from_uri(self.path)
        if store.get_file_info(name).type != pafs.FileType.Directory:
            return [self.path]
        found = store.get_file_info(pafs.FileSelector(name))
        return sorted(f"{self.path.rstrip('/')}/{f.base_name}" for f in found if f.base_name.endswith(".y4m"))

    def partitions(self):
        out, first = [], 0
        for path in self._files():
            with _open(path) as f:
                width, height, _, _, start = parse_header(f.read(4096))
                count, rest = divmod(f.size() - start, len(MARK) + sum(plane_sizes(width, height)))
            if rest:
                raise ValueError("the last frame is cut off")
            out += [_Slice(path, k, first + k, min(self.frames, count - k)) for k in range(0, count, self.frames)]
            first += count
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with _open(partition.path) as f:
            width, height, num, den, start = parse_header(f.read(4096))
            sizes = plane_sizes(width, height)
            f.seek(start + partition.skip * (len(MARK) + sum(sizes)))
            for k in range(partition.count):
                if f.read(len(MARK)) != MARK:
                    raise ValueError("a frame without its mark")
                yield (partition.first + k, width, height, num // den, *(f.read(n) for n in sizes))


class _Writer(DataSourceWriter):
    """An ordered partition is a file, written under a name of its own; commit gives it its place. Several partitions make a folder of files, in the order of the partitions."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        store, name = pafs.FileSystem.from_uri(self.path)
        out, own, last = None, f"{name}.{uuid.uuid4().hex}", -1
        for r in rows:
            if out is None:
                out = store.open_output_stream(own, compression=None)
                out.write(SIGNATURE + f"W{r.width} H{r.height} F{r.fps}:1 Ip A0:0 C420mpeg2 XYSCSS=420JPEG\n".encode())
            if r.frame_no <= last:
                raise ValueError("frames must come in order in each partition")
            if (len(r.y), len(r.cb), len(r.cr)) != plane_sizes(r.width, r.height):
                raise ValueError("planes must be 4:2:0")
            last = r.frame_no
            out.write(MARK + bytes(r.y) + bytes(r.cb) + bytes(r.cr))
        if out is not None:
            out.close()
        message = WriterCommitMessage()
        message.name = own if out is not None else None
        return message

    def commit(self, messages):
        store, name = pafs.FileSystem.from_uri(self.path)
        written = [m.name for m in messages if m is not None and m.name]
        if not written:
            raise ValueError("there is no frame to write")
        if len(written) == 1:
            store.move(written[0], name)
            return
        store.create_dir(name, recursive=True)
        for k, part in enumerate(written):
            store.move(part, f"{name}/part-{k:06d}.y4m")

    def abort(self, messages):
        store, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(m.name)


class _StreamReader(SimpleDataSourceStreamReader):
    """A file that grows: the frames that are whole, so many a batch at most, so a reader that falls behind holds no more than these."""

    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        with _open(self.path) as f:
            width, height, _, _, head = parse_header(f.read(4096))
            whole = (f.size() - head) // (len(MARK) + sum(plane_sizes(width, height)))
        stop = min(whole, start["frame"] + self.frames)
        return self._frames(start["frame"], stop), {"frame": stop}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._frames(start["frame"], end["frame"])

    def _frames(self, first: int, stop: int) -> Iterator[tuple]:
        return iter(list(_Reader(self.path, self.frames).read(_Slice(self.path, first, first, stop - first))))

    def commit(self, end: dict) -> None:
        pass


class Y4M(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("framesPerTask", 16)))

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options["path"], int(self.options.get("framesPerBatch", 2)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])
