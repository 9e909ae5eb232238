"""Folds over live frames: groups of frames, key frames, rate control. The same pure steps, (state, frame) -> (state, result), run over a table and over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def folded(rows: DataFrame, key: str, order: str, values: list[str], step: Step, schema: str, last_only: bool = False) -> DataFrame:
    """A fold over each key's rows in order: (key, order, results), or with ``last_only`` (key, results of the last row). A task holds one state, however long a key's rows are."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = f"{key} {rows.schema[key].dataType.simpleString()}, " + ("" if last_only else f"{order} {rows.schema[order].dataType.simpleString()}, ") + schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, kept, schema_of = None, object(), None, None
        for batch in batches:
            out = []
            schema_of = batch.schema
            for k, at, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if last_only and kept is not None:
                        out.append(kept)
                    state, now = None, k
                state, found = step(state, tuple(frame))
                kept = (k, *found)
                if not last_only:
                    out.append((k, at, *found))
            if out:
                yield _batch(out, schema_of)
        if last_only and kept is not None:
            yield _batch([kept], schema_of)

    def _batch(out: list[tuple], source: pa.Schema) -> pa.RecordBatch:
        known = [source.types[0]] if last_only else source.types[:2]
        arrays = [pa.array(c, known[i] if i < len(known) else None) for i, c in enumerate(zip(*out, strict=True))]
        return pa.RecordBatch.from_arrays([a.cast(pa.int32()) if i >= len(known) and kinds[i - len(known)] == "int" else a for i, a in enumerate(arrays)], [key, *([] if last_only else [order]), *names])

    kinds = [part.split()[1] for part in schema.split(", ")]
    return rows.select(key, order, *values).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, columns)


def stream_folded(rows: DataFrame, key: str, order: str, values: list[str], step: Step, schema: str, state_schema: str) -> DataFrame:
    """folded() over a stream; each key's state goes from batch to batch. Frames of a batch are put in order."""
    names = [key, order, *(part.split()[0] for part in schema.split(", "))]

    def run(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, out = tuple(state.get) if state.exists else None, []
        for at, *frame in pd.concat(list(frames)).sort_values(order)[[order, *values]].itertuples(index=False):
            now, found = step(now, tuple(int(v) for v in frame))
            out.append((keys[0], at, *found))
        state.update(now)
        yield pd.DataFrame(out, columns=names)

    columns = f"{key} {rows.schema[key].dataType.simpleString()}, {order} {rows.schema[order].dataType.simpleString()}, {schema}"
    return rows.groupBy(key).applyInPandasWithState(run, columns, state_schema, "append", "NoTimeout")


# Groups of frames

GROUPS = "is_copy boolean, is_key boolean, scene long, gop long, position int"
SESSIONS = f"user_id long, event_id long, {GROUPS}"
STATE = "last long, scene long, gop long, position int"


def step(state: tuple | None, v: int, threshold: int, interval: int) -> tuple[tuple, tuple]:
    """One frame: (state, (is_copy, is_key, scene, gop, position)); a cut or a full group starts the next one."""
    last, scene, gop, position = state or (None, 0, 0, -1)
    cut = last is not None and abs(v - last) > threshold
    position = 0 if cut or position + 1 == interval else position + 1
    scene, gop = scene + cut, gop + (position == 0)
    return (v, scene, gop, position), (last == v, position == 0, scene, gop, position)


def stream_sessions(rows: DataFrame, threshold: int, interval: int) -> DataFrame:
    """A row for each frame of a streaming (user_id, event_id, v)."""
    return stream_folded(rows, "user_id", "event_id", ["v"], lambda state, frame: step(state, frame[0], threshold, interval), GROUPS, STATE)


class Keys(NamedTuple):
    last: int = 0
    since: int = 0  #: frames since the last key frame, with it; 0 before the first frame
    mean: int = 0  #: smoothed distortion
    distortion: int = 0


def drifting(mean: int, distortion: int) -> bool:
    """The last distortion is more than twice the smoothed one, and more than 32."""
    return 0 < mean * 2 < distortion and distortion > 32


def key_step(state: tuple | None, frame: tuple, threshold: int, interval: int) -> tuple[tuple, tuple]:
    """One frame (value, forced): it is a key frame if it is the first, after a cut, asked for, due, or if the distortion drifts; (is_key, reason, drifts)."""
    s, (v, forced) = Keys(*(state or ())), frame
    change = abs(v - s.last) if s.since else 0
    drifts = drifting(s.mean, s.distortion)
    reasons = (("first", not s.since), ("cut", change > threshold), ("forced", bool(forced)), ("due", s.since >= interval), ("drift", drifts))
    reason = next((name for name, holds in reasons if holds), None)
    distortion = change // 100
    mean = (s.mean * 7 + distortion) // 8 if s.mean else distortion
    return Keys(v, 1 if reason else s.since + 1, mean, distortion), (reason is not None, reason, drifts)


def key_frames(rows: DataFrame, threshold: int, interval: int) -> DataFrame:
    """(user_id, event_id, is_key, reason, drifts) of (user_id, event_id, v, forced); the stand-in for a frame's distortion is a hundredth of its change."""
    return folded(rows, "user_id", "event_id", ["v", "forced"], lambda state, frame: key_step(state, frame, threshold, interval), "is_key boolean, reason string, drifts boolean")


def smoothed_step(state: tuple | None, frame: tuple) -> tuple[tuple, tuple]:
    """Exponential averages (4a + x) / 5 and (7a + x) / 8 in integers, truncated, reseeded where they are 0."""
    mean = lambda a, x, w: _truncated((a or x) * w + x, w + 1)
    now = tuple(mean(a, frame[0], w) for a, w in zip(state or (0, 0), (4, 7), strict=True))
    return now, now


def _truncated(a: int, b: int) -> int:
    return a // b if a >= 0 else -(-a // b)


# Rate control


class RateConfig(NamedTuple):
    """Bits a second, frames a second, frames a group, and the key frames' step."""

    bitrate: int
    rate: int
    interval: int
    base: int


class Rate(NamedTuple):
    """Bits left and in all of this group, frames left; smoothed change; bits, step, change, smoothed and last distortion of the last frame."""

    left: int = 0
    target: int = 0
    frames: int = 0
    mean_sad: int = 0
    bits: int = 0
    step: int = 0
    sad: int = 0
    mean_distortion: int = 0
    distortion: int = 0


RATE_STATE = ", ".join(f"{f} long" for f in Rate._fields)
#: Fixed values in 1/65536: the limits of a ratio, and the least weights of a new step in a falling and in another change.
RATIO_LIMITS, FALLING, STEADY = (13_107, 327_680), 29_491, 19_661


def _ratio(a: int, b: int) -> int:
    return min(RATIO_LIMITS[1], max(RATIO_LIMITS[0], (a << 16) // max(1, b)))


def rate_step(state: tuple | None, frame: tuple, config: RateConfig) -> tuple[tuple, tuple]:
    """One frame (is_key, change, bits, distortion): its share of the bits and its step. Bits that are None are the share of a key frame, and eight times the change over the step of others; a distortion that is None is a 64th of the change.

    A key frame opens a group: the group's bits with what the last one left, up to as much again, and a share with a floor. Another frame's
    step is that of the frame before, scaled by how its bits, carried over by the change of content, compare with the share that is left; it is drawn
    to the smoothed distortion, and mixed with the step before, more so the less content changes."""
    s, (is_key, sad, bits, distortion) = Rate(*(state or ())), frame
    if is_key:
        usual = config.bitrate * config.interval // config.rate
        target = usual + min(usual, max(0, s.left))
        share = max(1000, config.bitrate * 6 // config.rate, target * 5 // (config.interval + 4))
        return s._replace(left=target - (share if bits is None else bits), target=target, frames=config.interval - 1), (share, config.base)
    low, high = max(1, config.base), max(config.base * 2, min(512, config.base * 4))
    bounded = lambda v: max(low, min(high, v))
    mean = ((s.mean_sad or sad) * 4 + sad) // 5
    share = max(s.target // 50, s.left // max(1, s.frames)) * _ratio(sad, mean) >> 16
    step = config.base * 3 // 2
    if min(s.bits, s.step, s.sad) > 0:
        step = bounded(s.step * (s.bits * _ratio(sad, s.sad) >> 16) // max(1, share))
    if min(s.distortion, s.mean_distortion) > 0:
        step = bounded((step + step * s.mean_distortion // s.distortion) // 2)
    if min(s.step, mean) > 0:
        change = (sad << 16) // mean
        weight = max(FALLING if change < 32_768 else STEADY, min(65_536, change))
        step = bounded(step * weight + s.step * (65_536 - weight) >> 16)
    step = bounded(step)
    bits, distortion = sad * 8 // step if bits is None else bits, sad // 64 if distortion is None else distortion
    smooth = (s.mean_distortion * 7 + distortion) // 8 if s.mean_distortion else distortion
    return Rate(s.left - bits, s.target, s.frames - 1, mean, bits, step, sad, smooth, distortion), (share, step)


def _estimated(config: RateConfig) -> Step:
    return lambda state, frame: rate_step(state, (*frame, None, None), config)


def rate_steps(rows: DataFrame, config: RateConfig) -> DataFrame:
    """(user_id, event_id, share, step) for each of (user_id, event_id, is_key, sad)."""
    return folded(rows, "user_id", "event_id", ["is_key", "sad"], _estimated(config), "share long, step long")


def stream_rate_steps(rows: DataFrame, config: RateConfig) -> DataFrame:
    """rate_steps() over a stream."""
    return stream_folded(rows, "user_id", "event_id", ["is_key", "sad"], _estimated(config), "share long, step long", RATE_STATE)


# Decoding


def decode_groups(packets: DataFrame) -> DataFrame:
    """(stream_id, frame_no, picture, problem) of (stream_id, frame_no, kind, samples): an I packet is a picture, a P packet what is added to the one before, a COPY packet repeats that. Groups are decoded apart, from an I packet on; packets before the first one have no reference and are set aside with a problem."""
    grouped = packets.withColumn("gop", F.sum((F.col("kind") == "I").cast("int")).over(W.partitionBy("stream_id").orderBy("frame_no").rowsBetween(W.unboundedPreceding, 0)))

    def decode(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("frame_no", "kind", "samples")), strict=True)), key=lambda r: r[0])
        now, out = None, []
        for frame, kind, samples in rows:
            if kind == "I":
                now = np.array(samples, np.int64)
            elif now is not None and kind == "P":
                now = now + np.array(samples, np.int64)
            out.append((key[0].as_py(), frame, None if now is None else now.tolist(), "no reference" if now is None else None))
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["stream_id", "frame_no", "picture", "problem"])

    return grouped.groupBy("stream_id", "gop").applyInArrow(decode, "stream_id string, frame_no long, picture array<long>, problem string")
