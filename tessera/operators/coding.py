"""Entropy coding: the state recurrence is bit-serial, so each block or lane is coded by an Arrow function; models come from the relational side."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.planes import from_median_residuals, median_residuals

#: The state's lower bound, the scale of the frequencies in bits, and the size of a renormalised word.
FLOOR, SCALE_BITS, WORD_BITS = 1 << 15, 14, 16
#: A state of so many times a symbol's frequency must shrink first.
LIMIT = (FLOOR >> SCALE_BITS) << WORD_BITS


def encode(symbols: Sequence[int], freqs: Sequence[int], cums: Sequence[int]) -> bytes:
    """Range-ANS from the last symbol to the first; big-endian words, the last one first."""
    state, words = FLOOR, []
    for s in reversed(symbols):
        f = freqs[s]
        while state >= f * LIMIT:
            words.append(state & 0xFFFF)
            state >>= WORD_BITS
        state = ((state // f) << SCALE_BITS) + state % f + cums[s]
    words += [state & 0xFFFF, state >> WORD_BITS]
    return b"".join(w.to_bytes(2, "big") for w in reversed(words))


def decode(data: bytes, count: int, freqs: Sequence[int], cums: Sequence[int], table: Sequence[int]) -> list[int]:
    """Inverse of encode(); ``table`` has the symbol of each slot."""
    state, at, out, mask = int.from_bytes(data[:4], "big"), 4, [], (1 << SCALE_BITS) - 1
    for _ in range(count):
        slot = state & mask
        s = table[slot]
        out.append(s)
        state = freqs[s] * (state >> SCALE_BITS) + slot - cums[s]
        while state < FLOOR:
            if at > len(data) + 2:
                raise ValueError("the symbols are cut off")
            state = state << WORD_BITS | int.from_bytes(data[at : at + 2].ljust(2, b"\0"), "big")
            at += 2
    return out


class BitWriter:
    """Most significant bit first."""

    def __init__(self):
        self.value, self.count = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value, self.count = self.value << bits | value & (1 << bits) - 1, self.count + bits

    def bytes(self) -> bytes:
        pad = -self.count % 8
        return (self.value << pad).to_bytes((self.count + pad) // 8, "big")


class BitReader:
    """Zeros follow the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def get(self, bits: int) -> int:
        self.left -= bits
        return (self.value >> self.left if self.left >= 0 else self.value << -self.left) & (1 << bits) - 1


def pack_levels(levels: Sequence[int]) -> bytes:
    """Runs of levels: three bits each, then the length less one in groups of seven bits, lowest first; all at the usual level take no bytes."""
    if all(x == 2 for x in levels):
        return b""
    out, at = BitWriter(), 0
    while at < len(levels):
        stop = at + 1
        while stop < len(levels) and levels[stop] == levels[at]:
            stop += 1
        out.put(levels[at], 3)
        rest = stop - at - 1
        while rest >= 128:
            out.put(rest & 0x7F | 0x80, 8)
            rest >>= 7
        out.put(rest, 8)
        at = stop
    return out.bytes()


def unpack_levels(data: bytes, count: int) -> list[int]:
    if not data:
        return [2] * count
    bits, out = BitReader(data), []
    while len(out) < count:
        level, run, shift = bits.get(3), 0, 0
        while (part := bits.get(8)) & 0x80:
            run, shift = run | (part & 0x7F) << shift, shift + 7
        out += [level] * ((run | part << shift) + 1)
    return out[:count]


def code_blocks(blocks: DataFrame, freqs: Sequence[int]) -> DataFrame:
    """(frame, tokens) -> (frame, n, data) with one model."""
    cums = [sum(freqs[:k]) for k in range(len(freqs))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("tokens").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array([len(r) for r in rows], pa.int32()), pa.array([encode(r, freqs, cums) for r in rows], pa.binary())], ["frame", "n", "data"])

    return blocks.select("frame", "tokens").mapInArrow(run, "frame long, n int, data binary")


def uncode_blocks(coded: DataFrame, freqs: Sequence[int]) -> DataFrame:
    """Inverse of code_blocks()."""
    cums = [sum(freqs[:k]) for k in range(len(freqs))]
    table = [s for s, f in enumerate(freqs) for _ in range(f)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decode(d, n, freqs, cums, table) for d, n in zip(b.column("data").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array(rows, pa.list_(pa.int32()))], ["frame", "tokens"])

    return coded.mapInArrow(run, "frame long, tokens array<int>")


# Several lanes

LANES = 4


def encode_lanes(lanes: Sequence[Sequence[tuple[int, int]]]) -> bytes:
    """Range-ANS of the (frequency, cumulated frequency) pairs of each lane, a state a lane over one row of words: as they are read, the states first, then lane by lane."""
    states, words = [FLOOR] * len(lanes), []
    for k in reversed(range(len(lanes))):
        state = FLOOR
        for f, c in reversed(lanes[k]):
            while state >= f * LIMIT:
                words.append(state & 0xFFFF)
                state >>= WORD_BITS
            state = ((state // f) << SCALE_BITS) + state % f + c
        states[k] = state
    for state in reversed(states):
        words += [state & 0xFFFF, state >> WORD_BITS]
    return b"".join(w.to_bytes(2, "big") for w in reversed(words))


class LaneReader:
    """Inverse of encode_lanes(); symbols are asked for lane by lane, each with its model. Zeros follow the end."""

    def __init__(self, data: bytes, lanes: int = LANES):
        self.data, self.at = data, 4 * lanes
        self.states = [int.from_bytes(data[4 * k : 4 * k + 4].ljust(4, b"\0"), "big") for k in range(lanes)]

    def symbol(self, lane: int, model: Model) -> int:
        state, slot = self.states[lane], self.states[lane] & (1 << SCALE_BITS) - 1
        found = model.symbols[slot]
        state = model.freqs[found] * (state >> SCALE_BITS) + slot - model.cums[found]
        while state < FLOOR:
            if self.at > len(self.data) + 2:
                raise ValueError("the symbols are cut off")
            state = state << WORD_BITS | int.from_bytes(self.data[self.at : self.at + 2].ljust(2, b"\0"), "big")
            self.at += 2
        self.states[lane] = state
        return found


# Models


class Model:
    """Frequencies of 64 tokens that add up to 2^14, and what follows from them."""

    def __init__(self, freqs: Sequence[int]):
        self.freqs = list(freqs)
        self.cums = [0, *accumulate(self.freqs)][:-1]
        self.symbols = [s for s, f in enumerate(self.freqs) for _ in range(f)]

    @classmethod
    def of(cls, counts: Sequence[int]) -> Model:
        """The normalised model of a histogram; see models.normalise()."""
        scale, total = 1 << SCALE_BITS, sum(counts)
        if not total:
            return cls([scale // len(counts)] * len(counts))
        room = scale - sum(c == 0 for c in counts)
        freqs = [max(1, room * c // total) if c else 1 for c in counts]
        while (over := sum(freqs) - scale) != 0:
            freqs[freqs.index(max(freqs))] -= min(over, 1)
        return cls(freqs)

    def bits(self, counts: Sequence[int]) -> int:
        """256 times the bits of the counted tokens, by the linear logarithm of scalar.log2_q8()."""
        log = lambda v: (v.bit_length() - 1) * 256 + ((v - (1 << v.bit_length() - 1)) * 256 >> v.bit_length() - 1)
        return sum(c * (SCALE_BITS * 256 - log(f)) for c, f in zip(counts, self.freqs, strict=True) if c)

    def table(self) -> bytes:
        """A bitmap of the frequencies above 1, then each in a byte, or above 127 in two with the top bit set."""
        big = [(k, f) for k, f in enumerate(self.freqs) if f > 1]
        return sum(1 << k for k, _ in big).to_bytes(8, "big") + b"".join(f.to_bytes(1, "big") if f < 128 else (f | 0x8000).to_bytes(2, "big") for _, f in big)

    @classmethod
    def read_table(cls, data: bytes, at: int) -> tuple[Model, int]:
        if at + 8 > len(data):
            raise ValueError("a table is cut off")
        bitmap, at, freqs = int.from_bytes(data[at : at + 8], "big"), at + 8, [1] * 64
        for k in range(64):
            if bitmap >> k & 1:
                size = 2 if data[at : at + 1] >= b"\x80" else 1
                if at + size > len(data):
                    raise ValueError("a table is cut off")
                freqs[k] = int.from_bytes(data[at : at + size], "big") & 0x7FFF
                at += size
        if sum(freqs) != 1 << SCALE_BITS:
            raise ValueError("a table does not add up")
        return cls(freqs), at


#: Contexts of a pair: 2 for a zero parent plus 1 after a value; residuals of the low band; places.
CONTEXTS, RESIDUAL, PLACE = 6, 4, 5
#: A histogram's counts in a stream are capped here.
CAP = 65_535
Histograms = list[list[int]]
Selector = Callable[[Histograms, Histograms], tuple[str, list[Model], list[Model]]]


def cheapest(runs: Histograms, values: Histograms) -> tuple[str, list[Model], list[Model]]:
    """The uniform models, one merged pair, or each context's own, whichever costs least with its tables; ties in that order."""
    flat = Model([(1 << SCALE_BITS) // 64] * 64)
    merged = [Model.of([sum(c) for c in zip(*kind, strict=True)]) for kind in (runs, values)]
    own = [[Model.of(c) for c in kind] for kind in (runs, values)]
    header = lambda models: sum(8 * len(m.table()) for m in models) * 256
    choices = [("static", [[flat] * CONTEXTS] * 2, 0), ("merged", [[m] * CONTEXTS for m in merged], header(merged)), ("own", own, header(own[0] + own[1]))]
    cost = lambda models, head: head + sum(m.bits(c) for kind, counts in zip(models, (runs, values), strict=True) for m, c in zip(kind, counts, strict=True))
    name, models, _ = min(choices, key=lambda x: cost(x[1], x[2]))
    return name, *models


# Pairs of a run of zeros and a value


def signed_token(v: int) -> tuple[int, int, int]:
    """Token, bypass bits and their length; see scalar.signed_token()."""
    size, sign = abs(v), int(v < 0)
    if size <= 15:
        return (2 * size - 1 + sign if v else 0), 0, 0
    bits = (size - 16).bit_length()
    return 32 + bits, ((size - 16 - (1 << bits >> 1)) << 1) | sign, max(bits, 1)


def signed_width(token: int) -> int:
    return 0 if token < 32 else max(token - 32, 1)


def signed_value(token: int, bypass: int) -> int:
    if token < 32:
        return (token + 1) // 2 * (1 if token % 2 else -1)
    bits = token - 32
    size = 16 + (1 << bits >> 1) + (bypass >> 1)
    return -size if bypass & 1 else size


def unsigned_token(v: int) -> tuple[int, int, int]:
    if v < 32:
        return v, 0, 0
    bits = (v - 32).bit_length()
    return 32 + bits, (v - 32) - (1 << bits >> 1), max(bits - 1, 0)


def unsigned_width(token: int) -> int:
    return max(token - 33, 0)


def unsigned_value(token: int, bypass: int) -> int:
    return token if token < 32 else 32 + (1 << (token - 32) >> 1) + bypass


def grouped(value: int) -> bytes:
    """Groups of seven bits, the highest first; all but the last have the top bit set."""
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def sized(data: bytes) -> bytes:
    """Bytes after their length."""
    return grouped(len(data)) + data


def _length(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for used in range(at, at + 6):
        if used >= len(data):
            break
        value = value << 7 | data[used] & 0x7F
        if data[used] < 0x80:
            return value, used + 1
    raise ValueError("a length is cut off")


def _sized(data: bytes, at: int) -> tuple[bytes, int]:
    size, at = _length(data, at)
    if at + size > len(data):
        raise ValueError("a part is cut off")
    return data[at : at + size], at + size


#: Flags of a pair stream: plain bits, uniform models, merged models, zeros after the last pair.
RAW, STATIC, MERGED, TRAILING = 0x80, 0x40, 0x10, 0x01
#: Up to so many pairs are written as plain bits.
FEW = 32
Pair = tuple[int, int, int]


def encode_pairs(pairs: Sequence[Pair], flags: bytes = b"", count: int = 0, trailing: int = 0, select: Selector = cheapest) -> bytes:
    """The stream of (run, value, context) pairs, with the caller's flag bits and count before them. ``select`` may be any function from histograms to models."""
    out = [sized(flags), grouped(count)]
    if not pairs and not trailing:
        return b"".join(out)
    if len(pairs) <= FEW:
        bits = BitWriter()
        for run, value, _ in pairs:
            token, bypass, width = signed_token(value)
            for v, n in ((1, run + 1), (token, 6), (bypass, width)):
                bits.put(v, n)
        bits.put(0, trailing)
        return b"".join([*out, bytes([RAW]), sized(bits.bytes())])
    runs, values = ([[0] * 64 for _ in range(CONTEXTS)] for _ in range(2))
    base, rest = divmod(len(pairs), LANES)
    lanes, at, bypasses = [], 0, []
    for k in range(LANES):
        stop, symbols, bits = at + base + (k < rest), [], BitWriter()
        for run, value, context in pairs[at:stop]:
            for token, counts, kind in ((unsigned_token(run), runs, 0), (signed_token(value), values, 1)):
                bits.put(token[1], token[2])
                counts[context][token[0]] += 1
                symbols.append((kind, context, token[0]))
        if trailing and k == LANES - 1:
            token = unsigned_token(trailing)
            bits.put(token[1], token[2])
            runs[0][token[0]] += 1
            symbols.append((0, 0, token[0]))
        lanes.append(symbols)
        bypasses.append(sized(bits.bytes()))
        at = stop
    name, *models = select(*([[min(c, CAP) for c in row] for row in kind] for kind in (runs, values)))
    out.append(bytes([{"static": STATIC, "merged": MERGED, "own": 0}[name] | (TRAILING if trailing else 0)]))
    out.append(grouped(len(pairs) + bool(trailing)))
    if name != "static":
        out += [kind[c].table() for c in range(1 if name == "merged" else CONTEXTS) for kind in models]
    out += bypasses
    out.append(encode_lanes([[(models[kind][c].freqs[t], models[kind][c].cums[t]) for kind, c, t in symbols] for symbols in lanes]))
    return b"".join(out)


class PairReader:
    """Reads a pair stream; each pair is asked for with its context."""

    def __init__(self, data: bytes):
        self.flags, at = _sized(data, 0)
        self.count, at = _length(data, at)
        self.pairs = self.done = self.trailing = 0
        self.raw: BitReader | None = None
        if at == len(data):
            return
        flag, at = data[at], at + 1
        if flag & RAW:
            body, _ = _sized(data, at)
            self.raw = BitReader(body)
            return
        entries, at = _length(data, at)
        self.trailing = flag & TRAILING
        self.pairs = entries - self.trailing
        if flag & STATIC:
            self.models = [[Model([(1 << SCALE_BITS) // 64] * 64)] * CONTEXTS] * 2
        else:
            found = []
            for _ in range(2 if flag & MERGED else 2 * CONTEXTS):
                model, at = Model.read_table(data, at)
                found.append(model)
            self.models = [[found[k]] * CONTEXTS if flag & MERGED else found[k::2] for k in range(2)]
        self.bypass = []
        for _ in range(LANES):
            part, at = _sized(data, at)
            self.bypass.append(BitReader(part))
        self.lanes = LaneReader(data[at:])
        base, rest = divmod(self.pairs, LANES)
        self.ends = list(accumulate(base + (k < rest) for k in range(LANES)))

    def pair(self, context: int) -> tuple[int, int]:
        if self.raw is not None:
            run = 0
            while not self.raw.get(1):
                run += 1
                if self.raw.left < -64:
                    raise ValueError("the pairs are cut off")
            token = self.raw.get(6)
            return run, signed_value(token, self.raw.get(signed_width(token)))
        if self.done >= self.pairs:
            raise ValueError("more pairs are read than there are")
        lane = next(k for k, end in enumerate(self.ends) if self.done < end)
        self.done += 1
        token = self.lanes.symbol(lane, self.models[0][context])
        run = unsigned_value(token, self.bypass[lane].get(unsigned_width(token)))
        token = self.lanes.symbol(lane, self.models[1][context])
        return run, signed_value(token, self.bypass[lane].get(signed_width(token)))

    def rest(self) -> int:
        """The zeros after the last pair."""
        if not self.trailing:
            return 0
        token = self.lanes.symbol(LANES - 1, self.models[0][0])
        return unsigned_value(token, self.bypass[LANES - 1].get(unsigned_width(token)))


# Squares


def scanned(band: np.ndarray, upright: bool) -> np.ndarray:
    """A band in its scanning order: down the columns for the one of upright edges, else along the rows."""
    return (band.T if upright else band).reshape(-1)


def band_pairs(band: np.ndarray, upright: bool, parent: np.ndarray | None = None) -> list[Pair]:
    """Place of the last value, then the pairs up to it; a pair's context is whether the parent is zero where its run starts, and whether a value came before."""
    line, side = scanned(band, upright), band.shape[0]
    places = np.flatnonzero(line)
    first, second = divmod(int(places[-1]), side)
    out, start, before = [(first, 0, PLACE), (second, 0, PLACE)], 0, 0
    coarse = None if parent is None else (parent.T if upright else parent)
    for p in places.tolist():
        zero = coarse is not None and coarse[start // side >> 1, start % side >> 1] == 0
        out.append((p - start, int(line[p]), 2 * zero + before))
        start, before = p + 1, 1
    return out


def read_band(reader: PairReader, side: int, upright: bool, parent: np.ndarray | None = None) -> np.ndarray:
    """Inverse of band_pairs()."""
    last = reader.pair(PLACE)[0] * side + reader.pair(PLACE)[0]
    line, start, before = np.zeros(side * side, np.int64), 0, 0
    coarse = None if parent is None else (parent.T if upright else parent)
    while start <= last:
        zero = coarse is not None and coarse[start // side >> 1, start % side >> 1] == 0
        run, value = reader.pair(2 * zero + before)
        line[start + run] = value
        start, before = start + run + 1, 1
    band = line.reshape(side, side)
    return band.T if upright else band


#: Largest threshold below which a square's high bands count as zero, by layer and kind of plane.
THRESHOLD_CAPS = {"luma2": 3, "luma1": 2, "base": 1, "chroma": 8}


def cleared(squares: np.ndarray, threshold: int, cap: str) -> np.ndarray:
    """Squares without a value beyond the threshold in the high bands, and none in the low one, become zero."""
    half, limit = squares.shape[-1] // 2, min(threshold, THRESHOLD_CAPS[cap])
    high = np.abs(squares)
    low = high[..., :half, :half].max((-1, -2))
    high = np.where(np.arange(2 * half)[:, None] // half + np.arange(2 * half) // half > 0, high, 0).max((-1, -2))
    return np.where(((low == 0) & (high <= limit))[..., None, None], 0, squares)


def encode_squares(squares: np.ndarray, parents: np.ndarray | None = None, select: Selector = cheapest) -> bytes:
    """One plane's quantised squares (n, side, side): a flag for each and for its bands, residuals of the low band, pairs of the others. The residuals go on from the last sample of the square before, or from 0 after an empty one. ``parents`` are squares of half the side."""
    bits, pairs, carried = BitWriter(), [], 0
    half = squares.shape[-1] // 2
    for k, q in enumerate(squares):
        bits.put(int(q.any()), 1)
        if not q.any():
            carried = 0
            continue
        low = median_residuals(q[:half, :half], carried)
        carried = int(q[half - 1, half - 1])
        for band, upright, at in ((low, False, None), (q[:half, half:], True, (0, 1)), (q[half:, :half], False, (1, 0)), (q[half:, half:], False, (1, 1))):
            bits.put(int(band.any()), 1)
            if band.any():
                quarter = half // 2
                parent = None if at is None or parents is None else parents[k][at[0] * quarter : (at[0] + 1) * quarter, at[1] * quarter : (at[1] + 1) * quarter]
                found = band_pairs(band, upright, parent)
                pairs += found if at else [(r, v, c if c == PLACE else RESIDUAL) for r, v, c in found]
    return encode_pairs(pairs, bits.bytes(), len(squares), select=select)


class _Residuals:
    """A reader whose value contexts are all that of residuals."""

    def __init__(self, reader: PairReader):
        self.reader = reader

    def pair(self, context: int) -> tuple[int, int]:
        return self.reader.pair(PLACE if context == PLACE else RESIDUAL)


def decode_squares(data: bytes, side: int, parents: np.ndarray | None = None) -> np.ndarray:
    """Inverse of encode_squares()."""
    reader = PairReader(data)
    bits, half, carried, out = BitReader(reader.flags), side // 2, 0, np.zeros((reader.count, side, side), np.int64)
    for k in range(reader.count):
        if not bits.get(1):
            carried = 0
            continue
        low = read_band(_Residuals(reader), half, False) if bits.get(1) else np.zeros((half, half), np.int64)
        out[k, :half, :half] = from_median_residuals(low, carried)
        carried = int(out[k, half - 1, half - 1])
        for upright, (y, x) in ((True, (0, 1)), (False, (1, 0)), (False, (1, 1))):
            if bits.get(1):
                quarter = half // 2
                parent = None if parents is None else parents[k][y * quarter : (y + 1) * quarter, x * quarter : (x + 1) * quarter]
                out[k, y * half : (y + 1) * half, x * half : (x + 1) * half] = read_band(reader, half, upright, parent)
    return out


def code_planes(planes: DataFrame, side: int, select: Selector = cheapest) -> DataFrame:
    """(plane, data) of (plane, squares), arrays of all quantised squares of a plane."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encode_squares(np.array(s.as_py(), np.int64).reshape(-1, side, side), select=select) for s in b.column("squares")]
            yield pa.RecordBatch.from_arrays([b.column("plane"), pa.array(data, pa.binary())], ["plane", "data"])

    return planes.select("plane", "squares").mapInArrow(run, "plane long, data binary")


def uncode_planes(coded: DataFrame, side: int) -> DataFrame:
    """Inverse of code_planes()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decode_squares(d, side).reshape(-1) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("plane"), pa.array(rows, pa.list_(pa.int64()))], ["plane", "squares"])

    return coded.mapInArrow(run, "plane long, squares array<long>")


def pack_bits(rows: DataFrame, key: str, order: str, value: str, width: str) -> DataFrame:
    """(key, n_bits, data, back): each key's values in order as bits of the given widths, and their sum as read back."""

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (order, value, width)), strict=True))
        out = BitWriter()
        for _, v, n in found:
            out.put(v, n)
        data = out.bytes()
        bits = BitReader(data)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()]), pa.array([out.count], pa.int64()), pa.array([data], pa.binary()), pa.array([sum(bits.get(n) for _, _, n in found)], pa.int64())], [key, "n_bits", "data", "back"])

    return rows.select(key, order, value, width).groupBy(key).applyInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_bits long, data binary, back long")


def code_tables(models: DataFrame, key: str) -> DataFrame:
    """(key, data, freqs): each model's table, and its frequencies as read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [Model(f).table() for f in b.column("freqs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(data, pa.binary()), pa.array([Model.read_table(d, 0)[0].freqs for d in data], pa.list_(pa.int64()))], [key, "data", "freqs"])

    return models.select(key, "freqs").mapInArrow(run, f"{key} {models.schema[key].dataType.simpleString()}, data binary, freqs array<long>")


def square_runs(squares: DataFrame) -> DataFrame:
    """(frame, band, position, run, value, context) of (frame, coef, parent): the runs of the three high bands of a quantised 8x8 square in their scanning orders; ``parent``, a 4x4 square or null, gives contexts."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for frame, coef, parent in zip(b.column("frame").to_pylist(), b.column("coef").to_pylist(), b.column("parent").to_pylist(), strict=True):
                q, above = np.array(coef).reshape(8, 8), None if parent is None else np.array(parent).reshape(4, 4)
                for name, upright, y, x in (("HL", True, 0, 1), ("LH", False, 1, 0), ("HH", False, 1, 1)):
                    band = q[4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
                    if band.any():
                        at = 0
                        for r, v, c in band_pairs(band, upright, None if above is None else above[2 * y : 2 * y + 2, 2 * x : 2 * x + 2])[2:]:
                            at += r + 1
                            out.append((frame, name, at - 1, r, v, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["frame", "band", "position", "run", "value", "context"])

    return squares.select("frame", "coef", "parent").mapInArrow(run, "frame long, band string, position int, run int, value long, context int")
