"""Line dedup by winnowing: runs of lines that stood earlier in the corpus are deleted.

A document is the sequence of its lines that hold a word, compared without surrounding white space. A
*window* is a shortest run of whole lines with ``min_words`` words or more, from each line on forwards and up
to each line backwards. Winnowing selects in each window the line with the smallest hash, of equal ones the last. Equal
windows select equal lines at equal places, so a repeated run that is long enough is guaranteed to share a selected line, its
fingerprint, with its first copy. Each selected line goes, with its position and the lines of all windows that selected it, to the
part of its fingerprint. There positions with one fingerprint are joined, and their matches extended both ways from it: line by
line, as far as some window is equal on both sides of the fingerprint. Where windows match, the one with the smallest (doc_id, text, line) stays and the others are repeats; the
extended matches join into whole runs. So a line goes exactly if it lies in a run of ``min_words`` words or more of which an
equal run starts earlier, in an earlier document or further up. Shorter repeated runs stay, whatever their lines.

Matches meet by hash of what lies on each side of the fingerprint, window by window, so no pairs are listed, however many positions
share one. A fingerprint that is selected more often than 1/131,072 of all, a bounded table, is not joined in one part: its windows are
dealt by what lies on both sides, and each map task sends one window of each content; its other copies are known to be later ones there and then.

Defined results: a null text stays null, and a text without repeats stays as it is; a document whose lines all go keeps its row with the lines that hold no word, or an empty text;
rows of one doc_id with the same text count as one document, so repeated rows don't delete each other; those with different texts are documents
of their own, in the order of a hash of the text, which also breaks all ties; rows without doc_id
stay as they are and are nobody's first copy; an empty table gives an empty table; other columns are kept, whatever their names; a text of
any length is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, tasks, unused

#: Windows or lines around selected ones that a map task holds before it emits them.
FLUSH_WINDOWS = 1 << 20
#: A fingerprint is frequent if it is selected so often, and by so large a share of all; so there are 131,072 frequent ones at most.
FREQUENT, FREQUENT_SHARE = 256, 1 / 131_072


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line with a word, whole piece in order: hash, words, number in its text (blank lines count); and the rows' bounds."""
    rows = len(offsets) - 1
    starts, ends, _ = T.words(data, offsets)
    cut = np.flatnonzero(data == 10)
    # where a text or a line ends: the words before it
    breaks = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    row = np.repeat(np.arange(rows), 1 + np.diff(np.searchsorted(cut, offsets)))
    number = np.arange(len(breaks)) - (np.searchsorted(row, row) if len(row) else row)
    after = np.searchsorted(starts, breaks, "left")
    before = np.concatenate([[0], after[:-1]]) if len(after) else after
    full = after > before
    hashes = T.span_hashes(data, starts[before[full]], ends[after[full] - 1], seed=4)
    return hashes, (after - before)[full], number[full], np.searchsorted(row[full], np.arange(rows + 1))


def line_windows(counts: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line, and line after the last, of each distinct window."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + min_words, "left")
    fits = ahead <= bounds[row + 1] if n else np.zeros(0, bool)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    reaches = back >= bounds[row] if n else np.zeros(0, bool)
    spans = np.unique(np.concatenate([at[fits] * (n + 1) + ahead[fits], back[reaches] * (n + 1) + at[reaches] + 1]))
    return spans // (n + 1), spans % (n + 1)


def winnow(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The line that each window selects: that of the smallest hash, the last of equal ones."""
    if not len(first):
        return first
    starts = np.concatenate([[0], np.cumsum(stop - first)])
    line = np.repeat(first - starts[:-1], stop - first) + np.arange(starts[-1])
    least = np.minimum.reduceat(hashes[line], starts[:-1])
    return np.maximum.reduceat(np.where(hashes[line] == np.repeat(least, stop - first), line, -1), starts[:-1])


def sides(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """A hash of the lines of each window before the selected one and behind it."""
    up, down = T._power(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    run = lambda lo, hi: T.mix(((sums[hi] - sums[lo]) * down[lo]) ^ ((hi - lo).astype(np.uint64) << np.uint64(40)))
    return T.mix(run(first, selected) * np.uint64(0x9E3779B97F4A7C15) + run(selected + 1, stop))


def _windows_of(piece: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, ...]:
    """Lines (hash, words, number), their rows' bounds; windows (first, stop, selected line)."""
    hashes, counts, number, bounds = lines_of(*T.flat(piece.column("text")))
    first, stop = line_windows(counts, bounds, min_words)
    return hashes, counts, number, bounds, first, stop, winnow(hashes, first, stop)


def frequent_fingerprints(docs: DataFrame, min_words: int, n: int) -> np.ndarray:
    """Fingerprints that are selected at more lines than the limits say, in order."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            where = T.buckets(T.mix(prints), n)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                some = order[edge[b] : edge[b + 1]]
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "prints": [prints[some].tobytes()], "counts": [T.pack(counts[some])]})

        for piece in T.pieces(batches, "text"):
            piece = piece.filter(piece.column("doc_id").is_valid())
            hashes, _, _, _, _, _, selected = _windows_of(piece, min_words)
            if len(selected):
                held.append(hashes[np.unique(selected)])
                size += len(held[-1])
            if size > FLUSH_WINDOWS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(p, np.uint64), T.unpack(c)[0].astype(np.int64)) for batch in batches for p, c in zip(batch.column("prints").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        if rows:
            prints, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
            prints, back = np.unique(prints, return_inverse=True)
            sums = np.bincount(back, counts, len(prints)).astype(np.int64)
            keep = sums > FREQUENT
            # the largest are sent on; how many of them are frequent is known when all are counted
            yield pa.RecordBatch.from_pydict({"prints": [prints[keep].tobytes()], "counts": [sums[keep].tobytes()], "all": [int(sums.sum())]})

    parts = docs.mapInArrow(T.lean(gather), "b int, prints binary, counts binary").repartitionById(n, "b").mapInArrow(T.lean(total), "prints binary, counts binary, all long")
    return _frequent(parts)


def _frequent(parts: DataFrame) -> np.ndarray:
    parts = cut(parts)
    everything = parts.agg(F.sum("all")).first()[0] or 0
    least = max(FREQUENT, everything * FREQUENT_SHARE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prints, counts in zip(batch.column("prints").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"prints": [np.frombuffer(prints, np.uint64)[np.frombuffer(counts, np.int64) > least].tobytes()]})

    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in parts.mapInArrow(T.lean(run), "prints binary").collect())]))


SENT = "b int, kind int, keys binary, docs binary, texts binary, lows binary, highs binary, lines binary"


def _row(b: int, kind: int, keys: np.ndarray | None, docs: np.ndarray, texts: np.ndarray, lows: np.ndarray | None, highs: np.ndarray | None, lines: bytes | None = None) -> pa.RecordBatch:
    raw = lambda x: None if x is None else x.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([raw(x)], pa.binary()) for x in (keys, docs, texts, lows, highs)), pa.array([lines], pa.binary())], ["b", "kind", "keys", "docs", "texts", "lows", "highs", "lines"])


def _first_and_later(keys: np.ndarray, docs: np.ndarray, texts: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each key, and all that come later than it."""
    order = np.lexsort((lows, texts, docs, keys))
    keys, docs, texts, lows = keys[order], docs[order], texts[order], lows[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    lead = np.repeat(begins, np.diff(np.append(begins, len(keys))))
    later = (docs != docs[lead]) | (texts != texts[lead]) | (lows != lows[lead])
    return order[begins], order[later]


def _emit(min_words: int, frequent: np.ndarray, n: int):
    """Selected lines with their surroundings, to the parts of their fingerprints (kind 0); of frequent fingerprints the windows, to the parts of what is beside these (1), and those known to be repeats (2)."""

    def flush(near: list[tuple], wide: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        if near:
            prints, docs, texts, places, widths, *lines = (np.concatenate(x) for x in zip(*near, strict=True))
            near.clear()
            where = T.buckets(T.mix(prints), n)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(n + 1))
            offsets = np.concatenate([[0], np.cumsum(widths)])
            for b in np.flatnonzero(np.diff(edge)).tolist():
                some = order[edge[b] : edge[b + 1]]
                at, _ = T.ragged(offsets, some)
                yield _row(b, 0, prints[some], docs[some], texts[some], None, None, T.pack(places[some], widths[some], *(x[at] for x in lines)))
        if wide:
            keys, docs, texts, lows, highs = (np.concatenate(x) for x in zip(*wide, strict=True))
            wide.clear()
            fresh, later = _first_and_later(keys, docs, texts, lows)
            where = T.buckets(keys[fresh], n)
            fresh = fresh[np.argsort(where, kind="stable")]
            edge = np.searchsorted(np.sort(where), np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                some = fresh[edge[b] : edge[b + 1]]
                yield _row(b, 1, keys[some], docs[some], texts[some], lows[some], highs[some])
            for part in np.array_split(later, n):  # known to be later: no key needed
                if len(part):
                    turn += 1
                    yield _row(turn % n, 2, None, docs[part], texts[part], lows[part], highs[part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple] = []
        wide: list[tuple] = []
        size = turn = 0
        for piece in T.pieces(batches, "text"):
            piece = piece.filter(piece.column("doc_id").is_valid())
            hashes, counts, number, bounds, first, stop, selected = _windows_of(piece, min_words)
            if not len(first):
                continue
            docs, texts = (np.repeat(piece.column(c).to_numpy(), np.diff(bounds)) for c in ("doc_id", "text_hash"))
            hot = np.isin(hashes[selected], frequent)
            if hot.any():
                f, s, m = first[hot], stop[hot], selected[hot]
                wide.append((T.mix(hashes[m] + sides(hashes, f, s, m)), docs[m], texts[m], number[f].astype(np.int32), number[s - 1].astype(np.int32)))
                size += len(f)
            if not hot.all():
                f, s, m = first[~hot], stop[~hot], selected[~hot]
                order = np.argsort(m, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(m[order]) > 0]))
                lines, low, high = m[order][at], np.minimum.reduceat(f[order], at), np.maximum.reduceat(s[order], at)
                ends = np.cumsum(high - low)
                around = np.repeat(low - ends + (high - low), high - low) + np.arange(ends[-1])
                near.append((hashes[lines], docs[lines], texts[lines], lines - low, high - low, hashes[around], counts[around], number[around]))
                size += len(around)
            if size > FLUSH_WINDOWS:
                yield from flush(near, wide, turn)
                size, turn = 0, turn + 1
        yield from flush(near, wide, turn)

    return run


def _extended(prints: np.ndarray, docs: np.ndarray, texts: np.ndarray, places: np.ndarray, widths: np.ndarray, hashes: np.ndarray, counts: np.ndarray, number: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Joins positions by fingerprint and extends their matches both ways: (doc, text, low, high) of the later ones, one for each position."""
    bounds = np.concatenate([[0], np.cumsum(widths)])
    middle = bounds[:-1] + places
    first, stop = line_windows(counts, bounds, min_words)
    selected = winnow(hashes, first, stop)
    owner = np.searchsorted(bounds, first, "right") - 1
    # windows around a position that selected another line came with that one
    own = selected == middle[owner]
    first, stop, selected, owner = first[own], stop[own], selected[own], owner[own]
    # the fingerprint itself is what the positions are joined by; the lines beside it must be equal too
    key = T.mix(prints[owner] + sides(hashes, first, stop, selected))
    _, later = _first_and_later(key, docs[owner], texts[owner], number[first])
    later = later[np.argsort(owner[later], kind="stable")]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(later)), bool), np.diff(owner[later]) > 0]))
    if not len(at):
        return docs[:0], texts[:0], np.zeros(0, np.int32), np.zeros(0, np.int32)
    who = owner[later][at]
    # all these windows hold the fingerprint, so they make up one run
    return docs[who], texts[who], number[np.minimum.reduceat(first[later], at)].astype(np.int32), number[np.maximum.reduceat(stop[later], at) - 1].astype(np.int32)


def _repeats(min_words: int):
    """In each part the repeats; a row for each document with its packed spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple[np.ndarray, ...]] = []
        wide: list[tuple[np.ndarray, ...]] = []
        out: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for kind, keys, docs, texts, lows, highs, lines in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "docs", "texts", "lows", "highs", "lines")), strict=True):
                docs, texts = np.frombuffer(docs, np.int64), np.frombuffer(texts, np.int64)
                if kind == 0:
                    places, widths, hashes, counts, number = T.unpack(lines)
                    near.append((np.frombuffer(keys, np.uint64), docs, texts, places.astype(np.int64), widths.astype(np.int64), hashes.astype(np.uint64), counts.astype(np.int64), number.astype(np.int64)))
                    continue
                lows, highs = np.frombuffer(lows, np.int32), np.frombuffer(highs, np.int32)
                if kind == 1:
                    wide.append((np.frombuffer(keys, np.uint64), docs, texts, lows, highs))
                else:
                    out.append((docs, texts, lows, highs))
        if near:
            prints, docs, texts, places, widths, *lines = (np.concatenate(x) for x in zip(*near, strict=True))
            # a fingerprint at one position has nothing to be joined with
            _, back, often = np.unique(prints, return_inverse=True, return_counts=True)
            some = np.flatnonzero(often[back] > 1)
            at, _ = T.ragged(np.concatenate([[0], np.cumsum(widths)]), some)
            out.append(_extended(prints[some], docs[some], texts[some], places[some], widths[some], *(x[at] for x in lines), min_words))
        if wide:
            keys, docs, texts, lows, highs = (np.concatenate(x) for x in zip(*wide, strict=True))
            _, later = _first_and_later(keys, docs, texts, lows)
            out.append((docs[later], texts[later], lows[later], highs[later]))
        if out:
            docs, texts, lows, highs = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((texts, docs))
            docs, texts, lows, highs = docs[order], texts[order], lows[order], highs[order]
            begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(docs)), bool), (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1])]))
            names, hashes = docs[begins], texts[begins]
            ends = np.append(begins[1:], len(docs))
            for lo in range(0, len(names), 8192):
                some = range(lo, min(lo + 8192, len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 8192]), pa.array(hashes[lo : lo + 8192]), pa.array([lows[begins[k] : ends[k]].tobytes() for k in some], pa.binary()), pa.array([highs[begins[k] : ends[k]].tobytes() for k in some], pa.binary())], ["doc_id", "text_hash", "lows", "highs"])

    return run


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, text_hash, spans) for documents with lines to delete; spans are [first, last] line numbers, from 0, as packed pieces."""
    n = tasks(docs, 0.5)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    frequent = frequent_fingerprints(slim.select("doc_id", "text"), min_words, n)
    sent = slim.mapInArrow(T.lean(_emit(min_words, frequent, n)), SENT).repartitionById(n, "b")
    return sent.mapInArrow(T.lean(_repeats(min_words)), "doc_id long, text_hash long, lows binary, highs binary").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lows", "highs")).alias("spans"))


def _cut_lines(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for part in spans:
        np.add.at(gone, np.frombuffer(part["lows"], np.int32), 1)
        np.add.at(gone, np.frombuffer(part["highs"], np.int32) + 1, -1)
    held = np.cumsum(gone[:-1]) > 0
    # blank lines inside a deleted run go with it only if they lie between its lines, as the spans say
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]])))
    return "\n".join(x for x, h in zip(lines, held.tolist(), strict=True) if not h), list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def dedup_lines(docs: DataFrame, min_words: int = 50, report: bool = False) -> DataFrame:
    """``docs`` with the repeated runs cut from ``text``; with ``report``: doc_id, n_lines, n_deleted, deleted (runs as first-last, comma-joined) and text."""
    doc, content, spans_at = unused(docs, "doc_id_of_run", "text_hash", "spans")
    runs = repeated_runs(docs, min_words).withColumnsRenamed({"doc_id": doc, "text_hash": content, "spans": spans_at})
    # rows without doc_id match nothing; by their texts they don't all meet in one task
    hashed = F.xxhash64(docs["text"].cast("string"))
    joined = docs.join(runs, (F.coalesce(docs["doc_id"].cast("long"), hashed) == runs[doc]) & (hashed == runs[content]) & docs["doc_id"].isNotNull(), "left").drop(doc, content)
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "text", 8 << 20):
            hits = piece.column(spans_at).is_valid().to_numpy(zero_copy_only=False)
            texts = piece.column("text")
            done: dict[int, tuple[str, list]] = {}
            for k in np.flatnonzero(hits).tolist():
                if texts[k].is_valid:
                    done[k] = _cut_lines(texts[k].as_py(), piece.column(spans_at)[k].as_py())
            if done:
                values = texts.to_pylist()
                for k, (text, _) in done.items():
                    values[k] = text
                texts = pa.array(values, texts.type)
            if report:
                _, _, _, bounds = lines_of(*T.flat(piece.column("text")))
                after = lines_of(*T.flat(texts))[3]
                n_lines = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(n_lines), pa.array(n_lines - np.diff(after)), pa.array([",".join(f"{a}-{b}" for a, b in done[k][1]) if k in done else "" for k in range(piece.num_rows)]), texts], ["doc_id", "n_lines", "n_deleted", "deleted", "text"])
            else:
                columns = [piece.column(i) for i in range(piece.num_columns - 1)]
                columns[text_at] = texts
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names[:-1])

    return joined.mapInArrow(T.lean(run), "doc_id long, n_lines long, n_deleted long, deleted string, text string" if report else docs.schema)
