"""Secret scans with linking of credentials that come in several parts.

Strong findings stand alone: assignments to telling names, access identifiers and long hexadecimal runs. Weak
candidates, which any text may hold by chance, are 40-character keys and endpoints. Within a scope, ``scope``
characters around a finding, an interval join looks for the complementary parts: a key is reported if an access
identifier lies in its scope, an endpoint if both an access identifier and a reported key do.

Defined results: a null or empty text has no findings; repeated rows are scanned each for itself; spans are in
code points, ends exclusive, in order of start, then kind; an empty table gives an empty table;
other columns play no part; a text of any length is scanned whole, in time proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import documents

KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEY = re.compile(rb"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])")
_ENDPOINT = re.compile(rb"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%+-]*)?|\b[a-z0-9.-]+\.(?:amazonaws\.com|digitaloceanspaces\.com|wasabisys\.com)\b")
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16


def _near(spans: np.ndarray, others: np.ndarray, scope: int) -> np.ndarray:
    """Which of the sorted, disjoint spans have one of the others, sorted and disjoint, in ``scope`` around them."""
    if not len(others):
        return np.zeros(len(spans), bool)
    first = np.searchsorted(others[:, 1], spans[:, 0] - scope, "left")
    return (first < len(others)) & (others[np.minimum(first, len(others) - 1), 0] <= spans[:, 1] + scope)


def _linked(text: bytes, access: list[tuple[int, int]], scope: int, points: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Weak candidates whose other parts are in scope, counted in code points: (kind, start, end), in bytes. ``points`` has the code points before each byte, where they differ."""
    at = (lambda spans: spans) if points is None else (lambda spans: points[spans])
    ids = at(np.array(access, np.int64).reshape(-1, 2))
    keys = [m.span() for m in _KEY.finditer(text) if re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Z]", m[0]) and re.search(rb"[a-z]", m[0])]
    keys = np.array(keys, np.int64).reshape(-1, 2)
    keys = keys[_near(at(keys), ids, scope)]
    ends = np.array([m.span() for m in _ENDPOINT.finditer(text)], np.int64).reshape(-1, 2) if len(keys) else np.zeros((0, 2), np.int64)
    ends = ends[_near(at(ends), ids, scope) & _near(at(ends), at(keys), scope)]
    return [(3, a, b) for a, b in keys.tolist()] + [(4, a, b) for a, b in ends.tolist()]


def _points(text: bytes) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def scan(column: pa.Array, scope: int) -> list[list[tuple[int, int, int]]]:
    """The findings of each text: (kind, start, end) in code points."""
    data, offsets = T.flat(column)
    raw = data.tobytes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    inside = _HEX[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & ~np.concatenate([[False], inside[:-1]]) | inside & edge[:-1]
    last = inside & ~np.concatenate([inside[1:], [False]]) | inside & edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= MIN_HEX
    starts, ends = starts[long], ends[long]
    for row, a, b in zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        found[row].append((2, a - int(offsets[row]), b - int(offsets[row])))
    bounds = offsets.tolist()
    for row in range(len(found)):
        text = raw[bounds[row] : bounds[row + 1]]
        low = text.lower()
        points = None
        if any(h in low for h in _HINTS):
            found[row] += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if b"AKIA" in text:
            access = [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
            found[row] += [(1, *s) for s in access]
            if access:
                points = None if text.isascii() else _points(text)
                found[row] += _linked(text, access, scope, points)
        if found[row]:
            if not text.isascii():
                points = _points(text) if points is None else points
                found[row] = [(k, int(points[a]), int(points[b])) for k, a, b in found[row]]
            found[row].sort(key=lambda x: (x[1], x[0]))
    return found


def find_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """(doc_id, findings) for every row; findings are (kind, start, end) in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "text"):
            found = scan(piece.column("text"), scope)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row] for row in found], kind)], ["doc_id", "findings"])

    return documents(docs).mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:long,end:long>>")


def secret_digests(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Counts of the strong findings, their digest, and all findings as text."""
    found = find_secrets(docs, scope)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    text = lambda array: F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    strong = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(strong).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
