"""Approximate nearest neighbours for maximum inner product by score-aware quantisation.

Vectors, at length 1 and with their norms beside them, are cut into subspaces of ``SUB`` components with 16 codewords each, four bits. Codewords are fitted, on a
bounded sample, to the anisotropic loss: the part of the residual that is parallel to the vector, which
moves large inner products most, weighs ``eta`` times the rest. Every row is encoded under the same loss.

Rows fall into cells around centres that are fitted on the same sample, and a query visits the cells whose centres have the largest
inner products with it. How many, follows from the sample: so many that they hold ``recall`` of its rows' true neighbours there. Where
that is more than half of the cells, as with vectors in no groups, or with ``exact_cells``, there is one cell, and every query meets every row's code. A large cell is dealt over several parts, which
its queries all visit, so a cell with a third of all rows is no task's own.

A query's inner products with all codewords fill a table; rows are scanned by table lookups of two codes a byte,
the best of each block of rows are scored again on the original vectors in double precision, and a query's
best of all blocks are merged. Blocks of rows meet blocks of queries; no pair is a row of any table.

Equal vectors of a block are scanned once, with as many of their smallest vec_ids as can be in a result; so copies
neither crowd out other candidates nor lose a tie.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most valid vectors (of equally frequent lengths the smaller); ties go to the smaller vec_id; a row with
the query's vec_id is never its candidate; repeated rows are candidates each for itself, and a repeated query
is answered once, by the smallest of its vectors in byte order; null vec_ids take no part; an empty table gives
an empty table; other columns play no part. Texts play no part either, so none is too long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import tasks

SUB, WORDS = 2, 16
BLOCK, QUERY_BLOCK = 8192, 256
#: Cells at most; rows of a cell from which on there are several cells; rows of a part at most.
CELLS, CELL_ROWS, PART_ROWS = 256, 2048, 4 * BLOCK


@dataclass(frozen=True)
class AnnConfig:
    k: int = 20
    threshold: float = 0.2  #: the share of its norm from which an inner product counts as large; eta follows from it
    sample: int = 8192  #: rows that the codewords are fitted on, at most
    rerank: int = 200  #: rows of a block that are scored again
    rounds: int = 6
    every: int = 20  #: rows whose vec_id is divisible by it are queries
    recall: float = 0.98  #: share of the sample's true neighbours that the visited cells hold
    exact_cells: bool = False  #: visit all cells


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of each row under the anisotropic loss, by coordinate descent over the subspaces."""
    n, m = len(x), len(books)
    parts, dirs = x.reshape(n, m, SUB), _unit(x).reshape(n, m, SUB)
    codes = np.empty((n, m), np.int64)
    along = np.zeros((n, m), np.float32)
    plain, slope = [], []
    for j in range(m):
        plain.append(((parts[:, j, None, :] - books[j][None]) ** 2).sum(-1))
        slope.append((parts[:, j] * dirs[:, j]).sum(-1, keepdims=True) - dirs[:, j] @ books[j].T)
        codes[:, j] = plain[j].argmin(1)
        along[:, j] = np.take_along_axis(slope[j], codes[:, j, None], 1)[:, 0]
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[:, j]
            codes[:, j] = (plain[j] + (eta - 1) * (rest[:, None] + slope[j]) ** 2).argmin(1)
            along[:, j] = np.take_along_axis(slope[j], codes[:, j, None], 1)[:, 0]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, eta: float, rounds: int) -> np.ndarray:
    """Codewords (subspaces, 16, SUB): k-means first, then alternating assignment and least squares under the anisotropic loss."""
    n, d = x.shape
    m, rng = d // SUB, np.random.default_rng(11)
    parts = x.reshape(n, m, SUB)
    books = np.stack([parts[rng.choice(n, WORDS, replace=n < WORDS), j] for j in range(m)]).astype(np.float32)
    for _ in range(8):
        for j in range(m):
            near = ((parts[:, j, None, :] - books[j][None]) ** 2).sum(-1).argmin(1)
            for w in range(WORDS):
                if (near == w).any():
                    books[j, w] = parts[near == w, j].mean(0)
    dirs, size = _unit(x).reshape(n, m, SUB), m * WORDS * SUB
    for _ in range(rounds):
        codes = encode(x, books, eta)
        columns = ((np.arange(m) * WORDS + codes)[:, :, None] * SUB + np.arange(SUB)).reshape(n, -1)
        spread = np.zeros((n, size), np.float32)
        np.put_along_axis(spread, columns, dirs.reshape(n, -1), 1)
        gram = (eta - 1) * (spread.T @ spread).astype(np.float64)
        count = np.bincount(columns.reshape(-1), minlength=size).astype(np.float64)
        right = np.bincount(columns.reshape(-1), x.reshape(-1), size) + (eta - 1) * (spread * np.linalg.norm(x, axis=1, keepdims=True)).sum(0, dtype=np.float64)
        gram[np.diag_indices(size)] += count + 1e-4
        books = np.linalg.solve(gram, right + 1e-4 * books.reshape(-1)).reshape(m, WORDS, SUB).astype(np.float32)
    return books


def _padded(x: np.ndarray) -> np.ndarray:
    step = 2 * SUB
    return np.pad(x, ((0, 0), (0, -x.shape[1] % step))).astype(np.float32)


def _valid(rows: DataFrame) -> DataFrame:
    values = F.col("embedding").cast("array<float>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(values, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of cells by k-means; empty ones start again at rows far from theirs."""
    rng = np.random.default_rng(5)
    found = x[rng.choice(len(x), cells, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = cell_of(x, found)
        size = np.bincount(near, minlength=cells)
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        lost = np.flatnonzero(size == 0)
        found = sums / np.maximum(size, 1)[:, None]
        if len(lost):
            found[lost] = x[np.argsort(-((x - found[near]) ** 2).sum(1))[: len(lost)]]
    return found


def cell_of(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (x @ found.T - (found**2).sum(1) / 2).argmax(1)


def visits(x: np.ndarray, found: np.ndarray, config: AnnConfig) -> int:
    """How many cells a query visits: the fewest whose rows make up ``recall`` of the true neighbours of 256 rows within the sample."""
    if config.exact_cells or len(found) == 1 or len(x) <= config.k:
        return len(found)
    queries = np.arange(0, len(x), max(1, len(x) // 256))
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    near = np.argpartition(-score, config.k - 1, axis=1)[:, : config.k]
    place = np.argsort(np.argsort(-(x[queries] @ found.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, cell_of(x, found)[near], 1).reshape(-1)) + 1
    many = int(needed[int(np.ceil(config.recall * len(needed))) - 1])
    return many if many <= len(found) // 2 else len(found)


def _cells(found: np.ndarray, d: int):
    """Rows of each cell, by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.bincount(cell_of(_vectors(batch, d), found), minlength=len(found))
            some = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some].astype(np.int64))], ["cell", "rows"])

    return run


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def _blocks(found: np.ndarray, size: np.ndarray, parts: np.ndarray, many: int, config: AnnConfig, d: int):
    """Packs rows into their cells' parts, and queries into all parts of the cells that they visit, ``many`` and as many more as hold some rows; ``parts`` has the first part of each cell, and of none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: int, asks: bool, own: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "asks": [asks], "ids": [own.tobytes()], "vectors": [x.tobytes()]})

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            vectors = _vectors(batch, d)
            cell = cell_of(vectors, found)
            part = parts[cell] + (T.mix(ids.view(np.uint64)) % (parts[cell + 1] - parts[cell]).astype(np.uint64)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0, [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for at in range(lo, hi, BLOCK // 4):
                    some = order[at : min(hi, at + BLOCK // 4)]
                    yield row(int(part[some[0]]), False, ids[some], vectors[some])
            asks = np.flatnonzero(ids % config.every == 0)
            if not len(asks):
                continue
            order = np.argsort(-(vectors[asks] @ found.T), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            visited = np.zeros(order.shape, bool)
            np.put_along_axis(visited, order, (np.arange(len(found)) < many) | (before <= 10 * config.k), 1)
            for c in np.flatnonzero(visited.any(0)).tolist():
                who = asks[visited[:, c]]
                for at in range(0, len(who), QUERY_BLOCK):
                    for p in range(int(parts[c]), int(parts[c + 1])):
                        yield row(p, True, ids[who[at : at + QUERY_BLOCK]], vectors[who[at : at + QUERY_BLOCK]])

    return run


class _Index:
    """A block of rows: distinct vectors with their codes and smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: np.ndarray, eta: float, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + np.float32(0))
        _, first, back = np.unique(vectors.view([("", f"V{vectors.shape[1] * 4}")]).reshape(-1), return_index=True, return_inverse=True)
        place = np.argsort(first)
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        back = rank[back.reshape(-1)]
        self.vectors = vectors[first[place]].astype(np.float64)
        by = np.argsort(back, kind="stable")
        self.bounds = np.searchsorted(back[by], np.arange(len(place) + 1))
        self.ids, self.k = ids[by], k
        self.norms = np.linalg.norm(self.vectors, axis=1).astype(np.float32)
        codes = encode(_padded(_unit(self.vectors)), books, eta)
        self.codes = np.ascontiguousarray((codes[:, ::2] * WORDS + codes[:, 1::2]).T.astype(np.uint8))

    def search(self, qids: np.ndarray, queries: np.ndarray, books: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, exact score) of the best rows of the block."""
        parts = _padded(queries).reshape(len(queries), len(books), SUB)
        table = np.einsum("qms,mws->qmw", parts, books)
        pairs = (table[:, ::2, :, None] + table[:, 1::2, None, :]).reshape(len(queries), -1, WORDS * WORDS).astype(np.float32)
        n = self.codes.shape[1]
        if n > rerank:
            score = np.take(pairs[:, 0], self.codes[0], axis=1)
            for j in range(1, len(self.codes)):
                score += np.take(pairs[:, j], self.codes[j], axis=1)
            score *= self.norms
            near = np.argpartition(-score, rerank - 1, axis=1)[:, :rerank]
        else:
            near = np.broadcast_to(np.arange(n), (len(queries), n))
        exact = np.einsum("qrd,qd->qr", self.vectors[near], queries.astype(np.float64))
        if exact.shape[1] > self.k + 1:
            # a distinct vector has one row at least, so those beyond the first k + 1 scores and their ties cannot count
            floor = -np.partition(-exact, self.k, axis=1)[:, self.k]
            keep = exact >= floor[:, None]
        else:
            keep = np.ones(exact.shape, bool)
        q, r = np.nonzero(keep)
        distinct, value = near[q, r], exact[q, r]
        lengths = np.minimum(self.bounds[distinct + 1] - self.bounds[distinct], self.k + 1)
        ends = np.cumsum(lengths)
        rows = np.repeat(self.bounds[distinct] - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1] if len(ends) else 0)
        q, ids, value = np.repeat(q, lengths), self.ids[rows], np.repeat(value, lengths)
        other = ids != qids[q]
        return q[other], ids[other], value[other]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, in order."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], score[rank < k]


def _scan(books: np.ndarray, eta: float, config: AnnConfig, d: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index: list[_Index] | None = None
        now = -1
        for batch in batches:  # part by part, rows first, then queries
            for part, asks, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("part", "asks", "ids", "vectors")), strict=True):
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float32).reshape(-1, d)
                if part != now:
                    held, index, now = [], None, part
                if not asks:
                    held.append((ids, vectors))
                    continue
                if index is None:
                    index = []
                    if held:
                        all_ids, all_vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                        index = [_Index(all_ids[lo : lo + BLOCK], all_vectors[lo : lo + BLOCK], books, eta, config.k) for lo in range(0, len(all_ids), BLOCK)]
                        held = []
                if index:
                    q, near, score = _best(*(np.concatenate(x) for x in zip(*(block.search(ids, vectors, books, config.rerank) for block in index), strict=True)), config.k)
                else:
                    q, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                at = np.searchsorted(q, np.arange(len(ids) + 1))
                yield pa.RecordBatch.from_pydict({"query_id": ids, "part": pa.array(np.full(len(ids), part, np.int32)), "keys": [vectors[i].tobytes() for i in range(len(ids))], "ids": [near[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], "scores": [score[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    return run


def _merge(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, parts in zip(batch.column("query_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                key = min(p["keys"] for p in parts)
                parts = [p for p in parts if p["keys"] == key]
                # a repeated query met each part twice with the same answer
                parts = list({p["part"]: p for p in parts}.values())
                ids, score = (np.concatenate([np.frombuffer(p[c], kind) for p in parts]) for c, kind in (("ids", np.int64), ("scores", np.float64)))
                _, ids, score = _best(np.zeros(len(ids), np.int64), ids, score, k)
                out += [(query, r + 1, v, s) for r, (v, s) in enumerate(zip(ids.tolist(), score.tolist(), strict=True))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    return run


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, config: AnnConfig = AnnConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, by inner product."""
    valid = _valid(rows)
    common = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return rows.sparkSession.createDataFrame([], RESULT)
    d = common[0]["d"]
    valid = valid.where(F.size("embedding") == d)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.sample).select("embedding").collect()
    eta = (d - 1) * config.threshold**2 / (1 - config.threshold**2) if d > 1 else 1.0
    eta = max(1.0, eta)
    x = np.array([r[0] for r in sample], np.float32)
    books = fit(_padded(_unit(x)), eta, config.rounds)
    rows_in_all, n = common[0]["count"], tasks(rows, 0.25)
    found = centres(x, max(1, min(CELLS, len(x) // 32, -(-rows_in_all // CELL_ROWS))))
    many = visits(x, found, config)
    if many == len(found):
        # no cell can be left out, so rows are dealt by hash: near ones are spread over all blocks and each is scored again in its own
        found, many = found[:1], 1
    size = np.zeros(len(found), np.int64)
    for r in valid.mapInArrow(_cells(found, d), "cell int, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).collect():  # a row a cell
        size[r["cell"]] = r["rows"]
    part_rows = max(CELL_ROWS // 4, min(PART_ROWS, -(-rows_in_all // n)))
    parts = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // part_rows)))])
    blocks = valid.mapInArrow(_blocks(found, size, parts, many, config, d), "part int, asks boolean, ids binary, vectors binary").repartitionById(n, F.col("part") % n).sortWithinPartitions("part", "asks")
    met = blocks.mapInArrow(_scan(books, eta, config, d), "query_id long, part int, keys binary, ids binary, scores binary")
    return met.groupBy("query_id").agg(F.collect_list(F.struct("part", "keys", "ids", "scores")).alias("parts")).mapInArrow(_merge(config.k), RESULT)
