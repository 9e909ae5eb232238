"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every word that occurs before another, and the start, has a context restaurant; its customers are the words that follow there, and each
table's dish is one word. All contexts share one parent restaurant, whose customers are the tables of the contexts; the parent's
base is uniform over all known words and one unseen word. What is counted and seated are all pairs of all training documents, so
the model grows with the corpus.

Seating is sampled by Gibbs. In a sweep all customers of a dish leave their restaurant and are seated anew, given all other dishes'
tables and the parent's predictive probabilities; only how many tables they take matters to any probability. Up to ``EXACT`` customers
that number is drawn from its exact conditional distribution, which sums over all seatings by generalised Stirling numbers. A larger dish's
further customers come by the restaurant's rule, which leaves out what the tables to come weigh; a test holds the difference below 0.2 % of the
dish's customers. Dishes of a restaurant take turns in two halves. First the contexts are seated under a plain parent, then the parent seats the tables that this left, and
then the contexts are seated under that parent; their predictive probabilities are averaged over the sweeps after burn-in. They sum to 1 over all words and the
unseen one.

Discounts follow from the numbers of dishes with one and with two customers, for each part of the contexts and of the words by its own ones.

How it is dealt. A pass counts words; words above 1/131,072 of all tokens, a bounded table, get short codes. A second pass sends each
token once, with its context and its document's number, to the part that holds the context; the tokens of equal pairs are packed together. This exchange is read twice in
one plan: for the first seating, whose tables go to the parts that hold the words, and for the second, with the parent's answers, which scores the tokens too and sends back sums by document.
A context with more than half a part's share of the tokens is dealt over several parts by a hash of its words. In the first
seating each of these takes the restaurant's tables to be so many times its own ones; in the second it has the true number that the first left,
so that such a context's probabilities sum to 1 but for what its tables change from one seating to the other. A repeated task repeats its random numbers.

Defined results: a null or empty text has the end as its only token; repeated rows count, and are scored, each for itself; a null
doc_id is hashed as an empty text, which holds it out; without training documents all counts are 0 and all words have the unseen one's
probability, 1; an empty table gives an empty table; other columns play no part; a text of any length is handled whole; ties do not arise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, documents, labels, tasks

#: A word has a code from this share of all training tokens on; so there are 131,072 codes at most.
TABLE_SHARE = 1 / 131_072
#: Stands for the end, and as a context for the start, among the hashes.
END = np.uint64(0)
#: Distinct words that a task holds before it emits them; tokens that it packs at once.
FLUSH_WORDS, FLUSH_TOKENS = 1 << 20, 1 << 21
#: Customers of a dish up to which the tables are drawn from their exact distribution.
EXACT = 1024
#: Dishes with up to so many customers, and more than the limit before it, are drawn together.
_BINS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, EXACT])


@dataclass(frozen=True)
class PitmanYorConfig:
    strength: float = 1.0
    sweeps: int = 8
    burn_in: int = 3
    seed: int = 23


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in doc_ids], bool)


def _tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased words and its end; the rows' bounds."""
    data, offsets = T.flat(piece.column("text"))
    data = T.LOWER[data]
    starts, ends, bounds = T.words(data, offsets)
    hashes = np.maximum(T.span_hashes(data, starts, ends, seed=7), np.uint64(1))
    counts = np.diff(bounds) + 1
    out = np.full(len(hashes) + len(counts), END)
    edge = np.concatenate([[0], np.cumsum(counts)])
    inside = np.ones(len(out), bool)
    inside[edge[1:] - 1] = False
    out[inside] = hashes
    return out, edge


def _training(piece: pa.RecordBatch) -> pa.RecordBatch:
    return piece.filter(pa.array(~held_out(piece.column("doc_id").to_pylist())))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def word_counts(docs: DataFrame, n: int) -> DataFrame:
    """A row for each of n buckets: words by hash, in order, and their counts in the training documents."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def flush(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            where = T.buckets(T.mix(keys), n)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                rows = order[edge[b] : edge[b + 1]]
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "words": [keys[rows].tobytes()], "counts": [T.pack(counts[rows])]})

        for piece in T.pieces(batches, "text"):
            tokens, _ = _tokens(_training(piece))
            if len(tokens):
                held.append(_summed(tokens, np.ones(len(tokens), np.int64)))
                size += len(held[-1][0])
            if size > 2 * FLUSH_WORDS:
                held = [merge()]
                size = len(held[0][0])
                if size > FLUSH_WORDS:
                    yield from flush(*held[0])
                    held, size = [], 0
        if held:
            yield from flush(*merge())

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for b, words, counts in zip(*(batch.column(c).to_pylist() for c in ("b", "words", "counts")), strict=True):
                held.setdefault(b, []).append((np.frombuffer(words, np.uint64), T.unpack(counts)[0].astype(np.int64)))
        for b, parts in held.items():
            words, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "words": [words.tobytes()], "counts": [T.pack(counts)], "tokens": [int(counts.sum())], "types": [len(words)]})

    parts = docs.mapInArrow(gather, "b int, words binary, counts binary").repartitionById(n, "b")
    return cut(parts.mapInArrow(total, "b int, words binary, counts binary, tokens long, types long"))


def _above(table: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least so many counts, and the end; the share that the limit stands for bounds how many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, counts = np.frombuffer(words, np.uint64), T.unpack(counts)[0].astype(np.int64)
                keep = (counts >= least) | (words == END)
                yield pa.RecordBatch.from_pydict({"words": [words[keep].tobytes()], "counts": [counts[keep].tobytes()]})

    rows = table.mapInArrow(run, "words binary, counts binary").collect()
    words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)])
    order = np.argsort(words)
    return words[order], counts[order]


def _find(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The place of each token among the sorted words, or -1."""
    if not len(words):
        return np.full(len(tokens), -1, np.int64)
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    return np.where(words[at] == tokens, at, -1)


# The restaurants


def discount_of(customers: np.ndarray) -> float:
    """The discount by the numbers of dishes with one and with two customers."""
    ones, twos = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers, [customers, tables]: the weight of all seatings of so many customers at so many tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    at = np.arange(1, most + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for n in range(1, most):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + np.log(np.maximum(n - discount * at, 0)))
            out[n + 1, n + 2 :] = -np.inf
    return out


def _exact(customers: np.ndarray, others: np.ndarray, log_parent: np.ndarray, discount: float, strength: float, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes from their exact distribution, given the other dishes' tables of each one's restaurant."""
    out, most = np.empty(len(others), np.int64), int(customers.max())
    step = max(1, (1 << 21) // most)
    for lo in range(0, len(others), step):
        some = slice(lo, lo + step)
        odds = np.log(strength + discount * (others[some, None] + np.arange(most))) + log_parent[some, None]
        odds = np.cumsum(odds, 1) + weights[customers[some], 1 : most + 1]
        odds = np.cumsum(np.exp(odds - odds.max(1, keepdims=True)), 1)
        out[some] = (odds < rng.random(len(odds))[:, None] * odds[:, -1:]).sum(1) + 1
    return out


def _beyond(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, first: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers beyond the first ``EXACT`` came in turn, by the restaurant's rule; a 64th of those seated at a time."""
    tables, seated, left = first.copy(), EXACT, np.flatnonzero(customers > EXACT)
    while len(left):
        come = np.minimum(seated // 64, customers[left] - seated)
        opens = (strength + discount * (others[left] + tables[left])) * parent[left]
        tables[left] += rng.binomial(come, opens / (opens + seated + come / 2 - discount * tables[left]))
        seated += seated // 64
        left = left[customers[left] > seated]
    return tables


def reseat(customers: np.ndarray, tables: np.ndarray, opened: np.ndarray, parent: np.ndarray, discount: float, strength: float, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """New tables of each dish: all its customers leave and are seated anew; ``opened`` are all tables of its restaurant."""
    out = np.minimum(customers, 1)
    others = np.maximum(opened - tables, 0)
    order = np.argsort(customers, kind="stable")
    edge = np.searchsorted(customers[order], [1, *_BINS], "right")
    log_parent = np.log(parent)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi > lo:
            some = order[lo:hi]
            out[some] = _exact(customers[some], others[some], log_parent[some], discount, strength, weights, rng)
    some = order[edge[-1] :]
    if len(some):
        first = _exact(np.full(len(some), EXACT), others[some], log_parent[some], discount, strength, weights, rng)
        out[some] = _beyond(customers[some], others[some], parent[some], first, discount, strength, rng)
    return out


class Contexts:
    """The context restaurants of a part: pairs of a context and a word, with their customers."""

    def __init__(self, rows: list[tuple[int, bytes]], table: tuple[np.ndarray, np.ndarray], fans: np.ndarray, config: PitmanYorConfig, seed: int):
        """``rows`` are (chunk, packed tokens); see _packed(). ``fans`` says over how many parts each word's restaurant is dealt."""
        words, totals = table
        self.config, self.chunks = config, []
        contexts, dishes, train = [], [], []
        for name, data in sorted(rows):
            heads, widths, codes, rare, asks, docs = T.unpack(data)
            own = np.empty(len(codes), np.uint64)
            short = codes < len(words)
            own[short], own[~short] = words[codes[short].astype(np.int64)], rare
            contexts.append(np.repeat(heads, widths))
            dishes.append(own)
            ends = np.cumsum(asks.astype(np.int64))
            learned = np.concatenate([[0], np.cumsum(docs & 1)]).astype(np.int64)
            train.append(learned[ends] - learned[ends - asks])
            self.chunks.append((name, asks.astype(np.int64), docs >> 1))
        none = np.zeros(0, np.uint64)
        contexts, dishes = np.concatenate([none, *contexts]), np.concatenate([none, *dishes])
        # pairs in order of context, then word
        order = np.lexsort((dishes, contexts))
        c, w = contexts[order], dishes[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        self.pair_of = np.empty(len(c), np.int64)
        self.pair_of[order] = np.cumsum(fresh) - 1
        self.customers = np.bincount(self.pair_of, np.concatenate([np.zeros(0, np.int64), *train]), int(fresh.sum())).astype(np.int64)
        c, self.dishes = c[fresh], w[fresh]
        heads = np.ones(len(c), bool)
        heads[1:] = c[1:] != c[:-1]
        self.context = np.cumsum(heads) - 1
        names = c[heads]
        #: customers of each restaurant here, and in all: others' parts of a frequent context are known from its count
        here = np.bincount(self.context, self.customers, len(names)).astype(np.int64)
        at = _find(words, names)
        self.total = np.where(at >= 0, totals[at] if len(totals) else 0, here)
        self.scale = np.where(at >= 0, fans[at] if len(fans) else 1, 1).astype(float)
        self.names, self.split = names, np.flatnonzero(self.scale > 1)
        #: tables and discounts of the restaurants in ``split``, once they are known
        self.elsewhere: tuple[np.ndarray, np.ndarray] | None = None
        self.discount = discount_of(self.customers)
        self.weights = stirling(self.discount, min(EXACT, max(2, int(self.customers.max(initial=2)))))
        self.rng = np.random.default_rng([config.seed, seed])
        self.tables = np.minimum(self.customers, 1)
        # the words of the part, in order, and which of them each pair has
        self.words, self.word_of = np.unique(self.dishes, return_inverse=True)

    def opened(self) -> np.ndarray:
        """Tables of each restaurant."""
        found = np.bincount(self.context, self.tables, len(self.total)) * self.scale
        found[self.split] = np.minimum(found, self.total)[self.split] if self.elsewhere is None else self.elsewhere[0]
        return found

    def discounts(self) -> np.ndarray:
        """Discounts of all tables of each restaurant."""
        found = self.discount * self.opened()
        if self.elsewhere is not None:
            found[self.split] = self.elsewhere[1]
        return found

    def sweep(self, parent: np.ndarray) -> None:
        """``parent`` has the parent's probability of each pair's word."""
        for half in (0, 1):
            some = np.flatnonzero((self.customers > 1) & (self.word_of % 2 == half))
            opened = self.opened()[self.context[some]]
            self.tables[some] = reseat(self.customers[some], self.tables[some], opened, parent[some], self.discount, self.config.strength, self.weights, self.rng)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """Probability of each pair's word in its context, averaged over the sweeps after burn-in."""
        mean, sweeps = np.zeros(len(self.customers)), self.config.sweeps - self.config.burn_in
        strength = self.config.strength
        for k in range(self.config.sweeps):
            self.sweep(parent)
            if k >= self.config.burn_in:
                back = (strength + self.discounts()) / (strength + self.total)
                mean += (self.customers - self.discount * self.tables) / (strength + self.total)[self.context] + back[self.context] * parent
        return mean / sweeps

    def to_parent(self) -> tuple[np.ndarray, np.ndarray]:
        """The part's words, in order, and the tables that serve each: the parent's customers."""
        return self.words, np.bincount(self.word_of, self.tables, len(self.words)).astype(np.int64)


def parent_seating(customers: np.ndarray, share: float, types: int, config: PitmanYorConfig, seed: int) -> tuple[np.ndarray, float]:
    """Customers of each word in the parent restaurant less the discounts of its tables, averaged over the sweeps after burn-in; and the discounts of all tables. ``share`` is the share of all words that are here."""
    rng = np.random.default_rng([config.seed, seed, 1])
    discount = discount_of(customers)
    weights, tables, base = stirling(discount, min(EXACT, max(2, int(customers.max(initial=2))))), np.minimum(customers, 1), np.full(len(customers), 1 / (types + 1))
    mean, some = np.zeros(len(customers)), np.flatnonzero(customers > 1)
    for k in range(config.sweeps):
        opened = np.full(len(some), tables.sum() / share)
        tables[some] = reseat(customers[some], tables[some], opened, base[some], discount, config.strength, weights, rng)
        if k >= config.burn_in:
            mean += tables / (config.sweeps - config.burn_in)
    return customers - discount * mean, float(discount * mean.sum())


# The tasks


def _fans(counts: np.ndarray, train_tokens: int, n: int) -> np.ndarray:
    """Over how many parts the followers of each word are dealt."""
    return np.clip(np.ceil(counts * (2.0 * n) / max(1, train_tokens)), 1, n).astype(np.int64)


def _packed(table: tuple[np.ndarray, np.ndarray], train_tokens: int, n: int, names: list[int]):
    """Sends each token with its context and its document's number to the context's part, and a row of its documents for each chunk."""
    words, counts = table
    fans, names = _fans(counts, train_tokens, n), np.array(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def row(label: int, name: int, data: bytes | None, docs: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([name], pa.int64()), pa.array([data], pa.binary()), pa.array([docs], pa.binary())], ["label", "name", "data", "docs"])

        def flush() -> Iterator[pa.RecordBatch]:
            name = part + turn
            ids, lengths, tokens, train = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield row(int(names[name % n]), name, None, T.pack(ids, lengths))
            before = np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = END
            docs = np.repeat(np.arange(len(lengths)) * 2 + train, lengths)
            types, rank = np.unique(np.append(tokens, END), return_inverse=True)
            rank, first = rank[:-1], np.append(rank[-1:], rank[:-2])
            first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = rank[-1] if types[rank[-1]] == END else 0
            mixed, code = T.mix(types), _find(words, types)
            fan = np.where(code >= 0, fans[code] if len(words) else 1, 1).astype(np.uint64)
            place = ((mixed[first] >> np.uint64(7)) + mixed[rank] % fan[first]) % np.uint64(n)
            bits = np.uint64(max(1, int(len(types) - 1).bit_length()))
            key = (place << (bits * np.uint64(2))) | (first.astype(np.uint64) << bits) | rank.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key, docs = key[order], docs[order]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            pairs = key[begins]
            asks = np.diff(np.append(begins, len(key)))
            mask = (np.uint64(1) << bits) - np.uint64(1)
            where, c, w = (pairs >> (bits * np.uint64(2))).astype(np.int64), ((pairs >> bits) & mask).astype(np.int64), (pairs & mask).astype(np.int64)
            edge = np.searchsorted(where, np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                lo, hi = int(edge[b]), int(edge[b + 1])
                heads = np.flatnonzero(np.concatenate([[True], c[lo + 1 : hi] != c[lo : hi - 1]]))
                own = code[w[lo:hi]]
                rare = own < 0
                yield row(int(names[b]), name, T.pack(types[c[lo:hi][heads]], np.diff(np.append(heads, hi - lo)), np.where(rare, len(words), own), types[w[lo:hi][rare]], asks[lo:hi], docs[begins[lo] : begins[hi] if hi < len(begins) else len(docs)]), None)

        for piece in T.pieces(batches, "text"):
            tokens, edge = _tokens(piece)
            doc_ids = piece.column("doc_id").to_pylist()
            ids = np.array([(x is None, x or 0) for x in doc_ids], np.int64).reshape(-1)
            held.append((ids, np.diff(edge), tokens, ~held_out(doc_ids)))
            size += len(tokens)
            if size > FLUSH_TOKENS:
                yield from flush()
                size, turn = 0, turn + 1
        if held:
            yield from flush()

    return run


PACKED = "label int, name long, data binary, docs binary"


def _first_seating(table: tuple[np.ndarray, np.ndarray], train_tokens: int, types: int, n: int, config: PitmanYorConfig):
    """Seats the contexts under a plain parent by counts; to each part of the words go the tables that serve them."""
    words, counts = table
    fans = _fans(counts, train_tokens, n)
    rest, many = max(1, train_tokens - int(counts.sum())), max(1, types - len(words))

    def plain(hashes: np.ndarray) -> np.ndarray:
        at = _find(words, hashes)
        return np.where(at >= 0, counts[at] if len(counts) else 0, rest / many).clip(0.5) / max(1, train_tokens)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        label = key[0].as_py()
        found = Contexts([(a, d) for a, d in zip(rows["name"].to_pylist(), rows["data"].to_pylist(), strict=True) if d is not None], table, fans, config, label)
        parent = plain(found.dishes)
        for _ in range(config.burn_in):
            found.sweep(parent)
        own, tables = found.to_parent()
        here = np.bincount(found.context, found.tables, len(found.total)).astype(np.int64)[found.split]
        shared, split = found.names[found.split], dict(_by_part(found.names[found.split], n))
        out = []
        for b, some in _by_part(own, n):
            out.append((label, b, own[some].tobytes(), T.pack(tables[some]), None, None))
        for b, some in split.items():
            out.append((label, b, None, None, shared[some].tobytes(), T.pack(here[some], here[some] * found.discount)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["label", "b", "words", "tables", "contexts", "opened"])

    return run


SERVED = "label int, b int, words binary, tables binary, contexts binary, opened binary"


def _by_part(words: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The parts of the words that are there, and which ones each has."""
    where = T.buckets(T.mix(words), n)
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(n + 1))
    return [(b, order[edge[b] : edge[b + 1]]) for b in np.flatnonzero(np.diff(edge)).tolist()]


def _parent_answers(types: int, config: PitmanYorConfig):
    """In each part of the words: their counts first, then the tables of the contexts' parts; an answer for each of these, and a row of sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        asked: list[tuple[int, np.ndarray, np.ndarray]] = []
        shared: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        part = 0

        def row(label: int | None, seated: bytes | None = None, counts: bytes | None = None, opened: bytes | None = None, customers: float | None = None, discounts: float | None = None) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((label, part, seated, counts, opened, customers, discounts), kinds, strict=True)], ["label", "b", "seated", "counts", "opened", "customers", "discounts"])

        for batch in batches:
            for label, b, words, tables, contexts, opened in zip(*(batch.column(c).to_pylist() for c in ("label", "b", "words", "tables", "contexts", "opened")), strict=True):
                part = b
                if label is None:
                    known = [np.frombuffer(words, np.uint64), T.unpack(tables)[0].astype(np.int64)]
                elif words is not None:
                    asked.append((label, np.frombuffer(words, np.uint64), T.unpack(tables)[0].astype(np.int64)))
                else:
                    shared.append((label, np.frombuffer(contexts, np.uint64), *T.unpack(opened)))
        if shared:
            shared.sort(key=lambda x: x[0])
            names = np.unique(np.concatenate([x[1] for x in shared]))
            tables, discounts = np.zeros(len(names), np.int64), np.zeros(len(names))
            for _, own, some, less in shared:
                at = np.searchsorted(names, own)
                tables[at] += some.astype(np.int64)
                discounts[at] += less
            for label, own, _, _ in shared:
                at = np.searchsorted(names, own)
                yield row(label, opened=T.pack(own, tables[at], discounts[at]))
        if not asked:
            return
        asked.sort(key=lambda x: x[0])
        words = np.unique(np.concatenate([x[1] for x in asked]))
        customers = np.zeros(len(words), np.int64)
        for _, own, tables in asked:
            customers[np.searchsorted(words, own)] += tables
        seated, less = parent_seating(customers, max(1, int((customers > 0).sum())) / max(1, types), types, config, part)
        at = _find(known[0], words)
        counts = np.where(at >= 0, known[1][at] if len(known[1]) else 0, 0)
        for label, own, _ in asked:
            to = np.searchsorted(words, own)
            yield row(label, T.pack(seated[to].astype(np.float32)), T.pack(counts[to]))
        yield row(None, customers=float(customers.sum()), discounts=less)

    return run


ANSWERS = "label int, b int, seated binary, counts binary, opened binary, customers double, discounts double"


def _scored(table: tuple[np.ndarray, np.ndarray], train_tokens: int, types: int, n: int, config: PitmanYorConfig):
    """Seats the contexts under the parent's answers and scores the tokens; a row of sums for each chunk, and the chunks' own rows passed on."""
    divisor, fans = train_tokens + 0.1 * (types + 1), _fans(table[1], train_tokens, n)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [(a, None, d, None, None, None) for a, d in zip(rows["name"].to_pylist(), rows["docs"].to_pylist(), strict=True) if d is not None]
        found = Contexts([(a, d) for a, d in zip(rows["name"].to_pylist(), rows["data"].to_pylist(), strict=True) if d is not None], table, fans, config, key[0].as_py())
        words = found.words
        seated, counts = np.zeros(len(words)), np.zeros(len(words), np.int64)
        places = dict(_by_part(words, n))
        customers = discounts = 0.0
        shared = found.names[found.split]
        found.elsewhere = np.zeros(len(shared)), np.zeros(len(shared))
        for b, s, c, opened, customers, discounts in zip(*(answers[x].to_pylist() for x in ("b", "seated", "counts", "opened", "customers", "discounts")), strict=True):  # noqa: B007
            if opened is None:
                seated[places[b]], counts[places[b]] = T.unpack(s)[0], T.unpack(c)[0]
            else:
                names, tables, less = T.unpack(opened)
                at = np.searchsorted(shared, names)
                found.elsewhere[0][at], found.elsewhere[1][at] = tables, less
        parent = (seated + (config.strength + discounts) / (types + 1)) / (config.strength + customers)
        model = np.log10(found.predictive(parent[found.word_of]))
        base = np.log10((counts + 0.1) / divisor)[found.word_of]
        known = (counts > 0)[found.word_of]
        at = 0
        for name, asks, docs in found.chunks:
            pair = np.repeat(found.pair_of[at : at + len(asks)], asks)
            at += len(asks)
            which, back = np.unique(docs, return_inverse=True)
            out.append((name, key[0].as_py(), T.pack(which), T.pack(np.bincount(back, known[pair], len(which)).astype(np.int64)), np.bincount(back, base[pair], len(which)).tobytes(), np.bincount(back, model[pair], len(which)).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 6, kinds, strict=True)], ["name", "part", "docs", "hits", "base", "model"])

    return run


SUMS = "name long, part int, docs binary, hits binary, base binary, model binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _gathered(train_tokens: int):
    """Adds the sums of each chunk up to its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rest: dict[int, list] = {}
        for batch in batches:
            for name, part, docs, *sums in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "docs", "hits", "base", "model")), strict=True):
                if part is None:
                    ids, lengths = T.unpack(docs)
                    own[name] = ids.astype(np.int64).reshape(-1, 2), lengths.astype(np.int64)
                else:
                    rest.setdefault(name, []).append((part, docs, *sums))
        for name, (ids, lengths) in own.items():
            hits, base, model = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            # always in the same order, so that repeated runs give equal sums
            for _, docs, h, b, m in sorted(rest.get(name, ()), key=lambda x: x[0]):
                docs = T.unpack(docs)[0].astype(np.int64)
                hits[docs] += T.unpack(h)[0].astype(np.int64)
                base[docs] += np.frombuffer(b)
                model[docs] += np.frombuffer(m)
            doc_ids = [None if none else i for none, i in ids.tolist()]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(held_out(doc_ids)), pa.array(lengths), pa.array(hits), pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(model), pa.array(10 ** (-model / lengths))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score_documents(docs: DataFrame, config: PitmanYorConfig = PitmanYorConfig()) -> DataFrame:
    """Trains on the documents that are not held out and scores all of them; ``perplexity`` is that of a text's tokens."""
    docs = documents(docs)
    n = tasks(docs, 4)
    counted = word_counts(docs, n)
    train_tokens, types = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    table = _above(counted, max(1, train_tokens * TABLE_SHARE))

    # dealt by a hash of the labels, which are chosen to fall on different tasks
    packed = docs.mapInArrow(_packed(table, train_tokens, n, labels(n)), PACKED).repartition(n, "label")
    served = packed.groupBy("label").applyInArrow(_first_seating(table, train_tokens, types, n, config), SERVED)
    none = F.lit(None).cast("binary")
    known = counted.select(F.lit(None).cast("int").alias("label"), "b", "words", F.col("counts").alias("tables"), none.alias("contexts"), none.alias("opened"))
    answers = known.unionByName(served).repartitionById(n, "b").mapInArrow(_parent_answers(types, config), ANSWERS)
    totals = answers.where("label is null").agg(F.sum("customers").alias("customers"), F.sum("discounts").alias("discounts"))  # one row
    replies = answers.where("label is not null").select("label", "b", "seated", "counts", "opened").join(F.broadcast(totals))
    sums = packed.groupBy("label").cogroup(replies.groupBy("label")).applyInArrow(_scored(table, train_tokens, types, n, config), SUMS)
    return sums.repartition(n, "name").mapInArrow(_gathered(train_tokens), SCHEMA)
