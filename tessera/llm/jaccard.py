"""N-gram Jaccard join by a token-group matrix.

1. Texts with the same shingle set are one *class*, named by a 64-bit fingerprint of the set.
2. Every (token, class) entry goes to the token's bucket, packed; only entries whose token is in two
   classes or more come back. A class whose returned tokens cannot reach the overlap that any partner
   needs is done: the matrix row of the whole corpus already bounds it.
3. The remaining classes are put into groups of similar sets (by their rarest shared token, then by a
   random order of tokens); large groups are split. Each group is opened once, and joined by exact overlaps.
4. Groups, now within one component each, store the union of their members' prefix tokens. A query class
   meets the groups of other components that hold one of its prefix tokens; the number of such tokens
   bounds its overlap with any member, and only groups that the bound leaves are opened.

Tokens are ordered from rare to common, so a passage that many documents share is in no prefix unless it
is most of the document. No step lists all pairs of a group; verified links become edges of a forest.
For the number of links (``jaccard_links``) the classes ask all groups, those of their own component and their own
group too. Every class sits in one part of one group, so each pair that links is met once, verified there, and
added up by class, each partner with as many as its copies.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing;
a text of fewer words than a shingle has its whole sequence as its only shingle; repeated rows and equal
texts share a component; of equal sizes and counts the smaller fingerprint comes first, which no result shows; a text of any
length is one set, made whole; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, documents, tasks
from .components import components

#: Bytes of packed tokens that a map task holds before it emits them.
FLUSH_BYTES = 16 << 20
#: Classes that one task holds against a group.
QUERIES_A_TASK = 1024
#: Parts of a join by a key that many classes may share.
SALTS = 16
#: Components of up to a group's size over this share groups with others.
SMALL_SHARE = 8


@dataclass(frozen=True)
class JaccardConfig:
    width: int = 5
    percent: int = 75  #: 100 * intersection >= percent * union links two documents
    group_size: int = 256  #: members of a group at most; larger ones are split
    rounds: int = 2  #: groupings before the matrix is built, each by another key


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap at which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(sets), np.uint64)
    for k, s in enumerate(sets):
        out[k] = T.mix(np.array([(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29))).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]
    return out.view(np.int64)


def _sets(piece: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return T.shingle_sets(*T.flat(piece.column("text")), width)


def shingle_classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, class); class is null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "text"):
            sets = _sets(piece, width)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes), pa.array(_fingerprints(sets), mask=sizes == 0)], ["doc_id", "n_shingles", "class"])

    return docs.mapInArrow(T.lean(run), "doc_id long, n_shingles long, class long")


def _entries(width: int, n: int):
    """Map side of the matrix: a row for each bucket with classes, their token counts and the packed tokens; each class once a flush."""

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        names = np.fromiter(held, np.int64, len(held))
        tokens = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(names)), [len(s) for s in held.values()])
        sizes = np.bincount(owner, minlength=len(names))
        where = T.buckets(tokens, n)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(n + 1))
        held.clear()
        for b in range(n):
            rows = order[bounds[b] : bounds[b + 1]]
            if len(rows):
                own, counts = np.unique(owner[rows], return_counts=True)
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "classes": [names[own].tobytes()], "sizes": [sizes[own].astype(np.int32).tobytes()], "counts": [counts.astype(np.int32).tobytes()], "tokens": [T.pack48(tokens[rows])]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for piece in T.pieces(batches, "text"):
            sets = _sets(piece, width)
            for name, s in zip(_fingerprints(sets).tolist(), sets, strict=True):
                if len(s) and name not in held:
                    held[name] = s
                    size += 8 * len(s)
            if size > FLUSH_BYTES:
                yield from flush(held)
                size = 0
        yield from flush(held)

    return run


def _shared(n: int):
    """Reduce side: for each class the tokens of a bucket that another class has too, and in how many classes they are, packed by the class's own bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shared_of(batches, n)

    return run


def _shared_of(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for b, *blobs in zip(*(batch.column(c).to_pylist() for c in ("b", "classes", "sizes", "counts", "tokens")), strict=True):
            held.append((b, *blobs))
    held.sort(key=lambda x: x[0])
    at = 0
    while at < len(held):
        stop = at
        while stop < len(held) and held[stop][0] == held[at][0]:
            stop += 1
        part, at = held[at:stop], stop
        classes = np.concatenate([np.frombuffer(x[1], np.int64) for x in part])
        sizes = np.concatenate([np.frombuffer(x[2], np.int32) for x in part])
        counts = np.concatenate([np.frombuffer(x[3], np.int32) for x in part])
        tokens = np.concatenate([T.unpack48(np.frombuffer(x[4], np.uint8)) for x in part])
        names, first, index = np.unique(classes, return_index=True, return_inverse=True)
        sizes_of = sizes[first]
        owner = np.repeat(index.astype(np.int64), counts)
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        spread = np.diff(np.append(begins, len(tokens)))
        df = np.repeat(spread, spread)
        tokens, owner, df = tokens[df > 1], owner[df > 1], df[df > 1]
        if not len(tokens):
            continue
        order = np.argsort(owner, kind="stable")
        tokens, owner, df = tokens[order], owner[order], np.minimum(df[order], np.iinfo(np.uint16).max).astype(np.uint16)
        kept, begins, counts = np.unique(owner, return_index=True, return_counts=True)
        # all of a class goes to one bucket of the next exchange, many classes a row
        target = T.buckets(T.mix(names[kept].view(np.uint64)), n)
        by = np.argsort(target, kind="stable")
        edge = np.searchsorted(target[by], np.arange(n + 1))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for c in np.flatnonzero(np.diff(edge)).tolist():
            some = by[edge[c] : edge[c + 1]]
            take, _ = T.ragged(bounds, some)
            yield pa.RecordBatch.from_pydict({"b": pa.array([c], pa.int32()), "classes": [names[kept[some]].tobytes()], "sizes": [sizes_of[kept[some]].tobytes()], "counts": [counts[some].astype(np.int32).tobytes()], "tokens": [tokens[take].tobytes()], "dfs": [df[take].tobytes()]})


def _survivors(percent: int):
    """Gathers each class's shared tokens: drops the class if they are too few; orders the rest from rare to common, and finds how many are in its prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("classes", "sizes", "counts", "tokens", "dfs")), strict=True)]
        if not held:
            return
        classes, sizes, counts, tokens, dfs = (np.concatenate([np.frombuffer(x, kind) for x in column]) for column, kind in zip(zip(*held, strict=True), (np.int64, np.int32, np.int32, np.uint64, np.uint16), strict=True))
        held.clear()
        names, first, index = np.unique(classes, return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        owner = np.repeat(index, counts)
        least, has = -(-percent * n // 100), np.bincount(owner, minlength=len(names))
        good = has >= least
        keep = good[owner]
        tokens, dfs, owner = tokens[keep], dfs[keep], owner[keep]
        order = np.lexsort((tokens, dfs, owner))
        tokens, owner = tokens[order], owner[order]
        edge = np.searchsorted(owner, np.arange(len(names) + 1))
        # all tokens that are in one class only come first in the order of the whole set
        prefix = has - least + 1
        chosen = np.flatnonzero(good)
        for lo in range(0, len(chosen), 1024):
            some = chosen[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(n[some]), pa.array(prefix[some].astype(np.int32)), pa.array([tokens[edge[k] : edge[k + 1]].tobytes() for k in some.tolist()], pa.binary())], ["class", "n", "prefix", "tokens"])

    return run


def _keys(turn: int):
    """The token by which a class is grouped: its rarest, and in later turns the smallest in another order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for blob in batch.column("tokens").to_pylist():
                tokens = np.frombuffer(blob, np.uint64)
                keys.append(int((tokens[0] if turn == 0 else T.mix(tokens ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1))).min()).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(keys, pa.int64())], ["class", "key"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _overlaps(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many tokens of the sorted ``query`` each of n sets has; ``tokens`` and ``owner`` list all their tokens."""
    if not len(query):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    return np.bincount(owner[query[place] == tokens], minlength=n)


def _open(percent: int):
    """Join the members of one group by exact overlaps; the links found make a forest."""

    def run(table: pa.Table) -> pa.Table:
        names = np.array(table.column("class").to_pylist(), np.int64)
        sizes = np.array(table.column("n").to_pylist(), np.int64)
        order = np.argsort(names)
        sets = [np.sort(np.frombuffer(x, np.uint64)) for x in table.column("tokens").to_pylist()]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        forest, a, b = _Forest(len(names)), [], []
        left = len(names) - 1
        for k in order.tolist():
            if not left:
                break
            roots = np.array([forest.find(j) for j in range(len(names))])
            if (roots == roots[k]).all():
                continue
            found = _overlaps(sets[k], tokens, owner, len(names))
            for j in np.flatnonzero((100 * found >= percent * (sizes + sizes[k] - found)) & (roots != roots[k])).tolist():
                if forest.find(j) != forest.find(k):
                    forest.join(j, k)
                    left -= 1
                    a.append(names[k])
                    b.append(names[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: What a query and a group's row carry.
QUERY = ("class", "n", "label", "group", "part", "members", "small")


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, lengths = batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist()
        parts = [np.frombuffer(x, np.int64, count=k) for x, k in zip(blobs, lengths, strict=True)]
        rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in QUERY), pa.array(np.concatenate(parts) if parts else [], pa.int64())], [*QUERY, "token"])


def _commonest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last token in the order from rare to common."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([int(np.frombuffer(x, np.int64)[-1]) for x in batch.column("tokens").to_pylist()], pa.int64())], ["class", "token"])


def _verify(percent: int, count: bool):
    """One group's members against the queries that its bound left: an edge (a, b) to one member of each component that the query links with.
    With ``count``, also a row (a, null, n) for each class with links here: the copies of all its partners."""

    def run(table: pa.Table) -> pa.Table:
        a, b, n_links = [], [], []
        asks = table.column("asks")
        group, queries = table.filter(pc.invert(asks)), table.filter(asks)
        if group.num_rows and queries.num_rows:
            names, sizes, labels = (np.array(group.column(c).to_pylist(), np.int64) for c in ("class", "n", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            copies, links, asked = np.array(group.column("copies").to_pylist(), np.int64), np.zeros(len(sets), np.int64), {}
            for name, n, label, blob, own, inside in zip(*(queries.column(c).to_pylist() for c in ("class", "n", "label", "tokens", "copies", "inside")), strict=True):
                found = _overlaps(np.sort(np.frombuffer(blob, np.uint64)), tokens, owner, len(sets))
                linked = 100 * found >= percent * (sizes + n - found)
                hits = np.flatnonzero(linked & (labels != label))
                _, first = np.unique(labels[hits], return_index=True)
                a += [name] * len(first)
                b += names[hits[first]].tolist()
                if count:
                    # both of a pair inside the group may ask: the smaller one counts it
                    hits = np.flatnonzero(linked & (names > name)) if inside else np.flatnonzero(linked)
                    links[hits] += own
                    if len(hits):
                        asked[name] = int(copies[hits].sum())
            some = np.flatnonzero(links)
            n_links = [None] * len(a) + links[some].tolist() + list(asked.values())
            a += names[some].tolist() + list(asked)
            b += [None] * (len(some) + len(asked))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n_links, pa.int64())})

    return run


def _salted(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Joins one row a key to many; a key that many classes have is dealt over ``SALTS`` tasks."""
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(many, [key, "salt"]).drop("salt")


def class_links(docs: DataFrame, config: JaccardConfig = JaccardConfig(), copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(node, label), the components of the classes that link with another class; and with ``copies``, (class, copies), the links of each
    class that has any: (class, n_links), the copies of all its partners."""
    n = tasks(docs, 2)
    percent = config.percent
    entries = docs.mapInArrow(T.lean(_entries(config.width, n)), "b int, classes binary, sizes binary, counts binary, tokens binary").repartitionById(n, "b")
    shared = entries.mapInArrow(T.lean(_shared(n)), "b int, classes binary, sizes binary, counts binary, tokens binary, dfs binary").repartitionById(n, "b")
    alive = cut(shared.mapInArrow(T.lean(_survivors(percent)), "class long, n long, prefix int, tokens binary"))
    alive = alive.withColumn("copies", F.lit(1).cast("long")) if copies is None else cut(alive.join(copies, "class"))

    edges = None
    for turn in range(config.rounds):
        keyed = alive.mapInArrow(T.lean(_keys(turn)), "class long, key long")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("leader")).where("members > 1")
        grouped = _salted(keyed, sizes, "key")
        parts = F.ceil(F.col("members") / config.group_size).cast("long")
        own = grouped.select("key", F.pmod(F.xxhash64("class"), parts).alias("part"), "class")
        # the leader sits in each part of a split group, so that the parts meet
        lead = grouped.where((F.col("class") == F.col("leader")) & (parts > 1)).select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "class")
        opened = own.unionByName(lead).distinct().join(alive.select("class", "n", "tokens"), "class").groupBy("key", "part").applyInArrow(_open(percent), "a long, b long")
        edges = opened if edges is None else edges.unionByName(opened)
    edges = cut(edges)
    labels = components(edges)

    # where each class goes is worked out on slim rows; their tokens join last, by class
    slim = alive.mapInArrow(T.lean(_commonest), "class long, token long").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    slim = _salted(slim, slim.groupBy("label").agg(F.count("*").alias("members")), "label")
    # small components share groups with others that have the same commonest token; large ones have groups of their own
    slim = slim.withColumn("small", F.col("members") * SMALL_SHARE <= config.group_size)
    slim = cut(slim.withColumn("group", F.when(F.col("small"), F.xxhash64("token")).otherwise(F.xxhash64("label", F.lit(1)))).drop("token"))
    crowd = slim.groupBy("group").agg(F.ceil(F.count("*") / config.group_size).cast("long").alias("parts"))
    slim = _salted(slim, crowd, "group").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).drop("parts")
    placed = cut(alive.join(slim, "class"))
    rows = placed.select(*QUERY, "prefix", "tokens").where("prefix > 0").mapInArrow(T.lean(_prefixes), "class long, n long, label long, group long, part long, members long, small boolean, token long")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("crowd")).where("lo < hi" if copies is None else "crowd > 1").select("token")
    rows = cut(rows.join(mixed, "token"))
    matrix = rows.groupBy("token", "group", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("members").alias("members"), F.first("small").alias("small"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("crowd"))
    asking = rows.select("token", "class", "n", F.col("label").alias("own"), F.col("members").alias("own_members"), F.col("small").alias("own_small"), F.col("group").alias("own_group"), F.col("part").alias("own_part"))
    # each two classes of different components meet once: of two shared groups the first one's classes ask; small components ask large ones, and of two large ones the smaller asks
    # where links are counted, so do those of one component, and a class asks its own part if that has others with the token
    once = "case when own_small and small then own_group < group or own_group = group and own_part <= part when small then false when own_small then true else own_members < members or own_members = members and (own < lo or own = lo and own_part <= part) end"
    others = "(own <> lo or own <> hi)" if copies is None else "(crowd > 1 or own_group <> group or own_part <> part)"
    met = asking.join(matrix, "token").where(f"{others} and {once} and 100 * least <= 100 * 100 * n div {percent} and 100 * most >= {percent} * n")
    # a member of m elements shares at most the counted tokens and what follows the shorter prefix; it must lie within the size bounds
    low = f"greatest(least, ceil({percent} * n / 100.0))"
    bound = met.groupBy("class", "n", "group", "part").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most")).where(
        f"hits + greatest(ceil({percent} * n / 100.0), ceil({percent} * least(most, floor(100.0 * n / {percent})) / 100.0)) - 1 >= ceil({percent} * (n + {low}) / {100 + percent}.0)"
    )
    bound = cut(bound.select("group", "part", "class"))
    # a group that many classes ask for is opened in several tasks, each with some of them
    wanted = bound.groupBy("group", "part").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("long").alias("chunks"))
    groups = placed.join(wanted, ["group", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    home = placed.select("class", "n", "label", "copies", "tokens", F.col("group").alias("own_group"), F.col("part").alias("own_part"))
    asking = bound.join(wanted, ["group", "part"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks"))).join(home, "class").withColumn("inside", F.expr("own_group = group and own_part = part"))
    columns = ("group", "part", "chunk", "class", "n", "label", "copies", "tokens")
    both = groups.select(*columns, F.lit(False).alias("inside"), F.lit(False).alias("asks")).unionByName(asking.select(*columns, "inside", F.lit(True).alias("asks")))
    more = both.groupBy("group", "part", "chunk").applyInArrow(_verify(percent, copies is not None), "a long, b long, n long")
    if copies is None:
        return components(edges.unionByName(more.select("a", "b"))), None
    more = cut(more)
    links = more.where("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    return components(edges.unionByName(more.where("n is null").select("a", "b"))), links


def jaccard_components(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row; component_id is the smallest doc_id reachable by links, itself included."""
    return _joined(docs, config, False)


def jaccard_links(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The same with n_links, the number of other rows that a row links with; those with the same set are among them."""
    return _joined(docs, config, True)


def _joined(docs: DataFrame, config: JaccardConfig, count: bool) -> DataFrame:
    docs = documents(docs)
    named = cut(shingle_classes(docs, config.width))
    copies = cut(named.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"))) if count else None
    links, n_links = class_links(docs, config, copies)
    classes = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    labelled = classes.join(links.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    # a document alone in its component is its own smallest
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    found = labelled.join(roots, "label").select("class", "component_id", "rows")
    if n_links is not None:
        # a class without partners in its component links with its own copies only
        found = found.join(n_links, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")) + F.col("rows") - 1)
    found = cut(found.drop("rows"))
    # a hot class meets its one row in many parts: salt both sides
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(many, ["class", "salt"], "left")
    own = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count else []
    return joined.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"), *own)
