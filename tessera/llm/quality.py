"""Quality rules: counts that fail a text outright, then its distance from its language.

Each text gives two histograms: character classes, and common words. The same histograms, added up
over all documents of a language that pass the base rules, are that language's reference; references of another corpus,
kept by store_references(), can stand in their place, so that a corpus full of junk is not its own standard. A text is
rejected when the Jensen-Shannon distance of either histogram from every reference is beyond its limit,
provided the text is long enough for that histogram to mean anything.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged
each for itself; an empty table gives an empty table; other columns play no part, but ``lang``, where
there is one, says which reference a document adds to (null or unknown: ``other``); a distance at its limit is within it; a text
of any length is measured whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T

#: Common words of each language that has a reference of its own.
COMMON_WORDS = {
    "en": "the of and to in is that for it was on with as be by at from this are or an not which have but".split(),
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er für sie".split(),
    "fr": "de la le et les des en un une du dans que pour qui est il sur au par pas plus ne avec ce se".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo como más pero sus le no".split(),
}
LANGUAGES = (*COMMON_WORDS, "other")

#: Character classes by byte: a continuation byte belongs to the character before it.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "bracket", "symbol", "other", "beyond ASCII")
_CLASS = np.full(256, 8, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"?-", b"()[]{}", b"#*$%&|<>!~^=+_@\\/`")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[0xC0:] = 9
_CLASS[0x80:0xC0] = 10
_OF_CLASS = (_CLASS[:, None] == np.arange(len(CLASSES))).astype(np.int64)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_IN_WORD = (~T.SPACE & (_CLASS != 10)).astype(np.int64)
_EDGE = np.zeros(256, bool)
_EDGE[np.frombuffer(b".,;:'\"?!-()[]{}#*$%&|<>", np.uint8)] = True


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 10  #: below it the base rules fail a text
    repeat_percent: int = 20  #: so many hundredths of the words in repeated windows are allowed
    window: int = 5
    char_limit: float = 0.25  #: largest distance of the character classes
    word_limit: float = 0.45  #: largest distance of the common words
    min_chars: int = 200  #: shorter texts are not held against the character classes
    min_common: int = 60  #: texts of fewer words are not held against the common words


def _spans(words: list[str]) -> np.ndarray:
    blobs = [w.encode() for w in words]
    ends = np.cumsum([len(b) for b in blobs])
    return T.span_hashes(np.frombuffer(b"".join(blobs), np.uint8), ends - [len(b) for b in blobs], ends)


_ALL_COMMON = list(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
_COMMON_HASHES = _spans(_ALL_COMMON)
_COMMON_ORDER = np.argsort(_COMMON_HASHES)
_COMMON_SORTED = _COMMON_HASHES[_COMMON_ORDER]
#: After the common words: words without a letter or digit, and all other words.
N_CHAR, N_WORD = len(CLASSES), len(_ALL_COMMON) + 2


def measure(column: pa.Array, config: QualityConfig = QualityConfig()) -> dict[str, np.ndarray]:
    """Counts and both histograms of each text of a column."""
    data, offsets = T.flat(column)
    rows = len(offsets) - 1
    starts, ends, bounds = T.words(data, offsets)
    row_of_word = np.repeat(np.arange(rows), np.diff(bounds))
    out = {"n_words": np.diff(bounds)}
    bytes_of = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64).reshape(rows, 256)
    chars = bytes_of @ _OF_CLASS
    out["word_chars"] = bytes_of @ _IN_WORD
    out["n_symbols"] = bytes_of @ _SYMBOL

    salt = T.mix(np.arange(1, rows + 1, dtype=np.uint64))
    cut = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], cut + 1])
    line_starts.sort(kind="stable")
    line_ends = np.concatenate([cut, offsets[1:]])
    line_ends.sort(kind="stable")
    line_rows = np.repeat(np.arange(rows), 1 + np.diff(np.searchsorted(cut, offsets)))
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = T.mix(T.span_hashes(data, line_starts[full], line_ends[full]) ^ salt[line_rows[full]])
    _, once = np.unique(lines, return_index=True)
    out["n_dup_lines"] = np.bincount(line_rows[full], minlength=rows) - np.bincount(line_rows[full][once], minlength=rows)

    hashes = T.span_hashes(data, starts, ends)
    grams, at = T.windows(hashes, bounds, config.window)
    gram_rows = np.repeat(np.arange(rows), np.diff(at))
    keys = T.mix(grams ^ salt[gram_rows])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    begin = (bounds[:-1] - at[:-1])[gram_rows[again]] + np.flatnonzero(again)
    cover = np.bincount(begin, minlength=len(hashes) + 1) - np.bincount(begin + config.window, minlength=len(hashes) + 1)[: len(hashes) + 1]
    out["n_repeat_words"] = np.bincount(row_of_word[np.cumsum(cover)[: len(hashes)] > 0], minlength=rows)

    lo, hi, lowered = starts.copy(), ends.copy(), T.LOWER[data]
    for edge, move, at_edge in ((lo, 1, 0), (hi, -1, -1)):
        left = np.flatnonzero(_EDGE[data[edge + at_edge]] & (hi - lo > 1))
        while len(left):
            edge[left] += move
            left = left[_EDGE[data[edge[left] + at_edge]] & (hi[left] - lo[left] > 1)]
    short = hi - lo <= 16
    bare = T.span_hashes(lowered, lo[short], hi[short])
    place = np.minimum(np.searchsorted(_COMMON_SORTED, bare), len(_COMMON_SORTED) - 1)
    hit = _COMMON_SORTED[place] == bare
    common = np.bincount(row_of_word[short][hit] * N_WORD + _COMMON_ORDER[place[hit]], minlength=rows * N_WORD).reshape(rows, N_WORD)
    common[:, -2] = np.bincount(row_of_word[_EDGE[data[lo]] & (hi - lo == 1)], minlength=rows)
    common[:, -1] = out["n_words"] - common.sum(axis=1)
    out["base_failed"] = (out["n_words"] < config.min_words) | (100 * out["n_repeat_words"] > config.repeat_percent * out["n_words"])
    return out | {"chars": chars, "common": common}


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row from the reference; rows without counts are at 0."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (left + right) / 2)), 0)


def references(docs: DataFrame, config: QualityConfig = QualityConfig()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The histograms of each language, over all documents that pass the base rules. One bounded row a language and task is added up."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), N_CHAR + N_WORD), np.int64)
        for piece in T.pieces(batches, "text"):
            found = measure(piece.column("text"), config)
            which = np.array([LANGUAGES.index(x) if x in COMMON_WORDS else len(LANGUAGES) - 1 for x in piece.column("lang").to_pylist()], np.int64)
            good = ~found["base_failed"]
            np.add.at(sums, which[good], np.hstack([found["chars"], found["common"]])[good])
        yield pa.RecordBatch.from_pydict({"sums": pa.array(sums.tolist(), pa.list_(pa.int64())), "k": pa.array(range(len(LANGUAGES)), pa.int32())})

    parts = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(T.lean(gather), "sums array<long>, k int")
    total = parts.select("k", F.posexplode("sums")).where("col > 0").groupBy("k", "pos").agg(F.sum("col").alias("n"))
    table = np.zeros((len(LANGUAGES), N_CHAR + N_WORD))
    for k, pos, n in total.collect():  # 5 languages by the histograms' fixed length
        table[k, pos] = n
    return {name: (row[:N_CHAR], row[N_CHAR:]) for name, row in zip(LANGUAGES, table, strict=True) if row.sum()}


References = dict[str, tuple[np.ndarray, np.ndarray]]


def store_references(spark: SparkSession, refs: References, path: str) -> None:
    """Writes references, a row a language, below ``path``."""
    rows = [(name, chars.astype(np.int64).tolist(), words.astype(np.int64).tolist()) for name, (chars, words) in refs.items()]
    spark.createDataFrame(rows, "lang string, chars array<long>, words array<long>").coalesce(1).write.mode("overwrite").parquet(path)


def stored_references(spark: SparkSession, path: str) -> References:
    """Inverse of store_references()."""
    return {r.lang: (np.array(r.chars, float), np.array(r.words, float)) for r in spark.read.parquet(path).collect()}  # 5 languages


def judge(found: dict[str, np.ndarray], refs: dict[str, tuple[np.ndarray, np.ndarray]], config: QualityConfig) -> dict[str, np.ndarray]:
    rows = len(found["n_words"])
    chars = np.min([distance(found["chars"], c) for c, _ in refs.values()], axis=0) if refs else np.zeros(rows)
    common = np.min([distance(found["common"], w) for _, w in refs.values()], axis=0) if refs else np.zeros(rows)
    far = ((found["chars"].sum(axis=1) >= config.min_chars) & (chars > config.char_limit)) | ((found["n_words"] >= config.min_common) & (common > config.word_limit))
    return {"char_distance": chars, "word_distance": common, "kept": ~found["base_failed"] & ~far}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig(), refs: References | None = None) -> DataFrame:
    """A row for each document: its counts, distances and verdict; held against ``refs``, or else the references of ``docs`` themselves."""
    refs = references(docs, config) if refs is None else refs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "text"):
            found = measure(piece.column("text"), config)
            found |= judge(found, refs, config)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(found["base_failed"]), pa.array(found["kept"]), pa.array(found["char_distance"]), pa.array(found["word_distance"])],
                ["doc_id", *COUNTS, "base_failed", "kept", "char_distance", "word_distance"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.lean(run), SCHEMA)


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig(), refs: References | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept; see quality_rules()."""
    refs = references(docs, config) if refs is None else refs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "text"):
            found = measure(piece.column("text"), config)
            yield piece.filter(pa.array(judge(found, refs, config)["kept"]))

    return docs.mapInArrow(T.lean(run), docs.schema)
