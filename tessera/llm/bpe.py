"""BPE encoding by backtracking, decoding by an offset table.

The vocabulary's strings are in an Aho-Corasick automaton; one pass over a word finds the longest string at every
position. Tokens are laid from the left, longest first, as long as each neighbouring pair is compatible: a pair is
compatible if the merges, in their order, would never join anything across its border. A dead end steps back to
the next shorter string, and positions that led to one are not tried again, so the work is linear in the word's
length. What comes out is what applying the merges one by one gives. Words that recur are looked up in
a bounded table of each Python worker; it saves work and changes no result.

The text is normalised and split as the vocabulary's file says: texts whose code points are all below ``TABLE`` by
a table of classes, others by the tokenizers library's own normaliser and splitter. Special tokens in a text become
their ids before that.

Decoding takes each id's bytes from one array by its offsets.

Defined results: a null or empty text has no tokens and an empty decoding; repeated rows are encoded each
for itself; an empty table gives an empty table; other columns stay or play no part as each function says.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from . import _text as T
from ._spark import documents

#: Below it, Python and the library agree on every code point's class, composition and lower case.
TABLE = 0x500
#: Words and pairs that a worker keeps.
CACHE = 400_000
#: Characters whose classes are looked up at once.
PLACES = 1 << 18


def default_vocabulary() -> str:
    """The vocabulary that the queries use, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, or else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file: BPE with a word-end suffix, byte-level, without unknowns."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        splitters = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model["unk_token"] or not model["end_of_word_suffix"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splitters] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: not a vocabulary of the kind that this encoder knows")
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = splitters[0]["pattern"]["Regex"]
        self.splitter = Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.classes = np.array([0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(TABLE))], np.uint8)

        suffix, back = model["end_of_word_suffix"], {c: chr(b) for b, c in byte_characters().items()}
        self.end = "Ā"  # stands for the suffix; other characters are bytes
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        texts, strings = [""] * size, [""] * size
        for token, i in vocab.items():
            texts[i] = token
            ends = token.endswith(suffix)
            strings[i] = "".join(back[c] for c in token.removesuffix(suffix)) + self.end * ends
        for token, i in self.special.items():
            texts[i] = token
        self.length = [len(s) for s in strings]
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[left + right]
            key = (vocab[left], vocab[right])
            if self.parts[made] is None:
                self.parts[made], self.rank[made] = key, rank
            self.joined.setdefault(key, rank)
        #: Strings that the merges never leave as one token are no candidates.
        self.valid = [bool(s) and (self.parts[i] is not None or len(s.removesuffix(self.end)) == 1) for i, s in enumerate(strings)]
        for i in sorted((i for i in range(size) if self.parts[i]), key=self.rank.__getitem__):
            left, right = self.parts[i]
            self.valid[i] = self.valid[left] and self.valid[right] and self._apart(left, right, self.rank[i])
        automaton = ahocorasick.Automaton()
        of = {}
        for i, s in enumerate(strings):
            if self.valid[i]:
                automaton.add_word(s, i)
                of[s] = i
        automaton.make_automaton()
        self.automaton = automaton
        #: Of each token, the longest shorter one that it begins with.
        self.shorter = [next((of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in of), -1) if self.valid[i] else -1 for i, s in enumerate(strings)]
        self.pairs: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}

        def table(entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
            blobs = [e.encode() for e in entries]
            return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])

        self.decoding = table([" " + t for t in texts])
        self.numbers = table([f" {i}" for i in range(size)])

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` joins anything across the border of two tokens, taking them apart from the last merge back."""
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            if self.rank[left] < 0 and self.rank[right] < 0:
                return True
            if self.rank[left] > self.rank[right]:
                before = self.rank[left]
                left = self.parts[left][1]
            else:  # of equal ranks the one further left comes first, and a merge across lies left of the right token's own
                before = self.rank[right] + 1
                right = self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right, 1 << 60)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        text = word.decode("latin-1") + self.end
        n, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * (n + 1)
        for stop, token in self.automaton.iter(text):
            at = stop + 1 - length[token]
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        dead = bytearray(n + 1)
        dead[n - 1] = 1  # the suffix is no token of its own
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        known, out = self.words, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = np.array(self.encode_word(word), np.uint32).tobytes()
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return out

    def _plain(self, text: str) -> str | None:
        """The normalised text if the table of classes covers it."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if max(text) >= chr(TABLE):
            return None
        # each character has its lower case by itself, also a sigma at a word's end
        text = text.replace("Σ", "σ").lower()
        return text if max(text) < chr(TABLE) else None

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of normalised texts within the table, and the number of each text's first word."""
        whole = " ".join(texts)
        points = np.frombuffer(whole.encode("utf-16-le"), np.uint16)  # all are below TABLE
        kind = np.zeros(len(points) + 1, np.uint8)
        for at in range(0, len(points), PLACES):  # NumPy makes 8 bytes of each place that it looks up
            kind[at : at + PLACES][: len(points) - at] = self.classes[points[at : at + PLACES]]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        first = (kind != 0) & ((kind != before) | (kind == 2))
        for at in np.flatnonzero(first[:-1] & (points == 39)).tolist():
            # an apostrophe that stands alone, before letters
            if first[at + 1] and kind[at + 1] == 1:
                tail = whole[at + 1 : at + 3]
                size = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
                if size:
                    first[at + 1] = False
                    first[at + size] = kind[at + size] != 0
        starts = np.flatnonzero(first)
        width = np.uint8(1) + (points >= 0x80)
        inside = kind[:-1] != 0
        data = np.frombuffer(whole.encode(), np.uint8)[np.repeat(inside, width)]
        # what follows a word up to the next one has no width
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(width * inside, starts, dtype=np.int64))]) if len(starts) else np.zeros(1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's own."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, places = [], []
        for k, text in enumerate(texts):
            form = None if self.special_pattern and "<" in text and self.special_pattern.search(text) else self._plain(text) if text else ""
            if form is not None:
                plain.append(form)
                places.append(k)
            else:
                out[k] = self._encode_parts(text)
        words, firsts = self._split(plain)
        coded = words.dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]) if ids else np.zeros(1, np.int64)
        take, ends = T.ragged(offsets, coded.indices.to_numpy().astype(np.int64))
        found = flat[take]
        bounds = ends[firsts[:-1]], ends[firsts[1:]]
        if len(places) == len(texts):
            return found, np.append(bounds[0], ends[-1])
        for k, a, b in zip(places, *(x.tolist() for x in bounds), strict=True):
            out[k] = found[a:b]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _encode_parts(self, text: str) -> np.ndarray:
        """A text with special tokens, or with code points beyond the table."""
        out: list[bytes] = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32).tobytes())
            elif part:
                form = self.normalizer.normalize_str(part)
                out += self.ids_of([w.encode() for w, _ in self.splitter.pre_tokenize_str(form)])
        return np.frombuffer(b"".join(out), np.uint32)

    def _spelled(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        data, at = table
        take, ends = T.ragged(at, ids.astype(np.int64))
        whole = data[take].tobytes()
        cuts = ends[offsets].tolist()
        return [whole[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text of each row of ids: its tokens with a space between, in UTF-8."""
        return self._spelled(self.decoding, ids, offsets)

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each row's ids in decimal, with a space between."""
        return self._spelled(self.numbers, ids, offsets)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One set of tables in each Python worker."""
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the column ``token_ids`` instead of ``text``; another column of that name goes."""
    path = path or default_vocabulary()
    others = [c for c in docs.columns if c not in ("text", "token_ids")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for piece in T.pieces(batches, "text"):
            ids, offsets = vocab.encode([t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in others), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], [*others, "token_ids"])

    slim = docs.select(*others, F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(T.lean(run), slim.drop("text").schema.add("token_ids", ArrayType(IntegerType())))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with the column ``text`` instead of ``token_ids``; null ids are an empty text."""
    path = path or default_vocabulary()
    others = [c for c in rows.columns if c not in ("text", "token_ids")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("token_ids").to_pylist()]
            texts = vocab.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([t.decode() for t in texts], pa.string())], [*others, "text"])

    slim = rows.select(*others, "token_ids")
    return slim.mapInArrow(T.lean(run), slim.drop("token_ids").schema.add("text", StringType()))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        digest = lambda rows: [hashlib.sha256(r).hexdigest() for r in rows]
        for piece in T.pieces(batches, "text"):
            ids, offsets = vocab.encode([t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digest(vocab.decimals(ids, offsets))), pa.array(digest(vocab.decode(ids, offsets)))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(T.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
