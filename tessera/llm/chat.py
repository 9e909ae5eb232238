"""Chat formatting by schema fingerprint.

A record is a JSON object in any of the layouts below. The hash of its nested field paths, those that some
layout knows, picks a declarative mapping, which turns the record into canonical (role, text) turns. A record that has the
fields of several layouts goes by the first of them, and its other fields play no part. The turns are
written in one template, with spans of the assistant's texts as the loss mask:

    <|turn|>role LF text <|end|> LF

Inside roles and texts a backslash is doubled and ``<|`` becomes ``\\l`` (in roles, a line feed ``\\n`` too), so
no control string can come from a text, and reading back gives every text as it was.

Defined results: null texts and roles are empty, and a field that is null is there; in a list of turns, what is no object is a turn without role; turns stand by turn number, then role, then text, nulls first;
repeated rows are repeated turns; a record whose paths match no mapping has a null layout and no turns;
an empty table gives no conversations; other columns play no part; a text of any length is handled whole. A
conversation is one output row, so its own size is what a task holds.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

TURN, END, MARK = "<|turn|>", "<|end|>", "<|"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(MARK, "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


_BACK = {"\\": "\\", "l": MARK, "n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


@dataclass(frozen=True)
class Layout:
    """``turns`` lists (role, path) pairs in order; a ``list`` has its turns in an array, under the two keys, with its own names of roles."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    list: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), list=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), list=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Layout("prompt and response", ("prompt", "response"), ("system",), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), ("system",), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), ("context", "system"), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
_KNOWN = {p for layout in LAYOUTS for p in layout.required + layout.optional}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; array positions count as one."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Fingerprint -> mapping, for every choice of a layout's optional fields.
MAPPINGS = {fingerprint(layout.required + extra): layout for layout in LAYOUTS for k in range(len(layout.optional) + 1) for extra in combinations(layout.optional, k)}


def canonical(record: dict) -> tuple[str, Layout | None, list[tuple[str, str]]]:
    """The fingerprint, the mapping it picks, and the turns."""
    found = paths(record) & _KNOWN
    mark = fingerprint(found)
    layout = MAPPINGS.get(mark)
    if layout is None:
        layout = next((x for x in LAYOUTS if found.issuperset(x.required)), None)
    if layout is None:
        return mark, None, []
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    turns = [("system", text(record["system"]))] if record.get("system") is not None else []
    if layout.list:
        array, role, content = layout.list
        turns += [(layout.roles.get(text(t.get(role)), text(t.get(role))), text(t.get(content))) if isinstance(t, dict) else ("", text(t)) for t in record[array]]
    else:
        turns += [(role, "\n".join(text(record[p]) for p in parts if record.get(p) is not None)) for role, parts in layout.turns]
    return mark, layout, turns


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of code points under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{TURN}{escape_role(role)}\n", escape(text), f"{END}\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(f"{END}\n").partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


FORMATTED = "fingerprint string, layout string, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_records(records: DataFrame, key: str, record: str) -> DataFrame:
    """(key, fingerprint, layout, formatted, loss_spans) of JSON records in heterogeneous layouts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for piece in T.pieces(batches, "record"):
            rows = []
            for text in piece.column("record").to_pylist():
                try:
                    value = json.loads(text) if text is not None else {}
                except ValueError:
                    value = {}
                mark, layout, turns = canonical(value if isinstance(value, dict) else {})
                formatted, spans = render(turns)
                rows.append((mark, layout and layout.name, formatted, [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([piece.column("key"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), spans_type), strict=True))], ["key", "fingerprint", "layout", "formatted", "loss_spans"])

    return records.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record")).mapInArrow(run, f"key {records.schema[key].dataType.simpleString()}, {FORMATTED}")


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows as one record. A question and its answer are a prompt and a response, with a system text before them an instruction and its output; all else are messages."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("all"))
    roles, text = F.transform("all", lambda t: t["role"]), lambda k: F.col("all")[k]["content"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    triple = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    messages = F.to_json(F.struct(F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    named = lambda *names: roles == F.array(*map(F.lit, names))
    return whole.select("conv_id", F.when(named("user", "assistant"), pair).when(named("system", "user", "assistant"), triple).otherwise(messages).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold: counts and digests of turns and of the text under the loss mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "formatted"):
            rows = []
            for text, spans in zip(piece.column("formatted").to_pylist(), piece.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                digest, lossy = hashlib.sha256(), hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                for body in loss:
                    lossy.update(body.encode())
                rows.append((len(turns), digest.hexdigest(), sum(map(len, loss)), lossy.hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([piece.column("key"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("key", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold escapes and the marks of common templates.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(replace(replace(replace(role, '\', '\\'), '<|', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '\l')) + 8) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
