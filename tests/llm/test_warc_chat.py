from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import chat, queries, warc
from tessera.llm._spark import scratch

SF = "/root/testdata/sf0.01"
PAGES = [(1, "u", "x" * 1000), (2, None, "x" * 1000), (3, "a\r\nb é", None), (4, "", "x" * 10), (5, "", "x" * 10), (None, "n", "x" * 1000), (7, "q", "é" * 100000 + "z"), (7, "q", "é" * 100000 + "z")]


def _sql(name, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = db.execute(queries.ORACLE_SQL[name])
    return [c[0] for c in rel.description], rel.fetchall()


@pytest.mark.parametrize(("name", "table"), [("op3_warc_chunks", "pages"), ("op8_chat_format", "conversations")])
def test_query_matches_sql(spark, name, table):
    columns, want = _sql(name, table)
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_make_up_the_payloads(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, scratch(spark, "warc"), chunk_bytes=7000, file_bytes=1000)
    bodies, ends = defaultdict(bytes), []
    for r in sorted(warc.read_warc(manifest, chunk_bytes=1000).collect(), key=lambda r: (r.page_id or -1, r.chunk)):
        if r.record_type == "response" and r.page_id != 7:
            bodies[r.page_id] += r.data
        if r["last"]:
            ends.append((r.page_id, r.payload_bytes, r.record_type, r.refers_to))
    assert dict(bodies) == {1: b"x" * 1000, 3: b"", 4: b"x" * 10, 5: b"x" * 10}
    assert sorted(ends, key=str) == sorted([(1, 1000, "response", None), (2, 1000, "revisit", 1), (None, 1000, "revisit", 1), (3, 0, "response", None), (4, 10, "response", None), (5, 10, "response", None), (7, 200001, "response", None), (7, 200001, "response", None)], key=str)
    assert manifest.count() > 1
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.text(alphabet=st.sampled_from(list("\\<|tunrled>\n é")), max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages"),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"id":"x"}', "conversations"),
        (3, '{"prompt":"hi","completion":"yo"}', "prompt and completion"),
        (4, '{"instruction":"hi","input":null,"output":"yo"}', "instruction"),
        (5, '{"question":"hi","answer":"yo","n":3}', "question and answer"),
        (6, '{"other":1}', None),
        (7, "not json", None),
        (8, None, None),
    ]
    df = spark.createDataFrame([(i, r, "clash") for i, r, _ in records], "k long, record string, formatted string")
    got = {r.key: r for r in chat.format_records(df, "k", "record").collect()}
    for i, _, layout in records:
        assert got[i].layout == layout
        assert chat.parse(got[i].formatted) == ([("user", "hi"), ("assistant", "yo")] if layout else [])
    assert chat.canonical({"instruction": "a", "input": "b", "output": "c", "system": "s"})[2] == [("system", "s"), ("user", "a\nb"), ("assistant", "c")]


def test_turn_order_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", None), (1, None, "user", "first"), (1, 1, "assistant", None), (None, 0, None, "x"), (1, 0, "user", "<|end|>\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = {r.key: r.formatted for r in chat.format_records(chat.conversation_records(df), "conv_id", "record").collect()}
    assert chat.parse(formatted[1]) == [("user", "first"), ("user", "<|end|>\\"), ("assistant", ""), ("assistant", "")]
    assert chat.parse(formatted[None]) == [("", "x")]
    assert chat.conversation_records(df.limit(0)).count() == 0


def test_layouts_with_nulls_and_with_each_others_fields():
    of = lambda record: (lambda mark, layout, turns: (layout and layout.name, turns))(*chat.canonical(record))
    assert of({"prompt": None, "response": "x"}) == ("prompt and response", [("user", ""), ("assistant", "x")])
    assert of({"messages": [{"role": None, "content": None}]}) == ("messages", [("", "")])
    assert of({"prompt": "p", "messages": [{"role": "user", "content": "hi"}, None, "loose"]}) == ("messages", [("user", "hi"), ("", ""), ("", "loose")])
    assert of({"prompt": "p", "response": "r", "completion": "c"}) == ("prompt and response", [("user", "p"), ("assistant", "r")])
    assert of({"instruction": None, "input": "i", "output": None, "system": None}) == ("instruction", [("user", "i"), ("assistant", "")])
    for record in ({"messages": []}, {"messages": None}, {"messages": {"role": "user", "content": "x"}}, {}):
        assert of(record) == (None, [])


def test_conversations_take_their_layouts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", None), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "human", "x"), (None, 0, "user", "long " * 50_000), (None, 1, "assistant", None)]
    records = chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.key: (r.layout, chat.parse(r.formatted)) for r in chat.format_records(records, "conv_id", "record").collect()}
    assert got == {1: ("prompt and response", [("user", "q"), ("assistant", "a")]), 2: ("instruction", [("system", ""), ("user", "q"), ("assistant", "a")]), 3: ("messages", [("human", "x")]), None: ("prompt and response", [("user", "long " * 50_000), ("assistant", "")])}


def test_payloads_beyond_a_chunk_and_repeated_pages(spark):
    long = "".join(f"{k:07d} " for k in range(100_000))
    pages = [(5, None, long), (9, "u", long), (9, "u", long), (5, "again", long), (None, None, long), (1, "v", long[:-1])]
    manifest = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), scratch(spark, "warc"))
    rows = warc.read_warc(manifest).collect()
    whole = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if r.record_type == "response":
            whole[r.page_id][r.chunk].append(bytes(r.data))
    assert set(whole) == {5, 1} and len(whole[1]) > 1
    assert b"".join(whole[1][k][0] for k in range(len(whole[1]))).decode() == long[:-1]
    assert sum(len(p) for parts in whole[5].values() for p in parts) == 2 * len(long)
    ends = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows if r["last"]), key=str)
    assert ends == sorted([(5, "response", None), (5, "response", None), (9, "revisit", 5), (9, "revisit", 5), (None, "revisit", 5), (1, "response", None)], key=str)
