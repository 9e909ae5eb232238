import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm import line_dedup, mixing, queries

from . import brute


def test_deleted_runs_match_the_definition(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(30)] + [""]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for k in range(200)]
    rows += [(1000, None), (1001, ""), (None, rows[3][1]), (1002, "\n".join(["a b c d"] * 30)), (-5, rows[9][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, spans string, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 12, report=True).collect()}
    want = brute.deduped_lines(rows, 12)
    assert {i: got[i].text for i in want} == want
    assert got[1000].text is None and got[None].text == rows[[r[0] for r in rows].index(None)][1]
    plain = line_dedup.dedup_lines(docs, 12)
    assert plain.columns == docs.columns and plain.count() == len(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_do_not_delete_each_other(spark):
    text = "w " * 60
    docs = spark.createDataFrame([(4, text), (4, text), (9, "head\n" + text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()) == [(4, text), (4, text), (9, "head")]


def test_mixture_matches_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{path}'")
    want = db.execute("select doc_id, copy, source, rate, shuffle_key from (" + mixing.ORACLE_SQL + ")").fetchall()
    got = [tuple(r) for r in queries.op5_mix_sources(spark, "/root/testdata/sf0.01").collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("broadcast", [10_000, 1])
def test_rates_shares_and_edges(spark, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "x" * 10, "big" if i % 3 else None if i % 2 else "small", 1) for i in range(3000)] + [(5000, None, "void", 1), (None, "x", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    mixed = mixing.replicate(docs, {"big": 0.2, "small": 0.4, None: 0.4, "gone": 3.0, "void": 0.0})
    assert mixed.columns == docs.columns
    share = Counter(r.source for r in mixed.collect())
    total = sum(share.values())
    assert set(share) == {"big", "small", None}
    assert abs(share["big"] / total - 0.2) < 0.03 and abs(share[None] / total - 0.4) < 0.03
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_large_means_are_split(spark):
    docs = spark.createDataFrame([(i, "x", "a" if i else "b") for i in range(400)], "doc_id long, text string, source string")
    counts = Counter(r.source for r in mixing.replicate(docs, {"a": 0.1, "b": 0.9}).collect())
    assert 300 < counts["b"] < 420


def test_rows_of_one_id_with_different_texts(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(10)) for k in range(6))
    clean = "\n".join(" ".join(f"c{k}w{j}" for j in range(10)) for k in range(8))
    rows = [(1, passage), (2, "own line\n" + passage), (2, clean), (2, "short"), (2, "own line\n" + passage)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, passage), (2, "own line"), (2, clean), (2, "short"), (2, "own line")])


def test_selected_lines_are_shared_by_equal_windows():
    rng = np.random.default_rng(4)
    hashes, counts = rng.integers(0, 40, 4000).astype(np.uint64), rng.integers(1, 9, 4000)
    bounds = np.array([0, 1000, 1500, 1500, 4000])
    # a run of the first row stands in the last one too
    hashes[2000:2200], counts[2000:2200] = hashes[300:500], counts[300:500]
    first, stop = line_dedup.line_windows(counts, bounds, 20)
    assert ((np.add.reduceat(np.append(counts, 0), np.stack([first, stop], 1).reshape(-1))[::2]) >= 20).all()
    selected = line_dedup.winnow(hashes, first, stop)
    for f, s, m in zip(first.tolist(), stop.tolist(), selected.tolist(), strict=True):
        assert f <= m < s and hashes[m] == hashes[f:s].min() and (hashes[m + 1 : s] > hashes[m]).all()
    places = {(f, s): m - f for f, s, m in zip(first.tolist(), stop.tolist(), selected.tolist(), strict=True)}
    shared = [(f, s) for f, s in places if 300 <= f and s <= 500]
    assert shared and all(places[f, s] == places[f + 1700, s + 1700] for f, s in shared)
    assert len(np.unique(selected)) < 0.6 * len(hashes)


def test_matches_need_the_fingerprint():
    # equal lines before and behind, but another line at the selected place
    hashes = np.array([9, 8, 1, 7, 6, 9, 8, 2, 7, 6, 9, 8, 1, 7, 6], np.uint64)
    fixed = dict(docs=np.array([1, 2, 3]), texts=np.zeros(3, int), places=np.full(3, 2), widths=np.full(3, 5), hashes=hashes, counts=np.full(15, 2), number=np.tile(np.arange(5), 3), min_words=10)
    got = line_dedup._extended(prints=hashes[[2, 7, 12]], **fixed)
    assert [x.tolist() for x in got] == [[3], [0], [0], [4]]
    assert line_dedup._extended(prints=np.zeros(3, np.uint64), **fixed)[0].tolist() != [3]


def test_frequent_lines_with_other_surroundings(spark):
    # one line in all documents, in windows of its own in each, and in one passage that some share
    hashed = lambda line: int(line_dedup.lines_of(*T.flat(pa.array([line])))[0][0])
    common, passage = min((f"aa bb cc dd e{k}" for k in range(500)), key=hashed), [" ".join(f"p{k}w{j}" for j in range(4)) for k in range(3)]
    rows = []
    for k in range(700):
        own = [" ".join(f"d{k}l{i}w{j}" for j in range(5)) for i in range(6)]
        own[3:3] = [common] if k % 7 else [*passage[:2], common, passage[2]]
        rows.append((k, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n_frequent = len(line_dedup.frequent_fingerprints(docs, 12, 2))
    assert n_frequent >= 1
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, 12).collect()}
    assert got == brute.deduped_lines(rows, 12)
    assert sum(common in t.split("\n") for t in got.values()) == 601


def test_line_dedup_edges(spark):
    text = "w " * 60
    rows = [(1, text, 1, "a", 2), (None, text, 1, "a", 2), (None, text, 1, "a", 2), (2, "own\n" + text, 3, "b", None), (3, "x y z\n" * 40_000 + text, 0, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, __spans string, __doc_id int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    want = [(1, text, 1, "a", 2), (None, text, 1, "a", 2), (None, text, 1, "a", 2), (2, "own", 3, "b", None)]
    found = [tuple(r) for r in got.collect()]
    assert sorted(map(str, (r for r in found if r[0] != 3))) == sorted(map(str, want))
    # of the long text's own repeats the first seventeen lines stay, 51 words
    (long,) = (r for r in found if r[0] == 3)
    assert long[1] == brute.deduped_lines([(1, text), (3, "x y z\n" * 400 + text)], 50)[3]


def test_mixture_of_rows_without_ids_and_with_clashing_names(spark):
    rows = [(None, f"text {k}", "a" if k % 2 else "b", k, f"c{k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __count int, key string").withColumn("__source", F.lit(1)).withColumn("name", F.lit("n"))
    mixed = mixing.replicate(docs, {"a": 0.25, "b": 0.75}).cache()
    assert mixed.columns == docs.columns
    found = mixed.collect()
    assert all(r.text == f"text {r['__count']}" and r.key == f"c{r['__count']}" and r["__source"] == 1 for r in found)
    share = Counter(r.source for r in found)
    assert abs(share["a"] / len(found) - 0.25) < 0.04
    # counts are Poisson's, and rows without ids are shuffled over all partitions
    counts = Counter(Counter(r.text for r in found if r.source == "b").values())
    assert len(counts) >= 4 and mixed.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == mixed.rdd.getNumPartitions() > 1
    got = mixing.replicate(docs.where("false"), report=True)
    assert got.count() == 0
