import tracemalloc
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from tessera.llm import bpe, mixing, quality

from . import brute

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in kept]
    texts = brute.deduped_lines([(r["doc_id"], r["text"]) for r in rows], 50)
    groups = brute.jaccard_components(list(texts.items()))
    left = [(r["doc_id"], texts[r["doc_id"]], r["lang"], r["source"], len(texts[r["doc_id"]])) for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    mixed = mixing.replicate(spark.createDataFrame(left, docs.schema)).collect()
    vocabulary = bpe.Vocabulary(bpe.default_vocabulary())
    want = Counter()
    for r in mixed:
        ids, _ = vocabulary.encode([r.text])
        want[(r.doc_id, r.lang, r.source, r.n_chars, tuple(ids.tolist()))] += 1
    got = Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_similarity_stage_keeps_one_of_each_group(spark):
    text = "a b c d e f g h"
    rows = [(5, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, None, None, None, None), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [2, 7, 7, 8, None]


def test_entry_lists_pipeline_and_operators():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def _free_but_held(batches):
    """MB that a worker gives back when it is asked to."""
    import ctypes
    import re
    import time

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    for _ in batches:
        pass
    time.sleep(1)  # so that each task has a worker of its own
    before = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    yield pa.RecordBatch.from_pydict({"mb": [before - held()]})


@pytest.mark.parametrize("k", [0, 1, 4])
def test_workers_give_memory_back_after_a_stage(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    spark.sparkContext.environment["TESSERA_WORKERS"] = f"of this test {k}"  # workers of their own
    try:
        corpus_pipeline.STAGES[k][1](spark, docs, "").write.format("noop").mode("overwrite").save()
        left = [r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(_free_but_held, "mb double").collect()]
    finally:
        del spark.sparkContext.environment["TESSERA_WORKERS"]
    assert len(left) == 4 and max(left) < 12


def test_splitting_a_text_takes_few_times_its_size():
    vocabulary = bpe.Vocabulary(bpe.default_vocabulary())
    text = "Wörter über words, it's 12 naïve lines\n" * 30_000
    size = len(text.encode())
    tracemalloc.start()
    try:
        words, firsts = vocabulary._split([vocabulary._plain(text)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words[:5].to_pylist() == [w.encode() for w in ("wörter", "über", "words", ",", "it")] and firsts.tolist() == [0, len(words)]
    assert peak < 25 * size
