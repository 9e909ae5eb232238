import numpy as np

from tessera.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f\na b c d e f\n"), (5, "é" * 5000 + " x " * 3000), (6, "one\n\none\none \n# $ % <b>"), (6, "one\n\none\none \n# $ % <b>")]


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-i, t, None) for i, t in EDGE], docs.schema))
    got = {}
    for r in quality.quality_rules(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        want = brute.base_counts(r.text)
        for g in got[r.doc_id]:
            assert tuple(g[c] for c in quality.COUNTS) == want
            assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (g.base_failed and g.kept)
    assert len(got[-6]) == 2


def test_distance_is_a_bounded_metric_value():
    p, q = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 0]]), np.array([1.0, 0, 0])
    assert np.allclose(quality.distance(p, q), [0, 1, 0])


def test_junk_goes_and_clean_texts_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(junk) <= 0.25 * len(junk)


def test_filter_keeps_all_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("n_chars", "kept").withColumnRenamed("source", "n_words")
    assert quality.keep_good(clash).count() == len(want)
    assert quality.quality_rules(clash).count() == docs.count()


def test_verdicts_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-i, t, None) for i, t in EDGE], docs.schema))
    rows, config = docs.collect(), quality.QualityConfig()
    found = {r: (brute.quality_histograms(r.text, quality._ALL_COMMON), brute.base_counts(r.text)) for r in rows}
    failed = {r: c[0] < 10 or 100 * c[4] > 20 * c[0] for r, (_, c) in found.items()}
    refs = {}
    for r in rows:
        if not failed[r]:
            both = refs.setdefault(r.lang if r.lang in quality.COMMON_WORDS else "other", [np.zeros(quality.N_CHAR), np.zeros(quality.N_WORD)])
            for total, own in zip(both, found[r][0], strict=True):
                total += own
    quality.store_references(spark, quality.references(docs), str(tmp_path / "refs"))
    stored = quality.stored_references(spark, str(tmp_path / "refs"))
    assert set(stored) == set(refs) and all(np.array_equal(a, b) for k in refs for a, b in zip(stored[k], refs[k], strict=True))
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    again = {r.doc_id: r for r in quality.quality_rules(docs.limit(50), refs=stored).collect()}
    assert all(got[i] == r for i, r in again.items())
    for r in rows:
        (chars, words), counts = found[r]
        char, word = (min(brute.jensen_shannon(own, ref[k].tolist()) for ref in refs.values()) for k, own in ((0, chars), (1, words)))
        g = got[r.doc_id]
        assert np.isclose(g.char_distance, char) and np.isclose(g.word_distance, word)
        far = sum(chars) >= config.min_chars and char > config.char_limit or counts[0] >= config.min_common and word > config.word_limit
        assert g.kept == (not failed[r] and not far)
