import hashlib
import random

import numpy as np
import pytest

from tessera.llm import ann, bpe, language_model, queries, secret_scan

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def _held(vocabulary, library, texts):
    ids, offsets = vocabulary.encode(texts)
    spelled, numbers = vocabulary.decode(ids, offsets), vocabulary.decimals(ids, offsets)
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want.ids, texts[k]
        assert spelled[k].decode() == library.decode(want.ids, skip_special_tokens=False)
        assert numbers[k].decode() == " ".join(map(str, want.ids))


def test_ids_and_decoding_match_the_library(vocabulary, library):
    rng = random.Random(1)
    wide = [chr(c) for c in range(1, 0x600)] + list("'''’stredlvm   \n\t") + ["ẞ", "中", "\U0001f600", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|end", "Å", "ﬁ", "Σ"]
    dense = list("aaaabehtinrs 's'tre'll")
    _held(vocabulary, library, ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in (wide, dense) for _ in range(1500)])
    _held(vocabulary, library, ["", "don't''s's !'s 's!'ll'", "a" * 5000, "ab" * 3000 + "!" * 2000, "İSTANBUL ΣΑΣ ΑΣ"])


def test_bpe_query_whole_texts(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op6_bpe_backtracking(spark, SF).collect()}
    for d, want in zip(docs, library.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True):
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want.ids), hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_frames(spark, library):
    docs = spark.createDataFrame([(1, "Hello World", 5), (2, None, 6), (3, "", 7), (1, "Hello World", 5)], "doc_id long, text string, token_ids int")
    coded = bpe.encode_texts(docs)
    assert coded.columns == ["doc_id", "token_ids"]
    back = sorted((r.doc_id, r.text) for r in bpe.decode_ids(coded).collect())
    assert back == [(1, "hello</w> world</w>"), (1, "hello</w> world</w>"), (2, ""), (3, "")]
    assert bpe.encode_texts(docs.limit(0)).count() == 0 and bpe.round_trip(docs.limit(0)).count() == 0


def test_base_scores_match_and_the_model_is_better(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (None, "The the x"), (-2, ""), (-2, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    got = language_model.score_documents(df).collect()
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute.base_scores(docs), strict=True)), key=str)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert np.allclose([h[5] for h in have], [w[5] for w in want], rtol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def _packed_words(spark, docs):
    """The model's parts for a corpus in one part."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counted = language_model.word_counts(df, 1)
    tokens, types = counted.selectExpr("sum(tokens)", "sum(types)").first()
    table = language_model._above(counted, 1)
    rows = df.coalesce(1).mapInArrow(language_model._packed(table, tokens, 1, [0]), language_model.PACKED).collect()
    return tokens, types, table, [(r.name, bytes(r.data)) for r in rows if r.data is not None]


def test_probabilities_sum_to_one_and_match_a_plain_sampler(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    docs = [(k, " ".join(rng.choices(words, range(1, 10), k=rng.randint(1, 30)))) for k in range(60)]
    # one document that is held out asks for every pair
    held = next(i for i in range(100, 1000) if language_model.held_out([i])[0])
    docs.append((held, " ".join(f"{a} {b}" for a in words for b in [*words, "unseen"])))
    tokens, types, table, rows = _packed_words(spark, docs)
    config = language_model.PitmanYorConfig(sweeps=60, burn_in=20)
    found = language_model.Contexts(rows, table, np.ones(len(table[0]), int), config, 0)
    parent = np.full(len(found.words), 1 / (types + 1))
    for _ in range(3):
        found.sweep(parent[found.word_of])
    own, customers = found.to_parent()
    seated, discounts = language_model.parent_seating(customers, 1.0, types, config, 0)
    parent = (seated + (1 + discounts) / (types + 1)) / (1 + customers.sum())
    unseen = int(np.flatnonzero(customers == 0)[0])
    assert np.isclose(parent.sum(), 1) and parent[unseen] == parent.min()
    chances = found.predictive(parent[found.word_of])
    for context in range(len(found.total)):
        mine = found.context == context
        if mine.sum() == len(found.words):
            assert np.isclose(chances[mine].sum(), 1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: r for r in language_model.score_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), config).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute.pitman_yor_scores(docs, (found.discount, language_model.discount_of(customers)), 1.0, 300, 50, 5)
    have = np.array([got[i].score for i, _ in docs])
    assert np.allclose(have, want, rtol=0.05, atol=0.1) and abs(have.sum() / sum(want) - 1) < 0.01
    assert np.isclose(got[held].perplexity, 10 ** (-got[held].score / got[held].n_tokens))


def test_tables_are_drawn_from_their_distribution():
    rng, d, weights = np.random.default_rng(3), 0.6, language_model.stirling(0.6, language_model.EXACT)
    # by hand: three customers sit at one table in (1 - d)(2 - d) ways, at two in 3 (1 - d), at three in one
    assert np.allclose(np.exp(weights[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    n, others, parent = 100_000, 2.0, 0.3
    drawn = language_model.reseat(np.full(n, 3), np.ones(n, int), np.full(n, others + 1), np.full(n, parent), d, 1.0, weights, rng)
    odds = np.array([np.exp(weights[3, t]) * np.prod([(1 + d * (others + i)) * parent for i in range(t)]) for t in (1, 2, 3)])
    assert np.allclose(np.bincount(drawn, minlength=4)[1:] / n, odds / odds.sum(), atol=0.01)
    # beyond the border: as one by one; and the rule alone is near the exact distribution for what a probability takes from it
    k, border, most = 400, language_model.EXACT, 4096
    for others, parent in ((5.0, 0.01), (500.0, 0.001)):
        first = language_model._exact(np.full(k, border), np.full(k, others), np.log(np.full(k, parent)), d, 1.0, weights, rng)
        drawn, plain = language_model._beyond(np.full(k, most), np.full(k, others), np.full(k, parent), first, d, 1.0, rng), np.ones(k)
        more = first.astype(float)
        for seated in range(1, most):
            for tables, begin in ((plain, 1), (more, border)):
                if seated >= begin:
                    opens = (1 + d * (others + tables)) * parent
                    tables += rng.random(k) < opens / (opens + seated - d * tables)
            if seated + 1 == border:
                assert abs(plain.mean() - first.mean()) * d < border / 500
        assert abs(drawn.mean() / more.mean() - 1) < 0.1


def test_many_short_documents(spark):
    # more documents than 16 bits count, in one partition
    docs = [(k, f"w{k % 7} x{k % 11} y{k} z") for k in range(75_000)]
    got = {r.doc_id: r for r in language_model.score_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert len(got) == len(docs)
    for (i, _), want in zip(docs, brute.base_scores(docs), strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and abs(r.base_score - want[4]) < 1e-8


def test_contexts_that_are_dealt_over_parts(spark):
    # one word precedes most others, so its followers are dealt over parts; a very long text; repeated rows
    rng = random.Random(2)
    docs = [(k, " ".join(f"the n{int(rng.paretovariate(0.6)) % 500}" for _ in range(40))) for k in range(300)] + [(1000, "the n1 " * 60_000), (7, "the end"), (7, "the end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    many = language_model.score_documents(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = language_model.score_documents(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known)
    assert sorted(map(key, many)) == sorted(map(key, one))
    a, b = ({r.doc_id: r.score for r in rows} for rows in (many, one))
    # parts have their own discounts and random numbers
    assert all(abs(a[i] / b[i] - 1) < 0.25 for i in a) and abs(sum(a.values()) / sum(b.values()) - 1) < 0.05


def test_no_training_documents(spark):
    assert language_model.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(1000) if language_model.held_out([i])[0])
    row = language_model.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_linked_secrets_in_text_that_is_not_ascii(spark):
    access, key = "AKIA" + "Q2" * 8, "aB3" * 13 + "x"
    texts = [f"{access} {fill * 160} AWS_KEY={key} {fill * 20} https://h.example/b" for fill in ("q", "\u00e9", "\U0001f600")] + [f"{access} {'\u00e9' * 400} {key}"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = [tuple(r) for r in secret_scan.secret_digests(docs).select("doc_id", "spans").collect()]
    same = {s for k, s in got if k < 3}
    assert len(got) == 8 and len(same) == 1 and [x.split(":")[0] for x in same.pop().split(",")] == ["access", "key", "endpoint"]
    assert {s for k, s in got if k == 3} == {f"access:0:{len(access)}"}


def test_strong_findings_match_brute_force(spark):
    texts = ["", None, "é token = \"abcdefghijkl\" PASSWORD:x secret=" + "s" * 12, "AKIA" + "Q" * 14 + "AKIAX " + "ab12" * 4 + "0", "ſecret=abcdefghijklmnop", "api_key : 'zzzzzzzzzzzz' apikey=" + "f" * 16, "0" * 16, "a" * 15]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-k - 1, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, findings string").repartition(3)
    got = {r.doc_id: r for r in secret_scan.secret_digests(df).collect()}
    for i, t in docs:
        want = brute.strong_secrets(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[0] == k for x in want) for k in secret_scan.BASE)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert secret_scan.secret_digests(df.limit(0)).count() == 0


def test_weak_candidates_need_their_parts(spark):
    key, access = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"[:40], "AKIA" + "IOSFODNN7EXAMPLE"
    end = "https://s3.example.com/bucket"
    texts = [f"{access}\n{key}\n{end}", f"{key}\n{end}", f"{access}{' x' * 400}{key}", f"é {access} {key}", f"{access} {end}"]
    got = {r.doc_id: [f.kind for f in r.findings] for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ["access", "key", "endpoint"], 1: [], 2: ["access"], 3: ["access", "key"], 4: ["access"]}


def test_keys_after_an_equals_sign_and_scope_in_code_points(spark):
    key, access = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"[:40], "AKIA" + "IOSFODNN7EXAMPLE"
    end = "https://s3.example.com/bucket"
    pair = f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={key}\n"
    texts = [f"{pair}ENDPOINT={end}", f"AWS_SECRET_ACCESS_KEY={key}", f"{access} x={key}=", f"{access} {'é' * 298} {key}", f"{access} {'é' * 299} {key}", f"{access} {key} {'é' * 298} {end}"]
    got = {r.doc_id: r.findings for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: [f.kind for f in x] for i, x in got.items()} == {0: ["access", "key", "endpoint"], 1: [], 2: ["access"], 3: ["access", "key"], 4: ["access"], 5: ["access", "key"]}
    for i, kind, part in ((0, "key", key), (0, "endpoint", end), (3, "key", key)):
        assert [texts[i][f.start : f.end] for f in got[i] if f.kind == kind] == [part]


def _exact(ids, vectors, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        out[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
    return out


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = rows.collect()
    ids, vectors = np.array([r.vec_id for r in found]), np.array([r.embedding for r in found], np.float64)
    want, got = _exact(ids, vectors, 20, 20), {}
    place = {v: k for k, v in enumerate(ids.tolist())}
    for r in queries.op10_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert np.isclose(r.score, vectors[place[r.query_id]] @ vectors[place[r.vec_id]], rtol=1e-12)
    assert set(got) == set(want)
    assert np.mean([len(set(want[q]) & set(got[q].values())) / 20 for q in want]) >= 0.95


def _recall(spark, x, config):
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, config).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(map(len, got.values())) == {config.k}
    want = _exact(ids, x.astype(np.float64), config.every, config.k)
    return np.mean([len(set(want[q]) & set(got[q])) / config.k for q in want])


def test_queries_visit_few_cells_of_grouped_vectors(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 16))
    # a third of all rows in one group
    group = np.where(rng.random(12_000) < 1 / 3, 0, rng.integers(0, 40, 12_000))
    x = (middle[group] + 0.2 * rng.normal(size=(12_000, 16))).astype(np.float32)
    config = ann.AnnConfig(every=100)
    cells = ann.centres(x[:8192], 6)
    assert 1 <= ann.visits(x[:8192], cells, config) <= 3 and ann.visits(x[:8192], cells, ann.AnnConfig(exact_cells=True)) == 6
    assert _recall(spark, x, config) >= 0.9


def test_recall_where_norms_differ_widely(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(8192, 32)) * rng.lognormal(0, 1, (8192, 1))).astype(np.float32)
    assert _recall(spark, x, ann.AnnConfig(every=100)) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(600, 6)).astype(np.float32)
    good[100:400] = good[20]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(good)]
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in ann.nearest(df, ann.AnnConfig(rerank=50)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = _exact(np.arange(600), good.astype(np.float64), 20, 20)
    assert set(got) == set(want) and got[20] == want[20]
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]
