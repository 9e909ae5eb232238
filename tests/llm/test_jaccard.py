import random

from tessera.llm import jaccard
from tessera.llm.components import components

from . import brute


def _rows(seed=3):
    rng, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(2000)]
    for _ in range(30):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rows += [None, "", " \n", "a b", "A  b", "a b c d e", "  x y"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def _got(spark, rows, **config):
    docs = spark.createDataFrame([(i, "clash", t) for i, t in rows], "doc_id long, class string, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, jaccard.JaccardConfig(**config)).collect()}


def test_components_match_brute_force(spark):
    rows = _rows()
    assert _got(spark, rows, group_size=8) == brute.jaccard_components(rows)


def test_matrix_alone_finds_every_link(spark):
    rows = _rows(9)[:150]
    assert _got(spark, rows, rounds=1, group_size=4) == brute.jaccard_components(rows)


def test_empty_table_and_repeated_rows(spark):
    assert _got(spark, []) == {}
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:2] + (r.component_id,) for r in jaccard.jaccard_components(docs).collect()) == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]


def test_chains_stars_and_loops(spark):
    chain = random.Random(1).sample(range(41), 41)
    edges = list(zip(chain, chain[1:], strict=False)) + [(100, k) for k in range(101, 130)] + [(5, 5), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


def _links(rows):
    sets = [brute.shingles(t) for _, t in rows]
    return {i: sum(bool(s) and 100 * len(s & t) >= 75 * len(s | t) for k, t in enumerate(sets) if k != at) for at, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def test_every_link_is_counted(spark):
    rng = random.Random(4)
    base = [f"v{k}" for k in range(120)]
    close = []  # 70 different texts, most of which link with each other, in parts of large groups
    for k in range(70):
        words = list(base)
        words[rng.randrange(120)] = f"z{k}"
        close += [" ".join(words)] * rng.choice([1, 1, 3])
    texts = [t for _, t in _rows()] + close
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, "clash", t) for i, t in rows], "doc_id long, n_links string, text string")
    want, sets = _links(rows), brute.jaccard_components(rows)
    for config in ({"group_size": 8}, {"group_size": 4, "rounds": 1}, {}):
        got = jaccard.jaccard_links(docs, jaccard.JaccardConfig(**config)).collect()
        assert {r.doc_id: r.n_links for r in got} == want
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == sets
