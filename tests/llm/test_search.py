"""Operators 11 to 13 against plain versions: nulls, empty and long inputs, ties, repeated rows, extra columns."""

import random

import numpy as np
import pytest

from tests.llm import plain
from trellica.llm import centroids, lexical_search, topk_search

WORDS = ["ba", "lo", "TI", "Äx", "en9", "ra", "zu", "ke", "日本", "mi"]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(rng, n, dim, spread=1.0):
    return [(i, [rng.gauss(0, 1) * spread ** rng.random() for _ in range(dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(5)
    rows = vectors(rng, 150, 6, 40.0)
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # copies: ties beyond k
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, []), (501, []), (550, [0.0] * 6), (600, [2.5, 1.0]), (601, [1.0, -3.0]), (None, [9.0] * 6), (None, rows[0][1])]
    return rows + [(50, rows[50][1]), (50, rows[7][1]), (100, [3e4] * 6), (101, [-3e4] * 6), (650, [1.0, 2.0, 3.0])]


SHAPE = "vec_id long, embedding array<double>"


def test_topk_matches_plain(spark, odd_vectors, monkeypatch):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in odd_vectors], SHAPE + ", id int, bucket int, norm int")
    asked = [(i, v) for i, v in odd_vectors if i is not None and i % 50 == 0]
    want = plain.top_products(odd_vectors, asked, 5, 256)
    queries = df.where("vec_id % 50 = 0")
    assert found(topk_search.top_products(df, queries)) == want
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", 200)  # many buckets, blocks and groups of queries
    monkeypatch.setattr(topk_search, "BUCKET_VALUES", 100)
    monkeypatch.setattr(topk_search, "MOST_BUCKETS", 4)
    assert found(topk_search.top_products(df, queries)) == want
    assert topk_search.top_products(df.limit(0), queries).count() == 0 and topk_search.top_products(df, queries.limit(0)).count() == 0


def test_topk_of_named_and_single_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [-1.0, 0.0])], "vec_id string, embedding array<float>")
    assert found(topk_search.top_products(df, df.where("vec_id = 'a'"), k=3)) == [("a", 1, "b", 256 * 128), ("a", 2, "c", -256 * 256)]
    assert topk_search.top_products(df.where("vec_id = 'a'"), df.where("vec_id = 'a'")).count() == 0


@pytest.mark.parametrize("way", [None, "length", "coordinate"])
def test_ways_of_pruning_agree(way):
    rng = np.random.default_rng(8)
    x = np.floor(100 * rng.normal(size=(400, 12)) * rng.lognormal(0, 1, (400, 1)))
    q = np.concatenate((x[:40] + 3, np.zeros((1, 12)), x[:3]))
    ids, own = np.arange(400), np.concatenate((np.arange(1000, 1041), np.arange(3)))
    exact = (q @ x.T).astype(np.int64)
    least = np.array([np.sort(r)[-8] if n % 3 else topk_search.LEAST for n, r in enumerate(exact)])
    at, to, score = topk_search.search_block(x, ids, np.linalg.norm(x, axis=1), q, own, np.linalg.norm(q, axis=1), least, 5, way)
    got = sorted(zip(at.tolist(), to.tolist(), score.tolist(), strict=True))
    want = sorted((n, v, int(exact[n, v])) for n in range(len(q)) for v in sorted((v for v in range(400) if v != own[n] and exact[n, v] >= least[n]), key=lambda v: (-exact[n, v], v))[:5])
    assert got == want


def test_products_stay_exact_and_within_64_bits():
    big = np.array([[2.0**40, 1.0], [2.0**61, 2.0**61]])
    assert topk_search.products(big, big).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    odd = np.array([[2.0**30 + 1, 1.0]])
    assert topk_search.products(odd, np.array([[2.0**31 - 1, 3.0]])).tolist() == [[(2**30 + 1) * (2**31 - 1) + 3]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) + rng.choice(["", ".", "-Ba_LO", " q%d" % (i % 40)])) for i in range(160)]
    docs += [(500 + i, "ba lo ti en9") for i in range(70)]  # equal scores beyond k
    docs += [(700, None), (701, ""), (702, " .-\x00\x7f"), (703, "ba " * 30000 + "q1"), (None, "zu ke q3"), (5, "ke ke ke"), (5, "ke ke ke")]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12))) + " q%d" % i) for i in range(12)] + [(20, None), (21, "nowhere"), (22, "ba ba BA"), (22, "ba ba BA"), (22, "ke"), (23, "")]
    return docs, items


def test_ranking_matches_plain(spark, corpus, monkeypatch):
    docs, items = corpus
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = plain.ranked(docs, items, 20)
    assert found(lexical_search.ranked_search(df, asked)) == want
    assert found(lexical_search.ranked_search(df, asked, block_bytes=100)) == want
    for name, value in (("TIERS", (2, 5)), ("SHARD_DOCS", 20)):
        monkeypatch.setattr(lexical_search, name, value)
    assert found(lexical_search.ranked_search(df, asked)) == want
    assert lexical_search.ranked_search(df.limit(0), asked).count() == 0 and lexical_search.ranked_search(df, asked.limit(0)).count() == 0


def test_proofs_of_tiers():
    """An item stops at the first tier that proves it, and falls through where residuals leave room."""
    rng = np.random.default_rng(2)
    doc, impact = np.arange(50), np.sort(rng.integers(1, 1_000_000, 50))[::-1]

    def tier(a, b):
        made = object.__new__(lexical_search.Tier)
        made.doc, made.impact, made.at, made.to, made.most = doc[a:b], impact[a:b], np.array([0]), np.array([b - a]), impact[a : a + 1]
        return made

    tiers = [tier(0, 5), tier(5, 20), tier(20, 50)]
    for least, depth in ((int(impact[3]), 0), (int(impact[10]), 1), (1, 2)):
        kept, score, at = lexical_search.best_of_shard(tiers, np.array([0]), np.array([1]), least, 50, 20)
        assert at == depth
        want = [int(x) for x in impact[:20] if x >= least]
        assert score.tolist() == want and kept.tolist() == list(range(len(want)))


def test_hashes_alone_do_not_decide():
    block = lexical_search.Block([(1, "alpha beta gamma")])
    block.hashes = np.full(3, 7, np.uint64)
    data, off = lexical_search.buffers(__import__("pyarrow").array(["gamma delt beta"]))
    start, end, _ = lexical_search.spans(data, off)
    original, lexical_search.span_hash = lexical_search.span_hash, lambda *a: np.full(len(a[1]), 7, np.uint64)
    try:
        assert [block.words[n] if n >= 0 else None for n in block.numbers(data, start, end)] == [b"gamma", None, b"beta"]
    finally:
        lexical_search.span_hash = original


@pytest.mark.parametrize("k, dim", [(16, 6), (3, 6), (400, 6), (2, 1)])
def test_clusters_match_plain(spark, odd_vectors, k, dim, monkeypatch):
    rows = [(i, v[:dim] if v and len(v) >= 6 else v) for i, v in odd_vectors]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SHAPE + ", cluster int, ids int").repartition(3)
    want = plain.lloyd(rows, k, 3, dim, 64)
    run = lambda d: found(centroids.cluster(d, k=k, dim=dim, scale=64.0))
    assert run(df) == want
    monkeypatch.setattr(centroids, "TREE_VALUES", 50 * dim)
    monkeypatch.setattr(centroids, "LEAF", 2)
    assert run(df) == want
    assert run(df.limit(0)) == [] and run(df.where("vec_id = 300")) == []


def test_nodes_are_assigned_whole_and_ties_stay_exact():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-5, 6, (300, 3)) + c for c in ([0, 0, 0], [200, 0, 0], [0, 200, 0])])
    x = np.concatenate((x, np.full((50, 3), [100, 0, 0])))  # as far from the first centroid as from the second
    centres = np.array([[0, 0, 0], [200, 0, 0], [0, 200, 0], [0, 0, 0]])
    x = x[centroids.kd_order(x)]
    count, sums, own = centroids.walk(x, *centroids.node_facts(x), centres, label=True)
    want = np.argmin(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
    assert (own == want).all() and (count == np.bincount(want, minlength=4)).all()
    assert all((sums[c] == x[want == c].sum(axis=0)).all() for c in range(4))
    low, high, _ = centroids.node_facts(x)
    live = centroids.undominated(low, high, np.ones((len(low), 4), bool), centres)
    assert (live.sum(axis=1) == 2).any() and not live[:, 0].all() and (live.sum(axis=1) >= 1).all()


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], SHAPE)
    out = centroids.cluster(df, k=1, dim=2).collect()
    assert len(out) == 3 and max(r["inertia"] for r in out) > 2**59
