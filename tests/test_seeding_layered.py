import random
import time

import pytest
from pyspark.sql import functions as F

from trellica.functions.scoring import Scoring
from trellica.operators import layered as L
from trellica.operators import seeding as S

PAIR = "pair_index long, query_id string, query string, target_id string, target string"


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def plain_minimizers(text, k, w):
    count = len(text) - k + 1
    out = []
    for start in range(max(0, count - min(w, count)) + 1) if count > 0 else ():
        pos = min(range(start, min(start + w, count)), key=lambda p: (fnv(text[p : p + k]), p))
        if not out or out[-1] != pos:
            out.append(pos)
    return out


def test_minimizers_match_plain_version(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 2, 3, 5, 9, 30, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in S.minimizers(df, "id", "text", 3, 4).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["pos"])
        assert r["hash"] == fnv(r["kmer"]) - 2**63
    assert {i: sorted(set(x)) for i, t in enumerate(texts) if (x := plain_minimizers(t, 3, 4))} == {i: sorted(set(x)) for i, x in got.items()}
    for group in (1, 2, 7):
        again = {}
        for r in S.minimizers(df, "id", "text", 3, 4, starts=group).collect():
            again.setdefault(r["id"], []).append(r["pos"])
        assert {i: sorted(x) for i, x in again.items()} == {i: sorted(x) for i, x in got.items()}
    with pytest.raises(ValueError):
        S.minimizers(df, "id", "text", 0, 1)


def test_minimizers_count_symbols_not_bytes(spark):
    df = spark.createDataFrame([("a", "ACÉGTÉÉACGT日CA"), ("b", "ÉÉÉÉÉÉÉÉÉÉ"), ("c", None)], "id string, text string")
    for group in (1, 3, 100):
        got = sorted((r["id"], r["pos"], r["kmer"]) for r in S.minimizers(df, "id", "text", 3, 4, starts=group).collect())
        assert got == sorted((i, p, t[p : p + 3]) for i, t in (("a", "ACÉGTÉÉACGT日CA"), ("b", "ÉÉÉÉÉÉÉÉÉÉ")) for p in plain_minimizers(t, 3, 4))


def plain_chain(hits):
    length, before = [1] * len(hits), [-1] * len(hits)
    for i, (q, t) in enumerate(hits):
        for j in range(i):
            if hits[j][0] < q and hits[j][1] < t and length[j] + 1 > length[i]:
                length[i], before[i] = length[j] + 1, j
    at, out = length.index(max(length)), []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def test_chain():
    assert S.best_chain([(0, 5), (2, 1), (4, 3)]) == [1, 2]
    assert S.best_chain([(0, 0)]) == [0]
    rng = random.Random(6)
    for size in (3, 10, 60):
        for _ in range(100):
            hits = sorted({(rng.randrange(size), rng.randrange(size // 2 + 1)) for _ in range(size)})
            assert S.best_chain(hits) == plain_chain(hits)


def test_a_chain_of_many_hits_takes_seconds():
    rng = random.Random(1)
    hits = sorted({(rng.randrange(200_000), rng.randrange(200_000)) for _ in range(100_000)})
    began = time.perf_counter()
    chain = S.best_chain(hits)
    assert all(hits[a][0] < hits[b][0] and hits[a][1] < hits[b][1] for a, b in zip(chain, chain[1:])) and time.perf_counter() - began < 10


def test_seeded_alignment(spark):
    df = spark.createDataFrame([(0, "q", "TTACGTAA", "t", "GGACGTCC"), (1, "q", "AAAA", "t", "CCCC")], PAIR)
    first, second = S.align_seeded(df, Scoring(), 2, 2, 1).orderBy("pair_index").collect()
    assert (first["score"], first["query_start"], first["query_end"], first["target_start"], first["target_end"], first["cigar"]) == (6, 1, 7, 1, 7, "1X4=1X")
    assert second["error"] == "no shared seed"


def test_dag(spark):
    edges = [(0, 0, 0, 0, 2), (0, 1, 0, 1, 5), (0, 2, 0, 1, 4), (1, 0, 0, 0, 7), (1, 1, 1, 0, 1), (2, 0, 0, 0, 2)]
    rows = [(d, *e) for d in ("a", "b") for e in edges if not (d == "b" and e[0] == 2)]
    edges = spark.createDataFrame(rows, "dag_id string, layer int, edge_ord int, from int, to int, score int")
    ends = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "dag_id string, start int, end int")
    found = L.longest_paths(edges, ends, 3)
    assert {r["dag_id"]: (r["score"], r["path"]) for r in found.collect()} == {"a": (11, [0, 0, 0, 0]), "b": (None, None)}
    steps = L.longest_path_steps(edges, ends, 3)[1]
    assert {r["dag_id"]: r["path_score"] for r in L.path_score(steps, edges).collect()} == {"a": 11}
    widths = ends.withColumn("widths", F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)))
    problems = {r["problem"] for r in L.dag_problems(edges, widths).collect()}
    assert problems == {"a layer is empty", "end outside the last layer", "edge outside its layers"}


def decode(initial, grid, emissions):
    """Score, start, end and path by the plain recurrence: last best initial and final state, first best predecessor."""
    n = range(len(initial))
    start = max(n, key=lambda s: (initial[s], s))
    scores, back = [initial[s] if s == start else None for s in n], []
    for e in emissions:
        best = [max((s for s in n if scores[s] is not None), key=lambda s: (scores[s] + grid[s][to], -s)) for to in n]
        scores, back = [scores[best[to]] + grid[best[to]][to] + e[to] for to in n], [*back, best]
    end = max(n, key=lambda s: (scores[s], s))
    path = [end]
    for best in reversed(back):
        path.append(best[path[-1]])
    return scores[end], start, end, path[::-1]


def test_viterbi_in_blocks_gives_the_same_path(spark):
    rng = random.Random(12)
    initial, grid = [0, 3, 3], [[rng.randint(-2, 2) for _ in range(3)] for _ in range(3)]
    rows = [(p, i, [rng.randint(-2, 2) for _ in range(3)]) for p, n in enumerate((1, 2, 7, 40)) for i in range(n)]
    steps = spark.createDataFrame(rows, "p int, i int, e array<long>")
    want = {p: decode(initial, grid, [e for q, _, e in rows if q == p]) for p in range(4)}
    assert decode([0, -4], [[3, -2], [-1, 2]], [[2, -3], [-4, 3], [2, -2]])[:3] == (9, 0, 0)
    for block, fanout in ((1, 2), (3, 3), (100, 256)):
        found, path = {}, {}
        for r in L.viterbi_blocks(steps, "p", "i", "e", initial, grid, block, fanout).orderBy("p", "block").collect():
            found[r["p"]] = (r["score"], r["start"], r["end"])
            whole_path = path.setdefault(r["p"], r["states"][:1])
            assert whole_path[-1] == r["states"][0]
            whole_path.extend(r["states"][1:])
        assert found == {p: v[:3] for p, v in want.items()}
        assert path == {p: v[3] for p, v in want.items()}
    with pytest.raises(ValueError):
        L.viterbi_blocks(steps, "p", "i", "e", [0], [[0, 1]])


def test_ordered_fold_equals_plain_fold(spark):
    rng = random.Random(8)
    steps = [(p, i, [[rng.randint(0, 9) for _ in range(2)] for _ in range(2)]) for p in range(3) for i in range(23)]
    df = spark.createDataFrame(steps, "p int, i int, m array<array<long>>")
    want = {}
    for p, _, m in steps:
        t = want.get(p)
        want[p] = [x for r in m for x in r] if t is None else [min(t[a * 2 + k] + m[k][b] for k in (0, 1)) for a in (0, 1) for b in (0, 1)]
    for block in (2, 5, 100):
        assert {r["p"]: r["total"] for r in L.fold_matrices(df, "p", "i", "m", 2, block).collect()} == want


def test_steps_are_numbered_across_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "z"]), rng.randrange(1000), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive, parts in (("false", "7"), ("true", "5"), ("false", "1")):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted(((r["k"], r["step"], r["t"], r["i"]) for r in L.number_steps(df, "k", ["t", "i"]).collect()), key=str)
            want = [(k, n, t, i) for k in (None, "a", "hot", "z") for n, (t, i) in enumerate(sorted((t, i) for q, t, i in rows if q == k))]
            assert got == sorted(want, key=str)
            assert L.number_steps(df.limit(0), "k", ["t"]).count() == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
