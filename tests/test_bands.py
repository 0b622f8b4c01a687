"""Banded and second kernels against plain recurrences; readers of matrices and of several files."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from trellica.functions import kernels as K
from trellica.functions.scoring import Scoring, read_matrix
from trellica.operators.align import mode_scoring
from trellica.operators.tiles import tiled_scores
from trellica.sources.sequences import read_sequences, zip_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def consumed(ops, q, t):
    i = j = 0
    for op in ops:
        if op in "=X":
            assert (q[i] == t[j]) == (op == "=")
        i, j = i + (op != "I"), j + (op != "D")
    return i, j


def test_kernels_agree_with_plain_recurrences():
    rng = random.Random(3)
    linear, affine, lcs = Scoring(2, 1, -2).table(), Scoring(2, 1).table(), Scoring(1, 10**6, 0).table()
    for _ in range(250):
        q, t = (bytes(rng.choices(b"ACGT", k=rng.randint(0, 14))) for _ in range(2))
        x, y = np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8)
        d, ops = K.trace_edits(q, t, 20)
        assert d == distance(q, t) == sum(op != "=" for op in ops) and consumed(ops, q, t) == (len(q), len(t))
        assert d == 0 or K.trace_edits(q, t, d - 1) is None
        assert K.lcs_bits(q, t) == K.global_scores([(q, t)], lcs, 0)[0, 0]
        assert K.second_scores([(q, t)], linear, -2)[0] == K.global_scores([(q, t)], linear, -2)[0, 0]
        assert K.second_scores([(q, t)], linear, -2, free=True)[0] == K.global_scores([(q, t)], linear, -2, free=True)[0, 0]
        assert K.second_scores([(q, t)], linear, -2, local=True)[0] == K.local_scores([(q, t)], linear, -2)[0, 0]
        assert K.second_affine_scores([(q, t)], affine, -3, -1)[0] == K.affine_scores([(q, t)], affine, -3, -1)[0] == K.trace_affine(x, y, affine, -3, -1, None)[0]
        for band in (1, 3):
            found = K.trace_affine(x, y, affine, -3, -1, band)
            assert (found[0] if found else K.NEG) == K.affine_scores([(q, t)], affine, -3, -1, band)[0]


def test_few_edits_in_long_sequences_are_quick():
    q = bytes(random.Random(5).choices(b"ACGT", k=2048))
    t = q[:100] + b"N" + q[101:1500] + q[1501:1800] + b"N" + q[1800:]
    began = time.perf_counter()
    d, ops = K.trace_edits(q, t, 64)
    assert d == 3 and consumed(ops, q, t) == (2048, len(t)) and time.perf_counter() - began < 0.05


def affine_value(ops, q, t, table, gap_open, gap_extend):
    i = j = total = 0
    before = ""
    for op in ops:
        total += table[q[i], t[j]] if op in "=X" else gap_extend + (gap_open if op != before else 0)
        i, j, before = i + (op != "I"), j + (op != "D"), op
    assert "DI" not in ops and "ID" not in ops
    return total


def test_affine_paths_split_in_linear_space(monkeypatch):
    rng = random.Random(9)
    for cells in (0, 6, 40):
        monkeypatch.setattr(K, "AFFINE_CELLS", cells)
        for opened, extend in ((-3, -1), (-1, -2), (0, -1), (-9, 0)):
            table = Scoring(2, 1).table()
            for _ in range(60):
                q, t = (bytes(rng.choices(b"ACG", k=rng.choice([0, 1, 3, 9, 17]))) for _ in range(2))
                x, y = np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8)
                score, ops = K.affine_split(x, y, table, opened, extend)
                assert score == K.affine_scores([(q, t)], table, opened, extend)[0] == affine_value(ops, q, t, table, opened, extend)
                assert consumed(ops, q, t) == (len(q), len(t))


def test_a_long_affine_pair_needs_little_memory():
    rng = random.Random(2)
    q = bytes(rng.choices(b"ACGT", k=3000))
    t = q[:700] + bytes(rng.choices(b"ACGT", k=400)) + q[700:1900] + q[2100:]
    table = Scoring(2, 1).table()
    tracemalloc.start()
    score, ops = K.affine_split(np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8), table, -3, -1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 < 3 * 8 * len(q) * len(t)
    assert score == K.second_affine_scores([(q, t)], table, -3, -1)[0] == affine_value(ops, q, t, table, -3, -1)


def test_second_scores_of_batches():
    rng = random.Random(13)
    pairs = [tuple(bytes(rng.choices(b"ACGT", k=rng.randint(0, 30))) for _ in range(2)) for _ in range(300)]
    table = Scoring(2, 1, -2).table()
    assert (K.second_scores(pairs, table, -2) == K.global_scores(pairs, table, -2)[:, 0]).all()
    assert (K.second_scores(pairs, table, -2, free=True) == K.global_scores(pairs, table, -2, free=True)[:, 0]).all()
    assert (K.second_scores(pairs, table, -2, local=True) == K.local_scores(pairs, table, -2)[:, 0]).all()
    assert (K.second_affine_scores(pairs, table, -3, -1) == K.affine_scores(pairs, table, -3, -1)).all()


def warp_table(q, t):
    h = np.full((len(q) + 1, len(t) + 1), 10**9)
    h[0, 0] = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            h[i, j] = abs(q[i - 1] - t[j - 1]) + min(h[i - 1, j - 1], h[i - 1, j], h[i, j - 1])
    return h[-1, -1]


def test_warping_paths_split_and_batched(monkeypatch):
    rng = np.random.default_rng(7)
    pairs = [tuple(rng.integers(-9, 9, rng.integers(1, 40)) for _ in range(2)) for _ in range(80)]
    want = [warp_table(q, t) for q, t in pairs]
    assert K.warp_costs(pairs).tolist() == want
    for cells in (4096, 50, 0):
        monkeypatch.setattr(K, "WARP_CELLS", cells)
        for (q, t), path, cost in zip(pairs, K.warp_paths(pairs), want, strict=True):
            assert path[0].tolist() == [0, 0] and path[1].tolist() == [1, 1] and path[-1].tolist() == [len(q), len(t)]
            assert all(tuple(d) in ((0, 1), (1, 0), (1, 1)) for d in np.diff(path, axis=0).tolist())
            assert sum(abs(q[i - 1] - t[j - 1]) for i, j in path[1:]) == cost


def test_pairs_over_several_files(spark, tmp_path):
    for side, parts in (("q", ((2, 3), (1,))), ("t", ((1,), (4, 2)))):
        (tmp_path / side).mkdir()
        for i, part in enumerate(parts):
            (tmp_path / side / f"{i}.fa").write_text("".join(f">{side}{i}_{k}\n{'A' * n}\n" for k, n in enumerate(part)))
    query, target = (read_sequences(spark, str(tmp_path / side)) for side in "qt")
    got = [(r["pair_index"], r["query_id"], r["target_id"]) for r in zip_pairs(query, target).orderBy("pair_index").collect()]
    assert got == [(0, "q0_0", "t0_0"), (1, "q0_1", "t1_0"), (2, "q1_0", "t1_1")]
    with pytest.raises(Exception, match="unequal"):
        zip_pairs(query, target.where("idx = 0")).collect()


def test_matrix_files(spark, tmp_path):
    path = tmp_path / "small.mat"
    path.write_text("# two\n A C\nA 2 -1\nC -1 2\n")
    matrix, digest = read_matrix(spark, path=f"file://{path}")
    assert matrix.name == "small" and matrix.rows == ((2, -1), (-1, 2)) and len(digest) == 64
    assert read_matrix(spark, matrix) == (matrix, None)
    with pytest.raises(ValueError):
        read_matrix(spark)


@pytest.mark.parametrize("mode", ["global-linear", "local-linear", "semiglobal-linear", "edit-distance", "lcs"])
def test_tiles_give_the_score_of_the_whole_pair(spark, mode):
    rng = random.Random(mode)
    texts = [("".join(rng.choices("ACGT", k=rng.choice([0, 1, 7, 20]))), "".join(rng.choices("ACGT", k=rng.choice([0, 3, 6, 15])))) for _ in range(25)]
    rows = [(i, "q", q, "t", t) for i, (q, t) in enumerate(texts)] + [(99, "q", None, "t", "A")]
    df = spark.createDataFrame(rows, "pair_index long, query_id string, query string, target_id string, target string")
    scoring = mode_scoring(mode, Scoring())
    both = [(q.encode(), t.encode()) for q, t in texts]
    want = K.local_scores(both, scoring.table(), scoring.gap)[:, 0] if mode == "local-linear" else K.global_scores(both, scoring.table(), scoring.gap, mode == "semiglobal-linear")[:, 0]
    got = {r["pair_index"]: r["score"] for r in tiled_scores(df, mode, tile=6).collect()}
    assert got == {**dict(enumerate(want.tolist())), 99: None}
    with pytest.raises(ValueError):
        tiled_scores(df, "global-affine")
