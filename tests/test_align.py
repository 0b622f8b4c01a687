import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from trellica.functions import cigar as C
from trellica.functions import kernels as K
from trellica.functions.scoring import EDIT, LCS, Matrix, Scoring, blosum62
from trellica.operators import align as A
from trellica.plans.align_queries import edit_operation_totals, operation_totals

PAIR = "pair_index long, query_id string, query string, target_id string, target string"


def pairs(spark, *texts):
    return spark.createDataFrame([(i, f"q{i}", q, f"t{i}", t) for i, (q, t) in enumerate(texts)], PAIR)


def only(spark, query, target, mode, scoring=None, **options):
    return A.align(pairs(spark, (query, target)), mode, scoring, **options).first()


@pytest.mark.parametrize(
    ("query", "target", "mode", "scoring", "options", "expected"),
    [
        ("KITTEN", "SITTING", "edit-distance", None, {"engine": "blocks"}, {"distance": 3, "cigar": "1X3=1X1=1I"}),
        ("", "ABC", "edit-distance", None, {}, {"distance": 3, "cigar": "3I"}),
        ("ACGTACGT", "ACGTTCGT", "edit-distance", None, {}, {"distance": 1, "backend": "adaptive-banded", "block_size": 0}),
        ("AA", "AAA", "edit-distance", None, {"engine": "blocks", "block_size": 1}, {"distance": 1, "cigar": "1=1I1="}),
        ("AA", "AAA", "edit-distance", None, {"engine": "blocks", "block_size": 2}, {"distance": 1, "cigar": "1I2="}),
        ("AC", "A", "edit-distance", None, {"engine": "blocks", "block_size": 1}, {"distance": 1, "cigar": "1=1D"}),
        ("CCA", "C", "lcs", None, {}, {"score": 1}),
        ("ACCGGTCGAGTGCGCGGAAGCCGGCCGAA", "GTCGTTCGGAATGCCGTTGCTCTGTAAA", "lcs", None, {}, {"score": 20}),
        ("GATTACA", "GCATGCU", "global-linear", Scoring(1, 1, gap=-1), {}, {"score": 0}),
        ("CBA", "ACC", "global-linear", Scoring(2, 1, gap=-2), {}, {"score": -3}),
        ("", "ABC", "global-linear", Scoring(1, 1, gap=-2), {}, {"score": -6}),
        ("A", "C", "global-linear", Scoring(gap=-5, matrix=Matrix("m", "AC", ((2, 3), (3, 2)))), {}, {"score": 3, "cigar": "1X"}),
        ("ACB", "A", "global-affine", None, {}, {"score": -3}),
        ("", "ABC", "global-affine", None, {}, {"score": -6}),
        ("ACGTACGT", "ACGTTACGT", "global-affine", None, {"engine": "wavefront", "band": 2}, {"score": 12}),
        ("AAAATTTT", "TTTTAAAA", "global-affine", None, {}, {"score": -6}),
        ("AAAATTTT", "TTTTAAAA", "global-affine", None, {"engine": "wavefront", "band": 1}, {"score": -8}),
        ("ACACACTA", "AGCACACA", "local-linear", None, {}, {"score": 10}),
        ("AAAA", "TTTT", "local-linear", Scoring(1, 3, gap=-2), {}, {"score": 0, "cigar": "", "query_end": 0}),
        ("TTAC", "AC", "local-linear", None, {}, {"score": 4, "cigar": "2=", "query_start": 2, "target_start": 0}),
        ("ACGT", "TTACGTTT", "semiglobal-linear", None, {}, {"score": 8, "target_start": 2, "target_end": 6}),
        ("", "ABC", "semiglobal-linear", None, {}, {"score": 0, "target_start": 0, "target_end": 0}),
    ],
)
def test_known_answers(spark, query, target, mode, scoring, options, expected):
    row = only(spark, query, target, mode, scoring, verify=not options.get("band"), **options)
    assert {k: row[k] for k in expected} == expected
    assert row["error"] is None and row["verification_status"] == ("path_only" if options.get("band") else "full")


def test_wide_affine_pair_falls_back(spark):
    row = only(spark, "AAAA", "AAAATTTT", "global-affine", engine="auto", band=2)
    assert (row["score"], row["backend"], row["block_size"]) == (1, "linear-space", 1)


def naive(q, t, mode, s):
    """(score) of a pair by the plain recurrences, cell by cell."""
    low = -(10**6)
    pair = lambda a, b: s.match if a == b else -s.mismatch
    n, m = len(q), len(t)
    if mode == "global-affine":
        cell = [[[low] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
        cell[0][0][0] = 0
        for i in range(n + 1):
            for j in range(m + 1):
                if i and j:
                    cell[i][j][0] = max(cell[i - 1][j - 1]) + pair(q[i - 1], t[j - 1])
                if i:
                    cell[i][j][1] = max(cell[i - 1][j][0] + s.gap_open, cell[i - 1][j][1]) + s.gap_extend
                if j:
                    cell[i][j][2] = max(cell[i][j - 1][0] + s.gap_open, cell[i][j - 1][2]) + s.gap_extend
        return max(cell[n][m])
    h = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            near = []
            if i and j:
                near.append(h[i - 1][j - 1] + pair(q[i - 1], t[j - 1]))
            if i:
                near.append(h[i - 1][j] + s.gap)
            if j:
                near.append(h[i][j - 1] + s.gap)
            h[i][j] = max(near, default=0)
            if mode == "local-linear":
                h[i][j] = max(h[i][j], 0)
            if mode == "semiglobal-linear" and i == 0:
                h[i][j] = 0
    return max(map(max, h)) if mode == "local-linear" else max(h[n]) if mode == "semiglobal-linear" else h[n][m]


@pytest.mark.parametrize("mode", A.MODES)
def test_paths_are_optimal_for_every_block_size(spark, mode):
    rng = random.Random(mode)
    texts = [("".join(rng.choices("ACGT", k=rng.randint(0, 9))), "".join(rng.choices("ACGT", k=rng.randint(0, 9)))) for _ in range(120)]
    scoring = {"edit-distance": EDIT, "lcs": LCS}.get(mode, Scoring())
    want = [abs(naive(q, t, mode, scoring)) if mode == "edit-distance" else naive(q, t, mode, scoring) for q, t in texts]
    for block in (1, 2, 3, 20):
        out = A.align(pairs(spark, *texts), mode, engine="blocks", block_size=block, verify=True).orderBy("pair_index").collect()
        assert [r["path_score"] for r in out] == want
        assert {r["verification_status"] for r in out} == {"full"}
        for r in out:
            assert len(r["aligned_query"].replace("-", "")) == r["query_end"] - r["query_start"]
            assert len(r["aligned_target"].replace("-", "")) == r["target_end"] - r["target_start"]


def test_banded_and_word_distances(spark):
    df = pairs(spark, ("KITTEN", "SITTING"), ("AAAA", "TTTT"), ("A" * 65, "A"))
    q, t = F.col("query"), F.col("target")
    out = df.select(A.banded_distance(q, t, 2).alias("two"), A.banded_distance(q, t, 3).alias("three"), A.banded_distance(q, t, 4).alias("four"), A.bit_vector_distance(q, t).alias("word")).collect()
    assert [tuple(r) for r in out] == [(None, 3, 3, 3), (None, None, 4, 4), (None, None, None, None)]


def test_errors_become_rows(spark):
    df = pairs(spark, ("ACé", "AC"), (None, "AC"), ("AC", "AZ"), ("AC", "CA"))
    out = A.align(df, "global-linear", Scoring(matrix=Matrix("m", "AC", ((2, 3), (3, 2))))).orderBy("pair_index").collect()
    assert [r["verification_status"] for r in out] == ["failed", "failed", "failed", "path_only"]
    assert "not ASCII" in out[0]["error"] and "no sequence" in out[1]["error"] and "matrix m" in out[2]["error"]
    banded = A.align(pairs(spark, ("AAAA", "TTTT")), "edit-distance", engine="fixed-banded", band=3).first()
    assert banded["error"] == "no alignment inside the band" and banded["distance"] is None
    with pytest.raises(Exception, match="not ASCII"):
        A.align(df, "global-linear", fail_fast=True).collect()


@pytest.mark.parametrize("options", [{"mode": "x"}, {"engine": "x"}, {"block_size": 0, "engine": "blocks"}, {"block_size": 2}, {"engine": "myers"}, {"engine": "fixed-banded"}, {"mode": "global-linear", "score_only": True}])
def test_options_are_checked(spark, options):
    with pytest.raises(ValueError):
        A.align(pairs(spark, ("A", "A")), **options)


def test_operations(spark):
    row = A.with_operations(A.align(pairs(spark, ("KITTEN", "SITTING")), "edit-distance", engine="blocks")).first()
    assert [tuple(x) for x in row["operation_counts"]] == [("mismatch", 2), ("match", 4), ("insert", 1)]
    assert tuple(row["operations"][0]) == ("mismatch", 0, 0, "K", "S") and tuple(row["operations"][-1]) == ("insert", None, 6, None, "G")


def test_cigar_functions(spark):
    df = spark.createDataFrame([("2=1X3D1I",), ("",), ("0=",), ("3",)], "c string")
    out = df.select(C.valid(F.col("c")).alias("ok"), C.stats(F.col("c")).alias("s"), C.swap_gaps(F.col("c")).alias("p"), C.sam_cigar(F.col("c"), F.lit(2), F.lit(8), F.lit(9)).alias("sam")).collect()
    assert [r["ok"] for r in out] == [True, True, False, False]
    assert tuple(out[0]["s"]) == (2, 7, 5) and out[0]["p"] == "2=1X3I1D" and out[0]["sam"] == "2S2=1X3I1D1S" and out[1]["sam"] == "*"


def test_warp(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 2, 4]), ([7], [7]), ([1], [4, 4, 4]), ([], [1])], "query array<int>, target array<int>")
    out = A.warp(df).collect()
    assert [r["cost"] for r in out] == [2, 0, 9, None] and [r["path_cost"] for r in out[:3]] == [2, 0, 9]
    assert tuple(out[0]["path"][0]) == (0, 0) and tuple(out[0]["path"][-1]) == (3, 3)


HYPHENS = [("A-BC", "A-BC"), ("A-B", "AXB"), ("AXB", "A-B"), ("--", "-"), ("-A-", "A--"), ("", "--"), ("-", "")]


@pytest.mark.parametrize("mode", A.MODES)
def test_hyphens_are_symbols(spark, mode):
    scoring = {"edit-distance": EDIT, "lcs": LCS}.get(mode, Scoring())
    out = A.align(pairs(spark, *HYPHENS), mode, Scoring(), verify=True).orderBy("pair_index").collect()
    assert [r["verification_status"] for r in out] == ["full"] * len(HYPHENS)
    assert [abs(r["path_score"]) for r in out] == [abs(naive(q, t, mode, scoring)) for q, t in HYPHENS]
    if not mode.startswith(("lcs", "edit")):
        m = Matrix("m", "ABCX-", tuple(tuple(3 if a == b else -1 for b in range(5)) for a in range(5)))
        out = A.align(pairs(spark, *HYPHENS), mode, Scoring(gap=-2, matrix=m), verify=True).collect()
        assert {r["verification_status"] for r in out} == {"full"}


def test_paths_that_contradict_their_pair_have_no_score(spark):
    df = spark.createDataFrame([("2=", "AC", "AC", 2), ("1=1X", "AC", "AC", 2), ("1X1=", "AC", "GC", 2), ("2=", "AC", "AG", 2), ("1=", "AC", "AC", 2), ("2=1D", "AC", "AC", 2), ("2X", "AC", "CC", 2)], "c string, q string, t string, n int")
    span = [F.lit(0), F.col("n"), F.lit(0), F.col("n")]
    assert [r[0] for r in df.select(C.rescore(F.col("c"), F.col("q"), F.col("t"), span, Scoring())).collect()] == [4, None, 1, None, None, None, None]


def test_matrix_parsing():
    m = Matrix.parse("m", "# note\n  A C\nA 2 3\nC 4 2 # end\n")
    table = Scoring(matrix=m).table()
    assert table[ord("a"), ord("C")] == 3 and table[ord("C"), ord("A")] == 4
    for bad in ("", "A C\nA 1 2\n", "A C\nC 1 2\nA 1 2\n", "A A\nA 1 2\nA 1 2\n", "AB C\nAB 1 2\nC 1 2"):
        with pytest.raises(ValueError):
            Matrix.parse("m", bad)


def test_blosum62():
    m = blosum62()
    cell = lambda a, b: m.rows[m.alphabet.index(a)][m.alphabet.index(b)]
    assert m.alphabet == "ARNDCQEGHILKMFPSTWYVBZX*" and m.rows == tuple(zip(*m.rows, strict=True))
    assert [cell(a, a) for a in m.alphabet] == [4, 5, 6, 6, 9, 5, 5, 6, 8, 4, 4, 5, 5, 6, 7, 4, 5, 11, 7, 4, 4, 4, -1, 1]
    assert [cell("B", b) for b in m.alphabet] == [-2, -1, 3, 4, -3, 0, 1, -1, 0, -3, -4, 0, -3, -3, -2, 0, -1, -4, -3, -3, 4, 1, -1, -4]
    assert [cell("Z", b) for b in m.alphabet] == [-1, 0, 0, 1, -3, 3, 4, -2, 0, -3, -3, 1, -1, -3, -1, 0, -1, -3, -2, -2, 1, 4, -1, -4]
    assert [cell("X", b) for b in m.alphabet] == [0, -1, -1, -1, -2, -1, -1, -1, -1, -1, -1, -1, -1, -1, -2, 0, 0, -2, -1, -1, -1, -1, -1, -4]


def test_split_columns_read_off_at_once_are_those_of_splitting(monkeypatch):
    rng = np.random.default_rng(3)
    for scoring in (EDIT, LCS, Scoring(), Scoring(1, 3, gap=-1)):
        for _ in range(150):
            q, t = (rng.choice(np.frombuffer(b"ACG", np.uint8), rng.integers(0, 14)) for _ in range(2))
            block, box = int(rng.integers(1, 6)), (0, 0, len(q), len(t))
            monkeypatch.setattr(K, "WHOLE", 4_000_000)
            fast = K.trace_linear(q, t, scoring.table(), scoring.gap, block, box)
            monkeypatch.setattr(K, "WHOLE", -1)
            monkeypatch.setattr(K, "SMALL", -1)
            assert fast == K.trace_linear(q, t, scoring.table(), scoring.gap, block, box)
            monkeypatch.setattr(K, "SMALL", 400)


@pytest.mark.parametrize("together", [1 << 20, 4000, 1])
def test_paths_found_together_are_those_of_each_pair(monkeypatch, together):
    rng = random.Random(together)
    monkeypatch.setattr(K, "TOGETHER", together)
    monkeypatch.setattr(K, "SHORT", 900)  # the longest pairs go one by one
    for scoring in (EDIT, LCS, Scoring(), Scoring(1, 3, gap=-1), Scoring(0, 0, gap=0)):
        texts = [("".join(rng.choices("ACG", k=rng.randint(0, 40))).encode(), "".join(rng.choices("ACG", k=rng.randint(0, 40))).encode()) for _ in range(80)]
        blocks = [rng.choice((0, 1, 2, 3, 7, 50)) for _ in texts]
        boxes = [(0, 0, len(q), len(t)) if k % 2 else (len(q) // 3, len(t) // 4, len(q) - len(q) // 5, len(t) - len(t) // 6) for k, (q, t) in enumerate(texts)]
        one = lambda q, t, block, box: K.runs(K.trace_linear(np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8), scoring.table(), scoring.gap, block, box))
        want = [one(q, t, block, box) for (q, t), block, box in zip(texts, blocks, boxes, strict=True)]
        assert K.traces(texts, scoring.table(), scoring.gap, blocks, boxes) == want
    assert K.traces([], EDIT.table(), EDIT.gap, [], []) == []


def test_operation_totals_pass_the_kernel_once_after_dealing(spark, capsys):
    edit_operation_totals(spark, oracle.SMALL).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")


def test_operation_totals_keep_every_pair(spark):
    df = spark.createDataFrame([(7, "q", "", "t", ""), (8, "q", "AC", "t", "AGC"), (8, "q", "AC", "t", "A"), (9, "q", None, "t", "A")], PAIR)
    out = operation_totals(df).collect()
    assert sorted(map(tuple, out), key=str) == [(7, 0, 0, 0), (8, 2, 1, 1), (8, 2, 3, 1), (9, None, None, None)]
