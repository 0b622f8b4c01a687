import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from trellica.llm import _classify, _text, embedding_dedup, ngram_join, quality, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choices(["ba", "lo", "ti", "en", "ra"], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    """Texts of which every fourth holds one of three bad stems with a changing ending, among up to 300 clean words."""
    rng = random.Random(21)
    rows = []
    for i in range(700):
        words = prose(rng, rng.randint(1, 300)).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zulgh", "worvx", "quimp"]) + rng.choice(["", "s", "ba", "en", "ix", "oto"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in labelled] + [(None, None, "x"), (9000, "", "x"), (9001, "zulghotic", "x"), (9002, " ".join(["ra lo ti"] * 5000) + " worvxes", "x"), (9003, "ra " * 50, "x"), (9003, "ra " * 50, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in labelled if plain.fold(i, 5) == 0]
    assert {i for i, r in out.items() if r["held_out"] and i is not None and i < 9000} == {i for i, _ in held}
    assert np.mean([out[i]["predicted"] == y for i, y in held]) > 0.97
    assert out[9001]["predicted"] == 1 and out[9002]["predicted"] == 1 and out[9003]["predicted"] == 0 and out[9000]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_labels_of_the_held_out_fold_teach_nothing(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    one = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
    two = one.withColumn("toxic", F.when(F.col("doc_id").isin([i for i, _, _ in labelled if plain.fold(i, 5) == 0]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, x).collect()) for x in (one, two))
    assert first == second


def test_windows_cover_whole_texts():
    start, end, text = toxicity.passages(np.array([0, 1, 16, 17, 40]))
    for i, n in enumerate([0, 1, 16, 17, 40]):
        base = sum([0, 1, 16, 17, 40][:i])
        assert {x for a, b in zip(start[text == i], end[text == i], strict=True) for x in range(a, b)} == set(range(base, base + n))


def peak_mb(work):
    """What work() gives, and the most memory that it had at once and what it keeps."""
    _text._POWERS.clear()
    tracemalloc.start()
    try:
        return work(), *(x / 1e6 for x in reversed(tracemalloc.get_traced_memory()))
    finally:
        tracemalloc.stop()


def test_texts_are_hashed_in_small_passes():
    """Two workers of an executor score and cut batches of 4 MB beside its heap; a pass over all of it took 151 MB and kept 64."""
    rng = random.Random(25)
    texts = pa.array(["", None] + [prose(rng, 400) for _ in range(2000)] + [prose(rng, 60_000)])
    model = np.random.default_rng(1).normal(size=1 << 14), 0.5
    assert 4e6 < texts.nbytes
    whole, small = peak_mb(lambda: toxicity.scores(texts, model, 8 << 20)), peak_mb(lambda: toxicity.scores(texts, model))
    assert np.allclose(whole[0], small[0], rtol=0, atol=1e-9) and len(small[0]) == len(texts)
    assert small[1] < 50 < whole[1] and small[2] < 20 < whole[2]
    whole, small = peak_mb(lambda: _text.shingles(*_text.buffers(texts), 5)), peak_mb(lambda: _text.text_shingles(texts, 5))
    assert all((x == y).all() for x, y in zip(whole[0], small[0], strict=True))
    assert small[1] < 50 < whole[1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["id", "text"])
    rows, most, kept = peak_mb(lambda: sum(x.num_rows for x in ngram_join.segments(5, 6)(iter([batch]))))
    assert rows and most < 90 and kept < 20
    assert [len(x) for x in _text.text_shingles(texts.slice(0, 0), 5)] == [0, 0]


def test_sample_keeps_types_and_needs_no_python_rows(spark, capsys):
    """Ids of other types; the drawn ids go back to Spark as an Arrow table, not as an RDD of Python workers."""
    for kind in ("string", "decimal(20,0)", "timestamp_ntz", "struct<a:bigint,b:string>"):
        cast = {"timestamp_ntz": "cast(timestamp_seconds(id) as timestamp_ntz)", "struct<a:bigint,b:string>": "struct(id as a, cast(id as string) as b)"}.get(kind, f"cast(id as {kind})")
        rows = spark.range(200).selectExpr(f"{cast} as doc_id", "concat('word ', id) as text", "cast(id % 2 as int) as toxic")
        docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
        by = F.lit(True) if "struct" in kind else _classify.fold("doc_id", 5) != 0
        want = {r["text"] for r in rows.where(by).collect()}
        got = _classify.labelled_sample(docs, labels, "toxic", "doc_id", "text", 5, {None: 1000}, 100)
        assert {r["text"] for r in got.collect()} <= want and got.count() > 100 and {r["label"] for r in got.collect()} == {0, 1}
        assert "struct" in kind or got.count() == len(want)
        got.explain()
        assert "Scan" in (plan := capsys.readouterr().out) and "Scan ExistingRDD[__id" not in plan
    assert _classify.labelled_sample(docs, labels.limit(0), "toxic", "doc_id", "text", 5, {None: 1000}, 100).count() == 0


def test_quality_orders_several_grades(spark):
    rng = random.Random(31)
    noise = lambda n: " ".join(rng.choice(["###", "%%%", "!!"]) for _ in range(n))
    rows = [(i, f"{prose(rng, 40)} {noise(8 * (3 - g))}", g) for i in range(800) for g in [i % 4]]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9000, "", "x")], "doc_id long, text string, p_tail string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality(docs, ratings).collect()}
    held = [(i, g) for i, _, g in rows if plain.fold(i, 5) == 0]
    assert np.corrcoef([out[i]["expected_grade"] for i, _ in held], [g for _, g in held])[0, 1] > 0.9
    assert np.mean([out[i]["kept"] == (g == 3) for i, g in held]) > 0.9
    assert all(0 <= r["p_tail"] <= 1 and 0 <= r["expected_grade"] <= 3 for r in out.values())
    assert quality.quality(docs.limit(0), ratings).count() == 0
    assert {r["kept"] for r in quality.quality(docs, ratings.where("quality = 2")).collect()} == {True}
    assert quality.quality(docs, ratings.limit(0)).count() == docs.count()
    model = quality.train([t for _, t, _ in rows], [g for _, _, g in rows], buckets=1 << 14)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.linspace(-5, 5, 7))
    assert (np.diff(tails, axis=1) <= 0).all()


def test_sample_is_drawn_whatever_the_length(spark):
    """Rows by the hash of the id; whole texts fill the byte budget in that order."""
    docs = spark.createDataFrame([(i, "x" * (50 if i % 10 == 0 else 200)) for i in range(1, 101)] + [(99, "y" * 10), (7, "x" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 50)) for i in range(1, 201)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    got = _classify.labelled_sample(docs, labels, "toxic", "doc_id", "text", 5, {1: 20, None: 4}, 100).collect()
    for value, limit in ((0, 4), (1, 20)):
        want, used = set(), 0
        for i in [i for i in order if (i > 50) == value and plain.fold(i, 5)][:limit]:
            size = 50 if i % 10 == 0 else 200
            if used + size <= limit * 100:
                used += size
                want.add(i)
        assert {r["id"] for r in got if r["label"] == value} == want and len(want) > 1
    assert len(got) == len({r["id"] for r in got})


def test_long_labelled_texts_alone_teach_both_classes(spark):
    rng = random.Random(23)
    rows = []
    for i in range(60):
        words = prose(rng, 2000).split()
        if i % 2:
            words[rng.randrange(len(words))] = "zulgh"
        rows.append((i, " ".join(words), i % 2))
    assert min(len(t) for _, t, _ in rows) > 8000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in out) > 50


def test_labels_with_too_many_values_are_refused(spark):
    rows = spark.range(6000).withColumnsRenamed({"id": "doc_id"}).withColumn("text", F.lit("a b")).withColumn("quality", F.col("doc_id"))
    with pytest.raises(ValueError, match="more than"):
        quality.quality(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(41)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 40, 200)] + rng.normal(scale=0.03, size=(200, 16))
    tight = base[0] * 3 + rng.normal(scale=0.01, size=(150, 16))
    x = np.concatenate((base, near, tight, base[:5], base[:5] * 2)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0, 2.0]), (9005, [])]
    df = spark.createDataFrame(rows + [(None, [1.0] * 16)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = unit @ unit.T
    links = [(a, b) for a, b in zip(*np.nonzero(cos >= 0.95), strict=True) if a < b]
    degree = np.bincount(np.array(links).ravel(), minlength=len(x))
    of = plain.components(range(len(x)), links)
    for options in ({"most_cells": 1}, {"most_cells": 1, "per_block": 50}, {"per_block": 64}):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, **options).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == degree.tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == [of[i] for i in range(len(x))]
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(9000, 9006)) and got[None]["kept"]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_finds_all_links_of_a_dense_group_in_many_cells(spark):
    rng = np.random.default_rng(43)
    centre = rng.normal(size=32)
    group = centre / np.linalg.norm(centre) + rng.normal(scale=0.037, size=(3000, 32))
    x = np.concatenate((group, rng.normal(size=(300, 32))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, per_block=128).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    label = embedding_dedup.forest(*np.nonzero(link), len(x))
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_near_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(47)
    rows, expected, first = [], {}, 0
    for dim, n in ((8, 60), (16, 50), (3, 2), (5, 1)):
        x = np.repeat(rng.normal(size=(-(-n // 2), dim)), 2, axis=0)[:n] * rng.uniform(1, 2, (n, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True) * rng.integers(1, 4, (n, 1))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        expected |= {first + i: int(c) - 1 for i, c in enumerate((unit @ unit.T >= 0.95).sum(1))}
        rows += [(first + i, v.tolist()) for i, v in enumerate(x)]
        first += n
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"per_block": 8}):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df, **options).collect()}
        assert got == expected and min(sum(got[i] for i in part) for part in (range(60), range(60, 110), (110, 111))) > 0


def test_near_vectors_of_huge_components_and_named_ids_link(spark):
    rows = [("b", [1e200, 1e200]), ("a", [2e200, 2.001e200]), ("c", [-1e-200, 1e-200]), ("c", [-1e-200, 1e-200]), (None, [1.0, 1.0]), ("d", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id string, embedding array<double>, n_links int, component_id string")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [("None", 0, None, True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), ("c", 1, "c", True), ("d", 0, "d", True)]


def test_near_vectors_of_a_tight_group_cost_no_products_inside(spark):
    rng = np.random.default_rng(53)
    centre = rng.normal(size=24)
    group = centre / np.linalg.norm(centre) + rng.normal(scale=0.015, size=(2000, 24))
    x = np.concatenate((group, rng.normal(size=(200, 24))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, per_block=128).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == embedding_dedup.forest(*np.nonzero(link), len(x)).tolist()


def test_block_forest():
    label = embedding_dedup.forest(np.array([3, 1, 5]), np.array([1, 0, 4]), 7)
    assert label.tolist() == [0, 0, 2, 0, 4, 4, 6]


def test_vocabulary_in_pieces_is_the_same():
    rng = random.Random(51)
    texts = pa.array([prose(rng, 40) for _ in range(30)] + [None, ""], pa.string())
    lean = np.random.default_rng(1).normal(size=1 << 12)
    one, many = (toxicity.worst(toxicity.Vocabulary.of(texts, 1 << 12, most), lean, 0.1)[0] for most in (1 << 22, 300))
    assert np.allclose(one, many)


def test_likelihood_slopes_match_finite_differences():
    rng = np.random.default_rng(3)
    linear, cuts, y, weight = rng.normal(size=9), np.array([-1.0, 0.2, 1.5]), np.arange(9) % 4, rng.uniform(0.5, 2, 9)

    def loss(linear, cuts):
        tails = [[1.0] + [1 / (1 + np.exp(t - x)) for t in cuts] + [0.0] for x in linear]
        return -sum(w * np.log(t[g] - t[g + 1]) for t, g, w in zip(tails, y, weight, strict=True)) / len(y)

    to_linear, to_cut = quality.slopes(linear, y, cuts, weight)
    for i, got in enumerate(to_linear):
        step = np.eye(len(linear))[i] * 1e-6
        assert got == pytest.approx((loss(linear + step, cuts) - loss(linear - step, cuts)) / 2e-6, abs=1e-7)
    for i, got in enumerate(to_cut):
        step = np.eye(len(cuts))[i] * 1e-6
        assert got == pytest.approx((loss(linear, cuts + step) - loss(linear, cuts - step)) / 2e-6, abs=1e-7)


def test_softmax_slopes_match_finite_differences():
    rng = np.random.default_rng(4)
    texts, dim, buckets = ["zulgh ba lo ba", "ti en ra " * 8, "lo lo lo zulghs"], 3, 64
    vocabulary = toxicity.Vocabulary.of(pa.array(texts), buckets)
    ends = np.cumsum(vocabulary.per_text)
    a, y, weight = ends - vocabulary.per_text, np.array([1, 0, 1]), np.array([0.5, 2.0, 1.0])
    b = np.minimum(ends, a + toxicity.WINDOW)
    first = np.cumsum(vocabulary.per_word) - vocabulary.per_word
    parts = [rng.normal(size=(buckets, dim)), rng.normal(size=(dim, 2)), rng.normal(size=2)]

    def loss():
        total = 0.0
        for i in range(len(y)):
            mean = np.zeros(dim)
            for at in range(a[i], b[i]):
                word = vocabulary.tokens[at]
                own = vocabulary.buckets[first[word] : first[word] + vocabulary.per_word[word]]
                repeats = any(vocabulary.tokens[x] == word for x in range(max(a[i], at - toxicity.REPEAT), at))
                mean += (0 if repeats else 1) * parts[0][own].mean(0)
            logit = mean / max(b[i] - a[i], toxicity.WINDOW) @ parts[1] + parts[2]
            total -= weight[i] * (logit[y[i]] - np.log(np.exp(logit).sum()))
        return total / len(y)

    names, grad, to_weights, to_bias = toxicity.slopes(toxicity.SubwordSoftmax(*parts), vocabulary, first, a, b, y, weight)
    dense = np.zeros((buckets, dim))
    dense[names] = grad
    for part, got in zip(parts, (dense, to_weights, to_bias), strict=True):
        for at in np.ndindex(part.shape):
            keep = part[at]
            part[at] = keep + 1e-6
            up = loss()
            part[at] = keep - 1e-6
            down = loss()
            part[at] = keep
            assert got[at] == pytest.approx((up - down) / 2e-6, abs=1e-7)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("fitted", [64, 1, 0])
def test_near_vectors_that_share_ids_are_vectors_of_their_own(spark, kind, fitted, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FITTED_LENGTHS", fitted)
    rng = np.random.default_rng(17)
    base = rng.normal(size=(12, 4))
    rows = [(int(rng.integers(0, 9)), (base[rng.integers(0, 12)] + rng.choice([0.0, 0.12]) * rng.normal(size=4)).tolist()) for _ in range(120)]
    rows += [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (1, [1.0, 0.0]), (4, [-1.0, 0.0]), (4, None), (4, [3.0])]
    name = (lambda i: i) if kind == "long" else (lambda i: "id%d" % i)
    unit = [None if v is None else np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    of = plain.components(range(len(rows)), links)
    least = {c: min(name(rows[i][0]) for i in of if of[i] == c) for c in of.values()}
    want = sorted((name(i), sum(a == n for a, _ in links), least[of[n]], name(i) == least[of[n]]) for n, (i, _) in enumerate(rows))
    df = spark.createDataFrame([(name(i), v) for i, v in rows], f"vec_id {kind}, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, per_block=16).collect())
    assert got == want


ODD = [None, "", " \n", "a", "é", "Zulgh zulgh ra zulgh", "x " * 5, " ".join("w%d" % (i % 23) for i in range(40)), "lo ti " * 3000 + "Quimp", "a\tb\fc"]


def test_toxicity_scores_match_a_plain_version(spark, labelled):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame(list(enumerate([t for _, t, _ in labelled[:20]] + ODD)), "doc_id long, text string")
    for lean, bias in ((rng.normal(0, 20, 1 << 10), -3.0), (np.zeros(1 << 10), 0.5)):
        got = [r["score"] for r in toxicity.score_texts(docs, "text", (lean, bias)).orderBy("doc_id").collect()]
        assert got == pytest.approx([plain.toxic_score(r["text"], lean, bias) for r in docs.orderBy("doc_id").collect()], rel=1e-9, abs=1e-12)


def test_toxicity_fits_what_it_scores(spark, labelled):
    """The whole operator: its scores are those of the model that its own sample gives."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled[:200]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled[:200]], "doc_id long, toxic int")
    sample = sorted((r["label"], r["id"], r["text"]) for r in _classify.labelled_sample(docs, labels, "toxic", "doc_id", "text", 5, {1: 2000, None: 3000}, 10_000).collect())
    assert [i for _, i, _ in sample] == [i for _, i in sorted((y, i) for i, _, y in labelled[:200] if plain.fold(i, 5))]
    lean, bias = toxicity.train([t for _, _, t in sample], [y for y, _, _ in sample]).compact()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert got == pytest.approx({i: plain.toxic_score(t, lean, bias) for i, t, _ in labelled[:200]}, rel=1e-6, abs=1e-9)


def test_grades_match_a_plain_version(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame(list(enumerate(ODD + ODD)), "doc_id long, text string")
    for grades, cuts in (([0, 1], [0.2]), ([1, 2, 5], [-1.0, 0.7])):
        model = quality.CumulativeLink(grades, rng.normal(0, 2, 1 << 12), np.array(cuts))
        got = [(r["expected_grade"], r["p_tail"]) for r in quality.grade(docs, model).orderBy("doc_id").collect()]
        want = [plain.graded(t, model) for t in ODD + ODD]
        assert [x for pair in got for x in pair] == pytest.approx([x for pair in want for x in pair], rel=1e-9)
        assert got[: len(ODD)] == got[len(ODD) :]  # equal texts tie exactly
