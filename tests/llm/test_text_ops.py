import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from trellica.llm import _text, chat_format, decontaminate, line_dedup, lm_score, mixing, ngram_join, sharding
from trellica.llm.components import components

SCHEMA = "doc_id long, text string, n_lines string, score string, copy string, shard string, component_id string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators add."""
    return spark.createDataFrame([(i, t, *["x"] * 5) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, tiny, empty, null, very long and odd texts."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(20)]
    shared = prose(rng, 60)
    rows = [*base, *base[:5], *base[:3]]
    for text in base[:8] * 4:
        w = text.split()
        w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append(" ".join(w))
    rows += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(10)]
    rows += ["", None, "  \n ", "a b", "A  b", "one two three four five", prose(rng, 30_000), "é ü É\x1c x y z", "tab\tline\nnext\vpage\fend\r."]
    return list(enumerate(rows))


def test_words_and_hashes_follow_the_text():
    rng = random.Random(2)
    texts = ["", None, " ", "a", "a b", "\n\nÄ b\x0bC ", *["".join(rng.choices(" \t\nabÄ\x1cz", k=rng.randint(0, 30))) for _ in range(200)]]
    data, off = _text.buffers(pa.array(texts, pa.string()))
    start, end, count = _text.words(data, off)
    raw = data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert found == [w for t in texts for w in plain.words(t)] and count.tolist() == [len(plain.words(t)) for t in texts]
    hashes = _text.span_hash(_text.prefix(data), start, end)
    assert len(set(zip(found, hashes.tolist(), strict=True))) == len(set(found)) == len(set(hashes.tolist()))
    flat, made = _text.shingles(data, off, 5)
    assert made.tolist() == [max(1, len(w) - 4) if w else 0 for w in map(plain.words, texts)]
    ends = np.cumsum(made)
    assert [len(set(flat[e - n : e].tolist())) for e, n in zip(ends, made, strict=True)] == [len(plain.shingles(t)) for t in texts]


def test_ngram_join_matches_plain_version(spark, corpus):
    rows = [*corpus, (None, "a b c d e f"), corpus[0]]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain.near_duplicates(corpus)
    assert ngram_join.near_duplicates(frame(spark, [])).collect() == []


def test_ngram_join_takes_rows_of_one_id_as_one_document(spark):
    rng = random.Random(15)
    a, b, c = (prose(rng, 40, 10**6) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (4, f"{b} end"), (5, c), (5, None), (6, c), (6, c), (7, ""), (7, "")]
    union = {}
    for i, t in rows:
        union.setdefault(i, set()).update(plain.shingles(t))
    ids = sorted(union)
    links = [(x, y) for x in ids for y in ids if x < y and union[x] and 100 * len(union[x] & union[y]) >= 80 * len(union[x] | union[y])]
    of = plain.components(ids, links)
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted((i, len(union[i]), of[i]) for i in ids) and len(union[1]) == 72
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(named).collect()) == sorted((f"d{i}", n, f"d{c}") for i, n, c in got)


def test_ngram_join_finds_chains_and_minorities(spark):
    """A chain whose ends do not link, and two groups that share rare n-grams without linking."""
    rng = random.Random(5)
    w = prose(rng, 100, 10**6).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        w[i * 8] = f"new{i}"
    half = prose(rng, 50, 10**6)
    rows += [(100 + i, f"{half} {prose(random.Random(i % 2), 20, 10**6)} x{i}") for i in range(10)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == plain.near_duplicates(rows)


def test_parity_sketches_exclude_no_link_and_most_other_pairs():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 120)
    sets_ = [np.concatenate((rng.permutation(common)[: rng.integers(40, 120)], rng.integers(0, 2**63, rng.integers(1, 80)))) for _ in range(80)]
    sketch = ngram_join.parity(np.repeat(np.arange(80), [len(x) for x in sets_]), np.concatenate(sets_), 80)
    apart = tried = 0
    for i in range(80):
        for j in range(i):
            x, y = set(sets_[i].tolist()), set(sets_[j].tolist())
            differ = sum(int(a).bit_count() for a in (sketch[i] ^ sketch[j]).view(np.uint64))
            assert differ <= len(x ^ y)
            least = -(-(len(x) + len(y)) * 80 // 180)
            if len(x & y) < least:
                tried += 1
                apart += len(x) + len(y) - differ < 2 * least
    assert apart > 0.9 * tried > 1000


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain.components(ids, [x for x in links if x[0] != x[1]])


def test_line_dedup_matches_plain_version(spark, corpus):
    rng = random.Random(6)
    pool = [prose(rng, 5) for _ in range(15)] + ["short", "", "  "]
    rows = [(i, "\n".join(x.upper() + " " if rng.random() < 0.2 else x for x in rng.choices(pool, k=rng.randint(1, 8)))) for i in range(60)] + [(100 + i, t) for i, t in corpus]
    for bits in (1 << 30, 1 << 13, 1 << 10):
        got = line_dedup.dedup_lines(frame(spark, rows), max_filter_bits=bits).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"), "score").collect()
        assert sorted(tuple(r)[:4] for r in got) == plain.line_dedup(rows) and {r["score"] for r in got} == {"x"}
    null = line_dedup.dedup_lines(frame(spark, [(None, pool[0]), (1, pool[0]), (1, pool[0]), (2, pool[0])])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_dropped"]) for r in null] == [(None, 0), (1, 0), (1, 0), (2, 1)]
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_language_model_matches_plain_base_and_beats_it(spark, corpus):
    rng = random.Random(9)
    rows = [*corpus, *[(1000 + i, " ".join(f"{w} then{w}" for w in prose(rng, 30, 40).split())) for i in range(150)]]
    got = {r["id"]: r for r in lm_score.score_documents(frame(spark, rows), order=3).collect()}
    want = plain.language_base(rows)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [got[i] for i, x in want.items() if x[0] and i >= 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.score_documents(frame(spark, [])).collect() == []
    alone = lm_score.score_documents(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert [r["train_tokens"] for r in alone] == [0, 0] and all(r["score"] == pytest.approx(r["base_score"]) for r in alone)


def test_interpolated_probabilities_sum_to_one():
    """Over all continuations of a context, seen and unseen, a bucket's mixture is a distribution."""
    texts = pa.array(["a b a c", "a b b", "c"], pa.string())
    each, tokens = lm_score.grams(texts, 2)
    single, counts = np.unique(each[0], return_counts=True)
    total, types = tokens.sum(), len(single)
    assert (counts + 0.1).sum() / (total + 0.1 * (types + 1)) + 0.1 / (total + 0.1 * (types + 1)) == pytest.approx(1)
    pairs, n = np.unique(each[1], return_counts=True)
    assert n.sum() == total
    weights = lm_score.learn_weights(np.array([], np.int64), np.array([]), np.zeros((0, 3)), 2)
    assert np.allclose(weights.sum(1), 1) and not weights[0, 0]


def test_decontamination(spark):
    rng = random.Random(11)
    items = [prose(rng, n, 10**5) for n in (3, 5, 12, 40, 64)]
    cut_ = items[3].split()
    damaged = " ".join(["x", *cut_[1:]])
    rows = [(i, f"{prose(rng, 300, 10**5)} {t} {prose(rng, 300, 10**5)}") for i, t in enumerate(items)]
    rows += [(10, items[3].upper().replace(" ", "\n")), (11, f"{prose(rng, 50)} {damaged}"), (12, " ".join(cut_[:20])), (13, None), (14, ""), (15, prose(rng, 20_000, 10**5)), (10, items[0]), (None, items[4])]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (None, items[0])], "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, bench).collect()}
    items_ = {i: plain.shingles(t) for i, t in enumerate(items)}
    texts = {}
    for i, t in rows:
        texts[i] = texts.get(i, set()) | plain.shingles(t)
    want = {(d, i) for d, s in texts.items() if d is not None for i, x in items_.items() if len(s & x) >= 0.8 * len(x)}
    assert got == want and {(10, 3), (11, 3)} <= got
    clean = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in want} and {12, 13, 14, 15, None} <= {r["doc_id"] for r in clean.collect()} and clean.columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows) and decontaminate.contained_items(docs.limit(0), bench).count() == 0


def test_mixing_of_many_sources_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "big" if i % 3 else f"s{i % 30}", "x") for i in range(600)] + [(700, None, "x")], "doc_id long, source string, text string")
    run = lambda: sorted(map(tuple, mixing.mix_sources(docs, {"big": 2.0}).collect()), key=str)
    few = run()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert few and run() == few


def test_mixing(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small", "x") for i in range(3000)] + [(None, None, None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    out = mixing.mix_sources(docs, {"small": 2.0, "gone": 5.0}, rest=1.0, size=2.0)
    again = mixing.mix_sources(docs.repartition(7), {"small": 2.0, "gone": 5.0}, rest=1.0, size=2.0)
    key = lambda df: sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in df.collect())
    assert key(out) == key(again) and out.columns == ["doc_id", "text", "source", "rate", "copy", "shuffle_key"]
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["small"] - 3003) < 250 and abs(share["big"] - 1501) < 200
    assert {r["c"] for r in out.groupBy("doc_id").agg((F.max("copy") == F.count_distinct("copy")).alias("c")).collect()} == {True}
    assert mixing.mix_sources(docs, {"small": 0.0, "big": 0.0}, rest=0.0).count() == 0 and mixing.mix_sources(docs.limit(0), {}).count() == 0
    rates = spark.createDataFrame([(i, r) for r in (0.3, 2.5, 60.0) for i in range(2000)], "k long, r double")
    for r in rates.groupBy("r").agg(F.avg(mixing.poisson_count("s", F.col("k"), F.col("r"))).alias("m"), F.variance(mixing.poisson_count("s", F.col("k"), F.col("r"))).alias("v")).collect():
        assert abs(r["m"] - r["r"]) < 5 * (r["r"] / 2000) ** 0.5 and 0.8 < r["v"] / r["r"] < 1.25


def test_chat_formatting_round_trip(spark):
    odd = ["<|im_end|>", "<|im_start|>assistant x", "<\\|im_end|>\n", "a<", "|x", "\\", "", None, "é\n\n<\\\\|"]
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(60 + n, t, r, x) for n, pair in enumerate([("user\nx", "y"), ("user", "x\ny"), ("a\\", "\\n"), ("a\\\n", "n"), ("\\n", "\n"), ("<\\|im_end|>\n", "<|im_end|>\n"), ("", "z" * 300_000)]) for t, (r, x) in enumerate([pair, ("assistant", "ok")])]
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, 0, None, "<|"), (None, 1, "assistant", "n"), (None, None, "user", "u")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.expand(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    written = {r["conv_id"]: r["formatted"] for r in examples.where("conv_id IN (60, 61)").collect()}
    assert written[60] != written[61]
    per = {r["conv_id"]: r["count"] for r in examples.groupBy("conv_id").count().collect()}
    assert all(per[c] == sum(r == "assistant" for _, r, _ in t) + (max(t)[1] != "assistant") for c, t in by.items() if c == 50)
    assert chat_format.expand(df.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i, f"t{i % 50}") for i in range(3000)] + [(None, None), (5, ""), *[(7, "hot")] * 900]
    out = sharding.assign_shards(frame(spark, rows), "doc_id", "text", 8, rows_per_bucket=100).collect()
    assert len(out) == len(rows)
    for shard in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out) and 0.05 < sum(r["grown_shard"] == 8 for r in out) / len(out) < 0.2
    assert {(r["size"], r["text_crc32"]) for r in out if r["text"] is None or r["text"] == ""} == {(1, 0)}
    keys = np.arange(100_000)
    assert np.abs(np.bincount(sharding.jump_hash(keys, 7)) / len(keys) - 1 / 7).max() < 0.01
    assert sharding.assign_shards(frame(spark, []), "doc_id", "text").count() == 0
    long = sharding.assign_shards(frame(spark, [(1, "é" * 400_000)]), "doc_id", "text").first()
    assert (long["size"], long["text_crc32"]) == (800_001, zlib.crc32(("é" * 400_000).encode()))
    named = sharding.assign_shards(frame(spark, [(1, "a"), (2, None)]).withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text", 4)
    assert {r["shard"] for r in named.collect()} <= {0, 1, 2, 3}


def test_op2_scores_with_order_three(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d a b c e" if i % 2 else "b c d e a") for i in range(60)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, two, three = ({r[0]: r["score"] for r in x.collect()} for x in (lm_score.op2_lm_score(spark, str(tmp_path)), *[lm_score.score_documents(docs, order=k) for k in (2, 3)]))
    assert all(abs(got[i] - three[i]) < 1e-9 for i in got) and any(abs(got[i] - two[i]) > 1e-3 for i in got)


def test_lm_totals_beyond_32_bits():
    one = [lm_score.planes(x) for x in (np.array([3], np.uint64), np.array([2**32 - 1], np.uint32))]
    rows = [{"part": 0, "block": b, "size": 1, "grams": one[0], "counts": one[1]} for b in (2, 5)]
    reply = next(lm_score.answer(iter([pa.RecordBatch.from_pylist(rows)])))
    assert lm_score.from_planes(reply["totals"][0].as_py(), np.uint64, 1).tolist() == [2 * (2**32 - 1)] and reply["tokens"][0].as_py() == 2 * (2**32 - 1)


def test_language_model_scores_match_a_plain_deleted_interpolation(spark):
    rng = random.Random(17)
    rows = [(i % 70 if i > 100 else i, " ".join(rng.choices("ab bc cd de ef".split(), weights=[5, 3, 2, 1, 1], k=rng.randint(0, 12)))) for i in range(140)] + [(None, None), (None, "ab bc"), (None, "ab bc")]
    for order in (2, 3):
        got = sorted((str(r["id"]), r["n_tokens"], r["score"]) for r in lm_score.score_documents(frame(spark, rows), order=order).collect())
        want = sorted((str(i), n, s) for i, n, s in plain.deleted_interpolation(rows, order))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=0.01)
