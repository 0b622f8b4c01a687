import pytest

import corpus_pipeline
from tests import oracle
from tests.llm import plain
from trellica.llm import mixing, registry, sharding, toxicity


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    oracle.check(spark, registry.QUERIES[name], registry.ORACLES[name], oracle.SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_covers_the_whole_table(spark, name):
    assert registry.QUERIES[name](spark, oracle.SMALL).count() == spark.read.parquet(f"{oracle.SMALL}/documents.parquet").count()


def test_pipeline_matches_plain_stages(spark):
    """Each stage against a plain version on its own input; toxicity against its operator's verdicts."""
    docs = spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{oracle.SMALL}/labels.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{oracle.SMALL}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    left = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    left = {i for i, _, c in plain.near_duplicates([(i, texts[i]) for i in left]) if i == c}
    wanted = [s for s in (plain.shingles(t.lower()) for t in items.values()) if s]
    left = {i for i in left if not any(len(s & plain.shingles(texts[i].lower())) >= 0.8 * len(s) for s in wanted)}
    kept = spark.createDataFrame([(i, sources[i], texts[i]) for i in left], "doc_id long, source string, text string")
    want = sorted(r["doc_id"] for r in mixing.mix_sources(kept, mixing.WEIGHTS).collect())
    got = corpus_pipeline.run(spark, oracle.SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r["shard"] == sharding.jump_hash(__import__("numpy").array([r["doc_id"]]), 8)[0] for r in got)
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_pipeline_stages_keep_columns_and_survive_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (1, "", "en", "src1", 0)], docs.schema)
    kept = {"toxicity": [3], "ngram_join": [2], "decontamination": [3], "sharding": [3]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), oracle.SMALL).collect() == []
        out = stage(spark, odd, oracle.SMALL)
        copies = mixing.mix_sources(odd, mixing.WEIGHTS).count()
        assert out.count() in kept.get(name, [copies])
        assert name == "sharding" or out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {None, 1}
