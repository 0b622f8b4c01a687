"""Labelled samples for the classifiers of this subpackage, and the task that fits them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellica.llm._store import cut

#: A label with more distinct values than this is a mistake, not a grade.
MOST_VALUES = 1000


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, held_parts: int, most: dict, most_bytes: int) -> DataFrame:
    """(label, text) of a bounded training sample, none of the held-out fold (fold 0 of held_parts).

    For each label, at most `most[label]` (or most[None]) labelled ids that docs holds are drawn in the order of a hash of
    the id, whatever the length of their texts. Whole texts fill a budget of most * most_bytes for each label in that
    order; only a text that would exceed what is left of it is passed over. An id with several texts gives the least one.
    So rows and bytes are bounded by the parameters. Only the sample is bounded; scoring covers every row. A label with
    more than MOST_VALUES values raises ValueError.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).where(fold("__id", held_parts) != 0).distinct()
    values = sorted(r[0] for r in known.select("__label").distinct().limit(MOST_VALUES + 1).collect())
    if len(values) > MOST_VALUES:
        raise ValueError(f"{label} has more than {MOST_VALUES} values")
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sizes = cut(rows.select("__id", F.octet_length("__text").alias("__size")).join(known, "__id").groupBy("__id", "__label").agg(F.max("__size").alias("__size")))
    drawn = []
    for value in values:
        limit, used = most.get(value, most.get(None)), 0
        ordered, kept = sizes.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(limit).toArrow(), []
        for i, size in enumerate(ordered["__size"].to_pylist()):
            if used + size <= limit * most_bytes:
                used += size
                kept.append(i)
        drawn.append(ordered.select(["__id", "__label"]).take(pa.array(kept, pa.int64())))
    chosen = docs.sparkSession.createDataFrame(pa.concat_tables(drawn), known.schema) if drawn else known.limit(0)  # an Arrow table needs no Python on executors
    return rows.join(F.broadcast(chosen), "__id").groupBy("__label", "__id").agg(F.min("__text").alias("text")).select(F.col("__label").alias("label"), F.col("__id").alias("id"), "text")


def fit_in_task(sample: DataFrame, train: Callable):
    """What train(texts, labels) gives, computed by one task over a bounded sample; only the result reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        texts, labels = [], []
        if held:
            rows = pa.Table.from_batches(held)
            held.clear()
            rows = rows.sort_by([("label", "ascending"), ("id", "ascending")])
            texts, labels = rows["text"].combine_chunks(), rows["label"].to_pylist()
            del rows
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()  # an empty sample may have no partition
    return pickle.loads(found["model"]) if found else train([], [])
