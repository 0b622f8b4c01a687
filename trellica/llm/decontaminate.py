"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3), in DataFrame functions only.

Test items are short and documents long, so resemblance sketches of whole documents would never meet. Containment is
searched from the item's side instead. Items are partitioned by the number of their shingles (powers of two). Each item
keeps a bottom-k MinHash sketch, its k least shingle hashes; each partition has a threshold, the largest hash in any of its
sketches, and a document is sketched for that partition by its shingle hashes up to the threshold. The share of an item's
sketch found in the document's sketch estimates its containment; items that reach a lower bound of the wanted containment
are candidates. Candidates are verified by exact containment of all the item's shingles in the whole document: a candidate
pair asks for its item's shingles, so a shingle that many items hold is counted for the pairs that are candidates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._store import cut, table

#: Rows up to which a side is broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, id_: str, text: str, k: int) -> DataFrame:
    """(id, h): one row per k-word shingle in text order; a shorter text is one shingle, a text without words has none."""
    hashed = df.select(F.col(id_).alias("id"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    at = hashed.select("id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0)))).alias("i"))
    return at.select("id", F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(k)]).alias("h"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast df if it has few rows; it must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 5, least: float = 0.8, sketch: int = 16, loose: float = 0.3) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): pairs where the document holds at least `least` of the item's shingles.

    Sets hold distinct k-word shingles of the whole lower-cased texts, as 64-bit hashes. An item with up to `sketch`
    shingles is sketched whole, so its candidates are exact; for a longer one a pair is a candidate if at least
    `loose` of the sketch is found, which a pair with containment 0.8 misses with probability under 1e-5. Null or empty
    texts and rows with a null id hold nothing and match nothing; rows that share an id count as one text; empty tables
    give an empty result; other columns are not read.
    """
    of_item = with_shingles(items.where(F.col(item_id).isNotNull()), item_id, text, k).distinct()
    sized = of_item.groupBy("id").agg(F.count("*").alias("n_item"), F.slice(F.array_sort(F.collect_set("h")), 1, sketch).alias("least_h"))
    sized = cut(sized.withColumn("band", F.ceil(F.log2("n_item")).cast("int")))
    bound = sized.groupBy("band").agg(F.max(F.element_at("least_h", -1)).alias("top"))
    posts = sized.join(F.broadcast(bound), "band").select(F.col("id").alias("item"), "band", "top", F.size("least_h").alias("k"), F.explode("least_h").alias("h"))
    posts = cut(posts)
    top = posts.agg(F.max("top")).first()[0]
    of_doc = with_shingles(docs.where(F.col(doc_id).isNotNull()), doc_id, text, k)
    hit = of_doc.where(F.col("h") <= F.lit(top)).join(small(posts), "h").where(F.col("h") <= F.col("top"))
    seen = hit.groupBy("id", "item", "k").agg(F.count_distinct("h").alias("found"))
    pairs = cut(seen.where(F.col("found") >= F.when(F.col("k") < sketch, F.col("k") * least).otherwise(F.col("k") * loose)).select("id", "item"))
    whole = docs.join(small(pairs.select(F.col("id").alias(doc_id)).distinct()), doc_id, "left_semi")
    of_item = cut(of_item.select(F.col("id").alias("item"), "h"))
    wanted = pairs.join(small(of_item), "item")
    held = with_shingles(whole, doc_id, text, k).join(small(of_item.select("h").distinct()), "h", "left_semi").distinct()
    total = held.join(wanted, ["id", "h"]).groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    exact = total.join(small(sized.select(F.col("id").alias("item"), "n_item")), "item")
    return exact.where(F.col("n_shared") >= F.col("n_item") * least).select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "n_shared", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Documents that hold no test item; rows with a null id cannot be named and stay."""
    found = contained_items(docs, items, doc_id, **options).select(doc_id).distinct()
    return docs.join(small(cut(found)), doc_id, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains: five words, containment 0.8."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


ORACLE = r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark),
g AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT id, count(*) AS n_item FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n.n_item, round(count(*) / n.n_item::DOUBLE, 6) AS containment
FROM g AS d JOIN g AS i ON i.gram = d.gram AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_item HAVING count(*) >= 0.8 * n.n_item
"""
