"""Mixing sources to target weights by Poisson replication (operator 6), in DataFrame functions only.

A source with weight w should make up the share w of the output rows. Its mean repetition rate is therefore
w * total / rows of the source, and every document is repeated as often as a Poisson variable with that mean says. The
variable comes from inverting the distribution at a uniform number hashed from the seed and the document id, so the same
document always gets the same count, on any machine and in any order. The copies are then shuffled globally by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._skew import join_spread
from trellica.llm._store import table

#: More sources than this are joined by a shuffle, but for the large ones among them; fewer are a small table and broadcast.
BROADCAST_SOURCES = 20_000


def uniform(seed: str, *parts: Column) -> Column:
    """A uniform double in [0, 1) from 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def invert(u: Column, rate: Column) -> Column:
    """The least n whose cumulative Poisson probability exceeds u, for a rate up to PART."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = (acc["c"] <= u) & (acc["n"] == i - 1)
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.when(more, i).otherwise(acc["n"]).alias("n"))

    return F.aggregate(steps, zero, step, lambda acc: acc["n"])


#: exp(-rate) keeps its precision up to here; a larger rate is the sum of equal independent parts.
PART = 16


def poisson_count(seed: str, key: Column, rate: Column) -> Column:
    """Hash-seeded Poisson variable with the given mean; 0 for a rate that is 0 or null."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + invert(uniform(seed, key, i), rate / parts))
    return F.when(rate > 0, total).otherwise(0)


def mix_sources(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, source: str = "source", doc_id: str = "doc_id", seed: str = "mix", size: float = 1.0) -> DataFrame:
    """Repeat documents so that each source makes up its share, and shuffle them; adds copy, rate and shuffle_key.

    `weights` holds target weights by source, `rest` is that of every other source (a null source is one too); weights are
    scaled to sum to 1 over the sources present. Texts, of any length, are carried and not read. `size` is the expected output in multiples of the input rows. Rows that
    share an id get the same count, a null id counts as the empty id. A weight of 0 leaves a source out. An empty table
    gives an empty result; columns named copy, rate or shuffle_key are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "rate", "shuffle_key")])
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    counts = docs.groupBy(name.alias("__source")).agg(F.count("*").alias("rows"))
    given = F.lit(float(rest))
    for known, weight in weights.items():
        given = F.when(F.col("__source") == f"={known}", float(weight)).otherwise(given)
    counts = counts.withColumn("weight", given)
    sources, all_rows, all_weight = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rates = counts.select("__source", "rows", (F.col("weight") / F.nullif(F.lit(all_weight), F.lit(0.0)) * F.lit(all_rows * float(size)) / F.col("rows")).alias("rate"))
    rates, named = rates.withColumnRenamed("rows", "__rows"), docs.withColumn("__source", name)
    few = sources <= BROADCAST_SOURCES
    joined = named.join(F.broadcast(rates), "__source") if few else join_spread(named, rates, ["__source"], "__rows")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "rate")
    key = F.col(doc_id)
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.nullif(poisson_count(seed, key, F.col("rate")), F.lit(0)))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), F.coalesce(key.cast("string"), F.lit("")), F.col("copy"))))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: Target weights of the query and of the pipeline: the large crawl counts twice, every other source once.
WEIGHTS = {"src0": 2.0}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix, in shuffled order."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS)
    return out.select("doc_id", "source", "copy", "rate", "shuffle_key", F.md5("text").alias("text_md5"))


ORACLE = """
WITH RECURSIVE s AS (SELECT source, count(*) AS rows, CASE WHEN source = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM s) * ((SELECT sum(rows) FROM s)::DOUBLE * 1.0::DOUBLE) / rows AS rate FROM s),
d AS (SELECT d.doc_id, d.source, d.text, r.rate, ('0x' || substr(md5('mix:' || d.doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM documents AS d JOIN r ON r.source IS NOT DISTINCT FROM d.source),
c AS (SELECT doc_id, rate, u, 0 AS n, exp(-rate) AS p, exp(-rate) AS cum FROM d
      UNION ALL SELECT doc_id, rate, u, n + 1, p * rate / (n + 1), cum + p * rate / (n + 1) FROM c WHERE cum <= u AND n < 80),
k AS (SELECT doc_id, max(n) AS n FROM c GROUP BY doc_id)
SELECT e.doc_id, e.source, CAST(e.copy AS INTEGER) AS copy, e.rate, md5('mix order:' || e.doc_id || ':' || e.copy) AS shuffle_key, md5(e.text) AS text_md5
FROM (SELECT d.*, unnest(range(1, k.n + 1)) AS copy FROM d JOIN k ON k.doc_id = d.doc_id) AS e
"""
