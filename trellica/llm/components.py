"""Connected components of a link table, by repeated joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellica.llm._store import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that occurs in a link, with the smallest id reachable from it.

    Each round takes the least label among the neighbours and then the label's own label, so long chains halve; rounds
    end when no label changes. Nothing but one changed-row count per round reaches the driver.
    """
    x, y = F.col(a).alias("u"), F.col(b).alias("v")
    pairs = links.where(F.col(a) != F.col(b))
    both = cut(pairs.select(x, y).union(pairs.select(y.alias("u"), x.alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")))
    while True:
        seen = both.join(label, both.v == label.id).groupBy("u").agg(F.min("component").alias("near"))
        lower = label.join(seen, label.id == seen.u).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("id").alias("at"), F.col("component").alias("next"))
        label = cut(lower.join(jump, F.col("component") == F.col("at")).select("id", "was", F.least("component", "next").alias("component")))
        done = label.where("component <> was").isEmpty()
        label = label.drop("was")
        if done:
            return label
