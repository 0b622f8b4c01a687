"""A join in which no key gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellica.llm._store import cut

#: A key with more than this share of the rows (one in so many) is hot; so there are at most as many hot keys.
HOT_KEYS = 10_000


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with a table of one row per key that holds the number of `rows` of the key in `count`.

    Rows of hot keys meet a broadcast table of at most HOT_KEYS rows (keys and values must be of fixed size); all other
    rows meet theirs by a shuffle. `rows` should be materialised, as it is read three times.
    """
    least = max(100, rows.count() // HOT_KEYS + 1)
    hot = F.broadcast(cut(table.where(F.col(count) >= least)))
    often = rows.join(hot, keys)
    seldom = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(count) < least), keys)
    return often.unionByName(seldom)
