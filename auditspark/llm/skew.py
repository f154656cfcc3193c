"""Joins with a side of unique keys, where one key may hold a third of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many; so no more than that many are hot.
SHARE = 1000
#: Rows that one task may join; if there are no more, no key can be too hot.
ONE_TASK = 1_000_000


def join_unique(rows: DataFrame, named: DataFrame, keys: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with named, whose keys are unique; the column n says how many of the rows have the key, and goes.

    The hot keys, SHARE at most, are broadcast, so their rows stay where they are; of what is shuffled no key has
    more than one row in SHARE. Both sides should be tables: rows are read twice.
    """
    total = named.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if total <= ONE_TASK:
        return rows.join(named.drop(n), keys)
    is_hot = F.col(n) * SHARE > total
    hot = named.filter(is_hot)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(named.filter(~is_hot).drop(n), keys)
    return rows.join(F.broadcast(hot.drop(n)), keys).unionByName(cold)
