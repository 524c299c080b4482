"""Joining a per-key table back onto rows when one key may hold most of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key with more rows than this is heavy; the limit grows with the input so
# that heavy keys never number more than MOST_HEAVY, a broadcastable table.
HEAVY = 2_000_000
MOST_HEAVY = 100_000


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``table`` row per key.

    ``count`` is a column of ``table``: how many rows carry the key; ``total``
    is their number. Heavy keys are matched by broadcast where the rows lie, so
    no task receives all rows of one key; the others are shuffled as usual.
    """
    keys = list(keys)
    limit = max(HEAVY, total // MOST_HEAVY)
    if total <= limit:
        return rows.join(table.drop(count), keys)
    heavy = table.where(F.col(count) > limit).drop(count)
    light = table.where(F.col(count) <= limit).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))
