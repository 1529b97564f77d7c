"""Dropping rows by a list of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many keys (about 16 bytes each) are broadcast; beyond it, the join is by shuffle.
BROADCAST_KEYS = 2_000_000


def without(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` whose ``key`` isn't among the distinct, non-null values of ``keys``' only column. Rows with a null key stay."""
    name = "__bad"
    while name in docs.columns:
        name += "_"
    bad = keys.select(F.col(keys.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
    small = bad.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if small else bad, F.col(key) == F.col(name), "left_anti")
