"""Picking one row of a group by an order, with a combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_row(df: DataFrame, keys: list[str], order: list[str], values: list[str | Column]) -> DataFrame:
    """Of each key the whole row that comes last by ``order`` (nulls first), its nulls included.

    An aggregate rather than a window: a key written a million times shrinks to one row per
    task before anything is shuffled. Null keys form one group.
    """
    kept = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*")


def last_non_null(value: str, order: str) -> Column:
    """Aggregate: the last value that isn't null (a later null doesn't hide it)."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
