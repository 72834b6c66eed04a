"""The N best items of every group, where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def usable(score: str) -> Column:
    """The figure, or null where it is null, NaN or infinite; -0.0 becomes 0.0."""
    c = F.col(score).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c + F.lit(0.0))


def latest_items(rows: DataFrame, item: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of each item its row that comes last by ``order`` (nulls first); combined before the shuffle, so an item
    written again and again doesn't gather in one task."""
    kept = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return rows.groupBy(*item).agg(kept).select(*item, "_row.*")


def top_n_per_group(
    items: DataFrame, group: str, scores: list[str], ties: list[str], n: int, rank: str, salts: int = SALTS
) -> DataFrame:
    """The first ``n`` items of each group by ``scores`` and then ``ties``, all ascending, as ``rank`` 1 to n; all, if there are
    fewer. Null, NaN and infinite scores count as equal and come last; text is ordered by code points, null ties
    first. Items should differ in ``ties``; which of wholly equal ones comes first is open, but not how many. A null
    group is a group. An empty table gives no rows.

    Two stages: items are hashed into ``salts`` subgroups of their group, ranked, and all but n dropped (Spark cuts
    each subgroup to n before it shuffles); then the survivors, at most n times ``salts`` a group, are ranked.
    """
    order = [F.asc_nulls_last(f"_s{i}") for i in range(len(scores))] + [F.asc_nulls_first(t) for t in ties]
    keyed = items.withColumns({f"_s{i}": usable(s) for i, s in enumerate(scores)})
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)))
    inner = Window.partitionBy(group, "_salt").orderBy(*order)
    outer = Window.partitionBy(group).orderBy(*order)
    survivors = keyed.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= n)
    ranked = survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)
    return ranked.drop("_r", "_salt", *[f"_s{i}" for i in range(len(scores))])
