"""Joins and orders in which one key may hold a third of all rows.

Keys with very many rows are found by counts, which are combined before they are shuffled. Their list is bounded, so it is broadcast and
rows get their salt before the only shuffle of the join. Keys with fewer rows are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import cut_lineage

#: A key with more rows is hot, and split into parts of about this many.
CROWDED = 4096
#: At most so many keys are split, the largest ones; with more hot keys than that, none of the others holds a greater share of the rows.
MOST_HOT = 4096


def hot_keys(rows: DataFrame, key: list[str], parts: str, crowded: int = CROWDED) -> DataFrame:
    """(key, ``parts``) of the keys to be split: at most MOST_HOT rows, whatever the size of the table. Null keys match nothing. Of keys with
    equally many rows the smaller ones count, so that both sides of a join get the same list however often it is made."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    return counts.orderBy(F.desc("_n"), *key).limit(MOST_HOT).select(*key, F.ceil(F.col("_n") / crowded).cast("int").alias(parts))


def _salted(by: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(by), parts).cast("int")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def spread(left: DataFrame, right: DataFrame, key: list[str], by: str, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join whose hot keys lie on the left, and the key to join them by, in any way that keeps left rows: these are spread
    over salts by ``by``, the right ones are copied to every salt of their key."""
    hot = hot_keys(left, key, "_parts", crowded)
    return spread_rows(left, hot, key, by), copied(right, hot, key), [*key, "_salt"]


def spread_rows(left: DataFrame, hot: DataFrame, key: list[str], by: str) -> DataFrame:
    """The left side of ``spread`` with the hot keys given."""
    return left.join(F.broadcast(hot), key, "left").withColumn("_salt", _salted(by, F.coalesce("_parts", F.lit(1)))).drop("_parts")


def copied(right: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    """The right side of ``spread`` with the hot keys given."""
    return right.join(F.broadcast(hot), key, "left").withColumn("_salt", _every(F.coalesce("_parts", F.lit(1)))).drop("_parts")


def join_both(own: DataFrame, probes: DataFrame, key: list[str], crowded: int = CROWDED, by: tuple[str, str] = ("id", "id")) -> DataFrame:
    """Inner join of ``own`` and ``probes`` (whose other columns get the prefix ``probe_``) where either side may have hot keys. Such a
    key is cut into own parts x probe parts, so that no task gets more than its share of either; ``by`` names the columns
    that spread the rows of each side."""
    hot_own, hot_probe = F.broadcast(hot_keys(own, key, "_own", crowded)), F.broadcast(hot_keys(probes, key, "_probe", 16 * crowded))
    a, b = F.coalesce("_own", F.lit(1)), F.coalesce("_probe", F.lit(1))
    marked = lambda df: df.join(hot_own, key, "left").join(hot_probe, key, "left")
    left = marked(own).withColumn("_own_salt", _salted(by[0], a)).withColumn("_probe_salt", _every(b)).drop("_own", "_probe")
    right = marked(probes).withColumn("_probe_salt", _salted(by[1], b)).withColumn("_own_salt", _every(a)).drop("_own", "_probe")
    whole = [*key, "_own_salt", "_probe_salt"]
    right = right.select(*whole, *[F.col(c).alias(f"probe_{c}") for c in right.columns if c not in whole])
    return left.join(right, whole).drop("_own_salt", "_probe_salt")


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place from 1 of each row in its group (of all rows without a group) by ``order``; null groups are groups.

    Rows are cut into ranges of (group, order), numbered inside their range, and moved up by the rows of their group in the ranges
    before, so a group of any size is ordered by many tasks.
    """
    ranged = cut_lineage(rows.repartitionByRange(*[F.asc_nulls_first(g) for g in group], *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per group and range
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return ranged.join(before, same).withColumn(name, (inside + F.col("_before")).cast("int")).select(*rows.columns, name)


def running_counts(rows: DataFrame, order: list[Column], flags: dict[str, Column]) -> DataFrame:
    """Adds a column for each of ``flags``: in how many rows up to this one, by ``order`` over all rows, it holds. Counted in ranges like in ``numbered``."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(*[F.count_if(flag).alias(f"_n_{name}") for name, flag in flags.items()])  # a row per range
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", *[F.coalesce(F.sum(f"_n_{name}").over(upto), F.lit(0)).alias(f"_n_{name}") for name in flags])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.select("*", *[F.count_if(flag).over(inside).alias(name) for name, flag in flags.items()])
    return counted.join(F.broadcast(before), "_range").select(*rows.columns, *[(F.col(name) + F.col(f"_n_{name}")).alias(name) for name in flags])
