"""Weekly panels: aggregation of daily records, skeletons, fills, lags, dense supports, interventions.

Panels stay long, one row per unit and week; the week axis is bounded by the calendar, the unit axis is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.latest import last_non_null
from loomgrid.functions.scalars import iso_week, iso_year, week_end
from loomgrid.operators.skew import numbered


def increments(df: DataFrame, unit: str, day: str, columns: dict[str, str]) -> DataFrame:
    """Cumulative figures to increments (``columns``: cumulative -> new name) against the last known figure: the first is the figure itself,
    negative ones become 0, a missing figure has none (and what came in its time goes to the next known one)."""
    before = Window.partitionBy(unit).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    step = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0)))
    return df.withColumns({new: F.when(F.col(c).isNotNull(), step(c)) for c, new in columns.items()})


def deltas(df: DataFrame, unit: str, time: str, columns: list[str]) -> DataFrame:
    """``<c>_delta``: change from the row before of the unit; null for the first. Filter by time afterwards."""
    w = Window.partitionBy(unit).orderBy(time)
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns})


def weekly(df: DataFrame, unit: str, day: str, sums: list[str], peaks: list[str], lasts: list[str]) -> DataFrame:
    """Per unit and ISO week: sums, maxima, last non-null values, and how many days there were."""
    keyed = df.withColumns({"iso_year": iso_year(F.col(day)), "iso_week": iso_week(F.col(day)), "week_end": week_end(F.col(day))})
    return keyed.groupBy(unit, "iso_year", "iso_week", "week_end").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks],
        *[last_non_null(c, day).alias(c) for c in lasts], F.count(F.lit(1)).alias("days"),
    )


def skeleton(units: DataFrame, first: str, last: str) -> DataFrame:
    """Every unit with every Sunday from ``first`` to ``last`` (dates as text), as ``week_end``."""
    weeks = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 7 DAYS"))
    return units.withColumn("week_end", F.explode(weeks))


def fill_from(primary: DataFrame, secondary: DataFrame, keys: list[str], columns: list[str], named: tuple[str, str]) -> DataFrame:
    """Full outer join; a column comes from the primary where it has it, else from the secondary. ``source`` tells
    whether the primary had any of them."""
    a = primary.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = secondary.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    any_a = F.coalesce(*[F.col(f"a_{c}").cast("string") for c in columns]).isNotNull()
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in columns], F.when(any_a, named[0]).otherwise(named[1]).alias("source"))


def before_first_report(df: DataFrame, unit: str, time: str, source: str, value: str) -> Column:
    """``value``, or -1 before the unit's first non-null ``source``; units that never report stay null."""
    first = F.min(F.when(F.col(source).isNotNull(), F.col(time))).over(Window.partitionBy(unit))
    return F.when(F.col(time) < first, -1).otherwise(F.col(value))


def lagged(unit: str, time: str, value: str, steps: int) -> Column:
    """The value ``steps`` rows before; in a unit's first rows -1, but only where there is none."""
    w = Window.partitionBy(unit).orderBy(time)
    return F.coalesce(F.lag(value, steps).over(w), F.when(F.row_number().over(w) <= steps, -1))


def with_change(df: DataFrame, unit: list[str], time: str, value: str) -> DataFrame:
    """``changed``: 1.0 or 0.0 by the row before of the unit, null unless both are non-null."""
    before = F.lag(value).over(Window.partitionBy(*unit).orderBy(time))
    return df.withColumn("changed", F.when(F.col(value).isNotNull() & before.isNotNull(), (F.col(value) != before).cast("double")))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Adds ``number``, the 0-based place of each distinct key in text order. Keys are numbered in ranges, so no task sees all of
    them, however their first digits crowd."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(numbered(keys, [], [F.asc(key)], "number").withColumn("number", F.col("number") - 1), key)


def time_index(df: DataFrame, time: str, first: int = 0) -> DataFrame:
    """(time, t): the distinct times in order, from ``first`` on. The calendar bounds their number."""
    return df.select(time).where(F.col(time).isNotNull()).distinct().withColumn("t", (F.row_number().over(Window.orderBy(time)) - 1 + first).cast("int"))


def dense_suffix(cells: DataFrame, unit: str, t: str, value: str) -> DataFrame:
    """The start t and units of the largest complete suffix: of all starts the one with the greatest (area, units, weeks),
    the earliest of equal ones, area being units that have a value in every week from the start on, times those weeks.

    Units are reduced to their last incomplete week, then counted per week; only these counts are compared.
    """
    weeks = cells.select(t).distinct()
    have = cells.where(F.col(value).isNotNull()).groupBy(unit).agg(F.sort_array(F.collect_set(t)).alias("have"))
    every = weeks.agg(F.sort_array(F.collect_set(t)).alias("every")).select("every").scalar()
    gap = F.array_max(F.array_except(every, F.col("have")))
    gaps = have.select(unit, F.coalesce(gap, F.lit(-(2**31))).alias("gap"))
    per_gap = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).withColumn("every", every)
    starts = per_gap.select("n", "every", F.explode(F.filter("every", lambda w: w > F.col("gap"))).alias("start"))
    counts = starts.groupBy("start").agg(F.sum("n").alias("units"), F.first("every").alias("every"))
    counts = counts.withColumn("weeks", F.size(F.filter("every", lambda w: w >= F.col("start"))))
    best = counts.agg(F.max(F.struct((F.col("units") * F.col("weeks")).alias("area"), "units", "weeks", (-F.col("start")).alias("early")))).scalar()
    named = gaps.select(unit, "gap", (-best["early"]).alias("start"), best["area"].alias("area"), best["units"].alias("n_units"), best["weeks"].alias("n_weeks"))
    return named.where(F.col("gap") < F.col("start")).select(unit, "start", "area", "n_units", "n_weeks")


def start_and_end(panel: DataFrame, unit: str, t: str, z: str, steps: Column) -> DataFrame:
    """One row: s, the first time with any unit treated (``steps`` if none), and e, one more than the latest first
    treatment of a unit (0 if none)."""
    first = panel.groupBy(unit).agg(F.min(F.when(F.col(z) == 1, F.col(t))).alias("first"), F.max(t).alias("last"))
    return first.agg(F.coalesce(F.min("first"), steps).alias("s"), F.coalesce(F.max("first") + 1, F.lit(0)).alias("e"))


def interventions(panel: DataFrame, t: str, z: str, s: int | Column) -> DataFrame:
    """The saved interventions over the grid of a panel: as observed, all on, never on, on from ``s``."""
    kinds = {"observed": F.col(z), "full_on_all_time": F.lit(1), "full_on_no_time": F.lit(-1), "full_on_from_s": F.when(F.col(t) >= s, 1).otherwise(-1)}
    each = F.array(*[F.struct(F.lit(k).alias("intervention"), v.cast("int").alias("z_set")) for k, v in kinds.items()])
    return panel.withColumn("_i", F.explode(each)).select(*panel.columns, "_i.*")


def centred(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``row_centred`` and ``double_centred`` views of a long matrix (means over the cells that have a value)."""
    rows = df.groupBy(row).agg(F.avg(value).alias("_row"))
    columns = df.groupBy(column).agg(F.avg(value).alias("_column"))
    grand = df.agg(F.avg(value)).scalar()
    joined = df.join(rows, row).join(columns, column)
    return joined.withColumns(
        {"row_centred": F.col(value) - F.col("_row"), "double_centred": F.col(value) - F.col("_row") - F.col("_column") + grand}
    ).drop("_row", "_column")
