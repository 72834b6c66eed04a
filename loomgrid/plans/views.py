"""Views that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code, area_code_sql
from loomgrid.operators.counties import DAILY_SQL, daily_records
from loomgrid.operators.panel import time_index
from loomgrid.sources.tables import table

CODE = area_code_sql("fips")
DAILY = DAILY_SQL.format(code=CODE)


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """(fips, date, county, state, cases, deaths): daily records; a negative figure is none, and a record without one keeps the other."""
    rows = daily_records(table(spark, folder, "us_counties"), ["county", "state", "cases", "deaths"])
    return rows.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("cases", "deaths")}).withColumnRenamed("code", "fips")


DAILY_VIEW = f"""{DAILY},
 days AS (SELECT code AS fips, date, county, state, CASE WHEN cases >= 0 THEN cases END AS cases, CASE WHEN deaths >= 0 THEN deaths END AS deaths FROM daily),
 steps AS (
   SELECT *, CASE WHEN cases IS NOT NULL THEN greatest(0, cases - coalesce(last_value(cases IGNORE NULLS) OVER w, 0)) END AS new_cases,
     CASE WHEN deaths IS NOT NULL THEN greatest(0, deaths - coalesce(last_value(deaths IGNORE NULLS) OVER w, 0)) END AS new_deaths
   FROM days WINDOW w AS (PARTITION BY fips ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 weeks AS (
   SELECT fips, isoyear(date) AS iso_year, week(date) AS iso_week, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end,
     CAST(sum(new_cases) AS BIGINT) AS new_cases, CAST(sum(new_deaths) AS BIGINT) AS new_deaths, max(cases) AS cases, max(deaths) AS deaths,
     count(*) AS days, max_by(county, date) FILTER (county IS NOT NULL) AS county, max_by(state, date) FILTER (state IS NOT NULL) AS state
   FROM steps GROUP BY ALL),
 people AS (SELECT {CODE} AS fips, max(total_population) AS population FROM node_geography WHERE {CODE} IS NOT NULL GROUP BY 1)
"""


def population(spark: SparkSession, folder: str) -> DataFrame:
    """The largest population on record of each area."""
    nodes = table(spark, folder, "node_geography").withColumn("fips", area_code(F.col("fips"))).where(F.col("fips").isNotNull())
    return nodes.groupBy("fips").agg(F.max("total_population").alias("population"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """(panel_key, code, unit, week, value): one row per code, area and week, value null unless observed."""
    rows = table(spark, folder, "realized_binary_artifact").withColumn("unit", area_code(F.col("fips")))
    rows = rows.where(F.col("unit").isNotNull() & F.col("week_end_date").isNotNull())
    observed = ~F.col("observed_mask").eqNullSafe(False) & F.col("value").isin(-1, 1)
    value = F.max(F.when(observed, F.col("value"))).alias("value")
    return rows.groupBy("panel_key", "code", "unit", F.col("week_end_date").alias("week")).agg(value)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, week, t, x, z, prev_x, theta, training): cells with both an observed outcome and intervention.

    t numbers the weeks from 0; prev_x is the x of the unit's row before (-1 for the first); theta is a fixed field;
    training marks slots by unit and week.
    """
    wide = cells(spark, folder).groupBy("unit", "week").pivot("panel_key", ["x", "z"]).agg(F.max("value"))
    wide = wide.join(time_index(wide, "week"), "week").where(F.col("x").isNotNull() & F.col("z").isNotNull())
    digits = F.coalesce(F.right("unit", F.lit(2)).try_cast("int"), F.lit(0))
    return wide.select(
        "unit", "week", "t", "x", "z",
        F.expr("coalesce(lag(x) OVER (PARTITION BY unit ORDER BY t), -1)").alias("prev_x"),
        (F.lit(0.1) * ((F.col("t") + digits) % 5 - 2)).alias("theta"),
        ((F.col("t") + digits) % 4 != 0).alias("training"),
    )


def first_treated(rows: DataFrame) -> Column:
    """s, the first time with any unit treated (the number of times if none), as a scalar of another plan."""
    return rows.agg(F.coalesce(F.min(F.when(F.col("z") == 1, F.col("t"))), F.max("t") + 1)).scalar()


FIRST_TREATED = "(SELECT coalesce(min(t) FILTER (z = 1), max(t) + 1) FROM panel)"
CELLS_VIEW = f"""
 cells AS (
   SELECT panel_key, code, {CODE} AS unit, week_end_date AS week, max(CASE WHEN (observed_mask IS NULL OR observed_mask) AND value IN (-1, 1) THEN value END) AS value
   FROM realized_binary_artifact WHERE {CODE} IS NOT NULL AND week_end_date IS NOT NULL GROUP BY 1, 2, 3, 4)
"""
PANEL_VIEW = f"""{CELLS_VIEW},
 wide AS (
   SELECT unit, week, max(CASE WHEN panel_key = 'x' THEN value END) AS x, max(CASE WHEN panel_key = 'z' THEN value END) AS z, dense_rank() OVER (ORDER BY week) - 1 AS t
   FROM cells GROUP BY unit, week),
 panel AS (
   SELECT unit, week, t, x, z, coalesce(lag(x) OVER (PARTITION BY unit ORDER BY t), -1) AS prev_x,
     0.1::DOUBLE * ((t + coalesce(try_cast(right(unit, 2) AS INTEGER), 0)) % 5 - 2) AS theta,
     (t + coalesce(try_cast(right(unit, 2) AS INTEGER), 0)) % 4 <> 0 AS training
   FROM wide WHERE x IS NOT NULL AND z IS NOT NULL)
"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, w): distinct undirected pairs of different areas, src < dst, with the largest weight (1 where none)."""
    rows = table(spark, folder, "us_county_contiguity_adjacency").select(
        area_code(F.col("fips")).alias("a"), area_code(F.col("neighbor_fips")).alias("b"), "weight"
    )
    rows = rows.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("weight").alias("w"))
    return pairs.withColumn("w", F.coalesce("w", F.lit(1.0)))


EDGES_VIEW = f"""
 directed AS (SELECT {CODE} AS a, {area_code_sql("neighbor_fips")} AS b, weight FROM us_county_contiguity_adjacency),
 edges AS (
   SELECT least(a, b) AS src, greatest(a, b) AS dst, coalesce(max(weight), 1.0) AS w FROM directed
   WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2)
"""
