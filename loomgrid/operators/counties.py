"""The county table as the queries use it: rows with an area, one record per area and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code
from loomgrid.functions.latest import latest_row


def rows_of_areas(us_counties: DataFrame) -> DataFrame:
    """Rows of no area (county ``Unknown``, or no code) are left out; adds ``code``."""
    named = us_counties.where(~F.col("county").eqNullSafe("Unknown"))
    return named.withColumn("code", area_code(F.col("fips"))).where(F.col("code").isNotNull())


def daily_records(us_counties: DataFrame, values: list[str]) -> DataFrame:
    """Of each code and date the row loaded last (of equal ones the largest row_id)."""
    rows = rows_of_areas(us_counties).where(F.col("date").isNotNull())
    return latest_row(rows, ["code", "date"], ["loaded_at", "row_id"], values)


DAILY_SQL = """
 rows_of_areas AS (
   SELECT *, {code} AS code FROM us_counties WHERE county IS DISTINCT FROM 'Unknown' AND {code} IS NOT NULL AND date IS NOT NULL),
 daily AS (
   SELECT * FROM rows_of_areas
   QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)
"""
