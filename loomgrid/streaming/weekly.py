"""An extension: the weekly county sums over a stream of publications (the batch panel is made by ``operators.panel``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.counties import rows_of_areas


def weekly_stream(publications: DataFrame, late: str = "21 days") -> DataFrame:
    """(fips, week_start, week_end, new_cases, rows) of Monday weeks by day reported on, once no row of a week can come any more
    than ``late`` behind the newest. Null or negative figures count as 0; rows of no area or day are left out.

    Windows are aligned to the epoch, a Thursday, hence the offset of four days.
    """
    rows = rows_of_areas(publications).where(F.col("date").isNotNull()).withColumn("at", F.col("date").cast("timestamp"))
    week = F.window("at", "7 days", "7 days", "4 days")
    sums = rows.withWatermark("at", late).groupBy("code", week).agg(F.sum(F.greatest(F.col("new_cases"), F.lit(0))).alias("new_cases"), F.count(F.lit(1)).alias("rows"))
    return sums.select(F.col("code").alias("fips"), F.to_date("window.start").alias("week_start"), F.date_sub(F.to_date("window.end"), 1).alias("week_end"), "new_cases", "rows")
