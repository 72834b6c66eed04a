"""Reading the given tables, and CSV input with a stated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_scan(scanned: DataFrame) -> DataFrame:
    """A scan of at most half as many splits as the session has cores, its rows dealt evenly to all of them: small files of one row group
    can't be split further, so that work that is heavy per row would keep few cores busy. A larger scan stays as it is, without a shuffle."""
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if 2 * scanned.rdd.getNumPartitions() <= cores else scanned


def read_text_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV (also gzipped) with a header, every column read as text, blanks as nulls, then
    cast by ``schema``; text that can't be cast becomes null."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    wanted = [part.strip().split(" ", 1) for part in schema.split(",")]
    blank = lambda c: F.when(F.trim(c) != "", c)
    return raw.select(
        *[
            (blank(F.col(name)).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)).alias(name)
            for name, kind in wanted
        ]
    )


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, laid out by the columns ``by`` (one folder per experiment, for pruning)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
