import datetime as dt

from pyspark.sql import functions as F

from loomgrid.streaming.weekly import weekly_stream


def test_weeks_of_a_stream_equal_the_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/us_counties.parquet")
    rows.orderBy("loaded_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = weekly_stream(stream).writeStream.format("memory").queryName("weeks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.fips, r.week_end): r.new_cases for r in spark.table("weeks").collect()}
    want = {(r.fips, r.week_end): r.new_cases for r in weekly_stream(rows).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert all(k[1].isoweekday() == 7 for k in want)
    last = max(k[1] for k in want)
    assert {k for k in want if k[1] < last - dt.timedelta(28)} <= set(got)
    assert rows.where(F.col("date").isNull()).count() == 0
