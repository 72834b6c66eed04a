"""Whole jobs: nothing that the inputs hold is left out of the results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.complete import complete
from loomgrid.operators.simulate import gibbs_panels
from loomgrid.plans import models
from loomgrid.plans.ingest import LAST_WEEK, county_daily, joined_panel, weekly_outcomes

D = dt.date
COUNTIES = "row_id long, date date, county string, state string, fips string, cases long, deaths long, new_cases long, loaded_at timestamp_ntz"


def counties(spark, folder, rows):
    """us_counties, node_geography and us_county_centroids of a few areas; ``rows``: fips, date, cases, deaths."""
    when = dt.datetime(2023, 1, 1)
    full = [(i, d, "A", "S", f, c, k, 0, when) for i, (f, d, c, k) in enumerate(rows)]
    spark.createDataFrame(full, COUNTIES).write.parquet(f"{folder}/us_counties.parquet")
    codes = sorted({(r[0],) for r in rows})
    known = spark.createDataFrame(codes, "fips string")
    known.withColumn("total_population", F.lit(1000).cast("long")).write.parquet(f"{folder}/node_geography.parquet")
    known.write.parquet(f"{folder}/us_county_centroids.parquet")
    return str(folder)


def test_joined_panel_keeps_all_weeks(spark, tmp_path):
    days = [D(2020, 6, 10), D(2020, 6, 16), D(2021, 3, 2), D(2022, 6, 1)]
    folder = counties(spark, tmp_path, [("01001", d, 10 * (i + 1), i) for i, d in enumerate(days)])
    rows = joined_panel(spark, folder).orderBy("week_end").collect()
    assert [r.week_end for r in rows if r.observed] == [D(2020, 6, 14), D(2020, 6, 21), D(2021, 3, 7), D(2022, 6, 5)]
    assert sum(r.new_cases for r in rows) == 40 and rows[0].week_end == D(2020, 1, 26)
    assert len({r.week_end for r in rows}) == len(rows) == (rows[-1].week_end - rows[0].week_end).days // 7 + 1
    short = counties(spark, tmp_path / "short", [("01001", days[0], 10, 0)])
    assert joined_panel(spark, short).agg(F.max("week_end")).first()[0] == D.fromisoformat(LAST_WEEK)


def test_a_record_keeps_its_good_figure(spark, tmp_path):
    days = [D(2020, 6, d) for d in (1, 2, 3, 4)]
    folder = counties(spark, tmp_path, list(zip(["01001"] * 4, days, [10, None, 30, -5], [1, 2, -1, 5])))
    rows = {r.date.day: (r.cases, r.deaths, r.new_cases, r.new_deaths) for r in county_daily(spark, folder).collect()}
    assert rows == {1: (10, 1, 10, 1), 2: (None, 2, None, 1), 3: (30, None, 20, None), 4: (None, 5, None, 3)}
    week = weekly_outcomes(spark, folder).first()
    assert (week.new_cases, week.new_deaths, week.cases, week.deaths, week.days) == (30, 5, 30, 5, 4)


def test_completion_gives_every_slot(spark):
    values = {u: [1, -1, 1, 1] for u in "bcdefghij"} | {"a": [1, -1, None, 1], "k": [-1, 1, -1, None], "none": [None] * 4}
    df = spark.createDataFrame([(u, t, v) for u, s in values.items() for t, v in enumerate(s)], "unit string, t int, value int")
    # a's only neighbour has no series, k has no neighbour at all
    donors = spark.createDataFrame([("a", "none", 1)], "unit string, neighbor string, place int")
    got = {(r.unit, r.t): (r.value, r.feasible) for r in complete(df, donors, 4, width=2).collect()}
    assert set(got) == {("a", 2), ("k", 3), *(("none", t) for t in range(4))}
    assert got["a", 2] == (pytest.approx(1.0), True) and got["k", 3][0] == pytest.approx(-1.0)
    assert all(got["none", t] == (None, False) for t in range(4))
    # the unit is seen at no time together with another
    apart = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("b", 0, None), ("b", 1, 1)], "unit string, t int, value int")
    assert {(r.unit, r.t, r.value, r.feasible) for r in complete(apart, donors, 2).collect()} == {("a", 1, None, False), ("b", 0, None, False)}


def test_completed_panel_has_all_unobserved_cells(spark, data):
    rows = models.cells(spark, data).where("panel_key = 'x'")
    units, weeks, seen = rows.select("unit").distinct().count(), models.steps_of(spark, data), rows.where("value is not null").select("unit", "week").distinct().count()
    got = models.completed_panel(spark, data)
    assert got.count() == got.select("unit", "t").distinct().count() == units * weeks - seen


def test_panels_are_drawn_on_the_whole_graph(spark):
    df = spark.createDataFrame([(u, t, 1, 0, 0.0, 1) for u in ("01001", "02001", "03001") for t in range(2)], "unit string, t int, x int, z int, theta double, prev_x int")
    edges = spark.createDataFrame([("01001", "02001", 1.0), ("02001", "99999", 1.0)], "src string, dst string, w double")
    out = gibbs_panels(df, edges, 300, 20, 0.0, 0.0, 0.8, 1).toPandas()
    assert len(out) == 300 * 6 and not out.duplicated(["draw", "unit", "t"]).any()
    wide = out.pivot(index=["draw", "t"], columns="unit", values="x")
    # equal with 1 / (1 + exp(-1.6)) along the edge between states, and by chance without one
    assert (wide["01001"] == wide["02001"]).mean() == pytest.approx(0.832, abs=0.06)
    assert (wide["01001"] == wide["03001"]).mean() == pytest.approx(0.5, abs=0.08)


def test_counterfactual_draws_take_edges_between_states(spark, monkeypatch):
    taken = []
    rows = [("01001", 0, 1, 1, 0.0, 1), ("02001", 0, 1, 1, 0.0, 1)]
    monkeypatch.setattr(models, "panel", lambda *a: spark.createDataFrame(rows, "unit string, t int, x int, z int, theta double, prev_x int"))
    monkeypatch.setattr(models, "gamma", lambda *a: spark.createDataFrame([("01001", "02001", 1.0), ("02001", "01001", 1.0)], "src string, dst string, w double"))
    monkeypatch.setattr(models, "gibbs_panels", lambda panel, edges, *a: (taken.append(edges.count()), gibbs_panels(panel, edges, *a))[1])
    assert models.counterfactual_draws(spark, "").count() == 2 and taken == [1, 1]
