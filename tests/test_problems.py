"""The general problems against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code
from loomgrid.operators.impute import fill_category, fill_numeric
from loomgrid.operators.nearby import great_circle, in_polygon, near_in_plane, near_on_sphere, points_in_regions
from loomgrid.operators.orphans import coded, orphan_references, orphan_report
from loomgrid.operators.rolling import banded, rolling_totals, window_totals

DAY = dt.date(2020, 1, 1)


def test_area_code(spark):
    raw = ["1001.0", "01001", "123456", " 1001 ", "\t24077.0", "", "  ", None, " 7\n", ".0", "1.0.0"]
    rows = spark.createDataFrame([(r,) for r in raw], "c string").select(area_code(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["01001", "01001", "123456", "01001", "24077", None, None, None, "00007", "00000", "001.0"]


def test_banded_windows():
    band = banded(4, 3, 2)
    assert band.shape == (7, 4)
    assert (np.ones(7) @ band == 2).all()
    dense = np.array([[2**61, 2**61, 5, 0, 0, 0, 1]])
    assert window_totals(dense, banded(4, 3, 3), 3)[0].tolist() == [2**61 + 5, 5, 0, 1]
    assert window_totals(np.array([[2**62, 2**62, 2**62, 0]]), banded(2, 2, 3), 3)[0, 0] == 2**63 - 1


@pytest.mark.parametrize("tile_days", [8, 40, 128])
def test_rolling_totals(spark, tile_days):
    rng = random.Random(3)
    rows = []
    for e in ("a", "b", "ä", None):
        for d in range(0, 200):
            if rng.random() < 0.3:
                rows.append((e, DAY + dt.timedelta(d), rng.choice([None, 0, 3, 10**6])))
    rows += [("far", DAY, 4), ("far", DAY + dt.timedelta(700), 5), ("a", None, 9), ("one", DAY, 7)]
    df = spark.createDataFrame(rows, "e string, date date, v long").withColumns({"tile": F.lit(1), "d": F.lit("x")})
    got = {(r.e, r.day): (r.day_index, r.total_7, r.total_30, r.average_7) for r in rolling_totals(df, "e", "date", "v", (7, 30), tile_days).collect()}
    want = {}
    for e in {r[0] for r in rows if r[0] is not None}:
        own = {}
        for x, d, v in rows:
            if x == e and d is not None:
                own[d] = own.get(d, 0) + (v or 0)
        for k in range((max(own) - min(own)).days + 1):
            d = min(own) + dt.timedelta(k)
            total = lambda w: sum(own.get(d - dt.timedelta(i), 0) for i in range(w))  # noqa: E731, B023
            want[e, d] = (k, total(7), total(30), total(7) / 7)
    assert got == want


def test_rolling_totals_of_repeated_days(spark):
    rows = [("a", DAY, 2**62)] * 3 + [("a", DAY + dt.timedelta(1), None)] * 2 + [("b", DAY, -(2**62))] * 3 + [("c", DAY, 1)] * 500
    df = spark.createDataFrame(rows, "e string, day date, v long")
    out = {(r.e, r.day_index): r.total_7 for r in rolling_totals(df, "e", "day", "v").collect()}
    assert out == {("a", 0): 2**63 - 1, ("a", 1): 2**63 - 1, ("b", 0): -(2**63), ("c", 0): 500}


def test_rolling_totals_empty(spark):
    df = spark.createDataFrame([], "e string, date date, v long")
    assert rolling_totals(df, "e", "date", "v").collect() == []


@pytest.mark.parametrize("crowded", [3, 4096])
def test_near_in_plane(spark, crowded):
    rng = random.Random(5)
    points = [(f"k{i:03d}", rng.gauss(0, 1500), rng.gauss(0, 900)) for i in range(200)]
    points += [("t1", 0.0, 0.0), ("t2", 360.0, 480.0), ("t3", -600.0, 0.0), ("t1", 0.0, 0.0), ("n1", None, 0.0), ("n2", math.nan, 1.0), ("n3", math.inf, 1.0), (None, 0.0, 0.0), ("big", 1e14, -1e14)]
    df = spark.createDataFrame(points, "key string, x double, y double").withColumns({"cx": F.lit(1), "id": F.lit(2), "salt": F.lit(3)})
    got = [(r.key, r.neighbor) for r in near_in_plane(df, "key", "x", "y", 600.0, crowded).collect()]
    once = {k: (x, y) for k, x, y in points if k and x is not None and y is not None and math.isfinite(x) and math.isfinite(y)}
    want = {(a, b) for a in once for b in once if a < b and (once[a][0] - once[b][0]) ** 2 + (once[a][1] - once[b][1]) ** 2 <= 360000}
    assert len(got) == len(set(got)) and set(got) == want
    assert ("t1", "t2") in want and ("t1", "t3") in want


def test_near_on_sphere(spark):
    rng = random.Random(9)
    points = [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), -89.9])) for i in range(150)]
    points += [(1000, 179.999, 10.0), (1001, -179.999, 10.0), (1002, 0.0, 90.0), (1003, 120.0, 90.0), (1004, 5.0, 95.0), (1005, None, 1.0)]
    df = spark.createDataFrame(points, "key int, lon double, lat double")
    radius = 150_000.0
    got = {(r.key, r.neighbor) for r in near_on_sphere(df, "key", "lon", "lat", radius).collect()}
    a = df.where("abs(lat) <= 90 and lon is not null")
    b = a.select(F.col("key").alias("k2"), F.col("lon").alias("lo2"), F.col("lat").alias("la2"))
    met = a.join(b, F.col("key") < F.col("k2")).where(great_circle(F.col("lon"), F.col("lat"), F.col("lo2"), F.col("la2")) <= radius)
    assert got == {(r.key, r.k2) for r in met.collect()} and (1000, 1001) in got and (1002, 1003) in got


def test_points_in_regions(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    notch = [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (25.0, 2.0), (20.0, 10.0)]
    regions = spark.createDataFrame([("square", square), ("notch", notch), ("line", [(0.0, 0.0), (5.0, 5.0)])], "name string, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([("in", 5.0, 5.0), ("out", 15.0, 5.0), ("gap", 25.0, 8.0), ("arm", 21.0, 5.0), ("none", None, 1.0)], "key string, x double, y double")
    for size in (1.0, 7.0, 100.0):
        got = {(r.key, r.name) for r in points_in_regions(points, "key", "x", "y", regions, "name", "ring", size).collect()}
        assert got == {("in", "square"), ("arm", "notch")}
    empty = spark.createDataFrame([(1.0, 1.0, [])], "x double, y double, ring array<struct<x double, y double>>")
    assert not empty.select(in_polygon(F.col("x"), F.col("y"), F.col("ring")).alias("i")).first().i


T = dt.datetime(2020, 1, 1)


def at(h):
    return None if h is None else T + dt.timedelta(hours=h)


@pytest.mark.parametrize("hot_share", [2, 512])
def test_orphans(spark, hot_share):
    rng = random.Random(1)
    keys = ["a", "b", "c", "hot", "é", "zz"]
    parents = [(k, at(b), at(e)) for k in keys[:5] for b, e in [(rng.choice([None, *range(20)]), rng.choice([None, *range(5, 60)])) for _ in range(rng.randint(1, 4))]]
    parents += parents[:2] + [(None, at(1), None)]
    refs = [("t", i, "f", rng.choice([*keys, "hot", "hot", "hot", "nowhere", None]), at(rng.randint(0, 70))) for i in range(800)]
    refs += refs[:3] + [("t", 9001, "f", "a", None)]
    left = spark.createDataFrame(refs, "table_name string, row_id long, ref_field string, key string, at timestamp_ntz").withColumn("salt", F.lit("x"))
    right = spark.createDataFrame(parents, "key string, created_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("kind", F.lit(1))
    got = sorted((r.row_id, r.kind) for r in orphan_references(left, right, hot_share).collect())
    want = []
    for _, i, _, k, t in refs:
        if k is None:
            continue
        lives = [(b, e) for p, b, e in parents if p == k]
        begun = [(b, e) for b, e in lives if b is None or (t is not None and b <= t)]
        if not any(e is None or t is None or t < e for b, e in begun):
            want.append((i, "missing" if not lives else "late" if not begun else "deleted"))
    assert got == sorted(want)
    report = orphan_report(orphan_references(left, right, hot_share)).collect()
    assert sum(r.misses for r in report) == len(want)


def test_keys_as_bytes():
    keys = ["a", "a\0", "a\0\0", "", "é", "x" * 48, "x" * 49, "x" * 100_000, "x" * 99_999 + "y", "a"]
    bytes_ = coded(pa.array(keys))
    assert [[i == j for j in bytes_] for i in bytes_] == [[i == j for j in keys] for i in keys]
    assert len(coded(pa.array([], pa.string()))) == 0 and coded(pa.array(keys)[2:4]).tolist() == bytes_[2:4].tolist()


def test_long_keys(spark):
    names = ["k" * 200 + str(i) for i in range(5)] + ["", "k"]
    left = spark.createDataFrame([("t", i, "f", k, T) for i, k in enumerate(names)], "table_name string, row_id long, ref_field string, key string, at timestamp_ntz")
    right = spark.createDataFrame([(k, None, at(-1) if i == 1 else None) for i, k in enumerate(names[:3])] + [("", at(1), None)], "key string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    assert {r.row_id: r.kind for r in orphan_references(left, right).collect()} == {1: "deleted", 3: "missing", 4: "missing", 5: "late", 6: "missing"}


def test_orphans_empty(spark):
    left = spark.createDataFrame([("t", 1, "f", "a", T)], "table_name string, row_id long, ref_field string, key string, at timestamp_ntz")
    right = spark.createDataFrame([], "key string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    assert [r.kind for r in orphan_references(left, right).collect()] == ["missing"]
    assert orphan_references(left.limit(0), right).collect() == []


def test_fill_numeric_marks_and_accuracy(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for g in range(12):
        level = rng.uniform(2, 9)
        for d in range(60):
            v = int(np.exp(level + 0.03 * d + rng.normal(0, 0.02)))
            hide = rng.random() < 0.15 or (g == 3 and 20 <= d < 45)
            truth[g, d] = v
            rows.append((g, DAY + dt.timedelta(d), None if hide else v, 1))
    df = spark.createDataFrame(rows, "g int, day date, v long, _d int")
    out = {(r.g, (r.day - DAY).days): r for r in fill_numeric(df.drop("_d"), ["g"], "day", ["v"], 7).collect()}
    known = {(g, (d - DAY).days): v for g, d, v, _ in rows}
    errors, naive = [], []
    overall = np.log1p([v for v in known.values() if v is not None]).mean()
    for (g, d), v in known.items():
        near = any(known.get((g, d + k)) is not None for k in range(-7, 8) if k)
        assert out[g, d].v_filled == (v is None and near)
        assert (out[g, d].v == v) if v is not None else ((out[g, d].v is not None) == near)
        if v is None and near:
            errors.append(abs(np.log1p(out[g, d].v) - np.log1p(truth[g, d])))
            naive.append(abs(overall - np.log1p(truth[g, d])))
    assert np.mean(errors) < 0.15 < 0.5 < np.mean(naive)


def test_fill_category(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for g in range(20):
        v = 1
        for w in range(30):
            v = -v if rng.random() < 0.08 else v
            truth[g, w] = v
            rows.append((g, DAY + dt.timedelta(7 * w), rng.choice([v, v, v, None, 0])))
    df = spark.createDataFrame(rows, "g int, day date, v int")
    out = {(r.g, (r.day - DAY).days // 7): r for r in fill_category(df, ["g"], "day", "v", [-1, 1], 14).collect()}
    seen = {(g, (d - DAY).days // 7): v for g, d, v in rows if v in (-1, 1)}
    right = []
    for key in truth:
        near = any((key[0], key[1] + k) in seen for k in (-2, -1, 1, 2))
        assert out[key].v_filled == (key not in seen and near)
        if out[key].v_filled:
            right.append(out[key].v == truth[key])
    assert np.mean(right) > 0.8
    assert fill_category(df.limit(0), ["g"], "day", "v", [-1, 1], 14).collect() == []
    assert fill_numeric(df.limit(0), ["g"], "day", ["v"], 7).collect() == []
