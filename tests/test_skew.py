"""A third of all rows on one cell, node, prefix, experiment or score: right results, and no join that gathers the hot key."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import skew
from loomgrid.operators.graph import both_ways, components, nearest, neighbour_sum
from loomgrid.operators.nearby import near_in_plane
from loomgrid.operators.panel import dense_index
from loomgrid.operators.reports import exact_quantiles, ranks


@pytest.fixture(autouse=True)
def small(monkeypatch, spark):
    """Keys are hot from a few rows on."""
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5,))
    monkeypatch.setattr(skew.spread, "__defaults__", (5,))
    monkeypatch.setattr(skew.join_both, "__defaults__", (5, ("id", "id")))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def bare(df, key):
    """Exchanges on the key alone that rows go through without having been combined first."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    on_key = re.compile(r"Exchange hashpartitioning\((?:coalesce\()?" + r"\W*\d*L?, ".join(key) + r"#\d+L?, \d+\)")
    below = (lines[i + 1] for i, line in enumerate(lines) if on_key.search(line) and "Reused" not in line and i + 1 < len(lines))
    return [b for b in below if "Aggregate" not in b]


def test_hot_keys_are_few_and_spread(spark):
    df = spark.range(300).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    left, right, key = skew.spread(df, spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"], "id")
    joined = left.join(right, key)
    assert {(r.k, r._parts) for r in skew.hot_keys(df, ["k"], "_parts").collect()} == {(0, 20)}
    assert left.where("k = 0").select("_salt").distinct().count() > 10 and bare(joined, ["k"]) == []
    assert sorted((r.k, r.id, r.v) for r in joined.collect()) == sorted((r.k, r.id, r.k * 2) for r in df.collect())
    both = skew.join_both(df, df.withColumnRenamed("id", "other").withColumn("id", F.col("other")), ["k"])
    assert both.count() == 100 * 100 + 200 and bare(both, ["k"]) == []
    assert both.where("k = 0").select("id", "probe_id").distinct().count() == 10_000


def test_more_hot_keys_than_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 3)
    df = spark.range(200).select((F.col("id") % 10).alias("k"), "id").repartition(7)
    left, right, key = skew.spread(df, spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"], "id")
    assert {r.k for r in skew.hot_keys(df, ["k"], "_parts").collect()} == {0, 1, 2}
    assert sorted((r.k, r.id, r.v) for r in left.join(right, key).collect()) == [(k, i, 2 * k) for k in range(10) for i in range(k, 200, 10)]


def test_near_points_of_one_cell(spark):
    rng = random.Random(1)
    points = [(f"c{i:03d}", rng.uniform(0, 90), rng.uniform(0, 90)) for i in range(60)] + [(f"f{i:03d}", rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(120)]
    df = near_in_plane(spark.createDataFrame(points, "key string, x double, y double"), "key", "x", "y", 100.0, 5)
    got = [(r.key, r.neighbor) for r in df.collect()]
    want = {(a, b) for a, x, y in points for b, v, w in points if a < b and (x - v) ** 2 + (y - w) ** 2 <= 1e4}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000 and bare(df, ["cx", "cy"]) == []


def test_nearest_in_crowded_places(spark):
    rng = random.Random(2)
    points = [(f"s{i:03d}", 5.0, 5.0) for i in range(60)] + [(f"c{i:03d}", rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(60)]
    points += [(f"f{i:03d}", rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)) for i in range(60)]
    got = {(r.key, r.place): r.neighbor for r in nearest(spark.createDataFrame(points, "key string, x double, y double"), "key", "x", "y", 3, 5).collect()}
    want = {}
    for a, x, y in points:
        others = sorted(((x - v) ** 2 + (y - w) ** 2) ** 0.5 * 1e9 // 1 / 1e9 for b, v, w in points if b != a)[:3]
        near = sorted((((x - v) ** 2 + (y - w) ** 2) ** 0.5, b) for b, v, w in points if b != a)[:3]
        assert len(others) == 3
        want |= {(a, i + 1): b for i, (_, b) in enumerate(near)}
    assert got == want


def test_hub_of_a_graph(spark):
    edges = [("hub", f"n{i:03d}") for i in range(60)] + [(f"n{i:03d}", f"m{i:03d}") for i in range(60)] + [("x", "y"), ("y", "z")]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, w double")
    assert {(r.component, r.n) for r in components(links).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()} == {("hub", 121), ("x", 3)}
    units = sorted({u for e in edges for u in e})
    panel = spark.createDataFrame([(u, t, i + t) for i, u in enumerate(units) for t in range(2)], "unit string, t int, v int")
    out = neighbour_sum(both_ways(links), panel, "unit", "t", "v", "s")
    value = {(u, t): i + t for i, u in enumerate(units) for t in range(2)}
    want = {(u, t): sum(value[b if a == u else a, t] for a, b in edges if u in (a, b)) for u in units for t in range(2)}
    assert {(r.unit, r.t): r.s for r in out.collect()} == want and bare(out, ["dst"]) == []


def test_one_prefix_and_one_score(spark):
    keys = [f"01001{i:06d}" for i in range(150)] + [f"{i:05d}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in random.Random(3).sample(keys, len(keys))], "k string")
    assert {r.k: r.number for r in dense_index(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    rows = [(g, s, i) for i, (g, s) in enumerate([("hot", None)] * 40 + [("hot", 1.0)] * 40 + [("a", 2.0), (None, 1.0), (None, None)])]
    got = {r.i: r.place for r in ranks(spark.createDataFrame(rows, "g string, s double, i int"), "g", "s", [F.asc("i")], "place").collect()}
    order = sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0.0, r[2]))
    assert got == {r[2]: [x for x in order if x[0] == r[0]].index(r) + 1 for r in rows}


def test_quantiles_of_one_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("b").alias("g"), (F.col("id") % 500).cast("double").alias("v"))
    out = exact_quantiles(df, ["g"], "v", {"q500": 0.5})
    assert {r.g: r.q500 for r in out.collect()} == {"hot": pytest.approx(224.5, abs=0.6), "b": pytest.approx(449.5)}
    assert bare(out, ["g"]) == []
