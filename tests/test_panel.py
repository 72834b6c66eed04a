"""Hand-worked cases of the panel, graph, fold, score and report operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions.latest import last_non_null, latest_row
from loomgrid.functions.scalars import chance, experiment_name, experiment_part, finite, iso_week, iso_year, plus_minus, slot_loss, slug, week_end, week_start_of
from loomgrid.operators.graph import asymmetry, both_ways, components, kernel_weight, median_distance, nearest, neighbour_sum, normalised, random_graph, symmetric_by_max, symmetric_by_mean
from loomgrid.operators.metrics import baselines, masked_scores, predictors_in_rows, twelve_buckets, with_new_baselines
from loomgrid.operators.panel import before_first_report, deltas, dense_index, dense_suffix, fill_from, increments, lagged, skeleton, start_and_end, with_change
from loomgrid.operators.reports import QUANTILES, calibration, exact_quantiles, finite_summary, fold_means, one_se_choice, ranks, vector_errors
from loomgrid.operators.splits import blanket_violations, inner_roles, pattern_members, roles, schedule, time_blocks
from loomgrid.sources.tables import read_text_table

D = dt.date


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_weeks_and_names(spark):
    df = spark.createDataFrame([(D(2021, 1, 3),)], "d date")
    r = df.select(iso_year(F.col("d")).alias("y"), iso_week(F.col("d")).alias("w"), week_end(F.col("d")).alias("e")).first()
    assert (r.y, r.w, r.e) == (2020, 53, D(2021, 1, 3))
    assert df.select(week_start_of(F.lit(2020), F.lit(53))).first()[0] == D(2020, 12, 28)
    names = spark.createDataFrame([(" Complete Cov >= 30% ",), ("***",), (None,)], "s string")
    assert [r[0] for r in names.select(slug(F.col("s"))).collect()] == ["complete_cov_30", "item", "item"]
    name = experiment_name(F.lit("a_b"), F.lit("c"), F.lit("2w"), F.lit("knn"))
    r = df.select(name.alias("n"), experiment_part(name, 0, "outcome_").alias("o"), experiment_part(name, 3, "lag_").alias("x")).first()
    assert r.n == "outcome_a_b__intervention_c__lag_2w__knn" and r.o == "a_b" and r.x is None


def test_thresholds_increments_lags(spark):
    df = spark.createDataFrame([(1, None), (2, 9.9), (3, 10.0)], "i int, v double")
    assert column(df.withColumn("s", plus_minus(F.col("v"), 10)), "s", "i") == [None, -1, 1]
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 9)], "u string, t int, c int")
    assert column(increments(df, "u", "t", {"c": "n"}), "n", "t") == [5, 0, 6]
    assert column(deltas(df, "u", "t", ["c"]), "c_delta", "t") == [None, -2, 6]
    z = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, 1)], "u string, t int, z int")
    assert column(z.withColumn("l", lagged("u", "t", "z", 1)), "l", "t") == [-1, None, 1]
    z = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("a", 3, None), ("a", 4, 1)], "u string, t int, z int")
    assert column(z.withColumn("l", lagged("u", "t", "z", 2)), "l", "t") == [-1, -1, -1, 1]
    w = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 12.0), ("a", 4, None), ("b", 1, None)], "u string, t int, s double")
    w = w.withColumn("z", plus_minus(F.col("s"), 10))
    assert column(w.withColumn("f", before_first_report(w, "u", "t", "s", "z")), "f", "u", "t") == [-1, -1, 1, None, None]
    c = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("a", 3, None), ("a", 4, 1)], "u string, t int, v int")
    assert [v for v in column(with_change(c, ["u"], "t", "v"), "changed", "t") if v is not None] == [1.0]


def test_last_row_and_last_value(spark):
    rows = spark.createDataFrame([("w", D(2020, 1, 6), 10.0), ("w", D(2020, 1, 12), None)], "k string, d date, v double")
    assert rows.groupBy("k").agg(last_non_null("v", "d").alias("v")).first().v == 10.0
    assert latest_row(rows, ["k"], ["d"], ["v"]).first().v is None


def test_fill_from_and_skeleton(spark):
    a = spark.createDataFrame([(1, None, None), (2, 5, None)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 7, 8), (2, 7, 9), (3, 1, None)], "k int, x int, y int")
    got = [tuple(r) for r in fill_from(a, b, ["k"], ["x", "y"], ("first", "second")).orderBy("k").collect()]
    assert got == [(1, 7, 8, "second"), (2, 5, 9, "first"), (3, 1, None, "second")]
    grid = skeleton(spark.createDataFrame([("u",)], "u string"), "2020-01-26", "2020-02-09")
    assert column(grid, "week_end", "week_end") == [D(2020, 1, 26), D(2020, 2, 2), D(2020, 2, 9)]


def test_dense_index_and_suffix(spark):
    keys = ["01001", "01001000001", "02001", "10001", "10001"]
    got = {r.k: r.number for r in dense_index(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {"01001": 0, "01001000001": 1, "02001": 2, "10001": 3}
    cells = [(u, t, None if (u, t) in (("u2", 0), ("u3", 2)) else 1) for u in ("u1", "u2", "u3") for t in range(3)]
    rows = dense_suffix(spark.createDataFrame(cells, "unit string, t int, v int"), "unit", "t", "v").collect()
    assert {(r.unit, r.start, r.area) for r in rows} == {("u1", 1, 4), ("u2", 1, 4)}


def test_start_and_end(spark):
    z = spark.createDataFrame([(u, t, 1 if t >= first else -1) for u, first in (("u1", 1), ("u2", 2)) for t in range(4)], "u string, t int, z int")
    r = start_and_end(z, "u", "t", "z", F.lit(4)).first()
    assert (r.s, r.e) == (1, 3)
    r = start_and_end(z.withColumn("z", F.lit(-1)), "u", "t", "z", F.lit(4)).first()
    assert (r.s, r.e) == (4, 0)


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, w double")


def test_graph(spark):
    g = normalised(symmetric_by_max(edges_of(spark, [("1", "2", 2.0), ("2", "3", 1.0), ("1", "1", 9.0)])))
    weights = {(r.src, r.dst): r.w for r in g.collect()}
    assert weights[("1", "2")] == weights[("2", "1")] == pytest.approx(2 / 3) and len(weights) == 4
    panel = spark.createDataFrame([("1", 0, 1), ("2", 0, -1), ("3", 0, 1), ("4", 0, 1)], "unit string, t int, x int")
    assert column(neighbour_sum(g, panel, "unit", "t", "x", "n"), "n", "unit") == pytest.approx([-2 / 3, 1, -1 / 3, 0])
    lop = edges_of(spark, [("1", "2", 1.0), ("2", "1", 0.5), ("3", "1", 4.0), ("3", "3", 1.0)])
    mean = {(r.src, r.dst): r.w for r in symmetric_by_mean(lop).collect()}
    assert mean[("1", "2")] == 0.75 and mean[("1", "3")] == 2.0
    r = asymmetry(lop).first()
    assert (r.loops, r.greatest_gap, r.differing_pairs) == (1, 4.0, 2)


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(40)] + [("a", "b", 1.0), ("c", "b", 1.0), ("z", "z2", 1.0)]
    got = {r.node: r.component for r in components(edges_of(spark, chain)).collect()}
    assert set(got[f"{i:03d}"] for i in range(41)) == {"000"} and got["c"] == "a" and got["z2"] == "z"


def test_nearest(spark):
    line = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 10.0, 0.0)], "k string, x double, y double")
    pairs = {(min(r.k, r.neighbor), max(r.k, r.neighbor)) for r in nearest(line, "k", "x", "y", 1).collect()}
    assert pairs == {("a", "b"), ("b", "c")}
    assert median_distance(line, "k", "x", "y") == pytest.approx(9, abs=0.1)
    assert line.select(kernel_weight(F.lit(9.0), 9.0)).first()[0] == pytest.approx(math.exp(-1))
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(500, 0.01, (80, 2)), [[1e4, 0.0], [1e4, 0.0]]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "k int, x double, y double")
    got = {}
    for r in nearest(points, "k", "x", "y", 3).collect():
        got.setdefault(r.k, {})[r.place] = r.neighbor
    far = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    for i in range(len(xy)):
        want = [j for j in np.lexsort((np.arange(len(xy)), far[i])) if j != i][:3]
        assert [got[i][p] for p in (1, 2, 3)] == want
    assert nearest(points.limit(1), "k", "x", "y", 3).collect() == []


def test_random_graph(spark):
    nodes = spark.range(60).select(F.col("id").cast("int").alias("number"))
    a, b = ({(r.i, r.j) for r in random_graph(nodes, "number", 60, p, 1).collect()} for p in (0.2, 0.2))
    assert a == b and all(i < j < 60 for i, j in a) and 250 < len(a) < 460
    assert len(random_graph(nodes, "number", 60, 1.0, 1).collect()) == 60 * 59 // 2


def test_time_blocks():
    blocks = time_blocks(10, 3)
    assert [sum(b == k for _, b, _, _ in blocks) for k in (1, 2, 3)] == [4, 3, 3]
    assert [t for t, _, _, jump in blocks if jump] == [4, 7]
    with pytest.raises(ValueError):
        time_blocks(4, 3)
    plan = {(f, b): p for f, _, p, _, _, b in schedule(10, 3)}
    assert [[plan[f, b] for b in (1, 2, 3)] for f in (1, 2, 3)] == [[1, 2, 3], [3, 1, 2], [2, 3, 1]]


def test_roles_keep_the_blanket(spark):
    rng = np.random.default_rng(0)
    names = [f"u{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted((names[a], names[b]))) for a, b in rng.integers(0, 30, (60, 2)) if a != b})
    edges = edges_of(spark, [(a, b, 1.0) for a, b in pairs])
    members = spark.createDataFrame([(n, i % 4 + 1) for i, n in enumerate(names)], "unit string, part int")
    slots = roles(members, both_ways(edges), 12, 4)
    bad = blanket_violations(slots, edges).collect()
    assert len(bad) == 4 and all((r.spatial, r.temporal) == (0, 0) for r in bad)
    assert slots.where("role = 'validation'").count() > 0
    outer = slots.where("fold = 1").drop("fold")
    inside = inner_roles(outer, spark.createDataFrame([(n, i % 2 + 1) for i, n in enumerate(names)], "unit string, part int"), both_ways(edges), 12, 2)
    assert all((r.spatial, r.temporal) == (0, 0) for r in blanket_violations(inside, edges).collect())
    every = slots.withColumnRenamed("fold", "outer_fold")
    parts = pattern_members(every, 2)
    assert parts.where("part > 0").count() == every.where("role <> 'validation'").count()
    layers = inner_roles(every, parts, both_ways(edges), 12, 2)
    bad = blanket_violations(layers, edges).collect()
    assert len(bad) == 8 and all((r.spatial, r.temporal) == (0, 0) for r in bad)
    assert layers.where("role = 'validation'").select("outer_fold").distinct().count() == 4


def test_planted_violations_are_counted(spark):
    rows = [(1, 0, "a", "validation"), (1, 0, "b", "training"), (1, 0, "c", "outer_test"), (1, 1, "a", "training"), (1, 1, "b", "separator"), (1, 1, "c", "training"), (2, 0, "a", "training")]
    slots = spark.createDataFrame(rows, "fold int, t int, unit string, role string")
    edges = edges_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)])
    assert {(r.fold, r.spatial, r.temporal) for r in blanket_violations(slots, edges).collect()} == {(1, 2, 1), (2, 0, 0)}


def test_scores(spark):
    rows = [(1, 1 / 6 * -1, 1), (2, 1 / 2, -1), (3, 1 / 6, 1)]
    slots = spark.createDataFrame(rows, "i int, h double, x int")
    losses = [r[0] for r in slots.orderBy("i").select(slot_loss(F.col("h"), F.col("x"))).collect()]
    assert losses == pytest.approx([0.8736, 1.3133, 0.5403], abs=1e-4)
    s = {r.mask: r for r in masked_scores(slots, {"all": F.lit(True), "none": F.lit(False)}).collect()}
    assert s["all"].loss == pytest.approx(0.9091, abs=1e-4) and s["all"].brier == pytest.approx(0.3494, abs=1e-4)
    assert s["none"].slots == 0 and s["none"].loss is None
    p = [0.05, 0.95, 1.0 - 1e-12]
    fields = spark.createDataFrame([(math.atanh(2 * q - 1), y) for q, y in zip(p, (-1, 1, 1))], "h double, x int")
    assert masked_scores(fields, {"all": F.lit(True)}).first().ece == pytest.approx(1 / 30)
    assert spark.range(1).select(chance(F.lit(0.0))).first()[0] == 0.5
    assert len(twelve_buckets(*[F.lit(True)] * 4)) == 12


def test_persistence(spark):
    rows = [("u", 0, 1, True), ("u", 1, -1, False), ("u", 2, 1, True)]
    df = spark.createDataFrame(rows, "unit string, t int, x int, training boolean")
    assert column(baselines(df), "persistence", "t") == [-1.0, 1.0, 1.0]


def test_quantiles_and_calibration(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 5, 9)] + [(2, 4.0), (2, None)], "g int, v double")
    r = finite_summary(df, ["g"], "v").orderBy("g").collect()
    assert (r[0].n, r[0].mean) == (4, 4.25) and r[0].std == pytest.approx(3.1125, abs=1e-4)
    assert [r[0][q] for q in QUANTILES] == pytest.approx([1.075, 3.5, 8.7])
    assert (r[1].n, r[1].q500) == (1, 4.0)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 15_000), np.full(9_000, 0.25)])
    many = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    got = exact_quantiles(many, ["g"], "v", {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}).first()
    assert [got[c] for c in "abcde"] == pytest.approx(np.quantile(values, [0, 0.025, 0.5, 0.975, 1]).tolist(), abs=0)
    samples = spark.createDataFrame([(k, 1.0) for k in (1, 1, 2, 2)], "k int, v double")
    seen = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "k int, o double")
    z = {r.k: r.z for r in calibration(samples, seen, ["k"], "v", "o").collect()}
    assert z == {1: 0.0, 2: math.inf}
    nan = spark.createDataFrame([(math.nan,), (math.inf,), (2.0,), (None,)], "v double").select(finite(F.col("v")))
    assert [r[0] for r in nan.collect()] == [None, None, 2.0, None]


def test_vector_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 2.0), (3, 1.0, 3.0), (3, None, 3.0)], "g int, a double, b double")
    r = {x.g: x for x in vector_errors(df, ["g"], "a", "b").collect()}
    assert r[1].correlation == pytest.approx(1) and r[2].correlation == 1 and r[3].correlation == 0 and r[3].n == 2


def test_fold_means(spark):
    df = spark.createDataFrame([("a", 0.1, 3), ("a", 0.3, 1), ("b", 0.1, 1), ("c", 0.1, 1), ("c", None, 1)], "k string, v double, n int")
    two = {r.k: r for r in fold_means(df, ["k"], ["v"], "n", 2).collect()}
    assert (two["a"].v_weighted, two["a"].v_mean, two["a"].v_se) == pytest.approx((0.15, 0.2, 0.1))
    assert two["b"].status == "failed" and two["b"].v_mean is None and two["c"].v_mean is None
    assert {r.k: r.v_se for r in fold_means(df, ["k"], ["v"], "n", 1).collect()}["b"] == 0.0


def test_one_se_choice(spark):
    rows = [("g", 0.1, 0.10, 0.02, 0.20, 0.02), ("g", 0.2, 0.11, 0.02, 0.19, 0.02), ("g", 0.3, 0.30, 0.02, 0.10, 0.02)]
    df = spark.createDataFrame(rows, "g string, lam double, m_mean double, m_se double, b_mean double, b_se double")
    assert one_se_choice(df, "g", "m", "b", [F.col("lam")]).first().lam == 0.1


def test_choice_falls_back(spark):
    rows = [("g", 1.0, 0.10, 0.0, 0.2, 0.0, 9.0, 0.0), ("g", 2.0, 0.05, 0.0, 0.2, 0.0, None, None), ("h", 1.0, 0.10, 0.0, 0.2, 0.0, 9.0, 0.0), ("h", 2.0, 0.05, 0.0, 0.2, 0.0, 9.5, 0.0), ("h", 3.0, None, None, 0.1, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, lam double, m_mean double, m_se double, b_mean double, b_se double, p_mean double, p_se double")
    got = {r.g: r.lam for r in one_se_choice(df, "g", "p", "b", [F.col("lam")], ("m", "b")).collect()}
    assert got == {"g": 2.0, "h": 1.0}
    folds = spark.createDataFrame([("a", 1.0, None, 2), ("a", 2.0, 5.0, 2), ("b", 1.0, 4.0, 2)], "k string, v double, w double, want int").withColumn("n", F.lit(1))
    means = {r.k: (r.status, r.v_mean, r.w_mean) for r in fold_means(folds, ["k"], ["v"], "n", "want", ("w",)).collect()}
    assert means == {"a": ("completed", 1.5, None), "b": ("failed", None, None)}


def test_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), None if rng.random() < 0.1 else float(rng.integers(0, 40)), int(i)) for i, g in enumerate(rng.integers(0, 3, 900))]
    df = spark.createDataFrame(rows, "g int, s double, i int")
    got = {r.i: r.place for r in ranks(df, "g", "s", [F.asc_nulls_last("s"), F.asc("i")], "place").collect()}
    for g in range(3):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0.0, r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_read_text_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,,x\nbad,2.5,\n")
    rows = [tuple(r) for r in read_text_table(spark, str(tmp_path / "t.csv"), "a int, b double, c string, d date").collect()]
    assert rows == [(1, None, "x", None), (None, 2.5, None, None)]


def test_scores_by_key_keep_empty_masks_and_null_keys(spark):
    rows = [("a", 1, 0.5), ("a", -1, 0.5), (None, 1, 2.0)]
    slots = spark.createDataFrame(rows, "k string, x int, h double")
    masks = {"all": F.lit(True), "down": F.col("x") < 0}
    got = {(r.k, r.mask): r for r in masked_scores(slots, masks, ("k",)).collect()}
    assert {k: r.slots for k, r in got.items()} == {("a", "all"): 2, ("a", "down"): 1, (None, "all"): 1, (None, "down"): 0}
    assert got[None, "down"].loss is None and got["a", "down"].loss > got["a", "all"].loss
    alone = masked_scores(slots.where("k = 'a'"), masks).where("mask = 'all'").first()
    assert (got["a", "all"].loss, got["a", "all"].brier, got["a", "all"].ece) == pytest.approx((alone.loss, alone.brier, alone.ece))
    assert masked_scores(slots.limit(0), masks, ("k",)).collect() == []


def test_predictors_in_rows(spark):
    slots = spark.createDataFrame([("u", t, x, t < 2) for t, x in enumerate((1, -1, 1))], "unit string, t int, x int, training boolean")
    rows = predictors_in_rows(slots)
    assert rows.count() == 9 and rows.select("predictor").distinct().count() == 3
    assert rows.where("predictor = 'unit_mean'").agg(F.max(F.abs("h"))).first()[0] == 0.0


def test_new_baselines_replace_only_baselines_of_earlier_reports(spark):
    schema = "state string, part string, name string, loss double"
    earlier = [("a", "fit", "all", 1.0), ("a", "baselines", "old", 9.0), ("b", "fit", "all", 2.0), ("c", "baselines", "old", 9.0), (None, "fit", "all", 3.0)]
    new = [("a", "baselines", "new", 4.0), ("a", "baselines", "other", None), ("c", "baselines", "new", 5.0), ("d", "baselines", "new", 6.0), (None, "baselines", "new", 7.0)]
    make = lambda rows: spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in with_new_baselines(make(earlier), make(new), "state").collect())
    assert got == [("a", "baselines", "new", 4.0), ("a", "baselines", "other", None), ("a", "fit", "all", 1.0), ("b", "fit", "all", 2.0)]
    assert with_new_baselines(make([]), make(new), "state").collect() == []


def test_inner_folds_by_runs_of_times(spark):
    """Roles at the first times of runs stand for all times; violations weighted by the runs are those of all times."""
    from loomgrid.operators.splits import blanket_violations, inner_roles, pattern_members, roles, runs

    steps, units = 29, [f"u{i:02d}" for i in range(12)]
    members = spark.createDataFrame([(u, i // 3 + 1) for i, u in enumerate(units)], "unit string, part int")
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in zip(units, units[1:])], "src string, dst string, w double")
    both = pairs.unionByName(pairs.selectExpr("dst as src", "src as dst", "w"))
    lengths = runs(steps, 4, 3)
    assert sum(n for _, n in lengths) == steps and len(lengths) < 20
    layers = []
    for times in (None, [t for t, _ in lengths]):
        outer = roles(members, both, steps, 4, times).withColumnRenamed("fold", "outer_fold")
        layers.append(inner_roles(outer, pattern_members(outer, 3), both, steps, 3))
    all_rows, first_rows = [{(r.outer_fold, r.fold, r.t, r.unit): r.role for r in x.collect()} for x in layers]
    start = {t: a for a, n in lengths for t in range(a, a + n)}
    assert all_rows == {k: first_rows[k[0], k[1], start[k[2]], k[3]] for k in all_rows}
    broken = [x.withColumn("role", F.when(F.col("role") == "separator", "training").otherwise(F.col("role"))) for x in layers]
    whole, weighted = [sorted(map(tuple, blanket_violations(x, pairs, w).collect())) for x, w in zip(broken, (None, lengths))]
    assert whole == weighted and any(r[2] for r in whole)


@pytest.mark.parametrize("parts", [(1, 2, 3, 4), (1, 2, 4), (3,)])
def test_inner_roles_counted_without_slots(spark, parts):
    """Counts by kinds of units are those of the roles of all slots, with a hub, uneven parts and parts without units."""
    from loomgrid.operators.splits import inner_role_counts

    rng = np.random.default_rng(5)
    steps, units = 29, [f"u{i:02d}" for i in range(40)]
    members = spark.createDataFrame([(u, int(rng.choice(parts))) for u in units], "unit string, part int")
    pairs = {(units[0], u) for u in units[1:14]} | set(zip(units, units[1:]))
    both = spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "src string, dst string, w double")
    outer = roles(members, both, steps, 4).withColumnRenamed("fold", "outer_fold")
    slots = inner_roles(outer, pattern_members(outer, 3), both, steps, 3)
    want = sorted(map(tuple, slots.groupBy("outer_fold", "fold", "t", "role").count().collect()))
    got = inner_role_counts(members, both, steps, 4, 3)
    assert sorted(map(tuple, got.collect())) == want and sum(r[-1] for r in want) == 4 * 3 * steps * len(units)
    assert inner_role_counts(members.limit(0), both.limit(0), steps, 4, 3).collect() == []


def test_inner_fold_roles_writes_no_slots(spark, data):
    """No table that the query writes on its way has more rows than there are edges, however many weeks there are."""
    from pathlib import Path

    from loomgrid.plans import queries
    from loomgrid.session import run_folder

    folder = Path(run_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    queries()["inner_fold_roles"](spark, data).collect()
    written = [spark.read.parquet(str(p)).count() for p in set(folder.glob("*")) - before]
    assert written and max(written) <= queries()["contiguity"](spark, data).count()


@pytest.mark.parametrize("parts", [(1, 2, 3, 4), (1, 2, 4), (3,)])
def test_inner_violations_counted_without_slots(spark, monkeypatch, parts):
    """Violations by kinds are those of the roles of all slots: none; and, with pairs that the folds don't know and inner folds without transitions, many."""
    from loomgrid.operators import skew, splits

    rng = np.random.default_rng(6)
    steps, units = 29, [f"u{i:02d}" for i in range(40)]
    members = spark.createDataFrame([(u, int(rng.choice(parts))) for u in units], "unit string, part int")
    known = {(units[0], u) for u in units[1:14]} | set(zip(units, units[1:]))
    both = spark.createDataFrame([(a, b, 1.0) for x, y in known for a, b in ((x, y), (y, x))], "src string, dst string, w double")
    pairs = spark.createDataFrame([(*sorted(map(str, rng.choice(units, 2, replace=False))), 1.0) for _ in range(60)] + [(u, units[-1], 1.0) for u in units[:9]], "src string, dst string, w double")

    def both_counts(links):
        outer = roles(members, both, steps, 4).withColumnRenamed("fold", "outer_fold")
        slots = inner_roles(outer, pattern_members(outer, 3), both, steps, 3)
        return [sorted(map(tuple, x.collect())) for x in (blanket_violations(slots, links), splits.inner_violations(members, both, links, steps, 4, 3))]

    want, got = both_counts(both.where("src < dst"))
    assert got == want == [(o, f, 0, 0) for o in range(1, 5) for f in range(1, 4)]
    real = splits.schedule
    monkeypatch.setattr(splits, "schedule", lambda steps, folds: [(f, t, p, q, jump and folds != 3, b) for f, t, p, q, jump, b in real(steps, folds)])
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (4,))
    monkeypatch.setattr(skew.spread, "__defaults__", (4,))
    want, got = both_counts(pairs)
    assert got == want and sum(r[2] for r in want) > 0 and sum(r[3] for r in want) > 0
    assert splits.inner_violations(members.limit(0), both.limit(0), pairs.limit(0), steps, 4, 3).collect() == []


def test_inner_blanket_check_writes_no_slots(spark, data):
    """No table that the query writes on its way has more rows than there are edges, however many weeks there are."""
    from pathlib import Path

    from loomgrid.plans import queries
    from loomgrid.session import run_folder

    folder = Path(run_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    queries()["inner_blanket_check"](spark, data).collect()
    written = [spark.read.parquet(str(p)).count() for p in set(folder.glob("*")) - before]
    assert written and max(written) <= queries()["contiguity"](spark, data).count()
