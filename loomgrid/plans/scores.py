"""Queries of slot scores and panel statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.scalars import chance, slot_loss
from loomgrid.operators.graph import neighbour_sum
from loomgrid.operators.metrics import (
    baselines, draw_summary, masked_means, masked_scores, natural_parameter, panel_statistics, predictors_in_rows, scalar_gradient, six_masks, twelve_buckets,
    with_new_baselines,
)
from loomgrid.plans.graphs import DIRECTED_VIEW, gamma
from loomgrid.operators.skew import numbered
from loomgrid.plans.views import CELLS_VIEW, FIRST_TREATED, PANEL_VIEW, cells, first_treated, panel
from loomgrid.session import run_folder, written_table
from loomgrid.sources.tables import write_table

BETA, ETA, XI = -0.3, 0.3, 0.8


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with neighbours' sums, h, ``test`` (every fourth slot that doesn't train) and the panel's first treated time s."""
    rows = neighbour_sum(gamma(spark, folder), panel(spark, folder), "unit", "t", "x", "neighbours")
    h = natural_parameter(F.col("theta"), F.col("z"), F.col("prev_x"), F.col("neighbours"), BETA, ETA, XI)
    return rows.withColumns({"h": h, "test": ~F.col("training") & (F.col("t") % 2 == 0)})


SLOTS_VIEW = f"""WITH {DIRECTED_VIEW}, {PANEL_VIEW},
 sums AS (SELECT g.src, p.t, sum(g.w * p.x) AS v FROM gamma g JOIN panel p ON p.unit = g.dst GROUP BY 1, 2),
 slots AS (
   SELECT p.*, coalesce(v, 0) AS neighbours, theta + {BETA}::DOUBLE * z + {ETA}::DOUBLE * prev_x + {XI}::DOUBLE * coalesce(v, 0) AS h, NOT training AND p.t % 2 = 0 AS test
   FROM panel p LEFT JOIN sums s ON s.src = p.unit AND s.t = p.t),
 scored AS (SELECT *, abs(h) + ln(1 + exp(-2 * abs(h))) - x * h AS loss, (1 + tanh(h)) / 2 AS p, (x + 1) / 2 AS y, t >= {FIRST_TREATED} AS post, z > 0 AS treated FROM slots)
"""
SIX = [f"{a}_{b}" for a in ("test", "post_s") for b in ("all", "treated", "untreated")]
SIX_SQL = " UNION ALL ".join(
    f"SELECT '{a}_{b}' AS mask, * FROM scored WHERE {m} AND {c}"
    for a, m in (("test", "test"), ("post_s", "test AND post"))
    for b, c in (("all", "true"), ("treated", "treated"), ("untreated", "NOT treated"))
)
KINDS = {"all": "true", "training": "training", "separator": "NOT (training OR test)", "test": "test", "treated_test": "test AND treated", "untreated_test": "test AND NOT treated"}
TWELVE_SQL = " UNION ALL ".join(f"SELECT '{a}{b}' AS mask, * FROM scored WHERE {c} AND {t}" for a, c in KINDS.items() for b, t in (("", "true"), ("_post_s", "post")))


def masks(spark, folder):
    """Slots, and which lie from s on and which are treated."""
    rows = slots(spark, folder).withColumn("post", F.col("t") >= first_treated(panel(spark, folder)))
    return rows, F.col("post"), F.col("z") > 0


def slot_losses(spark, folder):
    """natural parameter, loss and chance of every slot."""
    rows, _, _ = masks(spark, folder)
    return rows.select("unit", "t", F.round("h", 9).alias("h"), F.round(slot_loss(F.col("h"), F.col("x")), 9).alias("loss"), F.round(chance(F.col("h")), 9).alias("p"))


def test_scores(spark, folder):
    """Loss, Brier and ECE of six masks."""
    rows, post, treated = masks(spark, folder)
    out = masked_scores(rows, six_masks(F.col("test"), post, treated))
    return out.select("mask", "slots", *[F.round(c, 9).alias(c) for c in ("loss", "brier", "ece")])


def bucket_means(spark, folder):
    """Panel means of twelve buckets."""
    rows, post, treated = masks(spark, folder)
    out = masked_means(rows, twelve_buckets(F.col("training"), F.col("test"), post, treated), F.col("x"))
    return out.select("mask", "slots", F.round("mean", 9).alias("mean"))


def gradient(spark, folder):
    """Gradients of the scalars, beta over its own mask."""
    rows, post, _ = masks(spark, folder)
    out = scalar_gradient(rows, F.col("training"), post)
    return out.select(*[F.round(c, 9).alias(c) for c in ("beta", "xi", "eta")])


def statistics_of_panel(spark, folder):
    """The ten statistics."""
    rows, _, _ = masks(spark, folder)
    out = panel_statistics(rows, first_treated(panel(spark, folder)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def draw_means(spark, folder):
    """Overall, unit and time means of each draw (states stand in for draws)."""
    rows = panel(spark, folder).withColumn("draw", F.substring("unit", 1, 2))
    out = draw_summary(rows, "draw", "unit", "t", "x", first_treated(panel(spark, folder)))
    return out.select("draw", "kind", "unit", "t", F.round("mean", 9).alias("mean"), F.round("post_mean", 9).alias("post_mean"))


def simple_predictors(spark, folder):
    """The three baselines of every slot."""
    out = baselines(panel(spark, folder))
    return out.select("unit", "t", *[F.round(c, 9).alias(c) for c in ("time_mean", "unit_mean", "persistence")])


def predictor_scores(spark, folder):
    """The baselines scored on the test slots like a model, their means turned into a field."""
    rows, _, _ = masks(spark, folder)
    scores = masked_scores(predictors_in_rows(rows), {"test_all": F.col("test")}, ("predictor",))
    return scores.select("predictor", "slots", *[F.round(c, 6).alias(c) for c in ("loss", "brier", "ece")])


def evaluation(rows: DataFrame, post: Column, treated: Column) -> tuple[DataFrame, DataFrame]:
    """Reports by state: the six masks of the fit, and the baselines on the test slots."""
    fit = masked_scores(rows, six_masks(F.col("test"), post, treated), ("state",)).withColumnsRenamed({"mask": "name"}).withColumn("part", F.lit("fit"))
    simple = masked_scores(predictors_in_rows(rows), {"all": F.col("test")}, ("state", "predictor")).withColumnsRenamed({"predictor": "name"})
    shape = ["state", "part", "name", "slots", "loss", "brier", "ece"]
    return fit.select(shape), simple.withColumn("part", F.lit("baselines")).select(shape)


def test_evaluation(spark, folder):
    """The report on the test slots of each state (states stand in for fits): scores of the fit by mask, and of the baselines."""
    rows, post, treated = masks(spark, folder)
    fit, simple = evaluation(written_table(rows.withColumn("state", F.substring("unit", 1, 2))), post, treated)
    return fit.unionByName(simple).select("state", "part", "name", "slots", *[F.round(c, 6).alias(c) for c in ("loss", "brier", "ece")])


def test_evaluation_baselines(spark, folder):
    """Q6: the earlier reports (of the states with any treated unit, baselines of before s) with only their baselines computed anew."""
    rows, post, treated = masks(spark, folder)
    rows = written_table(rows.withColumn("state", F.substring("unit", 1, 2)))
    fit, simple = evaluation(rows, post, treated)
    reported = rows.where(treated).select("state").distinct()
    _, old = evaluation(rows.where(~post), post, treated)
    earlier = fit.unionByName(old).join(reported, "state", "left_semi")
    return with_new_baselines(earlier, simple, "state").select("state", "part", "name", "slots", *[F.round(c, 6).alias(c) for c in ("loss", "brier", "ece")])


def artifact_round_trip(spark, folder):
    """The field, the interactions xi * gamma, the scalars and the completed surface, each written as a table of its own in the
    checkpoint folder, laid out by kind, and read again."""
    base = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    rows = panel(spark, folder)
    observed = cells(spark, folder).where("panel_key = 'x'").groupBy("unit", "week").agg(F.max("value").cast("double").alias("value"))
    means = observed.groupBy("unit").agg(F.avg("value").alias("m"))
    completed = observed.join(means, "unit").select(F.col("unit").alias("a"), F.col("week").cast("string").alias("b"), F.coalesce("value", "m").alias("value"))
    kinds = {
        "field": rows.select(F.col("unit").alias("a"), F.col("t").cast("string").alias("b"), F.col("theta").alias("value")),
        "interactions": gamma(spark, folder).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") * XI).alias("value")),
        "scalars": rows.agg(*[F.lit(v).alias(n) for n, v in (("beta", BETA), ("eta", ETA), ("xi", XI))]).unpivot([], ["beta", "eta", "xi"], "a", "value").withColumn("b", F.lit(None).cast("string")),
        "completed": completed,
    }
    for kind, df in kinds.items():
        write_table(df.select("a", "b", "value"), f"{base}/kind={kind}")
    again = spark.read.schema("a string, b string, value double, kind string").option("basePath", base).parquet(base)
    return again.select("kind", "a", "b", F.round("value", 9).alias("value"))


def treated_share(spark, folder):
    """Share treated and mean outcome of each time."""
    rows = panel(spark, folder)
    return rows.groupBy("t").agg(F.round(F.avg((F.col("z") == 1).cast("int")), 9).alias("treated_share"), F.round(F.avg("x"), 9).alias("time_mean"), F.count(F.lit(1)).alias("units"))


def unit_order(spark, folder):
    """All units by mean outcome and code, the order in which their series are shown."""
    means = panel(spark, folder).groupBy("unit").agg(F.round(F.avg("x"), 9).alias("unit_mean"))
    return numbered(means, [], [F.asc("unit_mean"), F.asc("unit")], "place")


def split_matrices(spark, folder):
    """Outcomes as treated and untreated surfaces with gaps, and the surface chosen by another intervention."""
    rows = panel(spark, folder)
    treated, untreated = F.when(F.col("z") > 0, F.col("x")), F.when(F.col("z") <= 0, F.col("x"))
    flipped = F.col("t") >= first_treated(rows)
    return rows.select("unit", "t", treated.alias("treated"), untreated.alias("untreated"), F.when(flipped, treated).otherwise(untreated).alias("chosen"))


def completion_stats(spark, folder):
    """Observed and missing cells of both surfaces on the full grid, completed by the unit's mean where it has one."""
    rows = cells(spark, folder).where("panel_key = 'x'").select("unit", "week", "value")
    means = rows.groupBy("unit").agg(F.avg("value").alias("m"))
    full = rows.join(means, "unit")
    missing = F.col("value").isNull()
    out = full.agg(
        F.count("value").alias("observed"), F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(missing & F.col("m").isNotNull(), 1)).alias("completed"),
        F.count(F.when(missing & F.col("m").isNull(), 1)).alias("failed"),
    )
    return out.withColumn("rate", F.round(F.try_divide("completed", "missing"), 9))


QUERIES = {f.__name__: f for f in (
    slot_losses, test_scores, bucket_means, gradient, statistics_of_panel, draw_means, simple_predictors, predictor_scores, treated_share, unit_order,
    split_matrices, completion_stats, test_evaluation, test_evaluation_baselines, artifact_round_trip,
)}

BASE_SQL = """ means AS (SELECT avg(x) FILTER (training) AS m FROM panel),
 times AS (SELECT t, avg(x) FILTER (training) AS m FROM panel GROUP BY 1), units AS (SELECT unit, avg(x) FILTER (training) AS m FROM panel GROUP BY 1),
 base AS (
   SELECT p.unit, p.t, coalesce(t.m, (SELECT m FROM means)) AS time_mean, coalesce(u.m, (SELECT m FROM means)) AS unit_mean,
     coalesce(last_value(CASE WHEN training THEN x END IGNORE NULLS) OVER (PARTITION BY p.unit ORDER BY p.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)::DOUBLE AS persistence
   FROM panel p JOIN times t ON t.t = p.t JOIN units u ON u.unit = p.unit)
"""
SCORE = """, bins AS (SELECT {key}, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(loss) AS loss, sum(pow(y - p, 2)) AS square, abs(sum(y) - sum(p)) AS gap FROM each GROUP BY ALL)
, totals AS (
   SELECT {key}, CAST(sum(n) AS BIGINT) AS slots, round(sum(loss) / sum(n), {d}) AS loss, round(sum(square) / sum(n), {d}) AS brier, round(sum(gap) / sum(n), {d}) AS ece FROM bins GROUP BY ALL)
 SELECT {key}, coalesce(slots, 0) AS slots, loss, brier, ece FROM (SELECT unnest({names}) AS {key}) LEFT JOIN totals USING ({key})"""
EVALUATION_SQL = f""", sixes AS ({SIX_SQL}), {BASE_SQL},
 fields AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, unit, t, atanh(least(greatest({n}, 1e-6::DOUBLE - 1), 1 - 1e-6::DOUBLE)) AS h FROM base" for n in ("time_mean", "unit_mean", "persistence"))}),
 states AS (SELECT left(unit, 2) AS state, bool_or(treated) AS reported FROM scored GROUP BY 1),
 each AS (
   SELECT left(unit, 2) AS state, 'fit' AS part, mask AS name, loss, p, y FROM sixes
   UNION ALL SELECT left(unit, 2), 'baselines', name, abs(f.h) + ln(1 + exp(-2 * abs(f.h))) - x * f.h, (1 + tanh(f.h)) / 2, y FROM scored s JOIN fields f USING (unit, t) WHERE test),
 bins AS (SELECT state, part, name, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(loss) AS loss, sum(pow(y - p, 2)) AS square, abs(sum(y) - sum(p)) AS gap FROM each GROUP BY ALL),
 totals AS (SELECT state, part, name, CAST(sum(n) AS BIGINT) AS slots, round(sum(loss) / sum(n), 6) AS loss, round(sum(square) / sum(n), 6) AS brier, round(sum(gap) / sum(n), 6) AS ece FROM bins GROUP BY ALL),
 names AS (SELECT 'fit' AS part, unnest({SIX}) AS name UNION ALL SELECT 'baselines', unnest(['time_mean', 'unit_mean', 'persistence']))
 SELECT state, part, name, coalesce(slots, 0) AS slots, loss, brier, ece FROM (SELECT * FROM states, names) LEFT JOIN totals USING (state, part, name)"""
_post = f"CASE WHEN t >= {FIRST_TREATED} THEN x END"

ORACLES = {
    "slot_losses": SLOTS_VIEW + "SELECT unit, t, round(h, 9) AS h, round(loss, 9) AS loss, round(p, 9) AS p FROM scored",
    "test_scores": SLOTS_VIEW + f", each AS ({SIX_SQL})" + SCORE.format(key="mask", d=9, names=SIX),
    "bucket_means": SLOTS_VIEW + f", each AS ({TWELVE_SQL}), names AS (SELECT unnest({[a + b for a in KINDS for b in ('', '_post_s')]}) AS mask) SELECT mask, count(x) AS slots, round(avg(x), 9) AS mean FROM names LEFT JOIN each USING (mask) GROUP BY 1",
    "gradient": SLOTS_VIEW + """SELECT round(avg((tanh(h) - x) * z) FILTER (training AND post), 9) AS beta, round(avg((tanh(h) - x) * neighbours) FILTER (training), 9) AS xi,
      round(avg((tanh(h) - x) * prev_x) FILTER (training), 9) AS eta FROM scored""",
    "statistics_of_panel": SLOTS_VIEW + f""", e AS (SELECT t, avg(x * neighbours) AS e FROM scored GROUP BY 1)
      SELECT round(avg(x), 9) AS overall_mean, round(avg(x) FILTER (post), 9) AS post_mean, round(avg(x * z), 9) AS alignment, round(avg(x * prev_x), 9) AS persistence, round(avg(x * theta), 9) AS field_alignment,
        round(avg(x * z) FILTER (NOT post), 9) AS pre_alignment, round(avg(x * z) FILTER (post), 9) AS post_alignment, (SELECT round(avg(e), 9) FROM e) AS energy,
        (SELECT round(avg(e), 9) FROM e WHERE t < {FIRST_TREATED}) AS pre_energy, (SELECT round(avg(e), 9) FROM e WHERE t >= {FIRST_TREATED}) AS post_energy FROM scored""",
    "draw_means": f"""WITH {PANEL_VIEW}, d AS (SELECT left(unit, 2) AS draw, * FROM panel)
      SELECT draw, 'overall' AS kind, NULL AS unit, NULL AS t, round(avg(x), 9) AS mean, round(avg({_post}), 9) AS post_mean FROM d GROUP BY 1
      UNION ALL SELECT draw, 'unit', unit, NULL, round(avg(x), 9), round(avg({_post}), 9) FROM d GROUP BY 1, 3 UNION ALL SELECT draw, 'time', NULL, t, round(avg(x), 9), round(avg({_post}), 9) FROM d GROUP BY 1, 4""",
    "simple_predictors": f"WITH {PANEL_VIEW}, {BASE_SQL} SELECT unit, t, round(time_mean, 9) AS time_mean, round(unit_mean, 9) AS unit_mean, round(persistence, 9) AS persistence FROM base",
    "predictor_scores": SLOTS_VIEW + f", {BASE_SQL}, fields AS (" + " UNION ALL ".join(f"SELECT '{n}' AS predictor, unit, t, atanh(least(greatest({n}, 1e-6::DOUBLE - 1), 1 - 1e-6::DOUBLE)) AS h FROM base" for n in ("time_mean", "unit_mean", "persistence"))
    + "), each AS (SELECT predictor, abs(f.h) + ln(1 + exp(-2 * abs(f.h))) - x * f.h AS loss, (1 + tanh(f.h)) / 2 AS p, y FROM scored s JOIN fields f ON f.unit = s.unit AND f.t = s.t WHERE test)" + SCORE.format(key="predictor", d=6, names=["time_mean", "unit_mean", "persistence"]),
    "test_evaluation": SLOTS_VIEW + EVALUATION_SQL,
    "test_evaluation_baselines": SLOTS_VIEW + EVALUATION_SQL + " WHERE reported",
    "artifact_round_trip": f"""WITH {DIRECTED_VIEW}, {PANEL_VIEW}, o AS (SELECT unit, week, max(value)::DOUBLE AS value FROM cells WHERE panel_key = 'x' GROUP BY 1, 2)
      SELECT 'field' AS kind, unit AS a, CAST(t AS VARCHAR) AS b, round(theta, 9) AS value FROM panel UNION ALL SELECT 'interactions', src, dst, round(w * {XI}::DOUBLE, 9) FROM gamma
      UNION ALL SELECT 'scalars', unnest(['beta', 'eta', 'xi']), NULL, unnest([{BETA}, {ETA}, {XI}]::DOUBLE[])
      UNION ALL SELECT 'completed', unit, CAST(week AS VARCHAR), round(coalesce(value, avg(value) OVER (PARTITION BY unit)), 9) FROM o""",
    "treated_share": f"WITH {PANEL_VIEW} SELECT t, round(avg(CAST(z = 1 AS INTEGER)), 9) AS treated_share, round(avg(x), 9) AS time_mean, count(*) AS units FROM panel GROUP BY 1",
    "unit_order": f"WITH {PANEL_VIEW}, m AS (SELECT unit, round(avg(x), 9) AS unit_mean FROM panel GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY unit_mean, unit) AS INTEGER) AS place FROM m",
    "split_matrices": f"""WITH {PANEL_VIEW} SELECT unit, t, CASE WHEN z > 0 THEN x END AS treated, CASE WHEN z <= 0 THEN x END AS untreated,
      CASE WHEN t >= {FIRST_TREATED} THEN CASE WHEN z > 0 THEN x END ELSE CASE WHEN z <= 0 THEN x END END AS chosen FROM panel""",
    "completion_stats": f"""WITH {CELLS_VIEW}, r AS (SELECT *, avg(value) OVER (PARTITION BY unit) AS m FROM cells WHERE panel_key = 'x'), c AS (
        SELECT count(value) AS observed, count(CASE WHEN value IS NULL THEN 1 END) AS missing, count(CASE WHEN value IS NULL AND m IS NOT NULL THEN 1 END) AS completed, count(CASE WHEN value IS NULL AND m IS NULL THEN 1 END) AS failed FROM r)
      SELECT *, CASE WHEN missing > 0 THEN round(completed / missing, 9) END AS rate FROM c""",
}
