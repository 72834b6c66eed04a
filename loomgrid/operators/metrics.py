"""Scores of slots (unit x time) under masks: losses, calibration, panel statistics, simple predictors.

Slots carry x, z, prev_x and h (the natural parameter). Several masks are scored in one pass: each slot is
exploded to the names of the masks it belongs to and aggregated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.scalars import chance, field_of_mean, slot_loss

BINS = 10
#: The simple predictors, by the column that holds the predicted mean.
PREDICTORS = ("time_mean", "unit_mean", "persistence")


def natural_parameter(theta: Column, z: Column, prev_x: Column, neighbours: Column, beta: float, eta: float, xi: float) -> Column:
    return theta + F.lit(beta) * z + F.lit(eta) * prev_x + F.lit(xi) * neighbours


def mask_names(masks: dict[str, Column]) -> Column:
    """The names of the masks that hold for a row, one row each."""
    return F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in masks.items()]), lambda n: n.isNotNull())).alias("mask")


def six_masks(test: Column, post: Column, treated: Column) -> dict[str, Column]:
    """test and test after s, of all, treated and untreated slots."""
    kinds = {"all": F.lit(True), "treated": treated, "untreated": ~treated}
    return {f"{a}_{b}": m & c for a, m in (("test", test), ("post_s", test & post)) for b, c in kinds.items()}


def twelve_buckets(training: Column, test: Column, post: Column, treated: Column) -> dict[str, Column]:
    """all, training, separator (neither), test, treated and untreated test, each over all times and after s."""
    kinds = {"all": F.lit(True), "training": training, "separator": ~(training | test), "test": test, "treated_test": test & treated, "untreated_test": test & ~treated}
    return {f"{a}{b}": c & t for a, c in kinds.items() for b, t in (("", F.lit(True)), ("_post_s", post))}


def masked_scores(slots: DataFrame, masks: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """mask, slots, loss, brier and ece (10 bins of the predicted chance; empty bins don't count) of each mask, for each value of ``keys``;
    a mask without slots comes out with a count of 0 and null scores. Null keys are a group of their own."""
    p = chance(F.col("h"))
    y = (F.col("x") + 1) / 2
    rows = slots.select(*keys, mask_names(masks), slot_loss(F.col("h"), F.col("x")).alias("loss"), F.pow(y - p, 2).alias("square"), y.alias("y"), p.alias("p"))
    bins = rows.groupBy(*keys, "mask", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.sum("square").alias("square"), F.abs(F.sum("y") - F.sum("p")).alias("gap")
    )
    scores = bins.groupBy(*keys, "mask").agg(
        F.sum("n").alias("slots"), (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("square") / F.sum("n")).alias("brier"), (F.sum("gap") / F.sum("n")).alias("ece")
    )
    if not keys:
        return all_masks(slots, masks).join(scores, "mask", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    empty = slots.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), F.lit(0).cast("long").alias("slots"))
    both = scores.unionByName(empty, allowMissingColumns=True)  # one row per mask has scores, the other only the count of 0
    return both.groupBy(*keys, "mask").agg(*[F.max(c).alias(c) for c in ("slots", "loss", "brier", "ece")])


def all_masks(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    return df.sparkSession.createDataFrame([(m,) for m in masks], "mask string")


def predictors_in_rows(slots: DataFrame) -> DataFrame:
    """Each slot once per simple predictor (``predictor``), with the field of the predicted mean as ``h``."""
    kinds = F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(n).alias("mean")) for n in PREDICTORS])
    rows = baselines(slots).withColumn("each", F.explode(kinds))
    return rows.withColumns({"predictor": F.col("each.predictor"), "h": field_of_mean(F.col("each.mean"))}).drop("each", *PREDICTORS)


def with_new_baselines(reports: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Earlier reports with only their baselines replaced: the rows of ``reports`` (``key``, ``part`` and scores) whose part is not
    ``baselines``, and the given baseline rows of those keys that have such a report. A key without an earlier report gets none;
    a report that the new baselines don't name keeps its fit rows and loses the old baselines. A null key is no report."""
    kept = reports.where((F.col("part") != "baselines") & F.col(key).isNotNull())
    return kept.unionByName(baselines.join(kept.select(key).distinct(), key, "left_semi"))


def masked_means(slots: DataFrame, masks: dict[str, Column], value: Column) -> DataFrame:
    """mask, slots and mean; null where the mask is empty."""
    means = slots.select(mask_names(masks), value.alias("v")).groupBy("mask").agg(F.count(F.lit(1)).alias("slots"), F.avg("v").alias("mean"))
    return all_masks(slots, masks).join(means, "mask", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))


def scalar_gradient(slots: DataFrame, loss_mask: Column, beta_mask: Column) -> DataFrame:
    """One row: the gradients of beta (over its own mask and count), xi and eta (over the loss mask)."""
    r = F.tanh(F.col("h")) - F.col("x")
    mean = lambda v, m: F.sum(F.when(m, v)) / F.count(F.when(m, 1))
    return slots.agg(
        mean(r * F.col("z"), loss_mask & beta_mask).alias("beta"), mean(r * F.col("neighbours"), loss_mask).alias("xi"), mean(r * F.col("prev_x"), loss_mask).alias("eta")
    )


def panel_statistics(slots: DataFrame, s: Column) -> DataFrame:
    """The ten statistics of a panel in one row. Graph energy is the mean over times of the sum over units of x times its
    neighbours' sum, over the number of units at the time."""
    post = F.col("t") >= s
    x, xz = F.col("x"), F.col("x") * F.col("z")
    on = lambda m, v: F.avg(F.when(m, v))
    flat = slots.agg(
        F.avg(x).alias("overall_mean"), on(post, x).alias("post_mean"), F.avg(xz).alias("alignment"), F.avg(x * F.col("prev_x")).alias("persistence"),
        F.avg(x * F.col("theta")).alias("field_alignment"), on(~post, xz).alias("pre_alignment"), on(post, xz).alias("post_alignment"),
    )
    energy = slots.groupBy("t").agg(F.avg(x * F.col("neighbours")).alias("e"))
    parts = {"energy": F.avg("e"), "pre_energy": on(~(F.col("t") >= s), F.col("e")), "post_energy": on(F.col("t") >= s, F.col("e"))}
    means = energy.agg(F.struct(*[v.alias(n) for n, v in parts.items()])).scalar()
    return flat.withColumns({n: means[n] for n in parts})


def draw_summary(slots: DataFrame, draw: str, unit: str, t: str, value: str, s: Column) -> DataFrame:
    """Overall and post-s mean of each draw, and its unit and time means, from one pass."""
    out = slots.groupingSets([[F.col(draw)], [F.col(draw), F.col(unit)], [F.col(draw), F.col(t)]], draw, unit, t).agg(
        F.avg(value).alias("mean"), F.avg(F.when(F.col(t) >= s, F.col(value))).alias("post_mean"), F.grouping_id().alias("level")
    )
    kind = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, "unit").otherwise("time")
    return out.select(draw, kind.alias("kind"), unit, t, "mean", "post_mean")


def baselines(slots: DataFrame) -> DataFrame:
    """Predicted means of x per slot: of the time step, of the unit (training slots only, else the mean of all training slots),
    and the unit's last training value before (else -1, its initial state)."""
    train = F.when(F.col("training"), F.col("x").cast("double"))
    overall = slots.agg(F.avg(train)).scalar()
    times = slots.groupBy("t").agg(F.avg(train).alias("time_mean"))
    units = slots.groupBy("unit").agg(F.avg(train).alias("unit_mean"))
    before = Window.partitionBy("unit").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(train, ignorenulls=True).over(before), F.lit(-1.0))
    return (
        slots.withColumn("persistence", last).join(F.broadcast(times), "t").join(units, "unit")
        .withColumns({c: F.coalesce(c, overall) for c in ("time_mean", "unit_mean")})
    )
