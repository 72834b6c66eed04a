"""Queries of the reports over run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.latest import latest_row
from loomgrid.functions.scalars import finite
from loomgrid.operators.reports import QUANTILES, calibration, exact_quantiles, finite_summary, fold_means, one_se_choice, ranks, vector_errors
from loomgrid.plans.graphs import DIRECTED_VIEW, directed
from loomgrid.operators.graph import symmetric_by_max, symmetric_by_mean
from loomgrid.operators.skew import spread
from loomgrid.session import written_table
from loomgrid.sources.tables import table

SOURCES = ["default", "default_test_train", "xi_zero"]
ITEM = ["experiment_name", "run_name", "source_name"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The counting row of each item with finite figures (null otherwise): score, worst, coverage."""
    rows = table(spark, folder, "posterior_predictive_summary")
    kept = ["row_id", "source_type", "source_slug", "run_slug", "latent_rank", "mean_abs_zscore", "max_abs_zscore", "coverage_rate", "num_statistics", "num_samples", "gibbs_sweeps", "output_path"]
    rows = latest_row(rows, ITEM, ["written_at", "row_id"], [*kept, F.col("written_at").alias("written")])
    return rows.withColumns({"score": finite(F.col("mean_abs_zscore")), "worst": finite(F.col("max_abs_zscore")), "coverage": finite(F.col("coverage_rate"))})


ITEMS_VIEW = """
 items AS (
   SELECT *, CASE WHEN isfinite(mean_abs_zscore) THEN mean_abs_zscore END AS score, CASE WHEN isfinite(max_abs_zscore) THEN max_abs_zscore END AS worst,
     CASE WHEN isfinite(coverage_rate) THEN coverage_rate END AS coverage FROM posterior_predictive_summary
   QUALIFY row_number() OVER (PARTITION BY experiment_name, run_name, source_name ORDER BY written_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)
"""


def nine(columns: list[str]) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


SUMMARY = ["mean", "std", "q025", "q500", "q975"]


def score_summary(spark, folder):
    """Finite scores per experiment: mean, population deviation, exact quantiles, and whether the mean coverage lies inside."""
    rows = items(spark, folder)
    out = finite_summary(rows, ["experiment_name"], "score")
    seen = rows.groupBy("experiment_name").agg(F.avg("coverage").alias("observed"))
    out = out.join(seen, "experiment_name")
    return out.select(
        "experiment_name", "n", *nine(SUMMARY), F.round("observed", 9).alias("observed"), F.round(F.abs(F.col("observed") - F.col("mean")), 9).alias("abs_error"),
        F.round("observed", 9).between(F.round("q025", 9), F.round("q975", 9)).alias("inside"),
    )


SUMMARY_SQL = "count(score) AS n, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.025) AS q025, quantile_cont(score, 0.5) AS q500, quantile_cont(score, 0.975) AS q975"


def source_summary(spark, folder):
    """A vector of summaries by source, with errors of the means against the median of all and the share of sources covered."""
    rows = items(spark, folder)
    out = finite_summary(rows, ["source_name"], "score")
    centre = exact_quantiles(rows.withColumn("one", F.lit(1)), ["one"], "score", {"m": 0.5}).select("m").scalar()
    out = out.withColumn("gap", F.abs(F.col("mean") - centre))
    return out.agg(
        F.count(F.lit(1)).alias("sources"), F.round(F.avg("gap"), 9).alias("mae"), F.round(F.sqrt(F.avg(F.col("gap") * F.col("gap"))), 9).alias("rmse"),
        F.round(F.max("gap"), 9).alias("max_error"), F.round(F.avg(centre.between(F.col("q025"), F.col("q975")).cast("int")), 9).alias("covered"),
    )


def truth_calibration(spark, folder):
    """The mean truth score of an experiment against the scores of its fits."""
    rows = items(spark, folder)
    truth = rows.where("source_type = 'truth'").groupBy("experiment_name").agg(F.round(F.avg("score"), 6).alias("observed"))
    out = calibration(rows.where("source_type <> 'truth'"), truth, ["experiment_name"], "score", "observed")
    return out.select("experiment_name", "observed", "n", *nine(["mean", "std"]), F.round("z", 6).alias("z"), *nine(["tail", "q025", "q500", "q975"]), "inside")


def calibration_summary(spark, folder):
    """Over all experiments the mean and greatest absolute z-score (finite ones) and the coverage rate."""
    out = truth_calibration(spark, folder).withColumn("z", finite(F.col("z")))
    return out.agg(F.count("z").alias("n"), F.round(F.avg(F.abs("z")), 6).alias("mean_abs_z"), F.round(F.max(F.abs("z")), 6).alias("max_abs_z"), F.round(F.avg(F.col("inside").cast("int")), 6).alias("coverage_rate"))


CALIBRATION_SQL = f"""WITH {ITEMS_VIEW}, truth AS (SELECT experiment_name, round(avg(score), 6) AS observed FROM items WHERE source_type = 'truth' GROUP BY 1),
 s AS (SELECT i.experiment_name, observed, score FROM items i JOIN truth t USING (experiment_name) WHERE source_type <> 'truth' AND score IS NOT NULL AND observed IS NOT NULL),
 g AS (SELECT experiment_name, observed, {SUMMARY_SQL}, avg(CAST(score <= observed AS INTEGER)) AS l, avg(CAST(score >= observed AS INTEGER)) AS r FROM s GROUP BY 1, 2),
 calibrated AS (
   SELECT experiment_name, observed, n, round(mean, 9) AS mean, round(std, 9) AS std, round(CASE WHEN std < 1e-12 THEN CASE WHEN abs(observed - mean) < 1e-12 THEN 0 ELSE sign(observed - mean) * 'inf'::DOUBLE END ELSE (observed - mean) / std END, 6) AS z,
     round(least(1.0, 2 * least(l, r)), 9) AS tail, round(q025, 9) AS q025, round(q500, 9) AS q500, round(q975, 9) AS q975, observed BETWEEN q025 AND q975 AS inside FROM g)
"""


def truth_comparison(spark, folder):
    """Scores of each source's runs against the one truth of the same run name and experiment (only where there is exactly one)."""
    rows = items(spark, folder)
    truth = rows.where("source_type = 'truth'").groupBy("experiment_name", "run_name").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("truth")).where("n = 1")
    pairs = rows.where("source_type <> 'truth'").join(truth.drop("n"), ["experiment_name", "run_name"])
    out = vector_errors(pairs, ["source_name"], "score", "truth")
    return out.select("source_name", "n", *nine(["mae", "mse", "rmse", "max_error"]), F.round("correlation", 6).alias("correlation"))


def truth_self(spark, folder):
    """Truth against itself: no error, correlation 1."""
    rows = items(spark, folder).where("source_type = 'truth'").select("experiment_name", "score", F.col("score").alias("same"))
    out = vector_errors(rows, ["experiment_name"], "score", "same")
    return out.select("experiment_name", "n", *nine(["mae", "mse", "rmse", "max_error"]), F.round("correlation", 6).alias("correlation"))


def candidate_scores(spark, folder):
    """Sources as folds of each run: weighted and plain means, standard errors, blank unless as many completed as the experiment's fullest run has."""
    return _folds(spark, folder).select(*ITEM[:2], "completed", "status", *nine([f"{v}_{k}" for v in ("score", "coverage") for k in ("weighted", "mean", "se")]))


def _folds(spark, folder):
    """All sources but the truth are folds."""
    rows = items(spark, folder).where(F.col("source_type") != "truth")
    runs = rows.groupBy(*ITEM[:2]).agg(F.count(F.lit(1)).alias("n"))
    rows, most, key = spread(rows, runs.groupBy("experiment_name").agg(F.max("n").alias("expected")), ["experiment_name"], "run_name")
    return fold_means(rows.join(most, key), ITEM[:2], ["score", "coverage"], "num_statistics", "expected", ("worst",))


FOLDS_SQL = f"""WITH {ITEMS_VIEW}, f AS (SELECT *, score IS NOT NULL AND coverage IS NOT NULL AS good FROM items WHERE source_type <> 'truth'),
 runs AS (SELECT experiment_name, run_name, count(*) AS n FROM f GROUP BY 1, 2), most AS (SELECT experiment_name, max(n) AS expected FROM runs GROUP BY 1),
 g AS (SELECT f.experiment_name, run_name, any_value(expected) AS expected, count(CASE WHEN good THEN 1 END) AS completed, """ + ", ".join(
    f"""sum(num_statistics * {v}) FILTER (good) / sum(num_statistics) FILTER (good AND {v} IS NOT NULL) AS {v}_weighted, avg({v}) FILTER (good) AS {v}_mean, count({v}) FILTER (good) AS {v}_known,
     CASE WHEN count({v}) FILTER (good) > 1 THEN stddev_samp({v}) FILTER (good) / sqrt(count({v}) FILTER (good)) ELSE 0 END AS {v}_se"""
    for v in ("score", "coverage", "worst")
) + """ FROM f JOIN most USING (experiment_name) GROUP BY 1, 2),
 candidates AS (SELECT experiment_name, run_name, completed, CASE WHEN completed = expected THEN 'completed' ELSE 'failed' END AS status, """ + ", ".join(
    f"CASE WHEN completed = expected AND {v}_known = completed THEN {v}_{k} END AS {v}_{k}" for v in ("score", "coverage", "worst") for k in ("weighted", "mean", "se")
) + " FROM g)"


def chosen_candidates(spark, folder):
    """Of each experiment the run within one standard error of the best worst score and coverage (of the best score and coverage where a run
    has no worst score), the least by rank, samples, sweeps, statistics (the most first) and name."""
    rows = _folds(spark, folder)
    most = lambda c: F.max(F.coalesce(c, F.lit(0))).alias(c)
    plain = items(spark, folder).groupBy(*ITEM[:2]).agg(most("latent_rank"), most("num_samples"), most("gibbs_sweeps"), (-F.max("num_statistics")).alias("statistics_less"))
    rows = rows.join(plain, ITEM[:2])
    for c in [f"{v}_{k}" for v in ("score", "coverage", "worst") for k in ("mean", "se")]:
        rows = rows.withColumn(c, F.round(c, 9))
    rows = written_table(rows)  # the choice goes over it several times
    order = ["latent_rank", "num_samples", "gibbs_sweeps", "statistics_less", "run_name"]
    best = one_se_choice(rows, "experiment_name", "worst", "coverage", list(map(F.col, order)), ("score", "coverage"))
    return best.select("experiment_name", "run_name", "latent_rank", "score_mean", "coverage_mean", "worst_mean")


_PLAIN = "latent_rank, num_samples, gibbs_sweeps, statistics_less NULLS FIRST, run_name"
CHOICE_SQL = FOLDS_SQL + f""", ranked AS (
   SELECT c.experiment_name, c.run_name, r.* EXCLUDE (experiment_name, run_name), {", ".join(f"round({v}_{k}, 9) AS {v}_{k}" for v in ("score", "coverage", "worst") for k in ("mean", "se"))}
   FROM candidates c JOIN (SELECT experiment_name, run_name, max(coalesce(latent_rank, 0)) AS latent_rank, max(coalesce(num_samples, 0)) AS num_samples, max(coalesce(gibbs_sweeps, 0)) AS gibbs_sweeps,
     -max(num_statistics) AS statistics_less FROM items GROUP BY 1, 2) r USING (experiment_name, run_name) WHERE score_mean IS NOT NULL AND coverage_mean IS NOT NULL),
 judged AS (SELECT *, CASE WHEN lacks THEN score_mean ELSE worst_mean END AS a, CASE WHEN lacks THEN score_se ELSE worst_se END AS a_se FROM (
   SELECT *, bool_or(worst_mean IS NULL OR worst_se IS NULL) OVER (PARTITION BY experiment_name) AS lacks FROM ranked)),
 one AS (SELECT *, first_value(a + a_se) OVER (PARTITION BY experiment_name ORDER BY a, coverage_mean, {_PLAIN}) AS lim FROM judged),
 two AS (SELECT *, first_value(coverage_mean + coverage_se) OVER (PARTITION BY experiment_name ORDER BY coverage_mean, {_PLAIN}) AS lim2 FROM one WHERE a <= lim)
 SELECT experiment_name, run_name, latent_rank, score_mean, coverage_mean, worst_mean FROM two WHERE coverage_mean <= lim2
 QUALIFY row_number() OVER (PARTITION BY experiment_name ORDER BY {_PLAIN}, a, coverage_mean) = 1"""


def cohort(name):
    return F.regexp_replace(name, "_[0-9]+$", "")


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """(cohort, source_name, statistic, experiment_name, value): one value per experiment, the mean over its runs."""
    rows = items(spark, folder).withColumn("cohort", cohort(F.col("experiment_name")))
    means = rows.groupBy("cohort", "source_name", "experiment_name").agg(*[F.avg(c).alias(c) for c in ("score", "worst", "coverage")])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in ("score", "worst", "coverage")])).alias("s")
    return means.select("cohort", "source_name", "experiment_name", each).select("cohort", "source_name", "experiment_name", "s.*")


TRIALS_VIEW = f"""{ITEMS_VIEW},
 means AS (SELECT regexp_replace(experiment_name, '_[0-9]+$', '') AS cohort, source_name, experiment_name, avg(score) AS score, avg(worst) AS worst, avg(coverage) AS coverage FROM items GROUP BY 1, 2, 3),
 trials AS (SELECT cohort, source_name, experiment_name, 'score' AS statistic, score AS value FROM means UNION ALL SELECT cohort, source_name, experiment_name, 'worst', worst FROM means
   UNION ALL SELECT cohort, source_name, experiment_name, 'coverage', coverage FROM means),
 summary AS (
   SELECT cohort, source_name, statistic, count(value) AS num_trials, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(stddev_samp(value) / sqrt(count(value)), 9) AS se,
     round(quantile_cont(value, 0.025), 9) AS q025, round(quantile_cont(value, 0.5), 9) AS q500, round(quantile_cont(value, 0.975), 9) AS q975
   FROM trials GROUP BY 1, 2, 3 HAVING count(value) >= 2 AND count(value) = count(*))
"""


def trial_summary(spark, folder):
    """Mean, deviation, standard error and quantiles over the trials of a cohort; groups that lack the value of a trial, or
    have fewer than two, are left out."""
    rows, key = trials(spark, folder), ["cohort", "source_name", "statistic"]
    flat = rows.groupBy(*key).agg(F.count("value").alias("num_trials"), F.count(F.lit(1)).alias("expected"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    flat = flat.where("num_trials >= 2 and num_trials = expected").withColumn("se", F.col("std") / F.sqrt("num_trials"))
    return flat.join(exact_quantiles(rows, key, "value", QUANTILES), key).select(*key, "num_trials", *nine(["mean", "std", "se", "q025", "q500", "q975"]))


def trial_wide(spark, folder):
    """The summary with statistics and metrics as columns."""
    rows = trial_summary(spark, folder)
    wide = rows.groupBy("cohort", "source_name").pivot("statistic", ["score", "worst", "coverage"])
    return wide.agg(F.max("mean").alias("mean"), F.max("std").alias("std"), F.max("q500").alias("q500"))


def trial_warnings(spark, folder):
    """Q7: experiments of a cohort that lack a source; trials without output or without a value; groups with too few or missing trials."""
    rows = items(spark, folder).withColumn("cohort", cohort(F.col("experiment_name")))
    held = rows.select("cohort", "experiment_name", "source_name").distinct()
    sources = held.groupBy("cohort").agg(F.collect_set("source_name").alias("wanted"))
    have = held.groupBy("cohort", "experiment_name").agg(F.collect_set("source_name").alias("have"))
    missing = have.join(sources, "cohort").withColumn("source_name", F.explode(F.array_except("wanted", "have")))
    warning = lambda df, kind, detail: df.select("cohort", "source_name", F.col(detail).alias("detail"), F.lit(kind).alias("warning"))
    unwritten = rows.groupBy("cohort", "source_name", "experiment_name").agg(F.count("output_path").alias("n")).where("n = 0")
    values = trials(spark, folder)
    blank = values.where("value is null").withColumn("detail", F.concat_ws("/", "experiment_name", "statistic"))
    groups = values.groupBy("cohort", "source_name", "statistic").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("expected"))
    out = warning(missing, "missing_source", "experiment_name").unionByName(warning(unwritten, "missing_output", "experiment_name"))
    out = out.unionByName(warning(blank, "missing_statistic", "detail")).unionByName(warning(groups.where("n < 2"), "too_few_trials", "statistic"))
    return out.unionByName(warning(groups.where("n <> expected"), "incomplete_statistic", "statistic"))


def ranked_runs(spark, folder):
    """Place of every item in its experiment by score, worst and names, missing figures last; the first is best."""
    rows = items(spark, folder)
    out = ranks(rows, "experiment_name", "score", [F.asc_nulls_last("worst"), F.asc("run_name"), F.asc("source_name")], "place")
    return out.select(*ITEM, "place", (F.col("place") == 1).alias("is_best"))


def winners(spark, folder):
    """L2: the best fit of every experiment."""
    order = F.struct(F.coalesce("score", F.lit(float("inf"))).alias("a"), F.coalesce("worst", F.lit(float("inf"))).alias("b"), "run_name", "source_name")
    rows = items(spark, folder).where("source_type = 'fit'")
    return rows.groupBy("experiment_name").agg(F.min_by(F.struct("run_name", "source_name", "row_id"), order).alias("w")).select("experiment_name", "w.*")


def recovery(spark, folder):
    """Frobenius and root mean square distance of two networks, and their sum with scalar errors where given."""
    a, b = symmetric_by_max(directed(spark, folder)), symmetric_by_mean(directed(spark, folder)).withColumnRenamed("w", "v")
    gap = F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))
    out = a.join(b, ["src", "dst"], "full_outer").agg(F.sqrt(F.sum(gap * gap)).alias("frobenius"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.abs(F.avg("w") - F.avg("v")).alias("scalar_error"))
    total = F.col("rmse") + F.coalesce("scalar_error", F.lit(0.0))
    return out.select(*nine(["frobenius", "rmse", "scalar_error"]), F.round(total, 9).alias("total"))


MATCH = ["source_type", "source_name", "source_slug", "run_name", "run_slug"]


def effects(spark, folder):
    """Mean over months of the treated series (100 sweeps) less the control's (50), over all months and from the third on."""
    rows = items(spark, folder).where(F.col("score").isNotNull()).withColumn("month", F.month("written"))
    series = rows.groupBy(*MATCH, "gibbs_sweeps", "month").agg(F.avg("score").alias("m"))
    means = series.groupBy(*MATCH, "gibbs_sweeps").agg(F.avg("m").alias("overall"), F.avg(F.when(F.col("month") >= 3, F.col("m"))).alias("post"))
    side = lambda sweeps, n: means.where(F.col("gibbs_sweeps") == sweeps).select(*MATCH, F.col("overall").alias(f"{n}_overall"), F.col("post").alias(f"{n}_post"))
    both = side(100, "treated").join(side(50, "control"), MATCH).where("treated_post is not null and control_post is not null")
    return both.select(*MATCH, F.round(F.col("treated_overall") - F.col("control_overall"), 9).alias("gte"), F.round(F.col("treated_post") - F.col("control_post"), 9).alias("gte_post_s"))


def target_errors(spark, folder):
    """Experiments with targets that name no experiment or no known type, truth targets without truth or with a name of their own, fit targets
    without a name, targets named twice, experiments without any output; a table without targets is an error of its own."""
    rows = table(spark, folder, "posterior_predictive_summary")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    kind = F.lower(F.trim(F.col("source_type")))
    known = F.coalesce(kind.isin("truth", "fit", "train_fit"), F.lit(False))
    each = {
        "no_experiment": blank("experiment_name"), "unknown_type": ~known, "fit_without_name": kind.isin("fit", "train_fit") & blank("source_name"),
        "truth_with_other_name": (kind == "truth") & (F.lower(F.trim("source_name")) != "truth"),
    }
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in each.items()]))
    by_row = rows.select("experiment_name", F.explode(found).alias("error")).distinct()
    flat = rows.groupBy("experiment_name").agg(F.count(F.when(kind == "truth", 1)).alias("truths"), F.count("output_path").alias("outputs"))
    lacking = F.array_compact(F.array(F.when(F.col("truths") == 0, "no_truth"), F.when(F.col("outputs") == 0, "no_output")))
    by_experiment = flat.select("experiment_name", F.explode(lacking).alias("error"))
    twice = rows.groupBy(*ITEM).count().where("count > 1").select("experiment_name", F.lit("duplicate_target").alias("error")).distinct()
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("experiment_name"), F.lit("no_targets").alias("error"))
    return by_row.unionByName(by_experiment).unionByName(twice).unionByName(empty)


SETTINGS = ["latent_rank", "num_samples", "gibbs_sweeps"]


def resumed_runs(spark, folder):
    """Of each item whether its first result can be reused for its last request: same settings (nulls equal), with
    output; else it runs again, or is an error where the settings differ but output exists."""
    rows = table(spark, folder, "posterior_predictive_summary")
    fields = F.struct(*SETTINGS, "output_path")
    by = F.struct("written_at", "row_id")
    both = rows.groupBy(*ITEM).agg(F.min_by(fields, by).alias("a"), F.max_by(fields, by).alias("b"), F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for s in SETTINGS:
        same = same & F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}"))
    action = F.when(F.col("a.output_path").isNull(), "rerun").when(same, "reuse").otherwise("error")
    return both.select(*ITEM, "n", action.alias("action"))


QUERIES = {f.__name__: f for f in (
    score_summary, source_summary, truth_calibration, calibration_summary, truth_comparison, truth_self, candidate_scores, chosen_candidates, trial_summary, trial_wide,
    trial_warnings, ranked_runs, winners, recovery, effects, target_errors, resumed_runs,
)}

ERRORS_SQL = """count(*) AS n, round(avg(abs(a - b)), 9) AS mae, round(avg(pow(a - b, 2)), 9) AS mse, round(sqrt(avg(pow(a - b, 2))), 9) AS rmse, round(max(abs(a - b)), 9) AS max_error,
  round(CASE WHEN stddev_pop(a) * sqrt(count(*)) < 1e-12 OR stddev_pop(b) * sqrt(count(*)) < 1e-12 THEN CASE WHEN max(abs(a - b)) <= 1e-12 THEN 1 ELSE 0 END ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS correlation"""

ORACLES = {
    "score_summary": f"""WITH {ITEMS_VIEW}, s AS (SELECT experiment_name, {SUMMARY_SQL}, avg(coverage) AS observed FROM items GROUP BY 1)
      SELECT experiment_name, n, round(mean, 9) AS mean, round(std, 9) AS std, round(q025, 9) AS q025, round(q500, 9) AS q500, round(q975, 9) AS q975, round(observed, 9) AS observed,
        round(abs(observed - mean), 9) AS abs_error, round(observed, 9) BETWEEN round(q025, 9) AND round(q975, 9) AS inside FROM s""",
    "source_summary": f"""WITH {ITEMS_VIEW}, s AS (SELECT source_name, {SUMMARY_SQL} FROM items GROUP BY 1), m AS (SELECT quantile_cont(score, 0.5) AS m FROM items), g AS (SELECT *, abs(mean - m) AS gap FROM s, m)
      SELECT count(*) AS sources, round(avg(gap), 9) AS mae, round(sqrt(avg(gap * gap)), 9) AS rmse, round(max(gap), 9) AS max_error, round(avg(CAST(m BETWEEN q025 AND q975 AS INTEGER)), 9) AS covered FROM g""",
    "truth_calibration": CALIBRATION_SQL + "SELECT * FROM calibrated",
    "calibration_summary": CALIBRATION_SQL + "SELECT count(z) FILTER (isfinite(z)) AS n, round(avg(abs(z)) FILTER (isfinite(z)), 6) AS mean_abs_z, round(max(abs(z)) FILTER (isfinite(z)), 6) AS max_abs_z, round(avg(CAST(inside AS INTEGER)), 6) AS coverage_rate FROM calibrated",
    "truth_comparison": f"""WITH {ITEMS_VIEW}, t AS (SELECT experiment_name, run_name, max(score) AS truth FROM items WHERE source_type = 'truth' GROUP BY 1, 2 HAVING count(*) = 1),
      p AS (SELECT source_name, score AS a, truth AS b FROM items JOIN t USING (experiment_name, run_name) WHERE source_type <> 'truth' AND score IS NOT NULL AND truth IS NOT NULL) SELECT source_name, {ERRORS_SQL} FROM p GROUP BY 1""",
    "truth_self": f"WITH {ITEMS_VIEW}, p AS (SELECT experiment_name, score AS a, score AS b FROM items WHERE source_type = 'truth' AND score IS NOT NULL) SELECT experiment_name, {ERRORS_SQL} FROM p GROUP BY 1",
    "candidate_scores": FOLDS_SQL + "SELECT experiment_name, run_name, completed, status, " + ", ".join(f"round({v}_{k}, 9) AS {v}_{k}" for v in ("score", "coverage") for k in ("weighted", "mean", "se")) + " FROM candidates",
    "chosen_candidates": CHOICE_SQL,
    "trial_summary": f"WITH {TRIALS_VIEW} SELECT * FROM summary",
    "trial_wide": f"WITH {TRIALS_VIEW} SELECT cohort, source_name, "
    + ", ".join(f"max({m}) FILTER (statistic = '{s}') AS {s}_{m}" for s in ("score", "worst", "coverage") for m in ("mean", "std", "q500"))
    + " FROM summary GROUP BY 1, 2",
    "trial_warnings": f"""WITH {TRIALS_VIEW}, held AS (SELECT DISTINCT cohort, experiment_name, source_name FROM means), w AS (SELECT DISTINCT cohort, source_name FROM held)
      SELECT w.cohort, w.source_name, e.experiment_name AS detail, 'missing_source' AS warning FROM (SELECT DISTINCT cohort, experiment_name FROM held) e JOIN w USING (cohort)
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.cohort = w.cohort AND h.experiment_name = e.experiment_name AND h.source_name = w.source_name)
      UNION ALL SELECT cohort, source_name, statistic, 'too_few_trials' FROM trials GROUP BY 1, 2, 3 HAVING count(value) < 2
      UNION ALL SELECT cohort, source_name, statistic, 'incomplete_statistic' FROM trials GROUP BY 1, 2, 3 HAVING count(value) <> count(*)
      UNION ALL SELECT cohort, source_name, experiment_name || '/' || statistic, 'missing_statistic' FROM trials WHERE value IS NULL
      UNION ALL SELECT regexp_replace(experiment_name, '_[0-9]+$', ''), source_name, experiment_name, 'missing_output' FROM items GROUP BY 1, 2, 3 HAVING count(output_path) = 0""",
    "ranked_runs": f"""WITH {ITEMS_VIEW}, r AS (SELECT experiment_name, run_name, source_name, CAST(row_number() OVER (PARTITION BY experiment_name ORDER BY score NULLS LAST, worst NULLS LAST, run_name, source_name) AS INTEGER) AS place FROM items)
      SELECT *, place = 1 AS is_best FROM r""",
    "winners": f"""WITH {ITEMS_VIEW} SELECT experiment_name, run_name, source_name, row_id FROM items WHERE source_type = 'fit'
      QUALIFY row_number() OVER (PARTITION BY experiment_name ORDER BY score NULLS LAST, worst NULLS LAST, run_name, source_name) = 1""",
    "recovery": f"""WITH {DIRECTED_VIEW}, j AS (SELECT coalesce(a.w, 0) - coalesce(b.w, 0) AS gap, a.w AS w, b.w AS v FROM maxed a FULL JOIN meant b ON a.src = b.src AND a.dst = b.dst)
      SELECT round(sqrt(sum(gap * gap)), 9) AS frobenius, round(sqrt(avg(gap * gap)), 9) AS rmse, round(abs(avg(w) - avg(v)), 9) AS scalar_error, round(sqrt(avg(gap * gap)) + abs(avg(w) - avg(v)), 9) AS total FROM j""",
    "effects": f"""WITH {ITEMS_VIEW}, s AS (SELECT {", ".join(MATCH)}, gibbs_sweeps, month(written_at) AS month, avg(score) AS m FROM items WHERE score IS NOT NULL GROUP BY ALL),
      g AS (SELECT {", ".join(MATCH)}, gibbs_sweeps, avg(m) AS overall, avg(m) FILTER (month >= 3) AS post FROM s GROUP BY ALL)
      SELECT {", ".join(MATCH)}, round(a.overall - b.overall, 9) AS gte, round(a.post - b.post, 9) AS gte_post_s FROM (SELECT * FROM g WHERE gibbs_sweeps = 100) a JOIN (SELECT * FROM g WHERE gibbs_sweeps = 50) b USING ({", ".join(MATCH)})
      WHERE a.post IS NOT NULL AND b.post IS NOT NULL""",
    "target_errors": """WITH t AS (SELECT *, lower(trim(source_type)) AS kind FROM posterior_predictive_summary)
      SELECT DISTINCT experiment_name, 'no_experiment' AS error FROM t WHERE coalesce(trim(experiment_name), '') = ''
      UNION ALL SELECT DISTINCT experiment_name, 'unknown_type' FROM t WHERE kind IS NULL OR kind NOT IN ('truth', 'fit', 'train_fit')
      UNION ALL SELECT DISTINCT experiment_name, 'fit_without_name' FROM t WHERE kind IN ('fit', 'train_fit') AND coalesce(trim(source_name), '') = ''
      UNION ALL SELECT DISTINCT experiment_name, 'truth_with_other_name' FROM t WHERE kind = 'truth' AND lower(trim(source_name)) <> 'truth'
      UNION ALL SELECT experiment_name, 'no_truth' FROM t GROUP BY 1 HAVING count(*) FILTER (kind = 'truth') = 0
      UNION ALL SELECT DISTINCT experiment_name, 'duplicate_target' FROM (SELECT experiment_name FROM t GROUP BY experiment_name, run_name, source_name HAVING count(*) > 1)
      UNION ALL SELECT experiment_name, 'no_output' FROM t GROUP BY 1 HAVING count(output_path) = 0
      UNION ALL SELECT NULL, 'no_targets' FROM (SELECT count(*) AS n FROM t) WHERE n = 0""",
    "resumed_runs": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY experiment_name, run_name, source_name ORDER BY written_at, row_id) AS a, row_number() OVER (PARTITION BY experiment_name, run_name, source_name ORDER BY written_at DESC, row_id DESC) AS b,
        count(*) OVER (PARTITION BY experiment_name, run_name, source_name) AS n FROM posterior_predictive_summary)
      SELECT x.experiment_name, x.run_name, x.source_name, x.n, CASE WHEN x.output_path IS NULL THEN 'rerun' WHEN x.latent_rank IS NOT DISTINCT FROM y.latent_rank AND x.num_samples IS NOT DISTINCT FROM y.num_samples
        AND x.gibbs_sweeps IS NOT DISTINCT FROM y.gibbs_sweeps THEN 'reuse' ELSE 'error' END AS action
      FROM o x JOIN o y ON x.experiment_name = y.experiment_name AND x.run_name = y.run_name AND x.source_name = y.source_name WHERE x.a = 1 AND y.b = 1""",
}
