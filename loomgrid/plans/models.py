"""Queries of fits, spectra, simulations and completions of the panel; checked by tests, as SQL can't express them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.complete import complete
from loomgrid.operators.fits import fit_low_rank, fit_nuclear, fit_scalars, seed_of, spectrum
from loomgrid.operators.graph import nearest
from loomgrid.operators.metrics import masked_means, six_masks
from loomgrid.operators.panel import time_index
from loomgrid.operators.simulate import gibbs, gibbs_panels
from loomgrid.operators.synthetic import confounded_panel
from loomgrid.plans.graphs import fold_roles, gamma, steps_of
from loomgrid.plans.problems import positions
from loomgrid.plans.scores import BETA, ETA, XI, slots
from loomgrid.plans.views import PANEL_VIEW, cells, first_treated, panel
from loomgrid.session import cut_lineage

DRAWS, SWEEPS, SEED = 8, 20, 7
#: Relative change of the objective at which the registered fits end.
TOL = 1e-3


def scalar_fit(spark, folder):
    """Beta, xi and eta without a field, over all slots and with beta masked to the times from s on."""
    rows = slots(spark, folder)
    fits = {"free": fit_scalars(rows), "xi_zero": fit_scalars(rows, fixed={"xi": 0.0}), "beta_post_s": fit_scalars(rows, beta_mask=F.col("t") >= first_treated(panel(spark, folder)))}
    return spark.createDataFrame([(k, v["beta"], v["xi"], v["eta"], v["loss"]) for k, v in fits.items()], "variant string, beta double, xi double, eta double, loss double")


def low_rank_fit(spark, folder):
    """M5, M8: scalars and rank-2 factors, the better of two starts; the units' factors with their field's size."""
    rows = slots(spark, folder)
    scalars, u, factors = fit_low_rank(rows, steps_of(spark, folder), rank=2, ridge=1.0, column_max=50.0, tol=TOL, starts=2, mask=F.col("training"))
    norms = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    return factors.select("unit", "v", norms.alias("norm"), F.lit(scalars["beta"]).alias("beta"), F.lit(scalars["xi"]).alias("xi"), F.lit(scalars["eta"]).alias("eta"), F.lit(scalars["loss"]).alias("loss"), F.lit(len(scalars["objective"])).alias("steps"), F.lit(scalars["converged"]).alias("converged"))


def nuclear_fit(spark, folder):
    """M3: the singular values of the field and the course of the objective."""
    fit = fit_nuclear(slots(spark, folder), steps_of(spark, folder), weight=0.05, tol=TOL)
    rows = [("singular_value", i + 1, float(v)) for i, v in enumerate(fit["singular_values"])] + [("objective", i + 1, float(v)) for i, v in enumerate(fit["objective"])]
    return spark.createDataFrame(rows, "kind string, place int, value double")


def fixed_rank_fit(spark, folder):
    """M4: the singular values and the course of the loss of a field of rank 2."""
    fit = fit_nuclear(slots(spark, folder), steps_of(spark, folder), weight=0.0, rank=2, tol=TOL)
    rows = [("singular_value", i + 1, float(v)) for i, v in enumerate(fit["singular_values"])] + [("loss", i + 1, float(v)) for i, v in enumerate(fit["objective"])]
    return spark.createDataFrame(rows, "kind string, place int, value double")


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """(place, singular_value, energy, cumulative, ratio) of the outcomes, largest first; energies are shares."""
    rows, schema = slots(spark, folder), "place int, singular_value double, energy double, cumulative double, ratio double"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    values = spectrum(rows, steps_of(spark, folder))
    energy = values**2 / max((values**2).sum(), 1e-300)
    ratio = np.append(values[:-1] / np.maximum(values[1:], 1e-12), np.nan)
    frame = pd.DataFrame({"place": np.arange(1, len(values) + 1), "singular_value": values, "energy": energy, "cumulative": np.cumsum(energy), "ratio": ratio})
    return spark.createDataFrame(frame, schema)  # a row per time of the calendar


def panel_spectrum(spark, folder):
    """Singular values of the outcomes, their energy, energy so far, and the ratio to the next."""
    return spectra(spark, folder)


def spectrum_report(spark, folder):
    """Ranks that reach shares of the energy, the elbow (the greatest ratio up to the rank of 90 %), norms, the greatest entry, and how low the rank is."""
    rows = spectra(spark, folder)
    rank = lambda share: F.least(F.count(F.when(F.col("cumulative") < share, 1)) + 1, F.count(F.lit(1))).cast("int")
    out = rows.agg(
        *[rank(share / 100).alias(f"rank_{share}") for share in (80, 90, 95, 99)], F.max("singular_value").alias("spectral_norm"), F.sum("singular_value").alias("nuclear_norm"),
        F.sqrt(F.sum(F.col("singular_value") * F.col("singular_value"))).alias("frobenius_norm"), F.max(F.when(F.col("place") == 1, F.col("energy"))).alias("leading_share"),
        F.sort_array(F.collect_list(F.when(~F.isnan("ratio"), F.struct("place", "ratio")))).alias("ratios"),
    )
    inside = F.filter("ratios", lambda r: r["place"] <= F.greatest("rank_90", F.lit(1)))
    best = F.array_max(F.transform(inside, lambda r: F.struct(r["ratio"].alias("ratio"), (-r["place"]).alias("p"))))
    low = F.when((F.col("rank_90") <= 2) & (F.col("rank_95") <= 4) & (F.col("leading_share") >= 0.5), "strong").when((F.col("rank_90") <= 6) & (F.col("rank_95") <= 12) & (F.col("leading_share") >= 0.2), "moderate").otherwise("weak")
    top = panel(spark, folder).agg(F.max(F.abs("x"))).scalar()
    return out.select(*[f"rank_{s}" for s in (80, 90, 95, 99)], (-best["p"]).alias("elbow"), best["ratio"].alias("elbow_ratio"), "spectral_norm", "nuclear_norm", "frobenius_norm", top.alias("max_abs"), "leading_share", low.alias("low_rank"))


def spectrum_energy(spark, folder):
    """M9: what the spectrum must add up to: the sum of squares of all entries."""
    return spectra(spark, folder).agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 6).alias("sum_of_squares"))


def scalar_gradients(spark, folder):
    """The gradients at the fitted scalars of each variant, to six digits; those of fixed scalars are not fitted."""
    rows = slots(spark, folder).withColumn("post", F.col("t") >= first_treated(panel(spark, folder)))
    each = None
    for r in scalar_fit(spark, folder).collect():  # three rows
        h = r.beta * F.col("z") + r.xi * F.col("neighbours") + r.eta * F.col("prev_x")
        gap = F.tanh(h) - F.col("x")
        beta = F.avg(F.when(F.col("post"), gap * F.col("z"))) if r.variant == "beta_post_s" else F.avg(gap * F.col("z"))
        xi = F.lit(0.0) if r.variant == "xi_zero" else F.avg(gap * F.col("neighbours"))
        one = rows.agg(*[F.round(F.abs(c), 6).alias(n) for n, c in (("beta", beta), ("xi", xi), ("eta", F.avg(gap * F.col("prev_x"))))], F.count(F.lit(1)).alias("slots"))
        one = one.withColumn("variant", F.lit(r.variant))
        each = one if each is None else each.unionByName(one)
    return each


def draw_seeds(spark, folder):
    """the seed of each draw of each item, as text (it exceeds a signed 64-bit number)."""
    from loomgrid.plans.reports import items

    @F.pandas_udf("string")
    def seeds(e: pd.Series, r: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([str(seed_of(*x)) for x in zip(e, r, s, d)])

    rows = items(spark, folder).select("experiment_name", "run_name", "source_name", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("draw"))
    return rows.withColumn("seed", seeds("experiment_name", "run_name", "source_name", "draw"))


def held_out_draws(spark, folder):
    """Held-out slots of fold 1 drawn given all others; observed and drawn means per mask and their distance."""
    held = fold_roles(spark, folder).where("fold = 1 and role = 'validation'").select("t", "unit", F.lit(True).alias("free"))
    # written once: all later plans, those of the rounds of the components too, begin with these rows
    rows = cut_lineage(panel(spark, folder).join(held, ["t", "unit"], "left").withColumn("free", F.coalesce("free", F.lit(False))))
    edges = cut_lineage(gamma(spark, folder).where(F.col("src") < F.col("dst")))
    drawn = cut_lineage(gibbs(rows, edges, "free", DRAWS, SWEEPS, BETA, ETA, XI, SEED))
    both = drawn.withColumnRenamed("x", "drawn").join(rows.select("unit", "t", "x", "z"), ["unit", "t"])
    both = both.withColumn("post", F.col("t") >= first_treated(rows))
    masks = six_masks(F.lit(True), F.col("post"), F.col("z") > 0)
    seen = masked_means(both, masks, F.col("x")).select("mask", F.col("slots"), F.col("mean").alias("observed"))
    return seen.join(masked_means(both, masks, F.col("drawn")).select("mask", F.col("mean").alias("drawn")), "mask").withColumn("distance", F.abs(F.col("observed") - F.col("drawn")))


def counterfactual_draws(spark, folder):
    """Panels drawn under all-on and never-on interventions on the whole graph, time means and the treatment effect."""
    rows = cut_lineage(panel(spark, folder))
    edges = cut_lineage(gamma(spark, folder).where(F.col("src") < F.col("dst")))
    out = None
    for name, z in (("full_on_all_time", 1), ("full_on_no_time", -1)):
        drawn = gibbs_panels(rows.withColumn("z", F.lit(z)), edges, DRAWS, SWEEPS, BETA, ETA, XI, SEED)
        means = drawn.groupBy("t").agg(F.avg("x").alias("mean"), F.count_distinct("draw").alias("draws")).withColumn("intervention", F.lit(name))
        out = means if out is None else out.unionByName(means)
    return out


def completed_panel(spark, folder):
    """Outcomes that are not observed, from the series of the nearest areas that have one, else of any."""
    rows = cells(spark, folder).where("panel_key = 'x'")
    rows = cut_lineage(rows.join(time_index(rows, "week"), "week").select("unit", "t", "value"))
    held = rows.where(F.col("value").isNotNull()).select(F.col("unit").alias("code")).distinct()
    near = nearest(positions(spark, folder).join(held, "code", "left_semi"), "code", "centroid_x", "centroid_y", 12).select(F.col("code").alias("unit"), "neighbor", "place")
    return complete(rows, near, steps_of(spark, folder))


def synthetic_panel(spark, folder):
    """A confounded field and interventions over the areas of the binary panel and its weeks."""
    units = cells(spark, folder).select("unit").distinct()
    return confounded_panel(units, "unit", steps_of(spark, folder), [0.8, 0.5, 0.3, 0.2], shared=2, own=2, slope=0.15, seed=SEED)


QUERIES = {f.__name__: f for f in (scalar_fit, low_rank_fit, nuclear_fit, fixed_rank_fit, panel_spectrum, spectrum_report, spectrum_energy, scalar_gradients, draw_seeds, held_out_draws, counterfactual_draws, completed_panel, synthetic_panel)}
# Fits are checked by what must hold at their end: gradients vanish, energies add up.
ORACLES = {
    "spectrum_energy": f"WITH {PANEL_VIEW} SELECT round(sum(x * x)::DOUBLE, 6) AS sum_of_squares FROM panel",
    "scalar_gradients": f"WITH {PANEL_VIEW} SELECT variant, 0::DOUBLE AS beta, 0::DOUBLE AS xi, 0::DOUBLE AS eta, count(*) AS slots FROM panel, (SELECT unnest(['free', 'xi_zero', 'beta_post_s']) AS variant) GROUP BY 1",
}
