"""Queries of the binary panel: thresholds, fills, lags, summaries, supports, interventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code
from loomgrid.functions.scalars import experiment_name, experiment_part, plus_minus
from loomgrid.operators.panel import (
    before_first_report, centred, dense_index, dense_suffix, interventions, lagged, start_and_end, time_index, with_change,
)
from loomgrid.plans.ingest import RATES_SQL, weeks
from loomgrid.plans.views import CELLS_VIEW, CODE, FIRST_TREATED, PANEL_VIEW, cells, first_treated, panel, population
from loomgrid.sources.tables import table

# Fixed values of the catalogue: outcome and coverage thresholds, lags, networks.
DEATH_RATES, COVERAGES = (1.0, 2.0, 5.0), (10, 20, 30, 40, 50, 60, 70, 80)
LAGS, NETWORKS = ("0w", "1w", "2w", "3w", "4w"), ("contiguity", "knn_8", "distance_kernel_8")
NON_MAINLAND = ("02", "15", "60", "66", "69", "72", "78")
LEAST_POPULATION = 2000


def binary(spark: SparkSession, folder: str) -> DataFrame:
    """(fips, week_end, rate, share, x, z, z_lag): weekly rates and shares of people as -1 / +1 with pre-report fill and lag."""
    rows = weeks(spark, folder).join(population(spark, folder), "fips", "left")
    per = lambda c, f: F.when(F.col("population") > 0, F.col(c) * F.lit(f) / F.col("population"))
    rows = rows.select("fips", "week_end", per("new_deaths", 1e5).alias("rate"), F.when(F.col("cases") > 0, per("cases", 100.0)).alias("share"))
    rows = rows.withColumns({"x": plus_minus(F.col("rate"), 2.0), "z": plus_minus(F.col("share"), 1.0)})
    rows = rows.withColumn("z", before_first_report(rows, "fips", "week_end", "share", "z"))
    return rows.withColumn("z_lag", lagged("fips", "week_end", "z", 2))


BINARY_VIEW = RATES_SQL.rstrip() + """,
 coded AS (
   SELECT fips, week_end, death_rate AS rate, CASE WHEN share > 0 THEN share END AS share FROM rates),
 signs AS (
   SELECT *, CASE WHEN rate IS NULL THEN NULL WHEN rate >= 2 THEN 1 ELSE -1 END AS x,
     CASE WHEN week_end < min(CASE WHEN share IS NOT NULL THEN week_end END) OVER (PARTITION BY fips) THEN -1 WHEN share IS NULL THEN NULL WHEN share >= 1 THEN 1 ELSE -1 END AS z FROM coded),
 binaries AS (
   SELECT *, coalesce(lag(z, 2) OVER w, CASE WHEN row_number() OVER w <= 2 THEN -1 END) AS z_lag FROM signs WINDOW w AS (PARTITION BY fips ORDER BY week_end))
"""


def binary_panel(spark, folder):
    """Thresholds, fill before the first report, lag by two weeks."""
    return binary(spark, folder).select("fips", "week_end", "x", "z", "z_lag")


def threshold_catalog(spark, folder):
    """F4 over the whole catalogue of thresholds: eligible rows, +1 rows and their share per threshold."""
    rows = binary(spark, folder)
    marks = [F.struct(F.lit(f"death_rate_100k_ge_{t:g}").alias("code"), plus_minus(F.col("rate"), t).alias("v")) for t in DEATH_RATES]
    marks += [F.struct(F.lit(f"share_ge_{t}").alias("code"), plus_minus(F.col("share"), t / 10).alias("v")) for t in COVERAGES]
    each = rows.select(F.explode(F.array(*marks)).alias("m")).select("m.*")
    out = each.groupBy("code").agg(F.count("v").alias("eligible"), F.count(F.when(F.col("v") == 1, 1)).alias("positive"))
    return out.withColumn("positive_share", F.round(F.try_divide("positive", "eligible"), 6))


CHANGES_VIEW = f"""WITH {CELLS_VIEW},
 changes AS (
   SELECT *, CASE WHEN value IS NOT NULL AND lag(value) OVER w IS NOT NULL THEN CAST(value <> lag(value) OVER w AS DOUBLE) END AS changed
   FROM cells WINDOW w AS (PARTITION BY code, unit ORDER BY week))
"""


def binary_summary(spark, folder):
    """Per code eligible and positive rows, population variance, transition rate, units with both or one state."""
    rows = with_change(cells(spark, folder), ["code", "unit"], "week", "value")
    units = rows.groupBy("code", "unit").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    units = units.groupBy("code").agg(
        F.count(F.when(F.col("low") < F.col("high"), 1)).alias("units_with_both"), F.count(F.when(F.col("low") == F.col("high"), 1)).alias("constant_units")
    )
    out = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("eligible"), F.round(F.count("value") / F.count(F.lit(1)), 6).alias("eligible_share"),
        F.round(F.avg((F.col("value") == 1).cast("int")), 6).alias("positive_share"), F.round(F.var_pop("value"), 6).alias("variance"),
        F.round(F.avg("changed"), 6).alias("transition_rate"), F.count_distinct("week").alias("weeks"), F.count_distinct("unit").alias("units"),
        F.min(F.when(F.col("value").isNotNull(), F.col("week"))).alias("first_week"), F.max(F.when(F.col("value").isNotNull(), F.col("week"))).alias("last_week"),
    )
    return out.join(units, "code")


def weekly_shares(spark, folder):
    """Per code and week units, eligible, +1, -1, and the +1 share of eligible and of all."""
    out = cells(spark, folder).groupBy("code", "week").agg(
        F.count_distinct("unit").alias("units"), F.count("value").alias("eligible"),
        F.count(F.when(F.col("value") == 1, 1)).alias("plus"), F.count(F.when(F.col("value") == -1, 1)).alias("minus"),
    )
    return out.withColumns({"share_of_eligible": F.round(F.try_divide("plus", "eligible"), 6), "share_of_all": F.round(F.col("plus") / F.col("units"), 6)})


def prevalence(spark, folder):
    """Pooled share of +1 per code."""
    return cells(spark, folder).where(F.col("value").isNotNull()).groupBy("code").agg(F.round(F.avg((F.col("value") == 1).cast("int")), 6).alias("prevalence"), F.count(F.lit(1)).alias("n"))


def lag_correlation(spark, folder):
    """A10: correlation of the outcome with the intervention two rows before, over complete pairs."""
    rows = binary(spark, folder).withColumn("before", F.lag("z", 2).over(Window.partitionBy("fips").orderBy("week_end")))
    pairs = rows.where(F.col("x").isNotNull() & F.col("before").isNotNull())
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "before"), 6).alias("correlation"))


def county_summary(spark, folder):
    """Per area last names, largest population and area, and its competition rank by population (none without)."""
    nodes = table(spark, folder, "node_geography").withColumn("fips", area_code(F.col("fips"))).where("fips is not null")
    rows = nodes.groupBy("fips").agg(
        F.max_by("county", F.struct("created_at", "county")).alias("county"), F.max("total_population").alias("population"), F.max("land_area_sq_km").alias("land_area")
    )
    # competition rank without ordering all rows in one task: count the distinct populations above
    counts = rows.where("population is not null").groupBy("population").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.log2(F.col("population") + F.lit(1.0)) * 64).cast("int")
    counts = counts.withColumn("bucket", bucket)
    above = counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn(
        "above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(F.desc("population")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("inside", inside).join(above.select("bucket", "above"), "bucket").select("population", (F.col("inside") + F.col("above") + 1).alias("rank"))
    return rows.join(ranks, "population", "left").select("fips", "county", "population", "land_area", "rank")


def trim_scope(spark, folder):
    """areas outside the mainland or with too few people, counted by the first reason that holds."""
    nodes = table(spark, folder, "node_geography").withColumn("fips", area_code(F.col("fips"))).where("fips is not null")
    nodes = nodes.groupBy("fips").agg(F.max("total_population").alias("population"))
    outside = F.substring("fips", 1, 2).isin(*NON_MAINLAND)
    keep = ~outside & F.coalesce(F.col("population") >= LEAST_POPULATION, F.lit(False))
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return nodes.agg(
        count(keep, "kept"), count(~keep, "excluded"), count(outside, "non_mainland"),
        count(~outside & (F.col("population") < LEAST_POPULATION), "below_threshold"), count(~outside & F.col("population").isNull(), "missing_population"),
    )


def experiment_grid(spark, folder):
    """Interventions x outcomes x lags x networks as names, and the parts read back from the names."""
    codes = table(spark, folder, "realized_binary_artifact").select("panel_key", "code").distinct()
    sets = codes.groupBy(F.lit(1).alias("one")).agg(*[F.sort_array(F.collect_set(F.when(F.col("panel_key") == k, F.col("code")))).alias(k) for k in ("x", "z")])
    grid = sets.select(F.explode("x").alias("outcome"), "z").select("outcome", F.explode("z").alias("intervention"))
    grid = grid.select("outcome", "intervention", F.explode(F.array(*map(F.lit, LAGS))).alias("lag"))
    grid = grid.select("outcome", "intervention", "lag", F.explode(F.array(*map(F.lit, NETWORKS))).alias("network"))
    name = experiment_name(F.col("outcome"), F.col("intervention"), F.col("lag"), F.col("network"))
    grid = grid.select(name.alias("name"))
    steps = F.regexp_replace(experiment_part(F.col("name"), 2, "lag_"), "w$", "").cast("int")
    return grid.select("name", experiment_part(F.col("name"), 0, "outcome_").alias("outcome"), experiment_part(F.col("name"), 1, "intervention_").alias("intervention"), steps.alias("lag_steps"))


def realized_panel(spark, folder):
    """Long cells as (t, unit number) per panel, the first week as the initial state t = -1."""
    rows = cells(spark, folder).where(F.col("week").between(F.lit("2020-01-26").cast("date"), F.lit("2022-05-15").cast("date")))
    rows = dense_index(rows, "unit").withColumnRenamed("number", "unit_index")
    return rows.join(time_index(rows, "week", first=-1), "week").select("panel_key", "code", "unit", "unit_index", "week", "t", "value", F.col("value").isNotNull().alias("observed"))


def dense_support(spark, folder):
    """The start and units of the largest complete suffix of cells with both panels observed."""
    wide = panel(spark, folder)
    grid = table(spark, folder, "realized_binary_artifact").select(F.col("week_end_date").alias("week")).distinct()
    every = time_index(grid, "week").select("t")
    both = wide.withColumn("both", F.lit(1)).select("unit", "t", "both").unionByName(every.select(F.lit("").alias("unit"), "t", F.lit(None).cast("int").alias("both")))
    return dense_suffix(both, "unit", "t", "both")


def panel_slice(spark, folder):
    """The panel from a start week on, re-indexed; that week becomes the initial state t = -1."""
    rows = panel(spark, folder).where(F.col("week") >= F.lit("2020-03-01").cast("date")).drop("t")
    return rows.join(time_index(rows, "week", first=-1), "week").select("unit", "week", "t", "x", "z")


def intervention_library(spark, folder):
    """Saved interventions over the grid with s and e of each."""
    rows = panel(spark, folder).select("unit", "t", "z")
    sets = interventions(rows, "t", "z", first_treated(rows))
    first = sets.groupBy("intervention", "unit").agg(F.min(F.when(F.col("z_set") == 1, F.col("t"))).alias("first"), F.max("t").alias("last"), F.sum("z_set").alias("total"))
    return first.groupBy("intervention").agg(
        F.coalesce(F.min("first"), F.max("last") + 1).alias("s"), F.coalesce(F.max("first") + 1, F.lit(0)).alias("e"), F.sum("total").alias("z_total")
    )


def single_unit_on(spark, folder):
    """One unit treated from a step on, the others never."""
    rows = panel(spark, folder).select("unit", "t")
    first = rows.agg(F.min("unit")).scalar()
    return rows.withColumn("z_set", F.when((F.col("unit") == first) & (F.col("t") >= 3), 1).otherwise(-1))


def treatment_window(spark, folder):
    """S and e of the observed panel."""
    rows = panel(spark, folder)
    return start_and_end(rows, "unit", "t", "z", F.max("last") + 1).select("s", "e")


def field_views(spark, folder):
    """raw, row-centred and double-centred outcomes."""
    out = centred(panel(spark, folder).select("unit", "t", F.col("x").cast("double").alias("x")), "t", "unit", "x")
    return out.select("unit", "t", "x", F.round("row_centred", 6).alias("row_centred"), F.round("double_centred", 6).alias("double_centred"))


QUERIES = {f.__name__: f for f in (
    binary_panel, threshold_catalog, binary_summary, weekly_shares, prevalence, lag_correlation, county_summary, trim_scope, experiment_grid,
    realized_panel, dense_support, panel_slice, intervention_library, single_unit_on, treatment_window, field_views,
)}

ORACLES = {
    "binary_panel": BINARY_VIEW + "SELECT fips, week_end, x, z, z_lag FROM binaries",
    "threshold_catalog": BINARY_VIEW + ", each AS ("
    + " UNION ALL ".join(
        [f"SELECT 'death_rate_100k_ge_{t:g}' AS code, CASE WHEN rate IS NULL THEN NULL WHEN rate >= {t} THEN 1 ELSE -1 END AS v FROM binaries" for t in DEATH_RATES]
        + [f"SELECT 'share_ge_{t}', CASE WHEN share IS NULL THEN NULL WHEN share >= {t / 10} THEN 1 ELSE -1 END FROM binaries" for t in COVERAGES]
    )
    + ") SELECT code, count(v) AS eligible, count(CASE WHEN v = 1 THEN 1 END) AS positive, round(count(CASE WHEN v = 1 THEN 1 END) / count(v), 6) AS positive_share FROM each GROUP BY code",
    "binary_summary": CHANGES_VIEW + """, units AS (SELECT code, unit, min(value) AS low, max(value) AS high FROM cells GROUP BY 1, 2),
      per_unit AS (SELECT code, count(CASE WHEN low < high THEN 1 END) AS units_with_both, count(CASE WHEN low = high THEN 1 END) AS constant_units FROM units GROUP BY 1)
      SELECT c.code, count(*) AS n_rows, count(value) AS eligible, round(count(value) / count(*), 6) AS eligible_share, round(avg(CAST(value = 1 AS INTEGER)), 6) AS positive_share,
        round(var_pop(value), 6) AS variance, round(avg(changed), 6) AS transition_rate, count(DISTINCT week) AS weeks, count(DISTINCT unit) AS units,
        min(CASE WHEN value IS NOT NULL THEN week END) AS first_week, max(CASE WHEN value IS NOT NULL THEN week END) AS last_week, any_value(units_with_both) AS units_with_both, any_value(constant_units) AS constant_units
      FROM changes c JOIN per_unit p ON p.code = c.code GROUP BY c.code""",
    "weekly_shares": f"""WITH {CELLS_VIEW} SELECT code, week, count(DISTINCT unit) AS units, count(value) AS eligible, count(CASE WHEN value = 1 THEN 1 END) AS plus, count(CASE WHEN value = -1 THEN 1 END) AS minus,
      CASE WHEN count(value) > 0 THEN round(count(CASE WHEN value = 1 THEN 1 END) / count(value), 6) END AS share_of_eligible, round(count(CASE WHEN value = 1 THEN 1 END) / count(DISTINCT unit), 6) AS share_of_all FROM cells GROUP BY 1, 2""",
    "prevalence": f"WITH {CELLS_VIEW} SELECT code, round(avg(CAST(value = 1 AS INTEGER)), 6) AS prevalence, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1",
    "lag_correlation": BINARY_VIEW + """, p AS (SELECT x, lag(z, 2) OVER (PARTITION BY fips ORDER BY week_end) AS before FROM binaries)
      SELECT count(*) AS n, round(corr(x, before), 6) AS correlation FROM p WHERE x IS NOT NULL AND before IS NOT NULL""",
    "county_summary": f"""WITH r AS (SELECT {CODE} AS fips, max_by(county, (created_at, county)) AS county, max(total_population) AS population, max(land_area_sq_km) AS land_area FROM node_geography WHERE {CODE} IS NOT NULL GROUP BY 1)
      SELECT *, CASE WHEN population IS NOT NULL THEN rank() OVER (ORDER BY population DESC NULLS LAST) END AS rank FROM r""",
    "trim_scope": f"""WITH n AS (SELECT {CODE} AS fips, max(total_population) AS population FROM node_geography WHERE {CODE} IS NOT NULL GROUP BY 1),
      j AS (SELECT *, left(fips, 2) IN {NON_MAINLAND} AS outside FROM n), k AS (SELECT *, NOT outside AND coalesce(population >= {LEAST_POPULATION}, false) AS keep FROM j)
      SELECT count(CASE WHEN keep THEN 1 END) AS kept, count(CASE WHEN NOT keep THEN 1 END) AS excluded, count(CASE WHEN outside THEN 1 END) AS non_mainland,
        count(CASE WHEN NOT outside AND population < {LEAST_POPULATION} THEN 1 END) AS below_threshold, count(CASE WHEN NOT outside AND population IS NULL THEN 1 END) AS missing_population FROM k""",
    "experiment_grid": f"""SELECT 'outcome_' || x.code || '__intervention_' || z.code || '__lag_' || l.v || '__' || n.v AS name, x.code AS outcome, z.code AS intervention, CAST(rtrim(l.v, 'w') AS INTEGER) AS lag_steps
      FROM (SELECT DISTINCT code FROM realized_binary_artifact WHERE panel_key = 'x') x, (SELECT DISTINCT code FROM realized_binary_artifact WHERE panel_key = 'z') z,
        (SELECT unnest({list(LAGS)}) AS v) l, (SELECT unnest({list(NETWORKS)}) AS v) n""",
    "realized_panel": f"""WITH {CELLS_VIEW} SELECT panel_key, code, unit, CAST(dense_rank() OVER (ORDER BY unit) - 1 AS INTEGER) AS unit_index, week, CAST(dense_rank() OVER (ORDER BY week) - 2 AS INTEGER) AS t, value, value IS NOT NULL AS observed
      FROM cells WHERE week BETWEEN DATE '2020-01-26' AND DATE '2022-05-15'""",
    "dense_support": f"""WITH {PANEL_VIEW}, w AS (SELECT DISTINCT t FROM wide), u AS (SELECT DISTINCT unit FROM panel),
      gaps AS (SELECT u.unit, coalesce(max(CASE WHEN p.unit IS NULL THEN w.t END), -1) AS gap FROM u CROSS JOIN w LEFT JOIN panel p ON p.unit = u.unit AND p.t = w.t GROUP BY 1),
      starts AS (SELECT w.t AS start, count(*) AS n_units, (SELECT count(*) FROM w v WHERE v.t >= w.t) AS n_weeks FROM w JOIN gaps g ON g.gap < w.t GROUP BY 1),
      best AS (SELECT start, n_units * n_weeks AS area, n_units, n_weeks FROM starts ORDER BY area DESC, n_units DESC, n_weeks DESC, start LIMIT 1)
      SELECT unit, start, area, n_units, n_weeks FROM gaps, best WHERE gap < start""",
    "panel_slice": f"WITH {PANEL_VIEW} SELECT unit, week, CAST(dense_rank() OVER (ORDER BY week) - 2 AS INTEGER) AS t, x, z FROM panel WHERE week >= DATE '2020-03-01'",
    "intervention_library": f"""WITH {PANEL_VIEW}, sets AS (
        SELECT 'observed' AS intervention, unit, t, z AS z_set FROM panel UNION ALL SELECT 'full_on_all_time', unit, t, 1 FROM panel UNION ALL SELECT 'full_on_no_time', unit, t, -1 FROM panel
        UNION ALL SELECT 'full_on_from_s', unit, t, CASE WHEN t >= {FIRST_TREATED} THEN 1 ELSE -1 END FROM panel),
      firsts AS (SELECT intervention, unit, min(CASE WHEN z_set = 1 THEN t END) AS f, max(t) AS l, sum(z_set) AS total FROM sets GROUP BY 1, 2)
      SELECT intervention, coalesce(min(f), max(l) + 1) AS s, coalesce(max(f) + 1, 0) AS e, CAST(sum(total) AS BIGINT) AS z_total FROM firsts GROUP BY 1""",
    "single_unit_on": f"WITH {PANEL_VIEW} SELECT unit, t, CASE WHEN unit = (SELECT min(unit) FROM panel) AND t >= 3 THEN 1 ELSE -1 END AS z_set FROM panel",
    "treatment_window": f"WITH {PANEL_VIEW}, f AS (SELECT unit, min(CASE WHEN z = 1 THEN t END) AS f, max(t) AS l FROM panel GROUP BY 1) SELECT coalesce(min(f), max(l) + 1) AS s, coalesce(max(f) + 1, 0) AS e FROM f",
    "field_views": f"""WITH {PANEL_VIEW} SELECT unit, t, CAST(x AS DOUBLE) AS x, round(x - avg(x) OVER (PARTITION BY t), 6) AS row_centred,
      round(x - avg(x) OVER (PARTITION BY t) - avg(x) OVER (PARTITION BY unit) + avg(x) OVER (), 6) AS double_centred FROM panel""",
}
