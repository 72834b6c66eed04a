"""Queries of the general problems (rolling totals, near points, orphans, filling) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code, area_code_sql
from loomgrid.operators.counties import DAILY_SQL, daily_records, rows_of_areas
from loomgrid.operators.impute import MOST_CORRELATION, MOST_LOG, NEWTON_STEPS, NO_EFFECT, fill_category, fill_numeric
from loomgrid.operators.nearby import near_in_plane, near_on_sphere, points_in_regions
from loomgrid.operators.orphans import orphan_references, orphan_report
from loomgrid.operators.rolling import rolling_totals
from loomgrid.sources.tables import table

CODE = area_code_sql("fips")
DAILY = DAILY_SQL.format(code=CODE)
RADIUS_M = 600.0
SPHERE_RADIUS_M = 2_000.0


# 1 Rolling totals
def rolling(spark: SparkSession, folder: str) -> DataFrame:
    daily = daily_records(table(spark, folder, "us_counties"), ["new_cases"]).withColumn("new_cases", F.greatest("new_cases", F.lit(0)))
    return rolling_totals(daily, "code", "date", "new_cases", (7, 30))


def p1_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = rolling(spark, folder)
    averages = [F.round(f"average_{w}", 6).alias(f"average_{w}") for w in (7, 30)]
    return out.select(F.col("code").alias("fips"), F.date_format("day", "yyyy-MM-dd").alias("day"), "total_7", "total_30", *averages)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = rolling(spark, folder)
    a, b = (F.col(c).cast("decimal(20,0)") for c in ("total_7", "total_30"))
    surge = a * 30 > b * 14  # total_7 / 7 > 2 * total_30 / 30 in whole numbers
    return out.where((F.col("day_index") >= 29) & surge).select(
        F.col("code").alias("fips"), F.date_format("day", "yyyy-MM-dd").alias("day")
    )


P1_SQL = f"""
WITH {DAILY},
 spans AS (SELECT code, min(date) AS first_day, max(date) AS last_day FROM daily GROUP BY code),
 days AS (SELECT code, first_day, CAST(unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
 figures AS (
   SELECT d.code, d.first_day, d.day, CASE WHEN r.new_cases > 0 THEN r.new_cases ELSE 0 END AS v
   FROM days d LEFT JOIN daily r ON r.code = d.code AND r.date = d.day),
 totals AS (
   SELECT code AS fips, strftime(day, '%Y-%m-%d') AS day, day - first_day AS day_index,
     CAST(sum(v) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_7,
     CAST(sum(v) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_30
   FROM figures)
"""


# 3 Points near other points or regions
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    points = positions(spark, folder)
    pairs = near_in_plane(points, "code", "centroid_x", "centroid_y", RADIUS_M)
    return pairs.select(F.col("code").alias("fips"), F.col("neighbor").alias("neighbor_fips"))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of areas with a position (neither coordinate missing, not both 0)."""
    points = table(spark, folder, "us_county_centroids").withColumn("code", area_code(F.col("fips")))
    return points.where(~((F.col("centroid_x") == 0) & (F.col("centroid_y") == 0)))


def p3_sphere(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "us_county_centroids").withColumn("code", area_code(F.col("fips")))
    pairs = near_on_sphere(points, "code", "centroid_lon", "centroid_lat", SPHERE_RADIUS_M)
    return pairs.select(F.col("code").alias("fips"), F.col("neighbor").alias("neighbor_fips"), F.round("distance", 3).alias("metres"))


def p3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Areas inside the diamond around each state (its centre and half extent from the positions)."""
    points = positions(spark, folder).where(F.col("code").isNotNull() & ~F.isnan("centroid_x") & ~F.isnan("centroid_y"))
    extent = points.where("state_name is not null").groupBy("state_name").agg(
        *[f(c).alias(f"{n}_{c[-1]}") for c in ("centroid_x", "centroid_y") for n, f in (("low", F.min), ("high", F.max))]
    )
    mid = lambda a: (F.col(f"low_{a}") + F.col(f"high_{a}")) / 2
    half = lambda a: (F.col(f"high_{a}") - F.col(f"low_{a}")) / 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(
        corner(mid("x") - half("x"), mid("y")), corner(mid("x"), mid("y") - half("y")),
        corner(mid("x") + half("x"), mid("y")), corner(mid("x"), mid("y") + half("y")),
    )
    regions = extent.select("state_name", ring.alias("ring"))
    met = points_in_regions(points, "code", "centroid_x", "centroid_y", regions, "state_name", "ring", 100_000.0)
    return met.select(F.col("code").alias("fips"), "state_name")


# 4 References to records that do not exist
def references(spark: SparkSession, folder: str) -> DataFrame:
    """Each reference of both tables: table_name, row_id, ref_field, key, at."""
    counties = rows_of_areas(table(spark, folder, "us_counties")).select(
        F.lit("us_counties").alias("table_name"), "row_id", F.lit("fips").alias("ref_field"), F.col("code").alias("key"), F.col("loaded_at").alias("at")
    )
    edges = table(spark, folder, "us_county_contiguity_adjacency")
    both = [
        edges.select(
            F.lit("us_county_contiguity_adjacency").alias("table_name"), F.col("edge_id").alias("row_id"), F.lit(f).alias("ref_field"),
            area_code(F.col(f)).alias("key"), F.col("recorded_at").alias("at"),
        )
        for f in ("fips", "neighbor_fips")
    ]
    return counties.unionByName(both[0]).unionByName(both[1])


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "node_geography").select(area_code(F.col("fips")).alias("key"), "created_at", "deleted_at")
    return orphan_references(references(spark, folder), parents)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(spark, folder).select("table_name", "row_id", "ref_field", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(orphans(spark, folder))


P4_SQL = f"""
WITH refs AS (
   SELECT 'us_counties' AS table_name, row_id, 'fips' AS ref_field, {CODE} AS code, loaded_at AS t FROM us_counties WHERE county IS DISTINCT FROM 'Unknown'
   UNION ALL SELECT 'us_county_contiguity_adjacency', edge_id, 'fips', {CODE}, recorded_at FROM us_county_contiguity_adjacency
   UNION ALL SELECT 'us_county_contiguity_adjacency', edge_id, 'neighbor_fips', {area_code_sql("neighbor_fips")}, recorded_at FROM us_county_contiguity_adjacency),
 nodes AS (SELECT DISTINCT {CODE} AS code, created_at, deleted_at FROM node_geography),
 judged AS (
   SELECT r.table_name, r.row_id, r.ref_field, r.code, r.t, count(n.code) AS lives,
     count(CASE WHEN (n.created_at IS NULL OR n.created_at <= r.t) THEN n.code END) AS begun,
     count(CASE WHEN (n.created_at IS NULL OR n.created_at <= r.t) AND (n.deleted_at IS NULL OR r.t < n.deleted_at) THEN n.code END) AS alive
   FROM refs r LEFT JOIN nodes n ON n.code = r.code WHERE r.code IS NOT NULL
   GROUP BY r.table_name, r.row_id, r.ref_field, r.code, r.t),
 missed AS (
   SELECT table_name, row_id, ref_field, CASE WHEN lives = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS kind,
     strftime(t, '%Y-%m') AS period FROM judged WHERE alive = 0)
"""


# 5 Filling missing values
def filled_counties(spark: SparkSession, folder: str) -> DataFrame:
    daily = daily_records(table(spark, folder, "us_counties"), ["cases", "deaths"])
    counts = [F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("cases", "deaths")]
    return fill_numeric(daily.select("code", "date", *counts), ["code"], "date", ["cases", "deaths"], 7)


def filled_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "realized_binary_artifact").withColumn("area", area_code(F.col("fips")))
    rows = rows.where(F.col("area").isNotNull() & F.col("week_end_date").isNotNull())
    observed = ~F.col("observed_mask").eqNullSafe(False) & F.col("value").isin(-1, 1)
    cells = rows.groupBy("code", "area", "week_end_date").agg(F.max(F.when(observed, F.col("value"))).alias("value"))
    return fill_category(cells, ["code", "area"], "week_end_date", "value", [-1, 1], 14)


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its values and marks, both tables in long form."""
    counties = filled_counties(spark, folder)
    fields = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.col(f"{c}_filled").alias("filled")) for c in ("cases", "deaths")])
    ).alias("f")
    shape = lambda df, name, code, day, *rest: df.select(
        F.lit(name).alias("table_name"), F.col(code).alias("fips"), F.date_format(day, "yyyy-MM-dd").alias("day"), *rest
    )
    first = shape(counties, "us_counties", "code", "date", fields).select("table_name", "fips", "day", "f.*")
    second = shape(
        filled_cells(spark, folder), "realized_binary_artifact", "area", "week_end_date",
        F.col("code").alias("field"), F.col("value").cast("double").alias("value"), F.col("value_filled").alias("filled"),
    )
    return first.unionByName(second)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_filled(spark, folder).where("filled").where(F.col("value").isNotNull()).select("table_name", "fips", "day", "field")


P5_SQL = f"""
WITH {DAILY},
 fields AS (
   SELECT code, date, 'cases' AS field, CASE WHEN cases >= 0 THEN cases END AS v FROM daily
   UNION ALL SELECT code, date, 'deaths', CASE WHEN deaths >= 0 THEN deaths END FROM daily),
 cells AS (
   SELECT code AS field, {CODE} AS area, week_end_date,
     max(CASE WHEN (observed_mask IS NULL OR observed_mask) AND value IN (-1, 1) THEN value END) AS v
   FROM realized_binary_artifact WHERE {CODE} IS NOT NULL AND week_end_date IS NOT NULL GROUP BY 1, 2, 3)
SELECT 'us_counties' AS table_name, a.code AS fips, strftime(a.date, '%Y-%m-%d') AS day, a.field FROM fields a
 WHERE a.v IS NULL AND EXISTS (
   SELECT 1 FROM fields b WHERE b.code = a.code AND b.field = a.field AND b.v IS NOT NULL AND abs(b.date - a.date) <= 7)
UNION ALL
SELECT 'realized_binary_artifact', a.area, strftime(a.week_end_date, '%Y-%m-%d'), a.field FROM cells a
 WHERE a.v IS NULL AND EXISTS (
   SELECT 1 FROM cells b WHERE b.area = a.area AND b.field = a.field AND b.v IS NOT NULL AND abs(b.week_end_date - a.week_end_date) <= 14)
"""



def _ratio_sql(classes: str) -> str:
    """Per field the ratio of variances within classes and of their effects, from the sums n, s, q of each class; 1e6 without an effect."""
    return f"""(SELECT field, n_all, s_all, CASE WHEN n_all <= k OR k < 2 OR n_all * n_all <= n2 THEN {NO_EFFECT} WHEN among > 0 THEN greatest(inside / among, 0) ELSE {NO_EFFECT} END AS ratio FROM (
      SELECT *, inside_sum / nullif(n_all - k, 0) AS inside, ((between_sum - s_all * s_all / n_all) / nullif(k - 1, 0) - inside_sum / nullif(n_all - k, 0)) * (k - 1) / nullif(n_all - n2 / n_all, 0) AS among FROM (
        SELECT field, sum(n) AS n_all, count(*) AS k, sum(s) AS s_all, sum(q - s * s / n) AS inside_sum, sum(s * s / n) AS between_sum, sum(n * n) AS n2 FROM {classes} WHERE n > 0 GROUP BY field)))"""


def _numeric_sql(reach: int) -> str:
    """The mixed-effects fill step by step: effects of areas, of days, of areas again, of days again; then the residuals beside each gap."""
    effect = lambda rows, key: f"SELECT field, {key}, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, sum(r * r) AS q FROM {rows} GROUP BY 1, 2"
    return f"""
 logs AS MATERIALIZED (SELECT code, date, field, ln(1 + greatest(v::DOUBLE, -0.999)) AS r FROM fields WHERE v IS NOT NULL),
 g1 AS ({effect("logs", "code")}), m1 AS (SELECT field, s_all / n_all AS mean, ratio FROM {_ratio_sql("g1")}),
 r1 AS MATERIALIZED (SELECT l.code, l.date, l.field, l.r - mean - (g.s - g.n * mean) / (g.n + ratio) AS r FROM logs l JOIN g1 g USING (code, field) JOIN m1 USING (field)),
 d1 AS ({effect("r1", "date")}), b1 AS MATERIALIZED (SELECT d.date, d.field, s / (n + ratio) AS b FROM d1 d JOIN {_ratio_sql("d1")} USING (field)),
 y2 AS MATERIALIZED (SELECT l.code, l.date, l.field, l.r - b AS r, b FROM logs l JOIN b1 USING (date, field)),
 g2 AS MATERIALIZED ({effect("y2", "code")}), m2 AS MATERIALIZED (SELECT field, ratio FROM {_ratio_sql("g2")}),
 r2 AS MATERIALIZED (SELECT y.code, y.date, y.field, y.r + y.b - mean - (g.s - g.n * mean) / (g.n + m2.ratio) AS r, b FROM y2 y JOIN g2 g USING (code, field) JOIN m1 USING (field) JOIN m2 USING (field)),
 d2 AS ({effect("r2", "date")}), b2 AS MATERIALIZED (SELECT d.date, d.field, s / (n + ratio) AS b FROM d2 d JOIN {_ratio_sql("d2")} USING (field)),
 steps AS (
   SELECT field, r - b AS y, lag(r - b) OVER w AS x, date - lag(date) OVER w AS gap FROM r2 WINDOW w AS (PARTITION BY code, field ORDER BY date)),
 tied AS MATERIALIZED (
   SELECT field, coalesce(CASE WHEN sum(x * y) > 0 THEN pow(least(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), {MOST_CORRELATION}), count(*) / sum(gap)) END, 0) AS c
   FROM steps WHERE gap <= {reach} GROUP BY 1),
 g3 AS MATERIALIZED (SELECT l.code, l.field, count(*) AS n, sum(l.r - mean - b) AS s FROM logs l JOIN m1 USING (field) JOIN b2 USING (date, field) GROUP BY 1, 2),
 fixed AS (
   SELECT f.code, f.date, f.field, f.v, mean + coalesce(g.s / (g.n + m2.ratio), 0) + coalesce(b, 0) AS base, c, CASE WHEN v IS NOT NULL THEN ln(1 + greatest(v::DOUBLE, -0.999)) END AS y
   FROM fields f JOIN m1 USING (field) JOIN m2 USING (field) LEFT JOIN tied USING (field) LEFT JOIN g3 g USING (code, field) LEFT JOIN b2 ON b2.date = f.date AND b2.field = f.field),
 beside AS (
   SELECT *, last_value(y - base IGNORE NULLS) OVER p AS ra, date - last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER p AS da,
     first_value(y - base IGNORE NULLS) OVER f AS rb, first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER f - date AS db FROM fixed
   WINDOW p AS (PARTITION BY code, field ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY code, field ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 weighed AS (SELECT *, coalesce(pow(c, da), 0) AS wa, coalesce(pow(c, db), 0) AS wb, v IS NULL AND coalesce(da <= {reach} OR db <= {reach}, da <= {reach}, db <= {reach}, false) AS filled FROM beside),
 numeric AS (
   SELECT code AS fips, date AS day, field, filled, CASE WHEN filled THEN greatest(floor(exp(least(
     base + (wa * (1 - wb * wb) * coalesce(ra, 0) + wb * (1 - wa * wa) * coalesce(rb, 0)) / greatest(1 - wa * wa * wb * wb, 1e-300), {MOST_LOG})) - 1 + 0.5), 0) ELSE v END AS value FROM weighed)"""


def _logit_sql(reach: int) -> str:
    """The logit of class 1 against -1 on the differences of three log shares, by Newton steps with a 3 x 3 system solved by determinants."""
    share = lambda n, own, a: f"ln({n}p - {own}p + {a}) - ln({n}m - {own}m + {a})"
    det = lambda a, b, c: f"({a}1 * ({b}2 * {c}3 - {b}3 * {c}2) - {a}2 * ({b}1 * {c}3 - {b}3 * {c}1) + {a}3 * ({b}1 * {c}2 - {b}2 * {c}1))"
    steps = ["w0 AS (SELECT 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS w3)"]
    for i in range(NEWTON_STEPS):
        sums = ", ".join([f"coalesce(sum((y - p) * x{a}), 0) - any_value(w{a}) AS g{a}" for a in (1, 2, 3)] + [f"coalesce(sum(p * (1 - p) * x{a} * x{b}), 0) + {int(a == b)} AS h{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3)])
        rows = [", ".join(f"h{a}{b} AS {r}{b}" for b in (1, 2, 3)) for a, r in ((1, "a"), (2, "b"), (3, "c"))]
        solved = []
        for a in (1, 2, 3):  # Cramer: column a replaced by the gradient
            cell = lambda r, b, a=a: f"g{'abc'.index(r) + 1}" if a == b else f"{r}{b}"
            top = f"({cell('a', 1)} * ({cell('b', 2)} * {cell('c', 3)} - {cell('b', 3)} * {cell('c', 2)}) - {cell('a', 2)} * ({cell('b', 1)} * {cell('c', 3)} - {cell('b', 3)} * {cell('c', 1)}) + {cell('a', 3)} * ({cell('b', 1)} * {cell('c', 2)} - {cell('b', 2)} * {cell('c', 1)}))"
            solved.append(f"w{a} + {top} / {det('a', 'b', 'c')} AS w{a}")
        steps.append(f"s{i} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, 1 / (1 + exp(-(w1 * x1 + w2 * x2 + w3 * x3))) AS p FROM shares, w{i} WHERE y IS NOT NULL AND near > 0))")
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT {', '.join(solved)} FROM w{i}, (SELECT *, {', '.join(rows)} FROM s{i}))")
    return f"""
 counted AS (
   SELECT field, area, week_end_date, v, coalesce(v = 1, false)::INT AS op, coalesce(v = -1, false)::INT AS om, count(*) FILTER (v = 1) OVER g AS gp, count(*) FILTER (v = -1) OVER g AS gm,
     count(*) FILTER (v = 1) OVER t AS tp, count(*) FILTER (v = -1) OVER t AS tm, count(*) FILTER (v = 1) OVER l AS np, count(*) FILTER (v = -1) OVER l AS nm FROM cells
   WINDOW g AS (PARTITION BY field, area), t AS (PARTITION BY week_end_date),
     l AS (PARTITION BY field, area ORDER BY week_end_date RANGE BETWEEN INTERVAL {reach} DAY PRECEDING AND INTERVAL {reach} DAY FOLLOWING)),
 shares AS MATERIALIZED (
   SELECT field, area, week_end_date, v, (v + 1) / 2 AS y, {share("g", "o", "1.0::DOUBLE")} AS x1, {share("t", "o", "1.0::DOUBLE")} AS x2, {share("n", "o", "0.5::DOUBLE")} AS x3, np + nm - op - om AS near FROM counted),
 {", ".join(steps)},
 category AS (
   SELECT area AS fips, week_end_date AS day, field, v IS NULL AND near > 0 AS filled, CASE WHEN v IS NULL AND near > 0 THEN CASE WHEN w1 * x1 + w2 * x2 + w3 * x3 > 0 THEN 1 ELSE -1 END ELSE v END AS value
   FROM shares, w{NEWTON_STEPS})"""


P5_VIEWS = P5_SQL[: P5_SQL.index("SELECT 'us_counties' AS table_name")]
P5_FILLED_SQL = P5_VIEWS.rstrip() + "," + _numeric_sql(7) + "," + _logit_sql(14) + """
SELECT 'us_counties' AS table_name, fips, strftime(day, '%Y-%m-%d') AS day, field, value::DOUBLE AS value, filled FROM numeric
UNION ALL SELECT 'realized_binary_artifact', fips, strftime(day, '%Y-%m-%d'), field, value::DOUBLE, filled FROM category
"""

POSITIONS_SQL = f"""
 points AS (
   SELECT {CODE} AS code, any_value(centroid_x) AS x, any_value(centroid_y) AS y, any_value(centroid_lon) AS lon, any_value(centroid_lat) AS lat, any_value(state_name) AS state_name
   FROM us_county_centroids WHERE {CODE} IS NOT NULL AND centroid_x IS NOT NULL AND centroid_y IS NOT NULL AND NOT isnan(centroid_x) AND NOT isnan(centroid_y)
     AND NOT (centroid_x = 0 AND centroid_y = 0) GROUP BY 1)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_windows": p1_windows,
    "p3_found": p3_found,
    "p3_sphere": p3_sphere,
    "p3_regions": p3_regions,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_filled": p5_filled,
}

ORACLES = {
    "p1_found": P1_SQL + "SELECT fips, day FROM totals WHERE day_index >= 29 AND total_7 * 30 > total_30 * 14",
    "p1_windows": P1_SQL + "SELECT fips, day, total_7, total_30, round(total_7 / 7.0, 6) AS average_7, round(total_30 / 30.0, 6) AS average_30 FROM totals",
    "p3_found": f"WITH {POSITIONS_SQL} SELECT a.code AS fips, b.code AS neighbor_fips FROM points a JOIN points b ON a.code < b.code AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 360000",
    "p3_sphere": f"""WITH points AS (SELECT {CODE} AS code, min(centroid_lon) AS lon, min(centroid_lat) AS lat FROM us_county_centroids
        WHERE centroid_lon IS NOT NULL AND centroid_lat IS NOT NULL AND {CODE} IS NOT NULL GROUP BY 1),
      met AS (SELECT a.code AS fips, b.code AS neighbor_fips, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d FROM points a JOIN points b ON a.code < b.code)
      SELECT fips, neighbor_fips, round(d, 3) AS metres FROM met WHERE d <= 2000""",
    "p3_regions": f"""WITH {POSITIONS_SQL}, s AS (SELECT {CODE} AS code, state_name, centroid_x AS x, centroid_y AS y FROM us_county_centroids WHERE state_name IS NOT NULL AND {CODE} IS NOT NULL AND NOT isnan(centroid_x)
        AND NOT isnan(centroid_y) AND centroid_x IS NOT NULL AND centroid_y IS NOT NULL AND NOT (centroid_x = 0 AND centroid_y = 0)),
      d AS (SELECT state_name, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (max(x) - min(x)) / 2 AS hx, (max(y) - min(y)) / 2 AS hy FROM s GROUP BY 1)
      SELECT DISTINCT p.code AS fips, d.state_name FROM points p JOIN d ON hx > 0 AND hy > 0 AND abs(p.x - mx) / hx + abs(p.y - my) / hy < 1""",
    "p4_found": P4_SQL + "SELECT * FROM missed",
    "p4_report": P4_SQL + "SELECT table_name, ref_field, kind, period, count(*) AS misses FROM missed GROUP BY ALL",
    "p5_found": P5_SQL,
    "p5_filled": P5_FILLED_SQL,
}
