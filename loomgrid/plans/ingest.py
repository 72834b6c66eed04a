"""Queries of the ingest: daily and weekly county figures, population, joins of sources, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code
from loomgrid.functions.latest import latest_row
from loomgrid.functions.scalars import iso_week, iso_year, number_or_infinity, per, slug, week_end, week_start_of
from loomgrid.operators.counties import daily_records
from loomgrid.operators.panel import deltas, fill_from, increments, skeleton, weekly
from loomgrid.operators.skew import spread
from loomgrid.plans.views import CODE, DAILY_VIEW, DAILY, daily, population
from loomgrid.session import run_folder
from loomgrid.sources.tables import read_text_table, table, write_table

FIRST_WEEK, LAST_WEEK = "2020-01-26", "2022-05-15"  # fixed values: the calendar's first and last Sunday

ZERO_FILLED = ["new_cases", "new_deaths", "cases", "deaths", "days", "case_rate", "death_rate"]


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return increments(daily(spark, folder), "fips", "date", {"cases": "new_cases", "deaths": "new_deaths"})


def weeks(spark: SparkSession, folder: str) -> DataFrame:
    return weekly(steps(spark, folder), "fips", "date", ["new_cases", "new_deaths"], ["cases", "deaths"], ["county", "state"])


def county_daily(spark, folder):
    """Daily records without rows of no area, cumulative figures turned into increments."""
    return steps(spark, folder).select("fips", "date", "cases", "deaths", "new_cases", "new_deaths")


def weekly_outcomes(spark, folder):
    """Sums, maxima, last names and days per area and ISO week."""
    monday = week_start_of(F.col("iso_year"), F.col("iso_week")).alias("week_start")
    return weeks(spark, folder).select("fips", "iso_year", "iso_week", monday, "week_end", "new_cases", "new_deaths", "cases", "deaths", "days", "county", "state")


def weekly_last_values(spark, folder):
    """A2 beside A3 (S3, S4): per area and week the last non-null figures, and the last whole row with its nulls."""
    rows = daily_records(table(spark, folder, "us_counties"), ["cases", "deaths"]).withColumn("week_end", week_end(F.col("date")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"last_{c}")
    row = F.max_by(F.struct("cases", "deaths", "date"), "date").alias("r")
    out = rows.groupBy("code", "week_end").agg(last("cases"), last("deaths"), row)
    return out.select(F.col("code").alias("fips"), "week_end", "last_cases", "last_deaths", F.col("r.cases").alias("row_cases"), F.col("r.deaths").alias("row_deaths"), F.col("r.date").alias("row_date"))


def event_pivot(spark, folder):
    """A4: event types as columns, the first value of the day each; rows with a null key vanish."""
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts")).dropna(subset=["user_id", "day"])
    types = ["click", "error", "purchase", "signup", "view"]
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("event_id")))
    return rows.groupBy("user_id", "day").pivot("event_type", types).agg(first)


def population_lookup(spark, folder):
    """A5: the largest population of each area."""
    return population(spark, folder)


def weekly_rates(spark, folder):
    """Population attached, guarded rates, share of people, its change, growth against the week before."""
    rows = weeks(spark, folder).join(population(spark, folder), "fips", "left")
    rows = rows.withColumns({
        "case_rate": per(F.col("new_cases"), F.col("population"), 1e5), "death_rate": per(F.col("new_deaths"), F.col("population"), 1e5),
        "share": per(F.col("cases"), F.col("population"), 100),
    })
    rows = deltas(rows, "fips", "week_end", ["share"])
    rows = rows.withColumn("prev_case_rate", F.expr("lag(case_rate) OVER (PARTITION BY fips ORDER BY week_end)"))
    rows = rows.withColumn("growth", F.when(F.col("prev_case_rate") > 0, F.col("case_rate") / F.col("prev_case_rate")))
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select("fips", "week_end", *map(six, ["case_rate", "death_rate", "share", "share_delta", "prev_case_rate", "growth"]))


RATES_SQL = f"""WITH {DAILY_VIEW},
 rates AS (
   SELECT w.fips, week_end, CASE WHEN population > 0 THEN new_cases * 1e5::DOUBLE / population END AS case_rate,
     CASE WHEN population > 0 THEN new_deaths * 1e5::DOUBLE / population END AS death_rate, CASE WHEN population > 0 THEN cases * 100::DOUBLE / population END AS share
   FROM weeks w LEFT JOIN people p ON p.fips = w.fips),
 shifted AS (
   SELECT *, share - lag(share) OVER w AS share_delta, lag(case_rate) OVER w AS prev_case_rate FROM rates WINDOW w AS (PARTITION BY fips ORDER BY week_end))
"""


def week_calendar(spark, folder):
    """The Sundays from the first to the last day of the records, with Monday and ISO parts."""
    span = table(spark, folder, "us_counties").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence(week_end(F.col("a")), week_end(F.col("b")), F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    return days.select("week_end", F.date_sub("week_end", 6).alias("week_start"), iso_year(F.col("week_end")).alias("iso_year"), iso_week(F.col("week_end")).alias("iso_week"))


def calendar_span(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The first and last Sunday of the fixed calendar, or of the records where these begin earlier or end later."""
    first, last = week_end(F.min("date")), week_end(F.max("date"))
    span = table(spark, folder, "us_counties").agg(F.least(F.lit(FIRST_WEEK).cast("date"), first).alias("a"), F.greatest(F.lit(LAST_WEEK).cast("date"), last).alias("b")).first()
    return str(span.a), str(span.b)


def joined_panel(spark, folder):
    """Areas known to all three tables, on every week of the calendar, which is longer where the records are; in absent weeks the
    seven figures of the records count as zero. Growth is against the week before."""
    codes = lambda name: table(spark, folder, name).select(area_code(F.col("fips")).alias("fips")).where("fips is not null").distinct()
    master = daily(spark, folder).select("fips").distinct().join(codes("node_geography"), "fips", "left_semi").join(codes("us_county_centroids"), "fips", "left_semi")
    grid = skeleton(master, *calendar_span(spark, folder))
    outcomes = weeks(spark, folder).select("fips", "week_end", *ZERO_FILLED[:5], F.lit(True).alias("seen"))
    out = grid.join(outcomes, ["fips", "week_end"], "left").join(population(spark, folder), "fips", "left")
    rates = {"case_rate": per(F.col("new_cases"), F.col("population"), 1e5), "death_rate": per(F.col("new_deaths"), F.col("population"), 1e5)}
    out = out.withColumns(rates).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ZERO_FILLED})
    before = F.expr("lag(case_rate) OVER (PARTITION BY fips ORDER BY week_end)")
    out = out.withColumn("prev_case_rate", before).withColumn("growth", F.when(F.col("prev_case_rate") > 0, F.col("case_rate") / F.col("prev_case_rate")))
    rounded = [F.round(c, 6).alias(c) for c in ("case_rate", "death_rate", "prev_case_rate", "growth")]
    return out.select("fips", "week_end", *ZERO_FILLED[:5], "population", F.coalesce("seen", F.lit(False)).alias("observed"), *rounded)


JOINED_SQL = f"""WITH {DAILY_VIEW},
 master AS (
   SELECT DISTINCT fips FROM days WHERE fips IN (SELECT {CODE} FROM node_geography) AND fips IN (SELECT {CODE} FROM us_county_centroids)),
 span AS (
   SELECT least(DATE '{FIRST_WEEK}', CAST(date_trunc('week', min(date)) + INTERVAL 6 DAY AS DATE)) AS a, greatest(DATE '{LAST_WEEK}', CAST(date_trunc('week', max(date)) + INTERVAL 6 DAY AS DATE)) AS b FROM us_counties),
 calendar AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_end FROM span),
 grid AS (
   SELECT m.fips, c.week_end, coalesce(w.new_cases, 0) AS new_cases, coalesce(w.new_deaths, 0) AS new_deaths, coalesce(w.cases, 0) AS cases, coalesce(w.deaths, 0) AS deaths,
     coalesce(w.days, 0) AS days, p.population, w.fips IS NOT NULL AS observed, coalesce(CASE WHEN p.population > 0 THEN w.new_cases * 1e5::DOUBLE / p.population END, 0) AS case_rate,
     coalesce(CASE WHEN p.population > 0 THEN w.new_deaths * 1e5::DOUBLE / p.population END, 0) AS death_rate
   FROM master m CROSS JOIN calendar c LEFT JOIN weeks w ON w.fips = m.fips AND w.week_end = c.week_end LEFT JOIN people p ON p.fips = m.fips),
 grown AS (SELECT *, lag(case_rate) OVER (PARTITION BY fips ORDER BY week_end) AS prev_case_rate FROM grid)
SELECT * EXCLUDE (case_rate, death_rate, prev_case_rate), round(case_rate, 6) AS case_rate, round(death_rate, 6) AS death_rate, round(prev_case_rate, 6) AS prev_case_rate,
  round(CASE WHEN prev_case_rate > 0 THEN case_rate / prev_case_rate END, 6) AS growth FROM grown
"""


def two_sources(spark, folder):
    """Weekly figures per nation, from orders where there are any, else from line items by supplier (their dates go on for longer)."""
    nation = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, folder, "orders").join(nation, "o_custkey")
    a = orders.groupBy("nation", week_end(F.to_date("o_orderdate")).alias("week_end")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    seller = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    lines = table(spark, folder, "lineitem").join(seller, "l_suppkey")
    b = lines.groupBy("nation", week_end(F.to_date("l_shipdate")).alias("week_end")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    filled = fill_from(a, b, ["nation", "week_end"], ["items", "total"], ("orders", "lineitem_fill"))
    return deltas(filled, "nation", "week_end", ["items"])


TWO_SOURCES_SQL = """WITH a AS (
   SELECT c_nationkey AS nation, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end, count(*) AS items, round(sum(o_totalprice), 2) AS total
   FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
 b AS (
   SELECT s_nationkey AS nation, CAST(date_trunc('week', l_shipdate) + INTERVAL 6 DAY AS DATE) AS week_end, count(*) AS items, round(sum(l_extendedprice), 2) AS total
   FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
 f AS (
   SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.week_end, b.week_end) AS week_end, coalesce(a.items, b.items) AS items, coalesce(a.total, b.total) AS total,
     CASE WHEN a.items IS NOT NULL OR a.total IS NOT NULL THEN 'orders' ELSE 'lineitem_fill' END AS source
   FROM a FULL JOIN b ON a.nation = b.nation AND a.week_end = b.week_end)
SELECT *, items - lag(items) OVER (PARTITION BY nation ORDER BY week_end) AS items_delta FROM f
"""


def excluded_units(spark, folder):
    """Known areas that the binary panel does not have."""
    nodes = table(spark, folder, "node_geography").select(area_code(F.col("fips")).alias("fips"), "state_name").distinct()
    held = table(spark, folder, "realized_binary_artifact").select(area_code(F.col("fips")).alias("fips"))
    return nodes.join(held, "fips", "left_anti")


def processing_summary(spark, folder):
    """One row of counts over the whole intake."""
    raw = table(spark, folder, "us_counties").withColumn("code", area_code(F.col("fips")))
    kept = F.col("code").isNotNull() & ~F.col("county").eqNullSafe("Unknown")
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~kept, 1)).alias("rows_of_no_area"), F.count_distinct(F.when(kept, F.col("code"))).alias("areas"),
        F.count_distinct("date").alias("days"), F.count(F.when(F.col("cases").isNull() | (F.col("cases") < 0), 1)).alias("bad_cases"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )


MANIFEST = ["experiment_name", "run_name", "source_name", "source_type", "latent_rank", "row_id"]
CUT = "2022-03-01 00:00:00"


def manifest_upsert(spark, folder):
    """Rows of experiments that were not written again stay, then the new ones follow."""
    rows = table(spark, folder, "posterior_predictive_summary").select(*MANIFEST, "written_at")
    new = rows.where(F.col("written_at") >= F.lit(CUT).cast("timestamp_ntz")).drop("written_at")
    old = rows.where(F.col("written_at") < F.lit(CUT).cast("timestamp_ntz")).drop("written_at")
    kept, named, key = spread(old, new.select("experiment_name").distinct(), ["experiment_name"], "row_id")
    return kept.join(named, key, "left_anti").select(*MANIFEST).unionByName(new)


def manifest_union(spark, folder):
    """Frames with different headers, missing columns as nulls."""
    rows = table(spark, folder, "posterior_predictive_summary")
    fits = rows.where(F.col("source_type") == "fit").select("row_id", "experiment_name", "latent_rank", "coverage_rate")
    truths = rows.where(F.col("source_type") == "truth").select("experiment_name", "row_id", "gibbs_sweeps", "output_path")
    rest = rows.where(~F.coalesce(F.col("source_type").isin("fit", "truth"), F.lit(False))).select("row_id", "num_samples", "experiment_name")
    return fits.unionByName(truths, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def plan_status(spark, folder):
    """Planned (experiment, source) requests against the results that exist, refreshed from them."""
    rows = table(spark, folder, "posterior_predictive_summary")
    out = rows.groupBy("experiment_name", "source_name").agg(
        F.count("output_path").alias("results"), F.max(F.when(F.col("output_path").isNotNull(), F.col("written_at"))).alias("last_written")
    )
    return out.withColumn("status", F.when(F.col("results") > 0, "completed").otherwise("missing"))


def coerced(spark, folder):
    """text to numbers and dates with nulls for what can't be read, infinity for rankings, slugs."""
    rows = table(spark, folder, "us_counties")
    code = area_code(F.col("fips"))
    return rows.select(
        "row_id", code.try_cast("int").alias("as_number"), number_or_infinity(code).alias("for_ranking"),
        F.try_to_date(F.col("county"), "yyyy-MM-dd").alias("as_date"), slug(F.col("county")).alias("county_slug"),
    )


def csv_round_trip(spark, folder):
    """The population table written as gzipped CSV and as parquet in the checkpoint folder, and read again."""
    base = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    people = population(spark, folder)
    people.write.option("compression", "gzip").csv(f"{base}/csv", header=True)
    write_table(people.withColumn("head", F.substring("fips", 1, 2)), f"{base}/parquet", ["head"])
    again = spark.read.schema("fips string, population bigint, head string").parquet(f"{base}/parquet").select(F.col("fips"), F.col("population").alias("p"))
    text = read_text_table(spark, f"{base}/csv", "fips string, population bigint")
    return text.join(again.withColumn("fips", F.col("fips").cast("string")), "fips").where(F.col("population").eqNullSafe(F.col("p"))).select("fips", "population")


QUERIES = {f.__name__: f for f in (
    county_daily, weekly_outcomes, weekly_last_values, event_pivot, population_lookup, weekly_rates, week_calendar, joined_panel, two_sources,
    excluded_units, processing_summary, manifest_upsert, manifest_union, plan_status, coerced, csv_round_trip,
)}

ORACLES = {
    "county_daily": f"WITH {DAILY_VIEW} SELECT fips, date, cases, deaths, new_cases, new_deaths FROM steps",
    "weekly_outcomes": f"""WITH {DAILY_VIEW} SELECT fips, iso_year, iso_week, week_end - 6 AS week_start, week_end, new_cases, new_deaths, cases, deaths, days, county, state FROM weeks""",
    "weekly_last_values": f"""WITH {DAILY}, w AS (SELECT *, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end FROM daily)
      SELECT code AS fips, week_end, max_by(cases, date) FILTER (cases IS NOT NULL) AS last_cases, max_by(deaths, date) FILTER (deaths IS NOT NULL) AS last_deaths,
        first(cases ORDER BY date DESC) AS row_cases, first(deaths ORDER BY date DESC) AS row_deaths, max(date) AS row_date FROM w GROUP BY 1, 2""",
    "event_pivot": "SELECT user_id, CAST(ts AS DATE) AS day, "
    + ", ".join(f"min_by(value, event_id) FILTER (event_type = '{t}' AND value IS NOT NULL) AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
    "population_lookup": f"SELECT {CODE} AS fips, max(total_population) AS population FROM node_geography WHERE {CODE} IS NOT NULL GROUP BY 1",
    "weekly_rates": RATES_SQL
    + """SELECT fips, week_end, round(case_rate, 6) AS case_rate, round(death_rate, 6) AS death_rate, round(share, 6) AS share, round(share_delta, 6) AS share_delta,
      round(prev_case_rate, 6) AS prev_case_rate, round(CASE WHEN prev_case_rate > 0 THEN case_rate / prev_case_rate END, 6) AS growth FROM shifted""",
    "week_calendar": """WITH s AS (SELECT min(date) AS a, max(date) AS b FROM us_counties),
      c AS (SELECT CAST(unnest(generate_series(date_trunc('week', a) + INTERVAL 6 DAY, date_trunc('week', b) + INTERVAL 6 DAY, INTERVAL 7 DAY)) AS DATE) AS week_end FROM s)
      SELECT week_end, week_end - 6 AS week_start, isoyear(week_end) AS iso_year, week(week_end) AS iso_week FROM c""",
    "joined_panel": JOINED_SQL,
    "two_sources": TWO_SOURCES_SQL,
    "excluded_units": f"SELECT DISTINCT {CODE} AS fips, state_name FROM node_geography WHERE {CODE} NOT IN (SELECT {CODE} FROM realized_binary_artifact WHERE {CODE} IS NOT NULL)",
    "processing_summary": f"""WITH r AS (SELECT *, {CODE} AS code, county IS DISTINCT FROM 'Unknown' AND {CODE} IS NOT NULL AS kept FROM us_counties)
      SELECT count(*) AS n_rows, count(CASE WHEN NOT kept THEN 1 END) AS rows_of_no_area, count(DISTINCT CASE WHEN kept THEN code END) AS areas, count(DISTINCT date) AS days,
        count(CASE WHEN cases IS NULL OR cases < 0 THEN 1 END) AS bad_cases, min(date) AS first_day, max(date) AS last_day FROM r""",
    "manifest_upsert": f"""WITH n AS (SELECT {", ".join(MANIFEST)} FROM posterior_predictive_summary WHERE written_at >= TIMESTAMP '{CUT}')
      SELECT {", ".join(MANIFEST)} FROM posterior_predictive_summary WHERE written_at < TIMESTAMP '{CUT}' AND experiment_name NOT IN (SELECT experiment_name FROM n) UNION ALL SELECT * FROM n""",
    "manifest_union": """SELECT row_id, experiment_name, latent_rank, coverage_rate, NULL AS gibbs_sweeps, NULL AS output_path, NULL AS num_samples FROM posterior_predictive_summary WHERE source_type = 'fit'
      UNION ALL SELECT row_id, experiment_name, NULL, NULL, gibbs_sweeps, output_path, NULL FROM posterior_predictive_summary WHERE source_type = 'truth'
      UNION ALL SELECT row_id, experiment_name, NULL, NULL, NULL, NULL, num_samples FROM posterior_predictive_summary WHERE source_type IS NULL OR source_type NOT IN ('fit', 'truth')""",
    "plan_status": """SELECT experiment_name, source_name, count(output_path) AS results, max(CASE WHEN output_path IS NOT NULL THEN written_at END) AS last_written,
      CASE WHEN count(output_path) > 0 THEN 'completed' ELSE 'missing' END AS status FROM posterior_predictive_summary GROUP BY 1, 2""",
    "coerced": f"""SELECT row_id, try_cast({CODE} AS INTEGER) AS as_number, coalesce(try_cast({CODE} AS DOUBLE), 'inf'::DOUBLE) AS for_ranking, try_strptime(county, '%Y-%m-%d')::DATE AS as_date,
        CASE WHEN coalesce(trim(regexp_replace(lower(county), '[^a-z0-9]+', '_', 'g'), '_'), '') = '' THEN 'item' ELSE trim(regexp_replace(lower(county), '[^a-z0-9]+', '_', 'g'), '_') END AS county_slug
      FROM us_counties""",
    "csv_round_trip": f"SELECT {CODE} AS fips, max(total_population) AS population FROM node_geography WHERE {CODE} IS NOT NULL GROUP BY 1",
}
