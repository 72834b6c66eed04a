"""Queries of graphs and of spatiotemporal folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.codes import area_code, area_code_sql
from loomgrid.operators.graph import (
    asymmetry, both_ways, components, kernel_weight, median_distance, nearest, neighbour_sum, normalised, random_graph, symmetric_by_max, symmetric_by_mean,
)
from loomgrid.operators.panel import dense_index
from loomgrid.operators.skew import numbered
from loomgrid.operators.splits import SEPARATOR, TRAINING, VALIDATION, blanket_violations, inner_role_counts, inner_violations, neighbour_parts, pattern_changes, roles, schedule_table, time_blocks
from loomgrid.plans.problems import POSITIONS_SQL, positions
from loomgrid.plans.views import CELLS_VIEW, CODE, EDGES_VIEW, PANEL_VIEW, cells, edges, panel
from loomgrid.session import written_table
from loomgrid.sources.tables import table

K = 4
FOLDS, INNER_FOLDS = 4, 3
XI = 0.8


def directed(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, w) as recorded: the largest weight of each direction, loops included."""
    rows = table(spark, folder, "us_county_contiguity_adjacency").select(
        area_code(F.col("fips")).alias("src"), area_code(F.col("neighbor_fips")).alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("w")
    )
    return rows.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.max("w").alias("w"))


DIRECTED_VIEW = f"""
 recorded AS (SELECT {CODE} AS src, {area_code_sql("neighbor_fips")} AS dst, max(coalesce(weight, 1.0)) AS w FROM us_county_contiguity_adjacency
   WHERE {CODE} IS NOT NULL AND {area_code_sql("neighbor_fips")} IS NOT NULL GROUP BY 1, 2),
 sides AS (SELECT src, dst, w FROM recorded WHERE src <> dst UNION ALL SELECT dst, src, w FROM recorded WHERE src <> dst),
 maxed AS (SELECT src, dst, max(w) AS w FROM sides GROUP BY 1, 2),
 meant AS (SELECT src, dst, sum(w) / 2 AS w FROM sides GROUP BY 1, 2),
 gamma AS (SELECT src, dst, w / (SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM maxed GROUP BY src)) AS w FROM maxed)
"""


def gamma(spark: SparkSession, folder: str) -> DataFrame:
    return normalised(symmetric_by_max(directed(spark, folder)))


def contiguity(spark, folder):
    """Distinct undirected neighbour pairs, smaller code first."""
    return edges(spark, folder).select(F.col("src").alias("fips"), F.col("dst").alias("neighbor_fips"))


def network_by_max(spark, folder):
    """max(A, A'), no diagonal, over the infinity norm."""
    return gamma(spark, folder).select("src", "dst", F.round("w", 9).alias("w"))


def network_by_mean(spark, folder):
    """(A + A') / 2, no diagonal, over the infinity norm, times xi."""
    known = normalised(symmetric_by_mean(directed(spark, folder)), degenerate_to_zero=True)
    return known.select("src", "dst", F.round("w", 9).alias("w"), F.round(F.col("w") * XI, 9).alias("xi_w"))


def graph_statistics(spark, folder):
    """Entries, edges, mean and greatest weighted degree over all nodes, Frobenius norm, infinity norm."""
    g = gamma(spark, folder)
    nodes = table(spark, folder, "us_county_centroids").select(area_code(F.col("fips")).alias("src")).where("src is not null").distinct()
    degrees = nodes.join(g.groupBy("src").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("q")), "src", "left")
    return degrees.agg(
        F.sum("n").alias("entries"), (F.sum("n") / 2).cast("long").alias("edges"), F.round(F.avg(F.coalesce("degree", F.lit(0.0))), 9).alias("mean_degree"),
        F.round(F.max("degree"), 9).alias("max_degree"), F.round(F.sqrt(F.sum("q")), 9).alias("frobenius"),
    )


def gamma_check(spark, folder):
    """Loops and asymmetry of the recorded matrix."""
    return asymmetry(directed(spark, folder)).withColumn("greatest_gap", F.round("greatest_gap", 9))


def edge_index(spark, folder):
    """Edges by node number; those with an end outside the nodes are dropped."""
    nodes = table(spark, folder, "us_county_centroids").select(area_code(F.col("fips")).alias("fips")).where("fips is not null").distinct()
    numbers = dense_index(nodes, "fips")
    ends = lambda side, n: numbers.select(F.col("fips").alias(side), F.col("number").alias(n))
    return edges(spark, folder).join(ends("src", "i"), "src").join(ends("dst", "j"), "dst").select("i", "j", F.round("w", 9).alias("w"))


def neighbour_sums(spark, folder):
    """Weighted sum of the neighbours' outcomes at each slot of the panel."""
    out = neighbour_sum(gamma(spark, folder), panel(spark, folder).select("unit", "t", "x"), "unit", "t", "x", "neighbours")
    return out.select("unit", "t", F.round("neighbours", 9).alias("neighbours"))


def graph_components(spark, folder):
    """Connected components and their sizes."""
    parts = components(edges(spark, folder))
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def induced_subgraph(spark, folder):
    """Edges among the areas of the binary panel, weights as they were."""
    held = cells(spark, folder).select("unit").distinct()
    g = gamma(spark, folder)
    g = g.join(held.withColumnRenamed("unit", "src"), "src", "left_semi").join(held.withColumnRenamed("unit", "dst"), "dst", "left_semi")
    return g.select("src", "dst", F.round("w", 9).alias("w"))


def scaled_field(spark, folder):
    """The recorded weights scaled by their greatest absolute value and by their root mean square."""
    g = directed(spark, folder)
    top, rms = g.agg(F.max(F.abs("w"))).scalar(), g.agg(F.sqrt(F.avg(F.col("w") * F.col("w")))).scalar()
    scale = lambda by: F.round(F.when(by > 0, F.col("w") / by).otherwise(0.0), 9)
    return g.select("src", "dst", scale(top).alias("by_max"), scale(rms).alias("by_rms"))


def nearest_areas(spark, folder):
    """The nearest areas of each by centroid, ties by code."""
    out = nearest(positions(spark, folder), "code", "centroid_x", "centroid_y", K)
    return out.select(F.col("code").alias("fips"), F.col("neighbor").alias("neighbor_fips"), F.round("distance", 6).alias("metres"), "place")


def kernel_graph(spark, folder):
    """Union of nearest neighbours as undirected pairs with weight exp(-d / median distance)."""
    points = positions(spark, folder)
    near = nearest(points, "code", "centroid_x", "centroid_y", K)
    pairs = near.groupBy(F.least("code", "neighbor").alias("fips"), F.greatest("code", "neighbor").alias("neighbor_fips")).agg(F.min("distance").alias("distance"))
    scale = median_distance(points, "code", "centroid_x", "centroid_y")
    return pairs.select("fips", "neighbor_fips", kernel_weight(F.col("distance"), scale).alias("weight"))


def random_edges(spark, folder):
    """A random and a cycle graph over the areas with a position."""
    numbers = dense_index(positions(spark, folder).select("code").where("code is not null").distinct(), "code")
    n = numbers.count()
    erdos = random_graph(numbers, "number", n, min(1.0, 6.0 / max(n, 1)), seed=7).select(F.lit("random").alias("kind"), "i", "j")
    cycle = numbers.select(F.lit("cycle").alias("kind"), F.col("number").alias("i"), ((F.col("number") + 1) % n).cast("int").alias("j"))
    return erdos.unionByName(cycle)


# Folds
def steps_of(spark: SparkSession, folder: str) -> int:
    """Weeks of the calendar: the t of slots runs over them."""
    return table(spark, folder, "realized_binary_artifact").select("week_end_date").where("week_end_date is not null").distinct().count()


def members(spark: SparkSession, folder: str, folds: int, pairs: DataFrame | None = None) -> DataFrame:
    """(unit, part): nodes of the graph (``pairs`` if its edges are at hand) in spatial parts; nodes without a position are dealt out by their number."""
    nodes = both_ways(edges(spark, folder) if pairs is None else pairs).select(F.col("src").alias("unit")).distinct()
    placed = spatial_parts(spark, folder).withColumnRenamed("fips", "unit")
    return dense_index(nodes, "unit").join(placed, "unit", "left").select("unit", F.coalesce("part", (F.col("number") % folds + 1).cast("int")).alias("part"))


def outer_slots(spark: SparkSession, folder: str) -> DataFrame:
    return fold_roles(spark, folder).withColumnRenamed("fold", "outer_fold")


def blocks(spark, folder):
    """Time blocks, transitions and the part that each fold validates in each block."""
    steps = steps_of(spark, folder)
    places = spark.createDataFrame(time_blocks(steps, FOLDS), "t int, block int, place int, is_transition boolean")
    return places.join(schedule_table(spark, steps, FOLDS).select("fold", "t", "part"), "t")


def fold_roles(spark, folder):
    """The role of every slot in every fold."""
    return roles(members(spark, folder, FOLDS), both_ways(edges(spark, folder)), steps_of(spark, folder), FOLDS)


def fold_summary(spark, folder):
    """Slots per role of each fold and whether it can be used; `validation` mode takes the first usable one."""
    slots = fold_roles(spark, folder)
    count = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_slots")
    out = slots.groupBy("fold").agg(count(TRAINING), count(SEPARATOR), count(VALIDATION))
    usable = (F.col("training_slots") > 0) & (F.col("validation_slots") > 0)
    first = out.where(usable).agg(F.min("fold")).scalar()
    return out.withColumns({"usable": usable, "validation_mode": F.coalesce(F.col("fold") == first, F.lit(False))})


def blanket_check(spark, folder):
    """Violations of the blanket per fold (none)."""
    return blanket_violations(fold_roles(spark, folder), edges(spark, folder))


def inner_fold_roles(spark, folder):
    """Roles inside the training slots of every outer fold, counted per outer fold, fold, time and role."""
    steps, pairs = steps_of(spark, folder), written_table(edges(spark, folder))
    return inner_role_counts(members(spark, folder, FOLDS, pairs), both_ways(pairs), steps, FOLDS, INNER_FOLDS)


def inner_blanket_check(spark, folder):
    """P15 for the inner layer of every outer fold: no violations of validation against training."""
    steps, pairs = steps_of(spark, folder), written_table(edges(spark, folder))
    return inner_violations(members(spark, folder, FOLDS, pairs), both_ways(pairs), pairs, steps, FOLDS, INNER_FOLDS)


def active_pattern_changes(spark, folder):
    """Times at which the set of slots open to the inner layer changes, for every outer fold."""
    return pattern_changes(outer_slots(spark, folder)).select("outer_fold", "t", "changed")


def partition_metrics(spark, folder):
    """Sizes, separators and cut edges per part, with the spread of sizes."""
    placed = neighbour_parts(members(spark, folder, FOLDS), both_ways(edges(spark, folder)))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    separators = placed.select(F.explode("near").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("separator"))
    m = members(spark, folder, FOLDS)
    ends = lambda side: m.select(F.col("unit").alias(side), F.col("part").alias(f"{side}_part"))
    cut = edges(spark, folder).join(ends("src"), "src").join(ends("dst"), "dst").where("src_part <> dst_part")
    cuts = cut.select(F.explode(F.array("src_part", "dst_part")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("cut_edges"))
    mean, spread = sizes.agg(F.avg("size")).scalar(), sizes.agg(F.stddev_pop("size")).scalar()
    out = sizes.join(separators, "part", "left").join(cuts, "part", "left").na.fill(0)
    return out.withColumns({"size_spread": F.round(spread, 6), "deviation": F.round(F.abs(F.col("size") - mean) / mean, 6)})


def spatial_parts(spark, folder):
    """Balanced compact parts without a graph library: areas in order of interleaved coordinates, cut into equal parts."""
    points = positions(spark, folder).where("code is not null").groupBy("code").agg(F.max("centroid_x").alias("x"), F.max("centroid_y").alias("y"))
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    cell = lambda c: F.floor((F.col(c) + 20_000_000.0) / 1000.0).cast("long")
    spread_bits = lambda c: sum((F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), 2 * b) for b in range(1, 16)), c.bitwiseAND(F.lit(1)))
    keyed = points.select("code", (spread_bits(cell("x")) + 2 * spread_bits(cell("y"))).alias("place"))
    placed = numbered(keyed, [], [F.asc("place"), F.asc("code")], "n")
    total = keyed.agg(F.count(F.lit(1))).scalar()
    return placed.select(F.col("code").alias("fips"), (F.floor((F.col("n") - 1) * FOLDS / total) + 1).cast("int").alias("part"))


QUERIES = {f.__name__: f for f in (
    contiguity, network_by_max, network_by_mean, graph_statistics, gamma_check, edge_index, neighbour_sums, graph_components, induced_subgraph, scaled_field,
    nearest_areas, kernel_graph, random_edges, blocks, fold_roles, fold_summary, blanket_check, inner_fold_roles, inner_blanket_check,
    active_pattern_changes, partition_metrics, spatial_parts,
)}


def _schedule_sql(folds: int, name: str) -> str:
    """Blocks by formula: block b of F starts at its smallest sizes (1, 2, 2, ...) filled up to equal heights."""
    return f"""
 total{name} AS (SELECT count(DISTINCT week_end_date) AS n FROM realized_binary_artifact WHERE week_end_date IS NOT NULL),
 sizes{name} AS (SELECT b, n // {folds} + CASE WHEN b <= n % {folds} THEN 1 ELSE 0 END AS size FROM total{name}, (SELECT unnest(range(1, {folds} + 1)) AS b)),
 starts{name} AS (SELECT b, size, coalesce(sum(size) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes{name}),
 times{name} AS (SELECT CAST(start + i AS INTEGER) AS t, b AS block, i + 1 AS place, b > 1 AND i = 0 AS is_transition FROM (SELECT *, unnest(range(size)) AS i FROM starts{name})),
 plan{name} AS (
   SELECT fold, t, block, place, is_transition, ((block - fold) % {folds} + {folds}) % {folds} + 1 AS part, ((block - 1 - fold) % {folds} + {folds}) % {folds} + 1 AS previous_part
   FROM times{name}, (SELECT unnest(range(1, {folds} + 1)) AS fold))"""


_bits = lambda c: " + ".join(f"(((({c}) >> {b}) & 1) << {2 * b})" for b in range(16))
_cell = lambda c: f"CAST(floor(({c} + 20000000.0) / 1000.0) AS BIGINT)"
SPATIAL_VIEW = POSITIONS_SQL + f""",
 keyed AS (SELECT code, {_bits(_cell("x"))} + 2 * ({_bits(_cell("y"))}) AS place FROM points),
 spatial AS (SELECT code AS fips, CAST((row_number() OVER (ORDER BY place, code) - 1) * {FOLDS} // count(*) OVER () + 1 AS INTEGER) AS part FROM keyed)"""
SIDES_VIEW = EDGES_VIEW + ", ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), units AS (SELECT DISTINCT src AS unit FROM ways)"
ROLES_VIEW = SIDES_VIEW + "," + SPATIAL_VIEW + f""",
 members AS (SELECT unit, coalesce(part, (row_number() OVER (ORDER BY unit) - 1) % {FOLDS} + 1) AS own FROM units LEFT JOIN spatial ON fips = unit),
 near AS (SELECT DISTINCT w.src AS unit, m.own AS part FROM ways w JOIN members m ON m.unit = w.dst JOIN members s ON s.unit = w.src WHERE s.own <> m.own),
 {_schedule_sql(FOLDS, "")},
 roles AS (
   SELECT p.fold, p.t, m.unit, CASE WHEN is_transition AND (n.unit IS NOT NULL OR own = p.part OR own = p.previous_part) THEN 'separator' WHEN is_transition THEN 'training'
     WHEN own = p.part THEN 'validation' WHEN n.unit IS NOT NULL THEN 'separator' ELSE 'training' END AS role
   FROM members m CROSS JOIN plan p LEFT JOIN near n ON n.unit = m.unit AND n.part = p.part)
"""
INNER_VIEW = ROLES_VIEW + f""",
 steps_ AS (SELECT fold AS outer_fold, t, unit, role, role <> 'validation' AS shared, lag(role <> 'validation') OVER (PARTITION BY fold, unit ORDER BY t) AS before FROM roles),
 jumps AS (SELECT outer_fold, t, max(CAST(before IS NOT NULL AND before <> shared AS INTEGER)) = 1 AS changed FROM steps_ GROUP BY 1, 2),
 patterns AS (SELECT outer_fold, t, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY outer_fold ORDER BY t) AS pattern FROM jumps),
 dealt AS (
   SELECT p.outer_fold, pattern, unit, (row_number() OVER (PARTITION BY p.outer_fold, pattern ORDER BY unit) - 1) % {INNER_FOLDS} + 1 AS own
   FROM (SELECT outer_fold, pattern, min(t) AS t FROM patterns GROUP BY 1, 2) p JOIN steps_ s ON s.outer_fold = p.outer_fold AND s.t = p.t WHERE shared),
 placed AS (
   SELECT s.*, coalesce(d.own, 0) AS own FROM steps_ s JOIN patterns p ON p.outer_fold = s.outer_fold AND p.t = s.t LEFT JOIN dealt d ON d.outer_fold = s.outer_fold AND d.pattern = p.pattern AND d.unit = s.unit),
 outer_slots AS (SELECT *, lag(own) OVER (PARTITION BY outer_fold, unit ORDER BY t) AS own_before FROM placed),
 near2 AS (SELECT DISTINCT s.outer_fold, w.src AS unit, s.t, s.own AS part FROM ways w JOIN outer_slots s ON s.unit = w.dst AND s.shared),
 {_schedule_sql(INNER_FOLDS, "2")},
 inner_slots AS (
   SELECT s.outer_fold, p.fold, s.t, s.unit, CASE WHEN role = 'validation' THEN 'outer_test' WHEN role = 'separator' OR (n.unit IS NOT NULL AND s.own <> p.part) THEN 'separator'
     WHEN (is_transition OR changed) AND (s.own = p.part OR coalesce(before AND s.own_before = CASE WHEN is_transition THEN previous_part ELSE p.part END, false)) THEN 'separator'
     WHEN is_transition OR changed THEN 'training' WHEN s.own = p.part THEN 'validation' ELSE 'training' END AS role
   FROM outer_slots s JOIN plan2 p ON p.t = s.t JOIN jumps j ON j.outer_fold = s.outer_fold AND j.t = s.t
   LEFT JOIN near2 n ON n.outer_fold = s.outer_fold AND n.unit = s.unit AND n.t = s.t AND n.part = p.part)
"""


def _violations_sql(slots: str, key: str) -> str:
    """Counts of edges and steps that join validation (or, for edges, outer test) to training."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    return f""", pairs_ AS (
   SELECT {", ".join(f"a.{k}" for k in key.split(", "))}, count(*) AS spatial FROM edges e JOIN {slots} a ON a.unit = e.src JOIN {slots} b ON b.unit = e.dst AND b.t = a.t AND {on}
   WHERE (a.role IN ('validation', 'outer_test') AND b.role = 'training') OR (b.role IN ('validation', 'outer_test') AND a.role = 'training') GROUP BY ALL),
 walks AS (SELECT *, lag(role) OVER (PARTITION BY {key}, unit ORDER BY t) AS last_role FROM {slots}),
 times_ AS (SELECT {key}, count(CASE WHEN (role = 'validation' AND last_role = 'training') OR (role = 'training' AND last_role = 'validation') THEN 1 END) AS temporal FROM walks GROUP BY ALL)
 SELECT {key}, coalesce(spatial, 0) AS spatial, temporal FROM times_ LEFT JOIN pairs_ USING ({key})"""


ORACLES = {
    "contiguity": f"WITH {EDGES_VIEW} SELECT src AS fips, dst AS neighbor_fips FROM edges",
    "network_by_max": f"WITH {DIRECTED_VIEW} SELECT src, dst, round(w, 9) AS w FROM gamma",
    "network_by_mean": f"WITH {DIRECTED_VIEW}, g AS (SELECT src, dst, w / (SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM meant GROUP BY src)) AS w FROM meant) SELECT src, dst, round(w, 9) AS w, round(w * {XI}, 9) AS xi_w FROM g",
    "graph_statistics": f"""WITH {DIRECTED_VIEW}, nodes AS (SELECT DISTINCT {CODE} AS src FROM us_county_centroids WHERE {CODE} IS NOT NULL),
      d AS (SELECT src, sum(w) AS degree, count(*) AS n, sum(w * w) AS q FROM gamma GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS entries, CAST(floor(sum(n) / 2) AS BIGINT) AS edges, round(avg(coalesce(degree, 0)), 9) AS mean_degree, round(max(degree), 9) AS max_degree, round(sqrt(sum(q)), 9) AS frobenius FROM nodes LEFT JOIN d USING (src)""",
    "gamma_check": f"""WITH {DIRECTED_VIEW}, j AS (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, a.w AS w, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS gap FROM recorded a FULL JOIN recorded b ON a.src = b.dst AND a.dst = b.src)
      SELECT count(CASE WHEN src = dst AND w <> 0 THEN 1 END) AS loops, round(max(gap), 9) AS greatest_gap, count(CASE WHEN gap > 1e-12 AND src < dst THEN 1 END) AS differing_pairs FROM j""",
    "edge_index": f"""WITH {EDGES_VIEW}, n AS (SELECT fips, CAST(row_number() OVER (ORDER BY fips) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT {CODE} AS fips FROM us_county_centroids WHERE {CODE} IS NOT NULL))
      SELECT a.number AS i, b.number AS j, round(w, 9) AS w FROM edges JOIN n a ON a.fips = src JOIN n b ON b.fips = dst""",
    "neighbour_sums": f"""WITH {DIRECTED_VIEW}, {PANEL_VIEW}, s AS (SELECT g.src, p.t, sum(g.w * p.x) AS v FROM gamma g JOIN panel p ON p.unit = g.dst GROUP BY 1, 2)
      SELECT p.unit, p.t, round(coalesce(s.v, 0), 9) AS neighbours FROM panel p LEFT JOIN s ON s.src = p.unit AND s.t = p.t""",
    "graph_components": f"""WITH RECURSIVE {SIDES_VIEW}, reach(node, label) AS (SELECT unit, unit FROM units UNION SELECT w.dst, r.label FROM reach r JOIN ways w ON w.src = r.node WHERE r.label < w.dst),
      c AS (SELECT node, min(label) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS nodes FROM c GROUP BY 1""",
    "induced_subgraph": f"WITH {DIRECTED_VIEW}, {CELLS_VIEW} SELECT src, dst, round(w, 9) AS w FROM gamma WHERE src IN (SELECT unit FROM cells) AND dst IN (SELECT unit FROM cells)",
    "scaled_field": f"WITH {DIRECTED_VIEW} SELECT src, dst, round(w / (SELECT max(abs(w)) FROM recorded), 9) AS by_max, round(w / (SELECT sqrt(avg(w * w)) FROM recorded), 9) AS by_rms FROM recorded",
    "nearest_areas": f"""WITH {POSITIONS_SQL}, d AS (SELECT a.code AS fips, b.code AS neighbor_fips, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS metres FROM points a JOIN points b ON a.code <> b.code)
      SELECT fips, neighbor_fips, round(metres, 6) AS metres, CAST(row_number() OVER (PARTITION BY fips ORDER BY metres, neighbor_fips) AS INTEGER) AS place FROM d QUALIFY place <= {K}""",
    "blocks": f"WITH {_schedule_sql(FOLDS, '')} SELECT t, block, place, is_transition, fold, part FROM plan",
    "fold_roles": f"WITH {ROLES_VIEW} SELECT fold, t, unit, role FROM roles",
    "fold_summary": f"""WITH {ROLES_VIEW}, c AS (SELECT fold, count(CASE WHEN role = 'training' THEN 1 END) AS training_slots, count(CASE WHEN role = 'separator' THEN 1 END) AS separator_slots,
        count(CASE WHEN role = 'validation' THEN 1 END) AS validation_slots FROM roles GROUP BY 1), u AS (SELECT *, training_slots > 0 AND validation_slots > 0 AS usable FROM c)
      SELECT *, coalesce(fold = (SELECT min(fold) FROM u WHERE usable), false) AS validation_mode FROM u""",
    "blanket_check": "WITH " + ROLES_VIEW + _violations_sql("roles", "fold"),
    "inner_fold_roles": f"WITH {INNER_VIEW} SELECT outer_fold, fold, t, role, count(*) AS slots FROM inner_slots GROUP BY 1, 2, 3, 4",
    "inner_blanket_check": "WITH " + INNER_VIEW + _violations_sql("inner_slots", "outer_fold, fold"),
    "active_pattern_changes": f"WITH {INNER_VIEW} SELECT outer_fold, t, changed FROM jumps",
    "spatial_parts": f"WITH {SPATIAL_VIEW} SELECT fips, part FROM spatial",
    "partition_metrics": f"""WITH {ROLES_VIEW}, s AS (SELECT own AS part, count(*) AS size FROM members GROUP BY 1), e AS (SELECT part, count(*) AS separator FROM near GROUP BY 1),
      c AS (SELECT a.own AS a, b.own AS b FROM edges JOIN members a ON a.unit = src JOIN members b ON b.unit = dst WHERE a.own <> b.own),
      x AS (SELECT part, count(*) AS cut_edges FROM (SELECT a AS part FROM c UNION ALL SELECT b FROM c) GROUP BY 1)
      SELECT s.part, size, coalesce(separator, 0) AS separator, coalesce(cut_edges, 0) AS cut_edges, round((SELECT stddev_pop(size) FROM s), 6) AS size_spread,
        round(abs(size - (SELECT avg(size) FROM s)) / (SELECT avg(size) FROM s), 6) AS deviation FROM s LEFT JOIN e ON e.part = s.part LEFT JOIN x ON x.part = s.part""",
}
