"""Graphs as edge tables: normalisation, checks, neighbour sums, components, nearest neighbours, random graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.nearby import WIDER, points_once
from loomgrid.operators.skew import CROWDED, copied, hot_keys, join_both, spread, spread_rows
from loomgrid.session import cut_lineage

TINY = 1e-12


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected pairs (src, dst, w) in both directions."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back)


def infinity_norm(edges: DataFrame) -> Column:
    """Greatest row sum of absolute weights, as a scalar of another plan."""
    return edges.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).scalar()


def normalised(edges: DataFrame, degenerate_to_zero: bool = False) -> DataFrame:
    """Weights over the infinity norm; a norm below 1e-12 leaves them (or makes them zero)."""
    norm = infinity_norm(edges)
    small = F.lit(0.0) if degenerate_to_zero else F.col("w")
    return edges.withColumn("w", F.when(norm >= TINY, F.col("w") / norm).otherwise(small))


def symmetric_by_max(directed: DataFrame) -> DataFrame:
    """max(A, A') without diagonal and zeros."""
    edges = both_ways(directed).where(F.col("src") != F.col("dst"))
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w")).where(F.col("w") != 0)


def symmetric_by_mean(directed: DataFrame) -> DataFrame:
    """(A + A') / 2 without diagonal; an absent direction counts as zero."""
    edges = both_ways(directed).where(F.col("src") != F.col("dst"))
    return edges.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def asymmetry(directed: DataFrame) -> DataFrame:
    """One row: loops, the greatest difference between directions, and how many pairs differ by more than 1e-12."""
    back = directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    joined = directed.join(back, ["src", "dst"], "full_outer")
    gap = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))
    return joined.agg(
        F.count(F.when((F.col("src") == F.col("dst")) & (F.col("w") != 0), 1)).alias("loops"), F.max(gap).alias("greatest_gap"),
        F.count(F.when((gap > TINY) & (F.col("src") < F.col("dst")), 1)).alias("differing_pairs"),
    )


def neighbour_sum(edges: DataFrame, panel: DataFrame, unit: str, t: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the weighted sum of the neighbours' values at the same time, 0 where there is none. ``edges`` in both
    directions. A hub's edges are spread over tasks, and its terms added up before the shuffle."""
    other = panel.select(F.col(unit).alias("dst"), t, F.col(value).alias("_v"))
    links, other, key = spread(edges.select("src", "dst", "w"), other, ["dst"], "src")
    sums = links.join(other, key).groupBy(F.col("src").alias(unit), t).agg(F.sum(F.col("w") * F.col("_v")).alias(name))
    return panel.join(sums, [unit, t], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, nodes without edges excepted.

    Each round takes the smallest label among neighbours and then the label's own label, so the rounds grow with the
    logarithm of the longest path; labels are written out each round. The edges of a hub, and the nodes of a large
    component, which share one label, are spread over tasks.
    """
    links = both_ways(edges.select("src", "dst", F.lit(1.0).alias("w"))).select("src", "dst").distinct()
    links = cut_lineage(links)
    hubs = cut_lineage(hot_keys(links, ["dst"], "_parts"))
    links = cut_lineage(spread_rows(links, hubs, ["dst"], "src"))
    labels = cut_lineage(links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    few = labels.count() <= CROWDED  # then no label can be hot
    for _ in range(most_rounds):
        named = copied(labels.select(F.col("node").alias("dst"), "component"), hubs, ["dst"])
        least = links.join(named, ["dst", "_salt"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        hooked = labels.join(least, "node", "left").select("node", F.least("component", F.coalesce("seen", "component")).alias("next"), "component")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("further"))
        ends, jump, key = (hooked, jump, ["next"]) if few else spread(hooked, jump, ["next"], "node")
        moved = ends.join(jump, key, "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), F.col("component").alias("before"))
        moved = cut_lineage(moved)
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("before")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def nearest(points: DataFrame, key: str, x: str, y: str, k: int, crowded: int = CROWDED, most_rounds: int = 60) -> DataFrame:
    """The ``k`` nearest other keys of each key in the plane (all, if there are fewer), of equal distances the smaller keys:
    ``key``, ``neighbor``, ``distance``, ``place`` (1 to k).

    Points look into the cells around them; who finds k neighbours no farther than a cell is wide is done, the others go on with cells three
    times as wide. The first cells are so small that none holds more than ``crowded`` points, so crowded places are settled there, and wide
    cells are searched by the few remote points only. Of points in one place only the first k + 1 can be neighbours. Cells that still
    hold very many points or searchers are split.
    """
    once = cut_lineage(points_once(points, key, x, y))
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    targets = cut_lineage(once.withColumn("n", first).where(F.col("n") <= k + 1).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")))
    frame = once.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    spark = points.sparkSession
    kind = points.schema[key].dataType.simpleString()
    found = spark.createDataFrame([], f"id {kind}, other {kind}, distance double, place int")
    if frame.n < 2:
        return found.select(F.col("id").alias(key), F.col("other").alias("neighbor"), "distance", "place")
    wide = max(frame.high_x - frame.low_x, frame.high_y - frame.low_y)
    size = max(wide / frame.n**0.5, wide * 2.0**-30, 1e-9)
    cell = lambda x, y, step: {"cx": F.floor(F.col(x) / step), "cy": F.floor(F.col(y) / step)}
    while size > wide * 2.0**-30 and targets.withColumns(cell("ox", "oy", size * WIDER)).groupBy("cx", "cy").count().agg(F.max("count")).first()[0] > crowded:
        size /= 8
    open_points = once
    order = Window.partitionBy("id").orderBy("distance", "other")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(most_rounds):
        last = size > wide
        step = size * WIDER
        probes = open_points.withColumns(cell("x", "y", step)).withColumn("o", around).select("id", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        placed = targets.withColumns(cell("ox", "oy", step))
        if frame.n <= crowded:  # then no cell can be crowded
            met = placed.join(probes, ["cx", "cy"])
        else:
            met = join_both(placed, probes, ["cx", "cy"], crowded, ("other", "id")).withColumnsRenamed({f"probe_{c}": c for c in ("id", "x", "y")})
        met = met.where(F.col("id") != F.col("other"))
        met = met.withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)))
        ranked = cut_lineage(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "other", "distance", "place"))
        far = ranked.groupBy("id").agg(F.max("place").alias("n"), F.max("distance").alias("d"))
        done = far if last else far.where((F.col("n") == k) & (F.col("d") <= size)).select("id")
        found = found.unionByName(ranked.join(done.select("id"), "id", "left_semi"))
        if last:
            break
        open_points = cut_lineage(open_points.join(done.select("id"), "id", "left_anti"))
        if open_points.isEmpty():
            break
        size *= 3
    return found.select(F.col("id").alias(key), F.col("other").alias("neighbor"), "distance", "place")


def median_distance(points: DataFrame, key: str, x: str, y: str, cells: int = 512) -> float:
    """The median distance over all pairs of points, to within a cell's diagonal of the square grid of ``cells`` a side.

    Points are counted per cell (at most cells squared rows reach the driver), and the counts' autocorrelation gives how many pairs
    lie how far apart, so no pairs are formed.
    """
    once = points_once(points, key, x, y)
    frame = once.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    if frame.low_x is None:
        return 0.0
    size = max(frame.high_x - frame.low_x, frame.high_y - frame.low_y) / (cells - 1)
    if size <= 0:
        return 0.0
    place = lambda c, low: F.floor((F.col(c) - low) / size + 0.5).cast("int")
    counts = once.groupBy(place("x", frame.low_x).alias("i"), place("y", frame.low_y).alias("j")).count().toPandas()
    grid = np.zeros((2 * cells, 2 * cells))
    grid[counts["i"], counts["j"]] = counts["count"]
    spectrum = np.fft.rfft2(grid)
    pairs = np.rint(np.fft.irfft2(spectrum * np.conj(spectrum), grid.shape))
    pairs[0, 0] -= grid.sum()
    shift = np.minimum(np.arange(2 * cells), 2 * cells - np.arange(2 * cells))
    far = np.hypot(shift[:, None], shift[None, :]).ravel() * size
    order = np.argsort(far)
    below = np.cumsum(pairs.ravel()[order])
    return float(far[order][np.searchsorted(below, below[-1] / 2)]) if below[-1] > 0 else 0.0


def kernel_weight(distance: Column, scale: float) -> Column:
    """exp(-distance / scale); 1 where the scale isn't positive."""
    return F.exp(-distance / F.lit(scale)) if scale > 0 else F.lit(1.0)


def random_graph(nodes: DataFrame, number: str, n: int, p: float, seed: int) -> DataFrame:
    """(i, j), i < j: each pair of the numbers 0 to n - 1 with chance ``p``, the same for the same seed. Each node draws the gaps to
    its next partners, so the work is that of the edges, not of the pairs."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for i in batch[number].to_pylist():
                rng = np.random.default_rng((seed, i))
                at = i
                while p > 0:
                    gaps = rng.geometric(p, 64)
                    steps = at + np.cumsum(gaps)
                    inside = steps[steps < n]
                    left.append(np.full(len(inside), i, np.int32))
                    right.append(inside.astype(np.int32))
                    if len(inside) < len(steps):
                        break
                    at = int(steps[-1])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["i", "j"])

    return nodes.select(F.col(number).cast("int").alias(number)).mapInArrow(draw, "i int, j int")
