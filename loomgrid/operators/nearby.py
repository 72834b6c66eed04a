"""Points near other points, and the regions that contain points.

Points are hashed to grid cells a little wider than the radius, each point looks into its own and
the neighbouring cells, and the exact distance (or the polygon) decides. Crowded cells are split
before the join: either side is salted and copied once per salt of the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.skew import CROWDED, join_both

EARTH_RADIUS_M = 6_371_008.8
#: Cells are wider than the radius by this factor, so that rounding can't push a neighbour two cells away.
WIDER = 1.000001
#: Cells from the origin up to which that holds.
FARTHEST_CELL = 2.0**31


def _finite(c: Column, limit: float = math.inf) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(limit))


def points_once(points: DataFrame, key: str, x: str, y: str, limit: float = math.inf) -> DataFrame:
    """(id, x, y) of each key with a position; null keys, null, NaN and infinite positions (and those from ``limit`` on) are left
    out, of a key with several positions the smallest (x, y) counts."""
    seen = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    seen = seen.where(F.col("id").isNotNull() & _finite(F.col("x"), limit) & _finite(F.col("y"), limit))
    return seen.groupBy("id").agg(F.min(F.struct("x", "y")).alias("at")).select("id", "at.x", "at.y")


def near_in_plane(points: DataFrame, key: str, x: str, y: str, radius: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs of different keys at most ``radius`` apart (exactly the radius included), each once:
    ``key``, ``neighbor``, ``distance``, with key < neighbor. An empty table gives no pairs.

    Each point probes half of the cells around it, the own one in id order, so that a pair is met
    once. The number of pairs is that of the result; nothing else is paired. A coordinate of FARTHEST_CELL
    times the radius or more is no position.
    """
    size = radius * WIDER
    once = points_once(points, key, x, y, size * FARTHEST_CELL).withColumns(
        {"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}
    )
    half = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    probes = once.withColumn("o", F.explode(half)).select(
        "id", "x", "y", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"),
        ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("same"),
    )
    met = join_both(once, probes, ["cx", "cy"], crowded)
    square = (F.col("x") - F.col("probe_x")) * (F.col("x") - F.col("probe_x")) + (F.col("y") - F.col("probe_y")) * (F.col("y") - F.col("probe_y"))
    met = met.where((~F.col("probe_same") | (F.col("probe_id") < F.col("id"))) & (square <= F.lit(float(radius) ** 2)))
    return met.select(
        F.least("id", "probe_id").alias(key), F.greatest("id", "probe_id").alias("neighbor"), F.sqrt(square).alias("distance")
    )


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def near_on_sphere(points: DataFrame, key: str, lon: str, lat: str, radius: float, crowded: int = CROWDED) -> DataFrame:
    """As ``near_in_plane`` by great-circle distance. Bands of latitude are cut into cells as wide
    as the radius at the band's edge nearest a pole; a probe covers the cells of three bands that its
    circle can reach, over the date line too. Latitudes outside -90..90 are no positions."""
    angle = math.degrees(radius / EARTH_RADIUS_M) * WIDER
    once = points_once(points, key, lon, lat).where(F.abs("y") <= 90)
    once = once.withColumns({"x": F.pmod(F.col("x") + 180.0, F.lit(360.0)) - 180.0, "band": F.floor(F.col("y") / angle).cast("long")})

    def cells(band: Column) -> Column:
        """Number of cells around the band."""
        edge = F.least(F.greatest(F.abs(band * angle), F.abs((band + 1) * angle)), F.lit(90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / angle), F.lit(1)).cast("long")

    def cell(x: Column, band: Column) -> Column:
        return F.floor((x + 180.0) / 360.0 * cells(band)).cast("long")

    own = once.withColumn("cell", F.pmod(cell(F.col("x"), F.col("band")), cells(F.col("band"))))
    # the widest difference in longitude at which the circle is touched
    ratio = F.sin(F.radians(F.lit(angle))) / F.cos(F.radians(F.col("y")))
    reach = F.when(F.abs("y") + angle >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * WIDER)
    probes = once.withColumn("reach", reach).select(
        "id", "x", "y", "reach", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    )
    low, high = cell(F.col("x") - F.col("reach"), F.col("band")), cell(F.col("x") + F.col("reach"), F.col("band"))
    covered = F.transform(F.sequence(low, F.least(high, low + cells(F.col("band")) - 1)), lambda c: F.pmod(c, cells(F.col("band"))))
    probes = probes.withColumn("cell", F.explode(F.array_distinct(covered))).select("id", "x", "y", "band", "cell")
    met = join_both(own, probes, ["band", "cell"], crowded).where(F.col("id") < F.col("probe_id"))
    met = met.withColumn("distance", great_circle(F.col("x"), F.col("y"), F.col("probe_x"), F.col("probe_y")))
    return met.where(F.col("distance") <= radius).select(F.col("id").alias(key), F.col("probe_id").alias("neighbor"), "distance")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over ``ring``, an array of (x, y) corners. A point on the lower or left edge counts as
    inside, on the upper or right edge as outside; fewer than three corners contain nothing."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, (i + 1).cast("int")), F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.when(n >= 3, hits % 2 == 1).otherwise(False)


def points_in_regions(
    points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region: str, ring: str, size: float, crowded: int = CROWDED
) -> DataFrame:
    """(key, region) of each point and polygon that holds it. Regions are laid over grid cells of
    ``size`` (chosen near the size of a small region), so a point meets only polygons whose box touches
    its cell. A point may lie in several regions or none; a coordinate of FARTHEST_CELL times ``size`` or more is no position."""
    once = points_once(points, key, x, y, size * FARTHEST_CELL).withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    shape = regions.where(F.size(ring) >= 3).select(F.col(region).alias("region_id"), F.col(ring).alias("ring"))
    box = lambda f, axis: F.floor(f(F.transform("ring", lambda p: p[axis])) / size)
    shape = shape.withColumn("cx", F.explode(F.sequence(box(F.array_min, "x"), box(F.array_max, "x"))))
    shape = shape.withColumn("cy", F.explode(F.sequence(box(F.array_min, "y"), box(F.array_max, "y"))))
    shape = shape.select("cx", "cy", F.col("region_id").alias("id"), "ring")
    met = join_both(once, shape, ["cx", "cy"], crowded)
    return met.where(in_polygon(F.col("x"), F.col("y"), F.col("probe_ring"))).select(
        F.col("id").alias(key), F.col("probe_id").alias(region)
    )
