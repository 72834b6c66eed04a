"""Filling gaps of a panel by synthetic nearest neighbours: a unit's series regressed on its donors' by principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import cut_lineage


def anchors(seen: np.ndarray, target: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Donor rows seen at ``at`` and times, both as many as possible, at which the target and all these donors are seen: donors are
    taken in order of their overlap, and the squarest block met on the way is kept."""
    times = seen[target].copy()
    times[at] = False
    donors = np.flatnonzero(seen[:, at])
    donors = donors[donors != target]
    order = donors[np.argsort(-(seen[donors] & times).sum(1), kind="stable")]
    best, rows, shared = (0, np.zeros(0, int), np.zeros(0, int)), [], times
    for d in order:
        shared = shared & seen[d]
        rows.append(d)
        if min(len(rows), shared.sum()) > best[0]:
            best = (min(len(rows), int(shared.sum())), np.array(rows), np.flatnonzero(shared))
    return best[1], best[2]


def component_rank(s: np.ndarray, ratio: float) -> int:
    """Singular values above the threshold for unknown noise (a cubic in the shape's ratio times their median), at least one."""
    # fixed values of the published approximation (cubic, square, linear, constant)
    threshold = np.polyval([0.56, -0.95, 1.82, 1.43], ratio) * np.median(s)
    return max(int((s > threshold).sum()), 1)


def predict(values: np.ndarray, target: int, at: int, span_eps: float, subspace_eps: float) -> tuple[float, bool]:
    """The target's value at ``at`` and whether both tests hold (training error, and the donors' values at ``at`` in the space of
    their other times); NaN without anchors."""
    rows, times = anchors(~np.isnan(values), target, at)
    if not len(rows):
        return np.nan, False
    x, y, new = values[np.ix_(rows, times)].T, values[target, times], values[rows, at]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    if not s[0] > 0:
        return np.nan, False
    k = min(component_rank(s, min(x.shape) / max(x.shape)), int((s > 1e-10 * s[0]).sum()))
    weights = (vt[:k].T / s[:k]) @ (u[:, :k].T @ y)
    error = (np.linalg.norm(x @ weights - y) / max(np.linalg.norm(y), 1e-12)) ** 2
    off = (np.linalg.norm(new - vt[:k].T @ (vt[:k] @ new)) / max(np.linalg.norm(new), 1e-12)) ** 2
    return float(np.clip(new @ weights, -1.0, 1.0)), bool(error <= span_eps and off <= subspace_eps)


def complete(panel: DataFrame, donors: DataFrame, times: int, span_eps: float = 0.5, subspace_eps: float = 0.5, width: int = 32) -> DataFrame:
    """(unit, t, value, feasible) of every slot without a value of the panel's units. ``panel``: unit, t, value; ``donors``: unit, neighbor, place.
    Infeasible values are given all the same; a slot for which no units have anchors gets a null that is not feasible.

    Each unit is joined with its donors' series, a bounded number, so no task holds more than a few series at a time. Slots left open
    go on to all other units in blocks of about ``width``, twice as many blocks in each round, and take the value of the first block
    that is feasible, else of the first that has any.
    """
    valued = panel.where(F.col("value").isNotNull())
    series = valued.groupBy("unit").agg(F.collect_list(F.struct("t", F.col("value").cast("double").alias("v"))).alias("s"))
    series = cut_lineage(series)
    given = donors.join(series.select(F.col("unit").alias("neighbor"), F.col("s").alias("ns")), "neighbor")
    grouped = given.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("place", "ns"))).alias("others"))
    rows = panel.select("unit").distinct().join(series, "unit", "left").join(grouped, "unit", "left")
    rows = rows.select("unit", "s", F.transform("others", lambda o: o["ns"]).alias("others"), F.lit(None).cast("array<int>").alias("at"), F.lit(-1).alias("block"))

    def dense(points: list[dict] | None) -> np.ndarray:
        out = np.full(times, np.nan)
        for p in points or []:
            out[p["t"]] = p["v"]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                values = np.stack([dense(row["s"]), *map(dense, row["others"] or [])])
                slots = np.flatnonzero(np.isnan(values[0])) if row["at"] is None else row["at"]
                found += [(row["unit"], int(at), row["block"], *predict(values, 0, int(at), span_eps, subspace_eps)) for at in slots]
            if found:
                unit, at, block, value, feasible = zip(*found)
                columns = [pa.array(unit, batch["unit"].type), pa.array(at, pa.int32()), pa.array(block, pa.int32()), pa.array(value, pa.float64(), from_pandas=True), pa.array(feasible, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "t", "block", "value", "feasible"])

    kind = panel.schema["unit"].dataType.simpleString()
    schema = f"unit {kind}, t int, block int, value double, feasible boolean"
    first = cut_lineage(rows.mapInArrow(run, schema)).drop("block")
    out = first.where(F.col("value").isNotNull())
    # without a value of its own at another time, or one of any unit at its time, a slot stays null
    missed = first.where(F.col("value").isNull())
    able = missed.join(series.select("unit"), "unit", "left_semi").join(valued.select("t").distinct(), "t", "left_semi").select("unit", "t")
    hopeless = missed.join(able, ["unit", "t"], "left_anti")
    still = cut_lineage(able)
    many = -(-max(series.count(), 1) // width)
    blocks = cut_lineage(series.groupBy(F.pmod(F.xxhash64("unit"), F.lit(many)).cast("int").alias("block")).agg(F.collect_list("s").alias("others")))
    low, step = 0, 1
    while low < many and not still.isEmpty():
        high = min(low + step, many)
        wanted = still.groupBy("unit").agg(F.sort_array(F.collect_list("t")).alias("at")).join(series, "unit")
        tried = wanted.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).join(blocks, "block").select("unit", "s", "others", "at", "block")
        found = tried.mapInArrow(run, schema).where(F.col("value").isNotNull())
        best = F.min(F.struct((~F.col("feasible")).alias("rank"), "block", "value", "feasible")).alias("b")
        found = cut_lineage(found.groupBy("unit", "t").agg(best).select("unit", "t", "b.value", "b.feasible"))
        out = out.unionByName(found)
        still = cut_lineage(still.join(found, ["unit", "t"], "left_anti"))
        low, step = high, step * 2
    rest = still.withColumns({"value": F.lit(None).cast("double"), "feasible": F.lit(False)})
    return out.unionByName(hopeless).unionByName(rest)
