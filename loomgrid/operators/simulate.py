"""Gibbs draws of panels: whole panels, or held-out slots given the rest.

Connected blocks of units are independent given what is held fixed, so each block is one task's work, with all draws at once. Inside
a block units are coloured so that no two neighbours share a colour, and a colour is updated together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.fits import seed_of
from loomgrid.operators.graph import both_ways, components
from loomgrid.session import cut_lineage

#: Draws x slots of a block that a task takes on; larger blocks are refused rather than gathered.
MOST_SPINS = 50_000_000


def colours(neighbours: list[np.ndarray]) -> np.ndarray:
    """Greedy colouring, most neighbours first."""
    out = np.full(len(neighbours), -1)
    for i in sorted(range(len(neighbours)), key=lambda i: -len(neighbours[i])):
        taken = set(out[neighbours[i]].tolist())
        colour = 0
        while colour in taken:
            colour += 1
        out[i] = colour
    return out


def draw_block(slots: pd.DataFrame, edges: pd.DataFrame, draws: int, sweeps: int, beta: float, eta: float, xi: float, seed: int) -> pd.DataFrame:
    """Draws of a block. ``slots``: unit, t, x, z, theta, prev_x, prev_t (the unit's row before, if any), outside (the fixed
    neighbours' weighted sum), free; ``edges``: src, dst, w both ways."""
    names, unit = np.unique(slots["unit"].to_numpy(object), return_inverse=True)
    if draws * len(slots) > MOST_SPINS:
        raise ValueError(f"a block of {len(names)} units is too large for one task: {draws} draws x {len(slots)} slots exceed {MOST_SPINS}")
    rng = np.random.default_rng(seed)
    place = {n: i for i, n in enumerate(names)}
    links: list[list[tuple[int, float]]] = [[] for _ in names]
    for a, b, w in zip(edges["src"], edges["dst"], edges["w"]):
        links[place[a]].append((place[b], w))
    near = [np.array([j for j, _ in link], int) for link in links]
    colour = colours(near)
    degree = np.array([len(link) for link in links], int)
    first = np.cumsum(degree) - degree
    index = np.concatenate([*near, np.zeros(0, int)])
    weight = xi * np.array([w for link in links for _, w in link], float)
    order = np.lexsort((unit, slots["t"].to_numpy()))
    get = lambda c: slots[c].to_numpy()[order]
    t, unit, x, z, theta, prev, outside, free = get("t"), unit[order], get("x"), get("z"), get("theta"), get("prev_x"), get("outside"), get("free").astype(bool)
    prev_t = get("prev_t").astype(float)
    state = np.zeros((draws, len(names)))
    seen = np.full(len(names), np.nan)  # the time at which a unit was last drawn
    drawn = np.zeros((draws, len(t)))
    for a, b in _runs(t):
        here = unit[a:b]
        before = np.where(seen[here] == prev_t[a:b], state[:, here], prev[a:b])
        fixed = theta[a:b] + beta * z[a:b] + xi * outside[a:b] + eta * before
        current = np.zeros((draws, len(names)))
        current[:, here] = np.where(free[a:b], rng.choice([-1.0, 1.0], (draws, b - a)), x[a:b])
        inside = np.full(len(names), -1)
        inside[here] = np.arange(b - a)
        groups = [g for c in range(colour.max(initial=-1) + 1) if len(g := here[(colour[here] == c) & free[a:b]])]
        terms = [_terms(first[g], degree[g]) for g in groups]
        for _ in range(sweeps):
            for k in rng.permutation(len(groups)):
                g, (flat, starts, linked) = groups[k], terms[k]
                h = fixed[:, inside[g]]
                if len(starts):
                    h[:, linked] += np.add.reduceat(current[:, index[flat]] * weight[flat], starts, axis=1)
                current[:, g] = np.where(rng.random(h.shape) < 1 / (1 + np.exp(-2 * h)), 1.0, -1.0)
        drawn[:, a:b] = current[:, here]
        state[:, here] = current[:, here]
        seen[here] = t[a]
    kept = np.flatnonzero(free)
    return pd.DataFrame({
        "draw": np.repeat(np.arange(draws), len(kept)), "unit": np.tile(names[unit[kept]], draws), "t": np.tile(t[kept], draws), "x": drawn[:, kept].ravel().astype(int),
    })


def _terms(first: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all links of some units one after the other, where those of each unit with links start, and which units these are."""
    starts = np.cumsum(degree) - degree
    linked = np.flatnonzero(degree)
    return np.arange(degree.sum()) + np.repeat(first - starts, degree), starts[linked], linked


def _runs(t: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
    return list(zip(cuts[:-1], cuts[1:]))


def gibbs(panel: DataFrame, edges: DataFrame, free: str, draws: int, sweeps: int, beta: float, eta: float, xi: float, seed: int) -> DataFrame:
    """(draw, unit, t, x) for the slots marked ``free``; all others keep their x. ``panel``: unit, t, x, z, theta, prev_x and the mark;
    ``edges``: undirected pairs. Free slots start at random, and are carried to the unit's next row.

    Blocks are the connected components of the free slots (neighbours at one time, and rows of a unit that follow each other): given
    the fixed slots they are independent. The draws depend on the seed and the block only.
    """
    both = both_ways(edges)
    node = lambda unit, t: F.concat_ws("@", unit, t)
    along = Window.partitionBy("unit").orderBy("t")
    marked = panel.withColumns({"prev_t": F.lag("t").over(along), "begins": ~F.coalesce(F.lag(free).over(along), F.lit(False))})
    # free rows of a unit that follow each other are one node, named by the smallest of its slots: the rounds of the components see no times
    slots = marked.where(free).withColumn("run", F.sum(F.col("begins").cast("int")).over(along))
    slots = slots.withColumn("node", F.min(node("unit", "t")).over(Window.partitionBy("unit", "run")))
    slots = cut_lineage(slots.select("unit", "t", "x", "z", "theta", "prev_x", "prev_t", "node"))
    ends = lambda side, name: slots.select(F.col("unit").alias(side), "t", F.col("node").alias(name))
    beside = both.join(ends("src", "a"), "src").join(ends("dst", "b"), ["dst", "t"]).groupBy("a", "b", "src", "dst").agg(F.max("w").alias("w"))
    beside = cut_lineage(beside)
    labels = components(beside.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    fixed = panel.where(~F.col(free)).select(F.col("unit").alias("dst"), "t", F.col("x").alias("v"))
    outside = both.join(fixed, "dst").groupBy(F.col("src").alias("unit"), "t").agg(F.sum(F.col("w") * F.col("v")).alias("outside"))
    placed = slots.join(labels, "node", "left").join(outside, ["unit", "t"], "left")
    placed = placed.select(F.coalesce("component", "node").alias("block"), "unit", "t", "x", "z", "theta", "prev_x", "prev_t", F.coalesce("outside", F.lit(0.0)).alias("outside"), F.lit(True).alias("free"))
    pairs = beside.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("component").alias("link_block"), "src", "dst").agg(F.max("w").alias("w"))

    def work(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return draw_block(a, b, draws, sweeps, beta, eta, xi, seed_of(seed, key[0]))

    kind = panel.schema["unit"].dataType.simpleString()
    return placed.groupBy("block").cogroup(pairs.groupBy("link_block")).applyInPandas(work, f"draw int, unit {kind}, t int, x int")


def gibbs_panels(panel: DataFrame, edges: DataFrame, draws: int, sweeps: int, beta: float, eta: float, xi: float, seed: int) -> DataFrame:
    """(draw, unit, t, x) of whole panels: as ``gibbs`` with every slot free, on all edges between the panel's units.

    With all slots free the blocks are the components of the units' graph, and a large one is to be expected. Draws are independent
    of each other, so each draw of a block is a task of its own, which depends on the seed, the block and the draw only.
    """
    marked = panel.withColumn("prev_t", F.lag("t").over(Window.partitionBy("unit").orderBy("t")))
    slots = cut_lineage(marked.select("unit", "t", "x", "z", "theta", "prev_x", "prev_t"))
    units = slots.select("unit").distinct()
    both = both_ways(edges).join(units.withColumnRenamed("unit", "src"), "src", "left_semi").join(units.withColumnRenamed("unit", "dst"), "dst", "left_semi")
    both = cut_lineage(both)
    labels = components(both)
    each = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    placed = slots.join(labels.withColumnRenamed("node", "unit"), "unit", "left").withColumn("block", F.coalesce("component", "unit"))
    placed = placed.select("block", "unit", "t", "x", "z", "theta", "prev_x", "prev_t", F.lit(0.0).alias("outside"), F.lit(True).alias("free"), each.alias("draw"))
    pairs = both.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("component").alias("link_block"), "src", "dst", "w", each.alias("link_draw"))

    def work(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return draw_block(a, b, 1, sweeps, beta, eta, xi, seed_of(seed, *key)).assign(draw=key[1])

    kind = panel.schema["unit"].dataType.simpleString()
    return placed.groupBy("block", "draw").cogroup(pairs.groupBy("link_block", "link_draw")).applyInPandas(work, f"draw int, unit {kind}, t int, x int")
