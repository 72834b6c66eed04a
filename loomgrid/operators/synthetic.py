"""Low-rank fields and interventions over given units, optionally sharing factors (confounding).

Factors of the units are Gaussian draws by unit, made orthonormal with the Gram matrix of all of them, which is summed over
the units; factors of the times are few and made on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.fits import MOST_TIMES, seed_of


def normals(units: list, rank: int, seed: int) -> np.ndarray:
    return np.stack([np.random.default_rng(seed_of(seed, u)).standard_normal(rank) for u in units]) if units else np.zeros((0, rank))


def orthonormal_factors(units: DataFrame, unit: str, rank: int, seed: int) -> tuple[np.ndarray, int]:
    """The rank x rank matrix that makes the units' draws orthonormal, and the number of units; earlier columns don't depend on later
    ones, so a first part of the columns and the rest span complements. Fails with fewer units than ``rank``."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((rank, rank)), 0
        for batch in batches:
            g = normals(batch["unit"].to_pylist(), rank, seed)
            total, n = total + g.T @ g, n + len(g)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["i", "v"])

    named = units.select(F.col(unit).alias("unit"))
    rows = named.mapInArrow(gram, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    n = int(rows[-1]) if len(rows) else 0
    if n < rank:
        raise ValueError(f"{n} units are too few for rank {rank}")
    return np.linalg.inv(np.linalg.cholesky(rows[:-1].reshape(rank, rank)).T), n


def confounded_panel(
    units: DataFrame, unit: str, times: int, strengths: list[float], shared: int, own: int, slope: float, seed: int
) -> DataFrame:
    """(unit, t, theta, chance, z). Interventions have ``shared`` factors: z is +1 with chance 0.5 + slope x score, kept within 0 and 1.
    The field has the same ``shared`` unit and time factors and ``own`` further ones orthogonal to them, with the given singular
    values (over the square root of the number of slots, so that a value of 1 is a field of size about 1)."""
    rank = shared + own
    if len(strengths) != rank or times < rank or times > MOST_TIMES:
        raise ValueError("one strength per factor, and between that many and MOST_TIMES times")
    turn, n = orthonormal_factors(units, unit, rank, seed)
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((times, rank)))[0]
    size = np.sqrt(float(times) * n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["unit"].to_pylist()
            if not names:
                continue
            v = normals(names, rank, seed) @ turn
            theta = (v * np.array(strengths)) @ u.T * size
            score = v[:, :shared] @ u[:, :shared].T * size
            chance = np.clip(0.5 + slope * score, 0.0, 1.0)
            luck = np.stack([np.random.default_rng(seed_of(seed, "z", name)).random(times) for name in names])
            yield pa.RecordBatch.from_arrays(
                [batch["unit"].take(pa.array(np.repeat(np.arange(len(names)), times))), pa.array(np.tile(np.arange(times, dtype=np.int32), len(names))),
                 pa.array(theta.ravel()), pa.array(chance.ravel()), pa.array(np.where(luck < chance, 1, -1).astype(np.int32).ravel())],
                names=["unit", "t", "theta", "chance", "z"],
            )

    kind = units.schema[unit].dataType.simpleString()
    return units.select(F.col(unit).alias("unit")).mapInArrow(emit, f"unit {kind}, t int, theta double, chance double, z int")
