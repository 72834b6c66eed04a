"""Pseudo-likelihood fits of a panel, by sums over units.

Scalars are fitted by Newton steps on aggregates of the slots. Low-rank fields keep the factors of the times on the driver (times
x rank, bounded by the calendar) while those of the units are never gathered: each pass over the units takes their factors one step
further and adds up what the next step of the times needs. Every few steps the units' state is written to the shared folder, so a pass
repeats only the steps since then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import slot_loss
from loomgrid.session import cut_lineage, written_table

FEATURES = {"beta": "z", "xi": "neighbours", "eta": "prev_x"}
#: Bound on the times, whose factors and Gram matrix the driver holds: a calendar of weeks or days, not a cap on data.
MOST_TIMES = 5_000
#: Steps after which the units' state is written.
KEPT_STEPS = 8


def seed_of(*parts: object) -> int:
    """An unsigned 64-bit seed from the ``|``-joined parts."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def fit_scalars(slots: DataFrame, fixed: dict[str, float] | None = None, loss_mask: Column | None = None, beta_mask: Column | None = None, steps: int = 30, tol: float = 1e-10) -> dict:
    """beta, xi, eta (those not ``fixed``) without a field. The gradient of beta is taken over its own mask and count, so with
    a beta mask the solution is where all three gradients vanish. Fails on an empty mask."""
    fixed = fixed or {}
    loss_mask = F.lit(True) if loss_mask is None else loss_mask
    masks = {k: loss_mask & (beta_mask if k == "beta" and beta_mask is not None else F.lit(True)) for k in FEATURES}
    rows = cut_lineage(slots.select("x", *FEATURES.values(), *[m.alias(f"m_{k}") for k, m in masks.items()], loss_mask.alias("m")))
    free = [k for k in FEATURES if k not in fixed]
    values = {k: float(fixed.get(k, 0.0)) for k in FEATURES}

    def moments(at: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
        h = sum((F.lit(at[k]) * F.col(f) for k, f in FEATURES.items()), F.lit(0.0))
        r, w = F.tanh(h) - F.col("x"), 1 - F.pow(F.tanh(h), 2)
        aggs = [F.avg(F.when(F.col("m"), slot_loss(h, F.col("x")))).alias("loss")]
        for k in free:
            f = F.col(FEATURES[k])
            aggs.append(F.avg(F.when(F.col(f"m_{k}"), r * f)).alias(f"g_{k}"))
            aggs += [F.avg(F.when(F.col(f"m_{k}"), w * f * F.col(FEATURES[o]))).alias(f"j_{k}_{o}") for o in free]
        got = rows.agg(*aggs).first()
        if got["loss"] is None:
            raise ValueError("the loss mask is empty")
        return got["loss"], np.array([got[f"g_{k}"] or 0.0 for k in free]), np.array([[got[f"j_{k}_{o}"] or 0.0 for o in free] for k in free])

    history: list[float] = []
    for _ in range(steps):
        loss, gradient, jacobian = moments(values)
        history.append(loss)
        if not free or np.abs(gradient).max() < tol:
            break
        step = np.linalg.lstsq(jacobian + 1e-12 * np.eye(len(free)), gradient, rcond=None)[0]
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        values = values | {k: values[k] - float(s) for k, s in zip(free, step)}
    return values | {"loss": history[-1], "history": history}


def unit_rows(slots: DataFrame, mask: Column) -> DataFrame:
    """One row per unit with its slots in order of time as arrays (bounded by the calendar)."""
    fields = ["t", "x", *FEATURES.values()]
    each = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in fields], mask.cast("double").alias("m"))))
    grouped = slots.groupBy("unit").agg(each.alias("s"))
    return grouped.select("unit", *[F.col(f"s.{c}").alias(c) for c in (*fields, "m")])


class Slots:
    """The slots of a batch of units, flat."""

    def __init__(self, batch: pa.RecordBatch):
        sizes = np.diff(batch["t"].offsets.to_numpy())
        self.units = batch["unit"]
        self.n = batch.num_rows
        self.unit = np.repeat(np.arange(self.n), sizes)
        get = lambda c: batch[c].flatten().to_numpy()
        self.t = get("t").astype(np.int64)
        self.x, self.m = get("x"), get("m")
        self.features = np.stack([get(f) for f in FEATURES.values()])
        self.state = {c: batch[c] for c in ("v", "theta", "y") if c in batch.schema.names}

    def kept(self, name: str, width: int) -> np.ndarray | None:
        """The state of the units as last written, units x ``width``."""
        return self.state[name].flatten().to_numpy().reshape(self.n, width) if name in self.state else None

    def first(self, rank: int, seed: int, scale: float = 0.1) -> np.ndarray:
        """Starting factors, from the unit's name."""
        return np.stack([np.random.default_rng(seed_of(seed, u)).normal(0.0, scale, rank) for u in self.units.to_pylist()]) if self.n else np.zeros((0, rank))


def summed(rows: DataFrame, work: Callable[[Slots], list[np.ndarray]]) -> list[np.ndarray]:
    """Adds up what ``work`` gives for each batch of units: partial sums per task, then one small aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] = []
        for batch in batches:
            part = work(Slots(batch))
            total = [a + b for a, b in zip(total, part)] if total else part
        if total:
            flat = np.concatenate([np.ravel(a) for a in total])
            shapes = [",".join(map(str, a.shape)) for a in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array([";".join(shapes)] * len(flat))], names=["i", "v", "shape"])

    got = rows.mapInArrow(run, "i int, v double, shape string").groupBy("i").agg(F.sum("v").alias("v"), F.first("shape").alias("shape")).toPandas().sort_values("i")
    if got.empty:
        raise ValueError("no slots")
    flat, out, at = got["v"].to_numpy(), [], 0
    for text in got["shape"].iloc[0].split(";"):
        shape = tuple(int(n) for n in text.split(",") if n)
        size = int(np.prod(shape)) if shape else 1
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def with_state(rows: DataFrame, state: Callable[[Slots], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """The rows with the units' state, written to the shared folder; what they held of it before is replaced."""
    plain = [c for c in rows.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = state(Slots(batch))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in plain], *[pa.array(list(now[n]), pa.list_(pa.float64())) for n in names]], names=[*plain, *names])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain] + [f"{n} array<double>" for n in names]
    return written_table(rows.mapInArrow(run, ", ".join(kinds)))


def residual(s: Slots, u: np.ndarray, v: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = (u[s.t] * v[s.unit]).sum(1) + scalars @ s.features
    return h, (np.tanh(h) - s.x) * s.m


def units_stepped(s: Slots, v: np.ndarray, u: np.ndarray, scalars: np.ndarray, ridge: float) -> np.ndarray:
    """One step of every unit's factor to the minimum of a bound of its loss (whose curvature is at most 1), so that it descends."""
    _, r = residual(s, u, v, scalars)
    rank = u.shape[1]
    gradient = np.stack([np.bincount(s.unit, r * u[s.t, k], s.n) for k in range(rank)], axis=1) + 2 * ridge * v
    curvature = np.stack([[np.bincount(s.unit, s.m * u[s.t, j] * u[s.t, k], s.n) for k in range(rank)] for j in range(rank)]).transpose(2, 0, 1)
    return v - np.linalg.solve(curvature + (2 * ridge + 1e-9) * np.eye(rank), gradient[:, :, None])[:, :, 0]


def replay(s: Slots, history: list[tuple], rank: int, seed: int, ridge: float) -> np.ndarray:
    """The factors of a batch's units after the steps since their state was last written."""
    v = s.kept("v", rank)
    v = s.first(rank, seed) if v is None else v
    for kind, *what in history:
        v = v * what[0] if kind == "scale" else units_stepped(s, v, *what, ridge)
    return v


def fit_low_rank(
    slots: DataFrame, times: int, rank: int, ridge: float, column_max: float | None = None, steps: int = 200, tol: float = 1e-6, starts: int = 1, seed: int = 0, mask: Column | None = None
) -> tuple[dict, np.ndarray, DataFrame]:
    """Alternating low-rank fit of the penalised mean loss: in each step the units' factors, then the times' factors and the scalars, go to
    the minimum of a quadratic bound; unit columns beyond ``column_max`` are scaled back. A start ends when the objective falls by less than
    ``tol`` of itself, or after ``steps``; of several ``starts`` the one with the lowest objective counts. Gives the scalars with
    the course of the objective and whether it ``converged``, the factors of the times, and those of the units (unit, v)."""
    if times > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times")
    rows = cut_lineage(unit_rows(slots, F.lit(True) if mask is None else mask))
    fits = [_low_rank_from(rows, times, rank, ridge, column_max, steps, tol, seed + i) for i in range(starts)]
    return min(fits, key=lambda f: f[0]["objective"][-1])


def _low_rank_from(rows: DataFrame, times: int, rank: int, ridge: float, column_max: float | None, steps: int, tol: float, seed: int) -> tuple[dict, np.ndarray, DataFrame]:
    u, scalars = np.random.default_rng(seed).normal(0.0, 0.1, (times, rank)), np.zeros(len(FEATURES))
    history: list[tuple] = []
    objective: list[float] = []
    loss, converged, kind = 0.0, False, rows.schema["unit"].dataType.simpleString()
    for _ in range(steps):
        history.append(("step", u, scalars))

        def work(s: Slots, done: tuple = tuple(history), u: np.ndarray = u, scalars: np.ndarray = scalars) -> list[np.ndarray]:
            v = replay(s, done, rank, seed, ridge)
            h, r = residual(s, u, v, scalars)
            lost = ((np.logaddexp(h, -h) - s.x * h) * s.m).sum()
            by_time = np.stack([np.bincount(s.t, r * v[s.unit, k], times) for k in range(rank)], axis=1)
            square = np.stack([np.bincount(s.t, s.m * v[s.unit, j] * v[s.unit, k], times) for j in range(rank) for k in range(rank)], axis=1)
            return [np.array([lost, s.m.sum()]), by_time, square, s.features @ r, (s.features * s.m) @ s.features.T, (v**2).sum(0)]

        lost, by_time, square, gradient, curvature, norms = summed(rows, work)
        n = max(lost[1], 1.0)
        loss = lost[0] / n
        objective.append(float(loss + ridge * ((u**2).sum() + norms.sum()) / n))
        converged = len(objective) > 1 and objective[-2] - objective[-1] <= tol * abs(objective[-2])
        over = column_max is not None and bool((np.sqrt(norms) > column_max * (1 + 1e-12)).any())
        if over:
            history.append(("scale", np.minimum(1.0, column_max / np.maximum(np.sqrt(norms), 1e-300))))
        if converged:
            break
        # both together: each goes half as far as it would alone
        pull = 2 * (square.reshape(times, rank, rank) + (ridge + 1e-9) * np.eye(rank))
        u = u - np.linalg.solve(pull, (by_time + 2 * ridge * u)[:, :, None])[:, :, 0]
        scalars = scalars - np.linalg.solve(2 * curvature + 1e-9 * np.eye(len(FEATURES)), gradient)
        if len(history) >= KEPT_STEPS:
            rows = with_state(rows, lambda s, done=tuple(history): {"v": replay(s, list(done), rank, seed, ridge)}, ["v"])
            history = []
    last = tuple(history)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = replay(Slots(batch), list(last), rank, seed, ridge)
            yield pa.RecordBatch.from_arrays([batch["unit"], pa.array(list(v), pa.list_(pa.float64()))], names=["unit", "v"])

    factors = rows.mapInArrow(emit, f"unit {kind}, v array<double>")
    return dict(zip(FEATURES, map(float, scalars))) | {"loss": float(loss), "objective": objective, "converged": converged, "seed": seed}, u, factors


def fit_nuclear(slots: DataFrame, times: int, weight: float, steps: int = 200, mask: Column | None = None, rank: int | None = None, tol: float = 1e-6) -> dict:
    """Accelerated proximal steps on a full field: gradients are local to a unit, and the singular values of the times x units field
    are shrunk by way of its times x times Gram matrix, which is summed over the units. With a ``rank`` plain steps on the
    fields of that rank instead: after each step the largest singular values stay as they are and the others vanish.

    The field's step is half of what its curvature allows and the scalars' a sixth, so that a joint step descends. The fit ends when the
    objective changes by less than ``tol`` of itself (``converged``), or after ``steps``.
    """
    if times > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times")
    rows = cut_lineage(unit_rows(slots, F.lit(True) if mask is None else mask))
    n = float(rows.agg(F.sum(F.aggregate("m", F.lit(0.0), lambda a, b: a + b))).first()[0] or 0.0)
    if not n:
        raise ValueError("the loss mask is empty")
    rate = n / 2
    plan: list[tuple] = []  # (shrink matrix, scalars, momentum) of each step so far
    scalars, y_scalars, momentum = np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), 1.0
    objective: list[float] = []
    shrunk, converged = np.zeros(times), False
    for _ in range(steps):

        def work(s: Slots, done: tuple = tuple(plan), at: np.ndarray = y_scalars) -> list[np.ndarray]:
            theta, y = field_after(s, done, rate, times, n)
            stepped = y - rate * _field_gradient(s, y, at, n)
            h = y[s.unit, s.t] + at @ s.features
            r = (np.tanh(h) - s.x) * s.m
            loss = ((np.logaddexp(h, -h) - s.x * h) * s.m).sum()
            return [np.array([loss]), stepped.T @ stepped, s.features @ r, (s.features**2) @ s.m]

        loss, gram, gradient, curvature = summed(rows, work)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        sigma = np.sqrt(np.maximum(values, 0.0))
        before = shrunk
        shrunk = np.maximum(sigma - rate * weight / np.sqrt(n), 0.0) if rank is None else np.where(np.arange(times) >= times - rank, sigma, 0.0)
        shrink = (vectors * np.where(sigma > 1e-12, shrunk / np.maximum(sigma, 1e-12), 0.0)) @ vectors.T
        stepped_scalars = y_scalars - gradient / np.maximum(6 * curvature, 1e-12)
        following = 0.5 * (1 + np.sqrt(1 + 4 * momentum**2))
        pull = (momentum - 1) / following if rank is None else 0.0
        plan.append((shrink, y_scalars, pull))
        y_scalars = stepped_scalars + pull * (stepped_scalars - scalars)
        scalars, momentum = stepped_scalars, following
        objective.append(float(loss[0] / n + (weight * before.sum() / np.sqrt(n) if rank is None else 0.0)))
        converged = len(objective) > 2 and abs(objective[-2] - objective[-1]) <= tol * abs(objective[-2])
        if converged:
            break
        if len(plan) >= KEPT_STEPS:
            rows = with_state(rows, lambda s, done=tuple(plan): dict(zip(("theta", "y"), field_after(s, done, rate, times, n))), ["theta", "y"])
            plan = []
    return dict(zip(FEATURES, map(float, scalars))) | {"objective": objective, "singular_values": shrunk[::-1], "converged": converged}


def field_after(s: Slots, done: tuple, rate: float, times: int, n: float) -> tuple[np.ndarray, np.ndarray]:
    """The field of a batch's units after the steps since their state was last written, and where the next step starts from."""
    theta, y = s.kept("theta", times), s.kept("y", times)
    if theta is None:
        theta = y = np.zeros((s.n, times))
    for shrink, at, pull in done:
        new = (y - rate * _field_gradient(s, y, at, n)) @ shrink
        y, theta = new + pull * (new - theta), new
    return theta, y


def _field_gradient(s: Slots, y: np.ndarray, scalars: np.ndarray, n: float) -> np.ndarray:
    h = y[s.unit, s.t] + scalars @ s.features
    out = np.zeros_like(y)
    out[s.unit, s.t] = (np.tanh(h) - s.x) * s.m / n
    return out


def spectrum(slots: DataFrame, times: int, value: str = "x") -> np.ndarray:
    """Singular values, largest first, of the times x units matrix of values (0 where absent), from its Gram matrix. Fails
    without slots."""
    rows = unit_rows(slots.withColumn("x", F.col(value).cast("double")), F.lit(True))

    def work(s: Slots) -> list[np.ndarray]:
        dense = np.zeros((s.n, times))
        dense[s.unit, s.t] = s.x
        return [dense.T @ dense]

    (gram,) = summed(rows, work)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0.0))
