"""Filling missing values from records of the same group near in time, with marks.

Numeric fields get a mixed-effects prediction: grand mean + group effect + time effect + a residual that is correlated along the group's time.
The effects are shrunk by variance components and the residual by its correlation, all estimated from the data in a few alternating
passes. Categories get a multinomial logit on the group's, the time's and the near shares, fitted by Newton steps.

A group is one row with its days as an array, which the calendar bounds. Each pass adds up sums over all groups where they lie; what
reaches the driver is a row per field or per day of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import written_table

#: Stands for a variance ratio where a group or time effect has no variance of its own.
NO_EFFECT = 1e6
#: Greatest correlation of residuals, and greatest logarithm of a prediction (beyond it no 64-bit number would hold it).
MOST_CORRELATION, MOST_LOG = 0.999999, 43.0
NEWTON_STEPS = 8
#: Days worked on at a time; bounds the memory of a task.
PART_DAYS = 200_000
_PAIRS = -(2**31)


def group_series(records: DataFrame, group: list[str], day: str, fields: list[str]) -> DataFrame:
    """g0, g1, ... and ``s``, the group's (d, v0, v1, ...) in order of days; d is null where the day is."""
    each = F.struct(F.unix_date(day).alias("d"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)])
    keyed = records.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], each.alias("r"))
    return keyed.groupBy(*[f"g{i}" for i in range(len(group))]).agg(F.sort_array(F.collect_list("r")).alias("s"))


class Series:
    """The days of a batch of groups, flat: group, day (``dated`` where there is one) and the columns of values."""

    def __init__(self, batch: pa.RecordBatch):
        sizes = np.diff(batch["s"].offsets.to_numpy())
        flat = batch["s"].flatten()
        self.n = batch.num_rows
        self.group = np.repeat(np.arange(self.n), sizes)
        day, *self.values = flat.flatten()
        self.dated = day.is_valid().to_numpy(zero_copy_only=False)
        self.days = day
        self.d = day.fill_null(_PAIRS).to_numpy().astype(np.int64)

    def sums(self, *columns: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(self.group, c, self.n) for c in columns]


def series_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Series]]:
    """Batches in parts of about PART_DAYS days (a longer group alone)."""
    for batch in batches:
        part = np.cumsum(np.diff(batch["s"].offsets.to_numpy())) // PART_DAYS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield (cut := batch.slice(a, b - a)), Series(cut)


def keyed_sums(rows: DataFrame, work: Callable[[Series], list[tuple[np.ndarray, np.ndarray]]], width: int) -> dict[int, np.ndarray]:
    """Adds up ``work``'s (keys, sums of shape keys x up to ``width``) over all batches: partial sums per task, then one small aggregate."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, series in series_of(batches):
            for keys, sums in work(series):
                wide = np.zeros((len(keys), width))
                wide[:, : sums.shape[1]] = sums
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *map(pa.array, np.ascontiguousarray(wide.T))], names=["key", *names])

    added = rows.mapInArrow(run, "key int, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
    return {r[0]: np.array(r[1:]) for r in added.toArrow().to_pandas().itertuples(index=False)}


def per_class(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Count, classes, sum, squares within and between classes, squared counts: what ``variance_ratio`` needs, of any set of classes."""
    some = n > 0
    n, s, q = n[some], s[some], q[some]
    return np.array([n.sum(), some.sum(), s.sum(), (q - s * s / n).sum(), (s * s / n).sum(), (n * n).sum()])


def variance_ratio(m: np.ndarray) -> float:
    """The variance within classes over that of the classes' effects, by the method of moments."""
    n, classes, s, within, between, n2 = m
    if n <= classes or classes < 2 or n * n <= n2:
        return NO_EFFECT
    within /= n - classes
    among = ((between - s * s / n) / (classes - 1) - within) * (classes - 1) / (n - n2 / n)
    return max(within / among, 0.0) if among > 0 else NO_EFFECT


class Effects:
    """Mean, shrinkage and effects of one field so far; days without an effect have none."""

    def __init__(self) -> None:
        self.mean, self.group_ratio, self.correlation = 0.0, NO_EFFECT, 0.0
        self.days, self.effects = np.zeros(0, np.int64), np.zeros(0)

    def at(self, d: np.ndarray) -> np.ndarray:
        if not len(self.days):
            return np.zeros(len(d))
        place = np.minimum(np.searchsorted(self.days, d), len(self.days) - 1)
        return np.where(self.days[place] == d, self.effects[place], 0.0)

    def group_effects(self, s: Series, y: np.ndarray, known: np.ndarray) -> np.ndarray:
        n, total = s.sums(known, np.where(known, y - self.mean - self.at(s.d), 0.0))
        return total / (n + self.group_ratio)


def logs(s: Series, f: int) -> tuple[np.ndarray, np.ndarray]:
    """log1p of a field (negative values as -0.999), and where it is known."""
    known = s.values[f].is_valid().to_numpy(zero_copy_only=False) & s.dated
    value = pc.cast(s.values[f], pa.float64()).fill_null(0.0).to_numpy()
    return np.where(known, np.log1p(np.maximum(value, -0.999)), 0.0), known


def neighbours(s: Series, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the last known row of its group before it and the first one after it; -1 where there is none."""
    n = len(known)
    place = np.where(known, np.arange(n), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(place)[:-1]]) if n else place
    back = np.where(known, np.arange(n), n)
    following = np.concatenate([np.minimum.accumulate(back[::-1])[::-1][1:], [n]]) if n else back
    following = np.where(following < n, following, -1)
    same = lambda at: np.where((at >= 0) & (s.group[at] == s.group), at, -1)
    return same(last), same(following)


def fit_numeric(rows: DataFrame, fields: int, reach: int) -> list[Effects]:
    """Effects of each field: groups, then times given the groups, groups given the times, times again with the correlation of residuals."""
    model = [Effects() for _ in range(fields)]

    def by_group(s: Series) -> list:
        out = []
        for f, e in enumerate(model):
            y, known = logs(s, f)
            y = np.where(known, y - e.at(s.d), 0.0)
            out.append(per_class(*s.sums(known, y, y * y)))
        return [(np.arange(fields), np.stack(out))]

    def by_day(s: Series, pairs: bool) -> list:
        days, at = np.unique(s.d, return_inverse=True)
        columns, out = [], []
        for f, e in enumerate(model):
            y, known = logs(s, f)
            r = np.where(known, y - e.mean - e.group_effects(s, y, known)[s.group], 0.0)
            columns += [np.bincount(at, c, len(days)) for c in (known, r, r * r)]
            if pairs:
                r = r - e.at(s.d)
                before, _ = neighbours(s, known)
                b = np.flatnonzero(known & (before >= 0) & (s.d - s.d[before] <= reach))
                a = before[b]
                out.append([(r[a] * r[b]).sum(), (r[a] ** 2).sum(), (r[b] ** 2).sum(), (s.d[b] - s.d[a]).sum(), len(b)])
        each = [(days, np.stack(columns, axis=1))] if len(days) else []
        return each + ([(np.arange(fields) + _PAIRS + 1, np.array(out, float))] if pairs else [])

    def take_days(got: dict[int, np.ndarray]) -> None:
        days = np.array(sorted(k for k in got if k > _PAIRS + fields), np.int64)
        for f, e in enumerate(model):
            n, s, q = np.stack([got[d][3 * f : 3 * f + 3] for d in days], axis=1) if len(days) else np.zeros((3, 0))
            e.days, e.effects = days, s / (n + variance_ratio(per_class(n, s, q)))

    for round_, pairs in enumerate((False, True)):
        for f, m in keyed_sums(rows, by_group, 6).items():
            model[f].mean = m[2] / m[0] if round_ == 0 and m[0] else model[f].mean
            model[f].group_ratio = variance_ratio(m)
        got = keyed_sums(rows, lambda s, p=pairs: by_day(s, p), max(3 * fields, 5))
        for f, e in enumerate(model):
            cross, a, b, gap, n = got.get(_PAIRS + 1 + f, np.zeros(5))[:5]
            if cross > 0:
                e.correlation = min(cross / np.sqrt(a * b), MOST_CORRELATION) ** (n / gap)
        take_days(got)
    return model


def fill_numeric(records: DataFrame, group: list[str], day: str, fields: list[str], reach: int) -> DataFrame:
    """``group``, ``day``, and of each field the value, ``<field>_filled`` (boolean) and the predicted value where
    filled. ``records`` has one row per group and day.

    A null field is filled if another record of the group at most ``reach`` days before or after has it; otherwise it stays null and
    isn't marked. Fields are counts: modelled as log1p (negative values as -0.999), and predicted as integers of 0 or more where
    the field is one, at most exp(MOST_LOG). The residual at a day is predicted from the nearest known ones before and after it, with a
    correlation that falls off exponentially with the days between. A null day has no neighbours in time; a null group is a group. Empty
    tables give empty results; a group with a single value has no effect of its own beyond the shrunk one.
    """
    rows = written_table(group_series(records, group, day, fields))  # the model goes over it several times
    model = fit_numeric(rows, len(fields), reach)
    integer = [records.schema[f].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for f in fields]
    keys = [f"g{i}" for i in range(len(group))]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in series_of(batches):
            columns = []
            for f, e in enumerate(model):
                y, known = logs(s, f)
                fixed = e.mean + e.group_effects(s, y, known)[s.group] + e.at(s.d)
                r = np.where(known, y - fixed, 0.0)
                sides = [(np.where(at >= 0, np.abs(s.d - s.d[at]), 0), at) for at in neighbours(s, known)]
                (d1, a), (d2, b) = sides
                one, two = e.correlation ** np.where(a >= 0, d1, np.inf), e.correlation ** np.where(b >= 0, d2, np.inf)
                both = np.maximum(1 - (one * two) ** 2, 1e-300)
                local = (one * (1 - two**2) * np.where(a >= 0, r[a], 0.0) + two * (1 - one**2) * np.where(b >= 0, r[b], 0.0)) / both
                filled = s.values[f].is_null().to_numpy(zero_copy_only=False) & s.dated & (((a >= 0) & (d1 <= reach)) | ((b >= 0) & (d2 <= reach)))
                value = np.expm1(np.minimum(fixed + local, MOST_LOG))
                value = np.maximum(np.floor(value + 0.5), 0.0).astype(np.int64) if integer[f] else value
                columns += [pc.if_else(pa.array(filled), pa.array(value).cast(s.values[f].type), s.values[f]), pa.array(filled)]
            at = pa.array(s.group)
            yield pa.RecordBatch.from_arrays([*[batch[k].take(at) for k in keys], s.days.cast(pa.date32()), *columns], names=["d" if c == "day" else c for c in out])

    out = [*keys, "day", *[x for i in range(len(fields)) for x in (f"v{i}", f"f{i}")]]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys} | {"day": "date"}
    kinds |= {f"v{i}": records.schema[f].dataType.simpleString() for i, f in enumerate(fields)} | {f"f{i}": "boolean" for i in range(len(fields))}
    done = rows.mapInArrow(emit, ", ".join(f"{'d' if c == 'day' else c} {kinds[c]}" for c in out))
    named = [F.col(k).alias(g) for k, g in zip(keys, group)] + [F.col("d").alias(day)]
    return done.select(*named, *[c for i, f in enumerate(fields) for c in (F.col(f"v{i}").alias(f), F.col(f"f{i}").alias(f"{f}_filled"))])


class Cells:
    """Class counts of a batch of groups: of the group, and near in time, both without the cell itself."""

    def __init__(self, s: Series, classes: list[int], reach: int):
        raw = pc.cast(s.values[0], pa.float64()).fill_null(np.nan).to_numpy()
        self.own = (raw[:, None] == np.array(classes, float)[None, :]) & s.dated[:, None]
        self.known = self.own.any(1)
        total = np.concatenate([np.zeros((1, len(classes))), np.cumsum(self.own, axis=0)])
        place = s.group.astype(np.int64) * 2**34 + s.d
        near = total[np.searchsorted(place, place + reach, "right")] - total[np.searchsorted(place, place - reach)]
        self.near = np.where(s.dated[:, None], near - self.own, 0)
        self.whole = np.stack(s.sums(*self.own.T), axis=1)[s.group] - self.own

    def features(self, times: np.ndarray) -> np.ndarray:
        """cells x classes x (log share in the group, at the time, near in time), each smoothed and without the cell itself."""
        share = lambda n, a: np.log((n + a) / (n.sum(1, keepdims=True) + a * n.shape[1]))
        return np.stack([share(self.whole, 1.0), share(times - self.own, 1.0), share(self.near, 0.5)], axis=2)


def fill_category(cells: DataFrame, group: list[str], day: str, value: str, classes: list[int], reach: int) -> DataFrame:
    """``group``, ``day``, ``value`` and ``<value>_filled``. ``cells`` has one row per group and day; a value that is null
    or not among ``classes`` is missing, and filled with the likeliest class if the group has a value at most
    ``reach`` days before or after, else left null.

    Multinomial logit: the utility of a class is the weighted sum of the logs of its smoothed shares in the group, at the time and near in
    time. The weights (with a standard normal prior) maximise the likelihood of all known cells that have a neighbour in time, each seen
    without itself, in NEWTON_STEPS steps. Of equal shares the first class in ``classes`` wins. A null day has no neighbours.
    """
    rows = written_table(group_series(cells.withColumn(value, F.when(F.col(value).isin(*classes), F.col(value))), group, day, [value]))
    k = len(classes)

    def count(s: Series) -> list:
        days, at = np.unique(s.d, return_inverse=True)
        own = Cells(s, classes, reach).own
        return [(days, np.stack([np.bincount(at, own[:, c], len(days)) for c in range(k)], axis=1))] if len(days) else []

    counts = keyed_sums(rows, count, k)
    days = np.array(sorted(counts), np.int64)
    table = np.stack([counts[d] for d in days]) if len(days) else np.zeros((0, k))
    at_time = lambda d: table[np.searchsorted(days, d)]
    weights = np.zeros(3)

    def newton(s: Series, w: np.ndarray) -> list:
        c = Cells(s, classes, reach)
        used = c.known & (c.near.sum(1) > 0)
        x = c.features(at_time(s.d))[used]
        u = x @ w
        p = np.exp(u - u.max(1, keepdims=True, initial=-np.inf)) if len(u) else u
        p = p / p.sum(1, keepdims=True) if len(u) else p
        mean = (p[:, :, None] * x).sum(1)
        gradient = (x[c.own[used]] - mean).sum(0)
        hessian = np.einsum("ik,ika,ikb->ab", p, x, x) - mean.T @ mean
        return [(np.zeros(1), np.concatenate([gradient, hessian.ravel()])[None, :])]

    for _ in range(NEWTON_STEPS if len(days) else 0):
        sums = keyed_sums(rows, lambda s, w=weights: newton(s, w), 12).get(0, np.zeros(12))
        weights = weights + np.linalg.solve(sums[3:].reshape(3, 3) + np.eye(3), sums[:3] - weights)
    keys = [f"g{i}" for i in range(len(group))]
    kind = cells.schema[value].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in series_of(batches):
            c = Cells(s, classes, reach)
            best = np.array(classes)[(c.features(at_time(s.d)) @ weights).argmax(1)] if len(s.group) else np.zeros(0, np.int64)
            filled = pa.array(~c.known & s.dated & (c.near.sum(1) > 0))
            chosen = pc.if_else(filled, pa.array(best).cast(s.values[0].type), s.values[0])
            at = pa.array(s.group)
            yield pa.RecordBatch.from_arrays([*[batch[g].take(at) for g in keys], s.days.cast(pa.date32()), chosen, filled], names=[*keys, "d", "v", "f"])

    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in keys)
    done = rows.mapInArrow(emit, f"{kinds}, d date, v {kind}, f boolean")
    return done.select(*[F.col(g).alias(name) for g, name in zip(keys, group)], F.col("d").alias(day), F.col("v").alias(value), F.col("f").alias(f"{value}_filled"))
