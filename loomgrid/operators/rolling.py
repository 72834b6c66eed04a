"""Totals and averages over trailing periods for every entity and day.

Records are spread over time tiles (``tile_days`` days, plus the records of the days just before
as a halo), so that an entity with any number of days is worked on by many tasks. Inside a task
runs of (entity, tile) are packed into dense entity-by-day blocks and multiplied by a banded 0/1
matrix per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows gathered before a block is packed; bounds the memory of a task.
BLOCK_ROWS = 100_000
_EXACT = 2**53
_TOP = float(2**63 - 1024)


def banded(tile_days: int, halo: int, window: int) -> np.ndarray:
    """(halo + tile_days) x tile_days: column j has ones over the ``window`` days that end with day j."""
    day = np.arange(halo + tile_days)[:, None] - halo
    end = np.arange(tile_days)[None, :]
    return ((day <= end) & (day > end - window)).astype(np.float64)


def window_totals(dense: np.ndarray, band: np.ndarray, window: int) -> np.ndarray:
    """Exact integer totals; beyond 2**53 in two limbs, beyond 64 bits the nearest 64-bit number."""
    if int(np.abs(dense).max(initial=0)) < _EXACT // window and dense.min(initial=0) > -(2**62):
        return (dense.astype(np.float64) @ band).astype(np.int64)
    high, low = dense >> 31, dense & (2**31 - 1)
    high, low = high.astype(np.float64) @ band, low.astype(np.float64) @ band
    near = high * 2.0**31 + low
    exact = high.astype(np.int64) * (1 << 31) + low.astype(np.int64)
    return np.where(np.abs(near) < _TOP, exact, np.where(near > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, joined so that no run of (entity, tile) is cut."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        starts = _run_starts(whole)
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
        rows = whole.num_rows - cut
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _run_starts(rows: pa.Table) -> np.ndarray:
    entity, tile = rows["e"].combine_chunks(), rows["tile"].to_numpy()
    new = np.ones(len(tile), bool)
    if len(tile) > 1:
        new[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False) | (tile[1:] != tile[:-1])
    return np.flatnonzero(new)


def rolling_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    value: str,
    windows: tuple[int, ...] = (7, 30),
    tile_days: int = 128,
) -> DataFrame:
    """Of each entity and calendar day from its first to its last record: ``day_index`` (days since
    the first), ``total_<w>`` (bigint) and ``average_<w>`` (total / w, also where fewer than w days
    have passed) of the trailing ``w`` days.

    Several rows of an entity and day are added up, before they are shuffled (beyond 64 bits the nearest 64-bit number). A null
    value counts as 0 but its day as a record; rows with a null entity or day are left out. An empty table gives no rows. Other
    columns of ``daily`` are ignored.
    """
    halo = max(windows) - 1
    known = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    v = F.col(value).cast("long")
    beyond = F.when(F.sum(v.cast("double")) > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    total = F.coalesce(F.try_sum(v), F.when(F.count(v) > 0, beyond), F.lit(0))
    once = known.groupBy(F.col(entity).alias("e"), F.col(day).alias("day")).agg(total.alias("v"))
    # the sum keeps v in this branch, so that both branches read one exchange
    spans = once.groupBy("e").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum(F.signum("v")).alias("days_above_zero"))
    tile_of = lambda d: F.floor(d / tile_days).cast("int")
    records = once.select("e", F.unix_date("day").alias("d"), "v")
    records = records.select(
        "e",
        F.explode(F.sequence(tile_of(F.col("d")), tile_of(F.col("d") + halo))).alias("tile"),
        "d",
        "v",
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    frame = spans.select("e", F.unix_date("first_day").alias("first"), F.unix_date("last_day").alias("last"), F.col("days_above_zero").cast("long").alias("v"))
    frame = frame.select(
        "e",
        F.explode(F.sequence(tile_of(F.col("first")), tile_of(F.col("last")))).alias("tile"),
        F.lit(None).cast("int").alias("d"),
        "v",
        "first",
        "last",
    )
    packed = records.unionByName(frame).repartition("e", "tile").sortWithinPartitions("e", "tile")
    names = [f"total_{w}" for w in windows]
    bands = [banded(tile_days, halo, w) for w in windows]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            starts = _run_starts(rows)
            group = np.zeros(rows.num_rows, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            tile = rows["tile"].to_numpy()[starts].astype(np.int64)
            is_frame = pc.is_valid(rows["first"]).to_numpy()
            first = np.full(len(starts), np.iinfo(np.int64).max)
            last = np.full(len(starts), -1 - 2**40)
            first[group[is_frame]] = rows["first"].drop_null().to_numpy()
            last[group[is_frame]] = rows["last"].drop_null().to_numpy()
            record = ~is_frame
            dense = np.zeros((len(starts), halo + tile_days), np.int64)
            at = rows["d"].drop_null().to_numpy().astype(np.int64) - tile[group[record]] * tile_days + halo
            np.add.at(dense, (group[record], at), rows["v"].to_numpy()[record])
            days = tile[:, None] * tile_days + np.arange(tile_days)[None, :]
            shown = (days >= first[:, None]) & (days <= last[:, None])
            g, j = np.nonzero(shown)
            if not len(g):
                continue
            totals = [window_totals(dense, band, w)[g, j] for band, w in zip(bands, windows)]
            day_number = days[g, j]
            out = pa.table(
                [
                    rows["e"].combine_chunks().take(pa.array(starts)).take(pa.array(g)),
                    pa.array(day_number.astype(np.int32)).cast(pa.date32()),
                    pa.array((day_number - first[g]).astype(np.int32)),
                    *map(pa.array, totals),
                ],
                names=["e", "day", "day_index", *names],
            )
            yield from out.to_batches(max_chunksize=50_000)

    kind = daily.schema[entity].dataType.simpleString()
    schema = f"e {kind}, day date, day_index int, " + ", ".join(f"{n} bigint" for n in names)
    done = packed.mapInArrow(pack, schema)
    averages = [(F.col(f"total_{w}") / F.lit(float(w))).alias(f"average_{w}") for w in windows]
    return done.select(F.col("e").alias(entity), "day", "day_index", *names, *averages)
