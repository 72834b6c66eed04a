"""References to records that do not exist (missing, deleted, or arriving later).

References and parents are range-partitioned by key together; in each range the parents form sorted
arrays that stay in memory, and batches of references are probed by binary search. Keys with very
many references are spread over salts, and only their parents are copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more references than the total divided by this is salted; so at most this many keys are.
HOT_SHARE = 512
#: Longer keys, in bytes, are searched by a digest.
SHORT = 48
#: Kinds of a miss, in the order of their numbers.
KINDS = ("missing", "late", "deleted")
_NEVER = np.iinfo(np.int64).max
_EVER = np.iinfo(np.int64).min


def coded(keys: pa.Array) -> np.ndarray:
    """Keys as byte strings of one width, equal where the keys are, in an order of their own. An end mark keeps trailing zero bytes; a key
    of more than SHORT bytes is stood for by its beginning and a digest of 256 bits."""
    plain = pc.cast(keys, pa.binary())
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(keys) and sizes.max() > SHORT:
        cut = [k if len(k) <= SHORT else k[:16] + blake2b(k, digest_size=32).hexdigest().encode() for k in plain.to_pylist()]
        plain, sizes = pa.array(cut, pa.binary()), np.array([len(k) for k in cut])
    width = int(sizes.max(initial=0)) + 1
    out = np.zeros((len(keys), width), np.uint8)
    offsets = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(keys)), sizes)
    out[row, np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = data
    out[np.arange(len(keys)), sizes] = 1
    return out.reshape(-1).view(f"S{width}")


class Range:
    """The lifetimes of a range of keys as arrays sorted by key and creation, with the latest end so far of each
    key, so that one search tells whether any lifetime covers a time."""

    def __init__(self, keys: np.ndarray, created: np.ndarray, deleted: np.ndarray):
        order = np.lexsort((created, keys))
        keys, created, deleted = keys[order], created[order], deleted[order]
        self.keys, self.starts = np.unique(keys, return_index=True)
        self.times = np.unique(created)
        number = np.repeat(np.arange(len(self.keys)), np.diff(np.append(self.starts, len(keys))))
        self.place = number * (len(self.times) + 1) + np.searchsorted(self.times, created) + 1
        # the running maximum inside each key: ranks of the ends, shifted by the key's number
        ends, rank = np.unique(deleted, return_inverse=True)
        self.until = ends[np.maximum.accumulate(number * len(ends) + rank) - number * len(ends)] if len(keys) else deleted

    def kinds(self, keys: pa.Array, times: np.ndarray) -> np.ndarray:
        """-1 where the key exists at the time, else a position in KINDS."""
        named = keys.dictionary_encode()
        asked = coded(named.dictionary)
        at = np.searchsorted(self.keys, asked) if len(self.keys) else np.zeros(len(asked), np.int64)
        found = np.zeros(len(asked), bool)
        inside = at < len(self.keys)
        found[inside] = self.keys[at[inside]] == asked[inside]
        which = named.indices.to_numpy()
        key, known = at[which], found[which]
        out = np.zeros(len(which), np.int8)
        key, time = key[known], times[known]
        place = key * (len(self.times) + 1) + np.searchsorted(self.times, time, side="right")
        last = np.searchsorted(self.place, place, side="right") - 1
        begun = last >= self.starts[key] if len(key) else np.zeros(0, bool)
        exists = begun & (self.until[np.maximum(last, 0)] > time) if len(key) else begun
        out[known] = np.where(exists, -1, np.where(begun, 2, 1))
        return out


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """``references``: table_name, row_id, ref_field, key, at (a timestamp); ``parents``: key, created_at
    (null: since ever), deleted_at (null: never), any number of lifetimes per key, repeated ones too.

    Gives the references whose key does not exist at their time, with ``kind``: ``missing`` (no
    lifetime at all), ``late`` (all begin after the time) or ``deleted``. A key exists from created_at
    on and up to, not at, deleted_at. A null key is no reference; a null time counts as before all
    times. Repeated references come out as often as they go in; keys may be of any length.
    """
    asked = references.where(F.col("key").isNotNull())
    counts = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    heavy = counts.where(F.col("n") * hot_share > total)  # fewer than hot_share keys: safe to broadcast
    heavy = F.broadcast(heavy.select("key", F.ceil(F.col("n") * hot_share / total).cast("int").alias("salts")))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    micros = lambda c, null: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(null))
    probes = asked.join(heavy, "key", "left").select(
        "key",
        F.pmod(F.xxhash64("row_id", "ref_field"), salts).cast("int").alias("salt"),
        F.lit(1).alias("is_reference"),
        micros("at", _EVER).alias("begin"),
        F.lit(0).cast("long").alias("end"),
        "table_name",
        "row_id",
        "ref_field",
        F.col("at").isNotNull().alias("timed"),
    )
    lives = parents.where(F.col("key").isNotNull()).join(heavy, "key", "left")
    lives = lives.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    lives = lives.select(
        "key",
        "salt",
        F.lit(0).alias("is_reference"),
        micros("created_at", _EVER).alias("begin"),
        micros("deleted_at", _NEVER).alias("end"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ("table_name", "row_id", "ref_field", "timed")],
    )
    ranges = probes.unionByName(lives).repartitionByRange("key", "salt")
    ranges = ranges.sortWithinPartitions("is_reference")
    kind = references.schema["row_id"].dataType.simpleString()
    schema = f"table_name string, row_id {kind}, ref_field string, key string, begin bigint, timed boolean, kind string"
    missed = ranges.mapInArrow(_probe, schema)
    at = F.when(F.col("timed"), F.timestamp_micros("begin").cast("timestamp_ntz"))
    return missed.select("table_name", "row_id", "ref_field", "key", "kind", at.alias("at"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents: list[pa.RecordBatch] = []
    held: Range | None = None
    for batch in batches:
        is_reference = batch["is_reference"].to_numpy()
        split = int(np.searchsorted(is_reference, 1))
        if split:
            parents.append(batch.slice(0, split).select(["key", "begin", "end"]))
        if split == batch.num_rows:
            continue
        if held is None:
            held = _range_of(parents)
            parents = []
        asked = batch.slice(split)
        kinds = held.kinds(asked["key"], asked["begin"].to_numpy())
        missed = np.flatnonzero(kinds >= 0)
        if len(missed):
            rows = asked.take(pa.array(missed))
            named = pa.array(KINDS).take(pa.array(kinds[missed]))
            columns = ["table_name", "row_id", "ref_field", "key", "begin", "timed"]
            yield pa.RecordBatch.from_arrays([*[rows[c] for c in columns], named], names=[*columns, "kind"])


def _range_of(parents: list[pa.RecordBatch]) -> Range:
    if not parents:
        return Range(np.zeros(0, "S1"), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = pa.Table.from_batches(parents).combine_chunks()
    return Range(coded(rows["key"].chunk(0)), rows["begin"].to_numpy(), rows["end"].to_numpy())


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table, field, kind and month (``YYYY-MM``; null where the reference has no time)."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    return found.groupBy("table_name", "ref_field", "kind", period).agg(F.count(F.lit(1)).alias("misses"))
