"""Placing texts into containers of fixed capacity with little room left.

Bounded-space online packing: each task keeps a fixed number of open windows, puts a text into the one
it fills best, and closes the fullest when none has room. The windows left open at the end of the tasks
are merged, those of neighbouring tasks together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.encode import TOKENIZERS, shipped, text_offsets, token_runs
from loomgrid.session import cut_lineage

WINDOWS = 256
#: Tasks whose leftover windows are merged in one group (so a group has at most WINDOWS times as many).
MERGED_TASKS = 64
#: Rows of closed windows that a task holds before it sends them on.
EMITTED_ROWS = 20_000


class OpenWindows:
    """At most ``most`` open containers, in order of the room they have."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.open: list[tuple[int, int]] = []  # (room, container)
        self.closed: list[int] = []  # containers closed since the caller last emptied the list

    def place(self, size: int) -> tuple[int, int]:
        """Container and offset of an item no larger than the capacity."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, container = self.open.pop(at)
        else:
            room, container = self.capacity, self.next
            self.next += 1
            if size < room and len(self.open) >= self.most:
                self.closed.append(self.open.pop(0)[1])  # the fullest: nothing later goes into it
        if room > size:
            insort(self.open, (room - size, container))
        else:
            self.closed.append(container)
        return container, self.capacity - room


def pack_sizes(sizes: np.ndarray, capacity: int, windows: int, first: int) -> tuple[list[tuple[int, int, int, int, int, int]], OpenWindows]:
    """(item, piece, start, length, container, offset) of every piece, in order. An item beyond the capacity is cut into
    full containers and a rest that is placed like an item; an item of size 0 is not placed."""
    state = OpenWindows(capacity, windows, first)
    rows = []
    for item, size in enumerate(sizes.tolist()):
        full = size // capacity if size > capacity else 0
        for piece in range(full):
            rows.append((item, piece, piece * capacity, capacity, state.next, 0))
            state.next += 1
        rest = size - full * capacity
        if rest:
            container, offset = state.place(rest)
            rows.append((item, full, full * capacity, rest, container, offset))
    return rows, state


SCHEMA = "piece int, token_start bigint, n_tokens int, container bigint, container_offset int, left_open boolean"


def pack_tokens(
    documents: DataFrame, id: str, text: str, capacity: int = 2048, windows: int = WINDOWS,
    file: str = "byte_bpe_50k.json", folder: str = TOKENIZERS,
) -> DataFrame:
    """Where each text goes: ``id``, ``piece``, ``token_start`` and ``n_tokens`` (the tokens of the text that it holds),
    ``container`` and ``container_offset``. Sizes are token counts of the whole texts.

    A text is in one container unless it alone is larger than the capacity; null and empty texts are not placed; rows with
    the same id are placed one by one. Containers never hold more than ``capacity`` tokens.
    """
    sent = shipped(documents, f"{folder}/{file}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        state = OpenWindows(capacity, windows, (context.partitionId() if context else 0) << 32)
        held: dict[int, list[tuple]] = {}  # rows of the open windows: at most windows times capacity
        ready: list[tuple] = []
        kind = None

        def batch_of(rows: list[tuple], left: bool) -> pa.RecordBatch:
            ids, *columns = zip(*rows)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            columns = [pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array([left] * len(rows))]
            return pa.RecordBatch.from_arrays(columns, names=["id", *[c.split()[0] for c in SCHEMA.split(", ")]])

        for ids, words, counts, _, offsets in token_runs(batches, sent.value):
            kind = ids.type
            for name, size in zip(ids.to_pylist(), np.diff(text_offsets(words, counts, offsets)).tolist()):
                full = size // capacity if size > capacity else 0
                for piece in range(full):
                    ready.append((name, piece, piece * capacity, capacity, state.next, 0))
                    state.next += 1
                rest = size - full * capacity
                if rest:
                    container, offset = state.place(rest)
                    held.setdefault(container, []).append((name, full, full * capacity, rest, container, offset))
                    while state.closed:
                        ready += held.pop(state.closed.pop())
                if len(ready) >= EMITTED_ROWS:
                    yield batch_of(ready, False)
                    ready = []
        if ready:
            yield batch_of(ready, False)
        rows = [row for window in held.values() for row in window]
        for at in range(0, len(rows), EMITTED_ROWS):
            yield batch_of(rows[at : at + EMITTED_ROWS], True)

    kind = documents.schema[id].dataType.simpleString()
    named = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    placed = cut_lineage(named.mapInArrow(run, f"id {kind}, {SCHEMA}"))  # tokens are counted once
    columns = ["id", "piece", "token_start", "n_tokens", "container", "container_offset"]
    moved = placed.where("left_open").join(merge_leftovers(placed, capacity), "container")
    moved = moved.withColumns({"container": F.col("target"), "container_offset": (F.col("container_offset") + F.col("shift")).cast("int")})
    return placed.where("not left_open").select(columns).unionByName(moved.select(columns)).withColumnRenamed("id", id)


def merge_leftovers(placed: DataFrame, capacity: int) -> DataFrame:
    """(container, target, shift) of the windows left open: best-fit, largest first, per MERGED_TASKS neighbouring tasks."""
    task = F.shiftright("container", 32)
    leftover = placed.where("left_open").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    leftover = leftover.withColumn("merge_group", F.floor(task / MERGED_TASKS))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "container"], ascending=[False, True])
        names = group["container"].to_numpy()
        rows, _ = pack_sizes(group["fill"].to_numpy(), capacity, len(group), 0)
        first: dict[int, int] = {}
        targets = [first.setdefault(container, int(names[item])) for item, _, _, _, container, _ in rows]
        return pd.DataFrame({"container": names, "target": targets, "shift": [r[5] for r in rows]})

    return leftover.groupBy("merge_group").applyInPandas(merge, "container bigint, target bigint, shift int")
