"""Graph-aware spatiotemporal folds: time blocks, schedule, roles of slots, and their checks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.operators.skew import copied, hot_keys, numbered, running_counts, spread, spread_rows
from loomgrid.session import written_table

TRAINING, SEPARATOR, VALIDATION, OUTER_TEST = "training", "separator", "validation", "outer_test"


def time_blocks(steps: int, folds: int) -> list[tuple[int, int, int, bool]]:
    """(t, block from 1, place in it from 1, is_transition). Blocks take 1, 2, 2, ... steps, and further ones go to the
    smallest, left to right; the first step of every block but the first is a transition."""
    sizes = [1] + [2] * (folds - 1)
    if steps < sum(sizes):
        raise ValueError(f"{folds} folds need at least {sum(sizes)} time steps, not {steps}")
    for _ in range(steps - sum(sizes)):
        sizes[sizes.index(min(sizes))] += 1
    out, t = [], 0
    for block, size in enumerate(sizes, 1):
        for place in range(1, size + 1):
            out.append((t, block, place, block > 1 and place == 1))
            t += 1
    return out


def runs(steps: int, *folds: int) -> list[tuple[int, int]]:
    """(first time, number of times) of the runs of times in which no role changes, in layers of so many folds: cut where a
    block or a transition begins in any of them, and one time later, as a change of the slots of a layer separates at its first time only."""
    first = {0}
    for n in folds:
        marks = [(block, jump) for _, block, _, jump in time_blocks(steps, n)]
        first |= {t + i for t in range(1, steps) if marks[t] != marks[t - 1] for i in (0, 1)}
    cuts = [*sorted(t for t in first if t < steps), steps]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def schedule(steps: int, folds: int) -> list[tuple[int, int, int, int, bool, int]]:
    """(fold, t, part, previous_part, is_transition, block): the part validated in each fold and time is
    ((block - fold) mod folds) + 1."""
    return [
        (fold, t, (block - fold) % folds + 1, (block - 1 - fold) % folds + 1, jump, block)
        for fold in range(1, folds + 1)
        for t, block, _, jump in time_blocks(steps, folds)
    ]


def schedule_table(spark: SparkSession, steps: int, folds: int) -> DataFrame:
    return spark.createDataFrame(schedule(steps, folds), "fold int, t int, part int, previous_part int, is_transition boolean, block int")


def neighbour_parts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, part, near): the other parts that a unit has neighbours in. ``members``: unit, part; ``edges`` both ways."""
    other = members.select(F.col("unit").alias("dst"), F.col("part").alias("other_part"))
    near = edges.join(other, "dst").groupBy(F.col("src").alias("unit")).agg(F.collect_set("other_part").alias("near"))
    joined = members.join(near, "unit", "left")
    near = F.coalesce("near", F.array().cast("array<int>"))
    return joined.withColumn("near", F.array_sort(F.array_remove(near, F.col("part"))))


def roles(members: DataFrame, edges: DataFrame, steps: int, folds: int, times: list[int] | None = None) -> DataFrame:
    """(fold, t, unit, role), at ``times`` only if given. The part of the schedule validates, its neighbours in other parts separate, and
    at a transition the parts before and after separate too, with none validated; all else trains."""
    spark = members.sparkSession
    plan = F.broadcast(schedule_table(spark, steps, folds))  # folds x calendar rows
    placed = neighbour_parts(members, edges).withColumnRenamed("part", "own")
    slots = placed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)) if times is None else F.array(*map(F.lit, times)))).join(plan, "t")
    near = F.array_contains("near", F.col("part"))
    own, before = F.col("own") == F.col("part"), F.col("own") == F.col("previous_part")
    role = (
        F.when(F.col("is_transition") & (near | own | before), SEPARATOR)
        .when(F.col("is_transition"), TRAINING)
        .when(own, VALIDATION)
        .when(near, SEPARATOR)
        .otherwise(TRAINING)
    )
    return slots.select("fold", "t", "unit", role.alias("role"))


def pattern_members(outer: DataFrame, folds: int) -> DataFrame:
    """(key, t, unit, part): inner parts. Between two changes of the set of slots that the outer layer shares out (its pattern), the units of
    the set are numbered in their order and dealt out; units outside it have part 0. ``outer`` as in ``inner_roles``."""
    key = [c for c in outer.columns if c not in ("t", "unit", "role")]
    upto = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    patterns = pattern_changes(outer).withColumn("pattern", F.sum(F.col("changed").cast("int")).over(upto)).select(*key, "t", "pattern")
    first = patterns.groupBy(*key, "pattern").agg(F.min("t").alias("t"))
    slots = outer.where(F.col("role") != VALIDATION).join(F.broadcast(first), [*key, "t"])  # a row per fold and pattern, bounded by the calendar
    dealt = numbered(slots.select(*key, "pattern", "unit"), [*key, "pattern"], [F.asc("unit")], "n")
    parts = dealt.select(*key, "pattern", "unit", F.pmod(F.col("n") - 1, F.lit(folds)).cast("int").alias("part"))
    placed = outer.join(F.broadcast(patterns), [*key, "t"]).select(*key, "t", "unit", "pattern")
    return placed.join(parts, [*key, "pattern", "unit"], "left").select(*key, "t", "unit", F.coalesce(F.col("part") + 1, F.lit(0)).alias("part"))


def inner_roles(outer: DataFrame, members: DataFrame, edges: DataFrame, steps: int, folds: int) -> DataFrame:
    """(key, fold, t, unit, role) inside an outer layer. ``outer``: t, unit, role and any key columns, such as the outer fold; ``members``: the
    inner parts, by unit or also by time and key (``pattern_members``).

    Slots the outer layer trains on are shared out like in ``roles``; its separators stay visible as separators; a change of the
    set of such slots from one time to the next separates like a transition does, in the parts of before and after; its validation
    slots are outer_test. A hub's edges are spread over tasks.
    """
    spark = outer.sparkSession
    plan = F.broadcast(schedule_table(spark, steps, folds))
    key = [c for c in outer.columns if c not in ("t", "unit", "role")]
    slots = outer.join(members.withColumnRenamed("part", "own"), [c for c in (*key, "t", "unit") if c in members.columns]).withColumn("shared", F.col("role") != VALIDATION)
    neighbours = slots.where("shared").select(*key, F.col("unit").alias("dst"), "t", F.col("own").alias("other"))
    links, neighbours, by = spread(edges.select("src", "dst"), neighbours, ["dst"], "src")
    near = links.join(neighbours, by).groupBy(*key, F.col("src").alias("unit"), "t").agg(F.collect_set("other").alias("near"))
    slots = slots.join(near, [*key, "unit", "t"], "left")
    along = Window.partitionBy(*key, "unit").orderBy("t")
    slots = slots.withColumns({"before": F.lag("shared").over(along), "own_before": F.lag("own").over(along)})
    full = slots.join(F.broadcast(pattern_changes(outer)), [*key, "t"], "left").join(plan, "t")
    jump, changed = F.col("is_transition"), F.coalesce("changed", F.lit(False))
    own = F.col("own") == F.col("part")
    near_part = F.coalesce(F.array_contains("near", F.col("part")), F.lit(False)) & ~own
    previous = F.coalesce("before", F.lit(False)) & (F.col("own_before") == F.when(jump, F.col("previous_part")).otherwise(F.col("part")))
    separate = near_part | (F.col("role") == SEPARATOR)
    role = (
        F.when(F.col("role") == VALIDATION, OUTER_TEST)
        .when(separate, SEPARATOR)
        .when((jump | changed) & (own | previous), SEPARATOR)
        .when(jump | changed, TRAINING)
        .when(own, VALIDATION)
        .otherwise(TRAINING)
    )
    return full.select(*key, "fold", "t", "unit", role.alias("role"))


def inner_plan(steps: int, outer_folds: int, folds: int, held: set[int]) -> tuple[list[tuple], list[tuple]]:
    """The states that the outer layer can be in at a time: (state, is_transition, part, previous_part, out, out_before), where ``out`` is the part whose units are
    outer validation (0 for none), ``out_before`` that of the time before (-1 at the first); and the calendar: (outer_fold, fold, t, state,
    separates, part, before), with what the inner layer does at t. ``held``: the parts that have units; only with these the set of shared slots changes."""
    states: dict[tuple, int] = {}
    calendar, inner, out_before = [], {}, {}
    for fold, t, part, previous, jump, _ in schedule(steps, folds):
        inner.setdefault(t, []).append((fold, part, previous, jump))
    for outer_fold, t, part, previous, jump, _ in schedule(steps, outer_folds):
        out, last = 0 if jump else part, out_before.get(outer_fold, -1)
        out_before[outer_fold] = out
        state = states.setdefault((jump, part, previous if jump else 0, out, last), len(states))
        changed = last >= 0 and out != last and bool({out, last} & held)
        calendar += [(outer_fold, fold, t, state, j or changed, p, b if j else p) for fold, p, b, j in inner[t]]
    return [(n, *s) for s, n in states.items()], calendar


#: A state of ``inner_plan``, and what the inner layer does at a time of its calendar.
STATE = "struct<state: int, jump: boolean, part: int, previous: int, out: int, out_before: int>"
DOES = "struct<state: int, separates: boolean, part: int, previous: int>"


def _one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _has(bits: Column, part: Column) -> Column:
    return bits.bitwiseAND(_one(part - 1)) != 0


def unit_bits(members: DataFrame, edges: DataFrame, outer_folds: int, folds: int) -> DataFrame:
    """(unit, bits, near): the parts of every unit of ``members`` and those of its neighbours, as bits. ``edges`` both ways, an edge of every unit.

    The outer layer shares out all units but those of one part, or all of them, so a unit has at most outer_folds + 1 inner parts, by its number among the units
    outside each part. Its own part and these are the bits of one number.
    """
    outs = range(outer_folds + 1)
    dealt = running_counts(members, [F.asc("unit")], {f"n{out}": F.col("part") != out for out in outs})
    inner = [F.when(F.col("part") != out, _one(outer_folds + out * folds + F.pmod(F.col(f"n{out}") - 1, F.lit(folds)))).otherwise(0) for out in outs]
    dealt = written_table(dealt.select("unit", sum(inner, _one(F.col("part") - 1)).alias("bits")))
    links, others, by = spread(edges.select("src", "dst"), dealt.withColumnRenamed("unit", "dst"), ["dst"], "src")
    near = links.join(others, by).groupBy(F.col("src").alias("unit")).agg(F.bit_or("bits").alias("near"))
    return dealt.join(near, "unit")


def slot_kind(bits: str, near: str, state: str, outer_folds: int, folds: int) -> Column:
    """(outer, own, near, own_before) of a unit in a state of the outer layer: its outer role and, where the outer layer trains on it, its inner part, those of
    its neighbours and its own of the time before, as bits. The roles of its slots depend on nothing else of the unit, and the number of kinds is bounded."""
    field = lambda c, out: F.call_function("shiftright", F.col(c), (outer_folds + out * folds).cast("int")).bitwiseAND(F.lit(2**folds - 1))
    at = lambda name: F.col(f"{state}.{name}")
    own, beside = _has(F.col(bits), at("part")), _has(F.col(near), at("part"))
    outer = F.when(at("jump"), F.when(beside | own | _has(F.col(bits), at("previous")), SEPARATOR).otherwise(TRAINING)).when(own, VALIDATION).when(beside, SEPARATOR).otherwise(TRAINING)
    open_bits = lambda c: F.when(outer == TRAINING, c).otherwise(0)
    last = F.when(at("out_before") >= 0, field(bits, F.greatest(at("out_before"), F.lit(0)))).otherwise(0)
    return F.struct(outer.alias("outer"), open_bits(field(bits, at("out"))).alias("own"), open_bits(field(near, at("out"))).alias("near"), open_bits(last).alias("own_before"))


def slot_role(kind: str, does: str) -> Column:
    """The role in the inner layer of the slots of a ``slot_kind`` by what the layer does at their time."""
    own = _has(F.col(f"{kind}.own"), F.col(f"{does}.part"))
    return (
        F.when(F.col(f"{kind}.outer") == VALIDATION, OUTER_TEST)
        .when((F.col(f"{kind}.outer") == SEPARATOR) | (_has(F.col(f"{kind}.near"), F.col(f"{does}.part")) & ~own), SEPARATOR)
        .when(F.col(f"{does}.separates") & (own | _has(F.col(f"{kind}.own_before"), F.col(f"{does}.previous"))), SEPARATOR)
        .when(F.col(f"{does}.separates"), TRAINING)
        .when(own, VALIDATION)
        .otherwise(TRAINING)
    )


def inner_calendar(members: DataFrame, steps: int, outer_folds: int, folds: int) -> tuple[list[tuple], list[tuple]]:
    """The ``inner_plan`` of the parts that have units."""
    if (outer_folds + 1) * (folds + 1) > 64:
        raise ValueError(f"the parts of {outer_folds} folds with {folds} inner ones don't fit 63 bits")
    held = {r.part for r in members.groupBy("part").agg(F.count(F.lit(1))).collect()}  # at most outer_folds
    return inner_plan(steps, outer_folds, folds, held)


def inner_role_counts(members: DataFrame, edges: DataFrame, steps: int, outer_folds: int, folds: int) -> DataFrame:
    """(outer_fold, fold, t, role, slots): how many units have each role in the ``inner_roles`` of all outer folds of ``roles``, with the parts of
    ``pattern_members``, without a row per slot. ``members``: unit, part; ``edges`` both ways, an edge of every unit.

    At a time the role depends on few of the bits of a unit, so units are counted by their kind for each state of the outer layer, and only the counts, whose
    number is bounded, meet the calendar.
    """
    spark, members = members.sparkSession, written_table(members)
    states, calendar = inner_calendar(members, steps, outer_folds, folds)
    seen = unit_bits(members, edges, outer_folds, folds).crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in states], f"s: {STATE}")))
    kinds = seen.select(F.col("s.state").alias("state"), slot_kind("bits", "near", "s", outer_folds, folds).alias("kind")).groupBy("state", "kind").agg(F.count(F.lit(1)).alias("n"))
    plan = F.broadcast(spark.createDataFrame([(*x[:3], x[3], x[3:]) for x in calendar], f"outer_fold int, fold int, t int, state int, does {DOES}"))  # folds x calendar rows
    counted = kinds.join(plan, "state").select("outer_fold", "fold", "t", slot_role("kind", "does").alias("role"), "n")
    return counted.groupBy("outer_fold", "fold", "t", "role").agg(F.sum("n").alias("slots"))


def inner_violations(members: DataFrame, edges: DataFrame, pairs: DataFrame, steps: int, outer_folds: int, folds: int) -> DataFrame:
    """(outer_fold, fold, spatial, temporal): the ``blanket_violations`` of the ``inner_roles`` of all outer folds over ``pairs``, without a row per slot. The other
    arguments are those of ``inner_role_counts``; ``pairs``: undirected, between units. A hub's edges are spread over tasks.

    Pairs are counted by the kinds of their ends for each state of the outer layer, units by their kinds in each two states that follow one another; these
    counts meet what the inner layer does there, with the number of times that it does so.
    """
    spark, members = members.sparkSession, written_table(members)
    states, calendar = inner_calendar(members, steps, outer_folds, folds)
    seen = written_table(unit_bits(members, edges, outer_folds, folds))  # both ends and the steps come from it
    kind = lambda end, state: slot_kind(f"{end}bits", f"{end}near", state, outer_folds, folds)
    end = lambda key, name: seen.select(F.col("unit").alias(key), F.col("bits").alias(f"{name}_bits"), F.col("near").alias(f"{name}_near"))
    key = ["outer_fold", "fold"]

    links, a, by = spread(pairs.select("src", "dst"), end("src", "a"), ["src"], "dst")
    hubs = hot_keys(pairs, ["dst"], "_parts")
    met = spread_rows(links.join(a, by).select("src", "dst", "a_bits", "a_near"), hubs, ["dst"], "src").join(copied(end("dst", "b"), hubs, ["dst"]), ["dst", "_salt"])
    met = met.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in states], f"s: {STATE}")))
    met = met.select(F.col("s.state").alias("state"), kind("a_", "s").alias("a"), kind("b_", "s").alias("b"))
    met = met.where((F.col("a.outer") != SEPARATOR) & (F.col("b.outer") != SEPARATOR)).groupBy("state", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    times = Counter((*x[:2], x[3], x[3:]) for x in calendar)
    plan = F.broadcast(spark.createDataFrame([(*x, n) for x, n in times.items()], f"outer_fold int, fold int, state int, does {DOES}, times long"))  # at most folds x calendar rows
    found = met.join(plan, "state").select(*key, slot_role("a", "does").alias("a"), slot_role("b", "does").alias("b"), (F.col("n") * F.col("times")).alias("n"))
    held = lambda c: F.col(c).isin(VALIDATION, OUTER_TEST)
    pair = (held("a") & (F.col("b") == TRAINING)) | (held("b") & (F.col("a") == TRAINING))
    spatial = found.groupBy(*key).agg(F.sum(F.when(pair, F.col("n")).otherwise(0)).alias("spatial"))

    by_time = {(*x[:2], x[2]): x[3:] for x in calendar}
    walks = Counter((outer_fold, fold, by_time[outer_fold, fold, t - 1], does) for (outer_fold, fold, t), does in by_time.items() if t)
    two = sorted({(before[0], after[0]) for _, _, before, after in walks})
    ways = spark.createDataFrame([(n, states[a], states[b]) for n, (a, b) in enumerate(two)], f"way int, s {STATE}, s2 {STATE}")
    units = seen.crossJoin(F.broadcast(ways)).select("way", kind("", "s").alias("a"), kind("", "s2").alias("b")).groupBy("way", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    number = {x: n for n, x in enumerate(two)}
    rows = [(outer_fold, fold, number[before[0], after[0]], before, after, n) for (outer_fold, fold, before, after), n in walks.items()]
    plan = F.broadcast(spark.createDataFrame(rows, f"outer_fold int, fold int, way int, before {DOES}, after {DOES}, times long"))  # at most folds x calendar rows
    found = units.join(plan, "way").select(*key, slot_role("a", "before").alias("a"), slot_role("b", "after").alias("b"), (F.col("n") * F.col("times")).alias("n"))
    crossed = ((F.col("a") == VALIDATION) & (F.col("b") == TRAINING)) | ((F.col("a") == TRAINING) & (F.col("b") == VALIDATION))
    temporal = found.groupBy(*key).agg(F.sum(F.when(crossed, F.col("n")).otherwise(0)).alias("temporal"))
    return temporal.join(spatial, key, "left").select(*key, F.coalesce("spatial", F.lit(0)).alias("spatial"), "temporal")


def pattern_changes(outer: DataFrame) -> DataFrame:
    """(key, t, changed): whether any slot begins or ends to be outer validation at t."""
    key = [c for c in outer.columns if c not in ("t", "unit", "role")]
    before = F.lag("role").over(Window.partitionBy(*key, "unit").orderBy("t"))
    flips = before.isNotNull() & ((F.col("role") == VALIDATION) != (before == VALIDATION))
    return outer.withColumn("flips", flips).groupBy(*key, "t").agg(F.max("flips").alias("changed"))


def blanket_violations(slots: DataFrame, edges: DataFrame, lengths: list[tuple[int, int]] | None = None) -> DataFrame:
    """Per fold (and other key columns): edges at one time between validation (or outer test) and training, and steps of a unit between
    validation and training. ``edges``: undirected pairs. A hub's edges are spread over tasks. ``lengths``: the ``runs`` whose first
    times the slots are of; an edge counts at each time of its run."""
    key = [c for c in slots.columns if c not in ("t", "unit", "role")]
    marked = slots.where(F.col("role") != SEPARATOR)
    a = marked.select(*key, "t", F.col("unit").alias("src"), F.col("role").alias("a"))
    b = marked.select(*key, "t", F.col("unit").alias("dst"), F.col("role").alias("b"))
    links, a, by = spread(edges.select("src", "dst"), a, ["src"], "dst")
    met = links.join(a, by).join(b, [*key, "t", "dst"])
    pair = lambda role: ((F.col("a") == role) & (F.col("b") == TRAINING)) | ((F.col("a") == TRAINING) & (F.col("b") == role))
    each = F.lit(1) if lengths is None else F.element_at(F.create_map(*[F.lit(x) for run in lengths for x in run]), F.col("t"))
    spatial = met.groupBy(*key).agg(F.sum(F.when(pair(VALIDATION) | pair(OUTER_TEST), each).otherwise(0)).alias("spatial"))
    before = F.lag("role").over(Window.partitionBy(*key, "unit").orderBy("t"))
    steps = slots.withColumn("before", before)
    crossed = ((F.col("role") == VALIDATION) & (F.col("before") == TRAINING)) | ((F.col("role") == TRAINING) & (F.col("before") == VALIDATION))
    temporal = steps.groupBy(*key).agg(F.count(F.when(crossed, 1)).alias("temporal"))
    return temporal.join(spatial, key, "left").select(*key, F.coalesce("spatial", F.lit(0)).alias("spatial"), "temporal")
