"""Summaries of runs: exact quantiles, calibration, comparison with truth, fold and trial aggregation, ranks, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.skew import numbered, spread

#: Rank error of the sketch that narrows down where a quantile lies.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """One row per group with the quantiles named in ``at`` (linear interpolation) of the non-null values; NaN must be made null before.

    Equal values are counted before anything else; a sketch tells between which values each quantile must lie, and only the
    values between are ordered. So a group with a third of all rows isn't sorted in one task, nor gathered in one.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    margin = 4.0 / SKETCH
    probs = [p for q in at.values() for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    frame = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.percentile_approx(value, probs, SKETCH).alias("_b"))
    few = F.col("n") < SKETCH  # the margin must hold the two neighbours of a place and the sketch's error
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("place"),
            (F.col("_low") if q <= margin else F.when(few, F.col("_low")).otherwise(F.col("_b")[2 * i])).alias("low"),
            (F.col("_high") if q >= 1 - margin else F.when(few, F.col("_high")).otherwise(F.col("_b")[2 * i + 1])).alias("high"),
        )
        for i, (name, q) in enumerate(at.items())
    ])
    frame = frame.withColumn("w", F.explode(wanted)).select(*group, "w.*")
    counts, frame, whole = spread(counts, frame, group, value)
    met = counts.join(frame, whole)
    key = [*group, "name"]
    below = met.groupBy(*key).agg(F.sum(F.when(F.col(value) < F.col("low"), F.col("c")).otherwise(0)).alias("below"))
    inside = met.where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", upto).join(below, key).withColumn("upto", F.col("upto") + F.col("below"))
    first = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    pair = inside.groupBy(*key, "place").agg(first(F.floor("place")).alias("a"), first(F.ceil("place")).alias("b"))
    done = pair.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    return done.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in at])


QUANTILES = {"q025": 0.025, "q500": 0.5, "q975": 0.975}


def finite_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, mean, population deviation and quantiles of the finite values per group (``value`` null where it isn't finite)."""
    flat = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return flat.join(exact_quantiles(df, group, value, QUANTILES), group, "left")


def z_score(observed: Column, mean: Column, std: Column) -> Column:
    """0 or +-infinity where the samples don't vary."""
    gap = observed - mean
    return F.when(std < 1e-12, F.when(F.abs(gap) < 1e-12, 0.0).otherwise(F.signum(gap) * F.lit(float("inf")))).otherwise(gap / std)


def calibration(samples: DataFrame, observed: DataFrame, key: list[str], value: str, actual: str) -> DataFrame:
    """Of each key with an observed value (``actual``) and finite samples (``value``): z-score, two-sided tail share, interval and whether it holds
    the observed value."""
    known = observed.where(F.col(actual).isNotNull()).select(*key, actual)
    rows = samples.where(F.col(value).isNotNull()).join(known, key)
    tails = rows.groupBy(*key, actual).agg(
        F.avg((F.col(value) <= F.col(actual)).cast("int")).alias("left"), F.avg((F.col(value) >= F.col(actual)).cast("int")).alias("right")
    )
    out = tails.join(finite_summary(rows, key, value), key)
    return out.select(
        *key, actual, "n", "mean", "std", z_score(F.col(actual), F.col("mean"), F.col("std")).alias("z"), F.least(F.lit(1.0), 2 * F.least("left", "right")).alias("tail"),
        "q025", "q500", "q975", F.col(actual).between(F.col("q025"), F.col("q975")).alias("inside"),
    )


def vector_errors(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Errors and correlation between two vectors per group, over pairs that both have. A side without spread gives
    correlation 1 if the sides are equal, else 0."""
    gap = F.abs(F.col(a) - F.col(b))
    out = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae"), F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(gap).alias("max_error"),
        F.covar_pop(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"),
    )
    norm = F.sqrt(F.col("n"))
    flat = (F.col("_a") * norm < 1e-12) | (F.col("_b") * norm < 1e-12)
    corr = F.when(flat, F.when(F.col("max_error") <= 1e-12, 1.0).otherwise(0.0)).otherwise(F.col("_c") / (F.col("_a") * F.col("_b")))
    return out.withColumn("correlation", corr).drop("_c", "_a", "_b")


def fold_means(folds: DataFrame, key: list[str], values: list[str], slots: str, expected: int | str, besides: tuple[str, ...] = ()) -> DataFrame:
    """Per candidate the slot-weighted and plain mean of each value over its folds and the standard error (0 for one
    fold); all null unless ``expected`` folds are completed (have every value). ``expected`` is a number or a column of ``folds``. Values
    named ``besides`` don't make a fold complete; they are null unless every completed fold has them."""
    good = F.lit(True)
    for v in values:
        good = good & F.col(v).isNotNull()
    aggs = [F.count(F.when(good, 1)).alias("completed")]
    for v in (*values, *besides):
        w = F.when(good, F.col(slots))
        x = F.when(good, F.col(v))
        aggs += [
            F.try_divide(F.sum(w * x), F.sum(w)).alias(f"{v}_weighted"), F.avg(x).alias(f"{v}_mean"),
            F.when(F.count(x) > 1, F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))).otherwise(0.0).alias(f"{v}_se"), F.count(x).alias(f"{v}_known"),
        ]
    wanted = F.max(expected) if isinstance(expected, str) else F.lit(expected)
    out = folds.groupBy(*key).agg(*aggs, wanted.alias("_expected"))
    whole = F.col("completed") == F.col("_expected")
    blank = [F.when(whole & (F.col(f"{v}_known") == F.col("completed")), F.col(c)).alias(c) for v in (*values, *besides) for c in (f"{v}_weighted", f"{v}_mean", f"{v}_se")]
    return out.select(*key, "completed", F.when(whole, "completed").otherwise("failed").alias("status"), *blank)


def one_se_choice(candidates: DataFrame, group: str, first: str, second: str, plain: list[Column], fallback: tuple[str, str] | None = None) -> DataFrame:
    """The chosen candidate of each group: within one standard error of the best ``<first>_mean``, then of the best
    ``<second>_mean`` among these, the least by ``plain`` (the least regularised). With a ``fallback`` a group in which any candidate lacks one
    of the two figures is judged by the two fallback figures instead; a candidate without those is none. A group of any number of
    candidates is spread over tasks."""

    def limited(rows: DataFrame, limits: DataFrame) -> DataFrame:
        rows, limits, key = spread(rows, limits, [group], "_first")
        return rows.join(limits, key).drop("_salt")

    def within(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
        best = F.min_by(F.col(f"{name}") + F.col(f"{name}_se"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
        return limited(rows, rows.groupBy(group).agg(best.alias("_limit"))).where(F.col(name) <= F.col("_limit")).drop("_limit")

    last = fallback or (first, second)
    rows = candidates.where(F.col(f"{last[0]}_mean").isNotNull() & F.col(f"{last[1]}_mean").isNotNull()).withColumn("_first", F.col(f"{last[0]}_mean"))
    lacks = F.lit(False)
    for n in (first, second):
        lacks = lacks | F.col(f"{n}_mean").isNull() | F.col(f"{n}_se").isNull()
    rows = limited(rows, rows.groupBy(group).agg(F.max(lacks).alias("_lacks")))
    for new, own, other in (("_first", first, last[0]), ("_second", second, last[1])):
        rows = rows.withColumns({f"{new}{tail}": F.when(F.col("_lacks"), F.col(f"{other}{end}")).otherwise(F.col(f"{own}{end}")) for tail, end in (("", "_mean"), ("_se", "_se"))})
    rows = within(rows, "_first", [F.col("_first"), F.col("_second"), *plain])
    rows = within(rows, "_second", [F.col("_second"), *plain])
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*plain, F.col("_first"), F.col("_second")])])
    kept = F.min_by(F.struct(*[c for c in candidates.columns if c != group]), order).alias("_best")
    return rows.groupBy(group).agg(kept).select(group, "_best.*")


def ranks(df: DataFrame, group: str, score: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in its group by ``score`` (ascending, null as infinity) and then ``order``; a group of any size,
    also one of equal scores, is ordered by many tasks."""
    return numbered(df, [group], [F.asc_nulls_last(score), *order], name)
