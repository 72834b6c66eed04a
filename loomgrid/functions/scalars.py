"""Column functions of the panel work: weeks, thresholds, guarded rates, names, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_end(day: Column) -> Column:
    """The Sunday that ends the ISO week of a date."""
    return F.date_add(F.trunc(day, "week"), 6)


def week_start_of(iso_year: Column, iso_week: Column) -> Column:
    """The Monday of an ISO year and week (4 January always lies in week 1)."""
    return F.date_add(F.trunc(F.make_date(iso_year, F.lit(1), F.lit(4)), "week"), (7 * (iso_week - 1)).cast("int"))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def plus_minus(value: Column, threshold: float) -> Column:
    """+1 from the threshold on, else -1; null stays null."""
    return F.when(value.isNotNull(), F.when(value >= threshold, 1).otherwise(-1))


def per(value: Column, base: Column, factor: float) -> Column:
    """factor * value / base where the base is positive, else null."""
    return F.when(base > 0, value * F.lit(float(factor)) / base)


def slug(text: Column, fallback: str = "item") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one ``_``, none at the ends."""
    s = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.length(F.coalesce(s, F.lit(""))) > 0, s).otherwise(F.lit(fallback))


def experiment_name(outcome: Column, intervention: Column, lag: Column, network: Column) -> Column:
    return F.concat_ws("__", F.concat(F.lit("outcome_"), outcome), F.concat(F.lit("intervention_"), intervention), F.concat(F.lit("lag_"), lag), network)


def experiment_part(name: Column, number: int, prefix: str) -> Column:
    """Part ``number`` (from 0) of a name without its prefix; null where the prefix isn't there."""
    part = F.get(F.split(name, "__"), F.lit(number))
    return F.when(F.startswith(part, F.lit(prefix)), F.substring(part, F.lit(len(prefix) + 1), F.length(part)))


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def number_or_infinity(text: Column) -> Column:
    """For rankings: text that is no number counts as infinity."""
    return F.coalesce(F.btrim(text).try_cast("double"), F.lit(float("inf")))


def slot_loss(h: Column, x: Column) -> Column:
    """log(2 cosh h) - x h, without overflow."""
    return F.abs(h) + F.log1p(F.exp(-2 * F.abs(h))) - x * h


def chance(h: Column) -> Column:
    """P(x = +1) = (1 + tanh h) / 2."""
    return (1 + F.tanh(h)) / 2


def field_of_mean(m: Column, margin: float = 1e-6) -> Column:
    """atanh of a mean of +-1 values, kept away from the ends."""
    return F.atanh(F.least(F.greatest(m, F.lit(margin - 1.0)), F.lit(1.0 - margin)))
