"""Scores as Columns: recency curves, retention, candidate scores. Times are epoch seconds; a null age is no age."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def age_days(as_of: float, t: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(as_of) - F.coalesce(t, F.lit(as_of))) / DAY)


def linear(age: Column, days: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.least(age / days, F.lit(1.0)))


def two_scale(age: Column) -> Column:
    """Linear over one day for what is younger than a day, else linear over thirty."""
    return F.when(age < 1.0, F.greatest(F.lit(0.0), 1.0 - age)).otherwise(linear(age, 30.0))


def half_life(age: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age / days)


def decay(age: Column, days: float = 30.0) -> Column:
    return F.exp(F.lit(-math.log(2.0) / days) * age)


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def or_default(c: Column, default: float) -> Column:
    """Null and 0 become the default."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def retention(age: Column, importance: Column, hits: Column, most_hits: Column, surprise: Column) -> Column:
    """.35 recency + .30 importance + .25 use + .10 surprise; unused rows younger than a week count as used a little."""
    used = F.when(hits > 0, F.log1p(hits) / F.log1p(F.greatest(most_hits, F.lit(1)))).when(age < 7.0, F.lit(0.3)).otherwise(F.lit(0.0))
    return 0.35 * decay(age) + 0.30 * unit(importance) + 0.25 * used + 0.10 * unit(F.coalesce(surprise, F.lit(0.0)))


def mean_logprob(c: Column) -> Column:
    """The mean of an array of log-probabilities; 0 for an empty or null one."""
    n = F.size(F.coalesce(c, F.array().cast("array<double>")))
    return F.when(n > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))


def perplexity(c: Column) -> Column:
    """exp of minus the mean of an array of log-probabilities; 1 for an empty or null one."""
    n = F.size(F.coalesce(c, F.array().cast("array<double>")))
    return F.when(n > 0, F.exp(-mean_logprob(c))).otherwise(F.lit(1.0))
