"""Temporal scores as Columns over epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the temporal scores.
HALF_LIFE, DECAY = 3600, 0.693
FUSE = {"recency": 0.50, "sequence": 0.35, "periodic": 0.15}
ALPHA, CAUSAL_HIGH, CAUSAL_LOW = 0.10, 1.10, 0.85
FREQUENCY_CAP, RECURRENCE_WEIGHT, RECURRENCE_CAP = 10_000, 0.05, 0.10


def epoch(ts: str) -> Column:
    """Seconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def hour(t: Column, offset: int = 0) -> Column:
    return F.floor(F.pmod(t + offset, F.lit(86400)) / 3600).cast("int")


def weekday(t: Column, offset: int = 0) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor((t + offset) / 86400) + 3, F.lit(7)).cast("int")


def linear_decay(age: Column, span: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(age, F.lit(0)) / F.lit(float(span)))


def exponential_decay(age: Column, half_life: float = HALF_LIFE) -> Column:
    return F.exp(-F.greatest(age, F.lit(0)) * F.lit(DECAY) / F.lit(float(half_life)))


def step_decay(age: Column) -> Column:
    return F.when(age < 3600, 0.8).when(age < 86400, 0.5).otherwise(0.1)


def periodic_score(t: Column, target_hour: int, target_day: int) -> Column:
    return F.when(hour(t) == target_hour, 0.5).otherwise(0.0) + F.when(weekday(t) == target_day, 0.5).otherwise(0.0)


def sequence_score(index: Column, total: Column) -> Column:
    """``index`` counts from 0."""
    return F.when(total <= 1, F.lit(1.0)).otherwise(1 - index / total)


def fused(recency: Column, sequence: Column, periodic: Column) -> Column:
    return recency * FUSE["recency"] + sequence * FUSE["sequence"] + periodic * FUSE["periodic"]


def frequency_bonus(freq: Column, cap: int = FREQUENCY_CAP) -> Column:
    return F.ln(F.least(freq, F.lit(cap)) + 1) / F.ln(F.lit(float(cap + 1)))


def recurrence_boost(freq: Column, age: Column) -> Column:
    return F.least(frequency_bonus(freq) * RECURRENCE_WEIGHT + exponential_decay(age) * RECURRENCE_WEIGHT, F.lit(RECURRENCE_CAP))


def boosted(score: Column, fuse: Column, recurrence: Column, alpha: float = ALPHA) -> Column:
    """Only positive scores are boosted."""
    return F.when(score > 0, score + score * (fuse * alpha + recurrence)).otherwise(score)


def circular_score(value: Column, target: int, period: int) -> Column:
    """1 at the target, falling to 0 half a period away on the circle."""
    if not 0 <= target < period:
        raise ValueError(f"target must be in [0, {period})")
    apart = F.abs(value - target)
    return 1 - F.least(apart, F.lit(period) - apart) / F.lit(period / 2)
