"""Target transforms, sample weights and prediction blends."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log1p_clipped(y: Column) -> Column:
    return F.log1p(F.greatest(y, F.lit(0.0)))


def expm1_clipped(z: Column) -> Column:
    return F.greatest(F.expm1(z), F.lit(0.0))


def band_weight(y: Column, low: float = 50, high: float = 400, top: float = 2.0) -> Column:
    """Ramp from 1 at ``low`` to ``top`` at ``high``; 1 outside the band, so outliers are not chased."""
    ramp = 1.0 + (top - 1.0) * (y - low) / float(high - low)
    return F.when(y.between(low, high), ramp).otherwise(1.0)


def power_weight(y: Column, scale: float = 200.0, power: float = 1.0, cap: float = 5.0) -> Column:
    return 1.0 + F.least(F.pow(F.abs(y) / float(scale), F.lit(float(power))), F.lit(float(cap)))


def active_weight(y: Column, threshold: float = 50, weight: float = 3.0) -> Column:
    return F.when(y >= threshold, float(weight)).otherwise(1.0)


def blend(first: Column, second: Column, alpha: float) -> Column:
    return alpha * first + (1.0 - alpha) * second


def non_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def expected_value(probability: Column, value: Column) -> Column:
    """Chance of activity times the size of the activity, never below zero."""
    return non_negative(probability * value)
