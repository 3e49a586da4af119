"""Forecast errors as aggregate columns over ``y``, ``yhat`` and ``ref_prev``.

Every aggregate skips pairs in which ``y`` or ``yhat`` is missing; callers report how many those were.
All of them combine on the map side, so the number of rows per model and split does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def residual(y: str = "y", yhat: str = "yhat") -> Column:
    return F.col(y) - F.col(yhat)


def absolute_error(y: str = "y", yhat: str = "yhat") -> Column:
    return F.abs(residual(y, yhat))


def _known(value: Column, other: str) -> Column:
    return F.when(F.col(other).isNotNull(), value)


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(absolute_error(y, yhat))


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    e = residual(y, yhat)
    return F.sqrt(F.avg(e * e))


def mape(y: str = "y", yhat: str = "yhat", floor: float = 1e-6) -> Column:
    return 100.0 * F.avg(absolute_error(y, yhat) / F.greatest(F.abs(F.col(y)), F.lit(floor)))


def r2(y: str = "y", yhat: str = "yhat") -> Column:
    """Missing when ``y`` does not vary."""
    e = residual(y, yhat)
    known = _known(F.col(y), yhat)
    return 1.0 - F.sum(e * e) / F.nullif(F.var_pop(known) * F.count(known), F.lit(0.0))


def tolerance_accuracy(k: float, y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg((absolute_error(y, yhat) <= F.lit(float(k))).cast("double"))


def directional_accuracy(y: str = "y", yhat: str = "yhat", ref: str = "ref_prev") -> Column:
    same = F.signum(F.col(y) - F.col(ref)) == F.signum(F.col(yhat) - F.col(ref))
    return F.avg(same.cast("double"))


def wape(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sum(absolute_error(y, yhat)) / F.nullif(F.sum(_known(F.abs(F.col(y)), yhat)), F.lit(0.0))


def smape(y: str = "y", yhat: str = "yhat", floor: float = 1.0) -> Column:
    scale = F.greatest(F.abs(F.col(y)) + F.abs(F.col(yhat)) + floor, F.lit(floor))
    return 200.0 * F.avg(absolute_error(y, yhat) / scale)


def mape_safe(y: str = "y", yhat: str = "yhat", floor: float = 10.0) -> Column:
    return mape(y, yhat, floor)


def pinball(tau: float, y: str = "y", yhat: str = "yhat") -> Column:
    e = residual(y, yhat)
    return F.avg(F.greatest(tau * e, (tau - 1.0) * e))


def deadzone(width: float, power: float = 1.0, y: str = "y", yhat: str = "yhat") -> Column:
    beyond = F.greatest(absolute_error(y, yhat) - width, F.lit(0.0))
    return F.avg(F.pow(beyond, F.lit(float(power))))


def pairs_scored(y: str = "y", yhat: str = "yhat") -> Column:
    return F.count(residual(y, yhat))


def pairs_missing(y: str = "y", yhat: str = "yhat") -> Column:
    return F.count(F.lit(1)) - F.count(residual(y, yhat))
