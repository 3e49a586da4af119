"""Losses for boosting, as column expressions over the label ``y`` and the raw score ``f``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Loss:
    """``pull`` is the negative gradient. ``tau`` set: leaves take that quantile of the residual;
    otherwise they take the weighted step sum(pull) / (sum(curvature) + l2)."""

    name: str
    tau: float | None = None

    def pull(self, y: Column, f: Column) -> Column:
        if self.name == "quantile":
            return F.when(y > f, F.lit(self.tau)).otherwise(F.lit(self.tau - 1.0))
        if self.name == "poisson":
            return y - F.exp(f)
        if self.name == "pseudo_huber":
            return (y - f) / F.sqrt(1.0 + (y - f) * (y - f))
        return y - f

    def curvature(self, y: Column, f: Column) -> Column:
        """For pseudo-Huber the curvature of a parabola above the loss: steps then never overshoot."""
        if self.name == "poisson":
            return F.exp(f)
        if self.name == "pseudo_huber":
            return 1.0 / F.sqrt(1.0 + (y - f) * (y - f))
        return F.lit(1.0)

    def value(self, y: Column, f: Column) -> Column:
        e = y - f
        if self.name == "quantile":
            return F.greatest(self.tau * e, (self.tau - 1.0) * e)
        if self.name == "poisson":
            return F.exp(f) - y * f
        if self.name == "pseudo_huber":
            return F.sqrt(1.0 + e * e) - 1.0
        return e * e

    def arrays(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pull and curvature of arrays."""
        if self.name == "quantile":
            return np.where(y > f, self.tau, self.tau - 1.0), np.ones(len(y))
        if self.name == "poisson":
            rate = np.exp(f)
            return y - rate, rate
        if self.name == "pseudo_huber":
            near = 1.0 / np.sqrt(1.0 + (y - f) * (y - f))
            return (y - f) * near, near
        return y - f, np.ones(len(y))

    def values(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """``value`` of arrays."""
        e = y - f
        if self.name == "quantile":
            return np.maximum(self.tau * e, (self.tau - 1.0) * e)
        if self.name == "poisson":
            return np.exp(f) - y * f
        if self.name == "pseudo_huber":
            return np.sqrt(1.0 + e * e) - 1.0
        return e * e

    def prediction(self, f: Column) -> Column:
        return F.exp(f) if self.name == "poisson" else f

    @property
    def start_quantile(self) -> float | None:
        """Quantile of the label to start from; None: the mean (of the rate)."""
        if self.name == "quantile":
            return self.tau
        return 0.5 if self.name == "pseudo_huber" else None


def make_loss(name: str, tau: float = 0.5) -> Loss:
    if name == "absolute":
        return Loss("quantile", 0.5)
    if name == "quantile":
        return Loss("quantile", float(tau))
    if name in ("squared", "poisson", "pseudo_huber"):
        return Loss(name)
    raise ValueError(f"unknown loss {name!r}")
