"""Pulsegrid: feature, split, forecast and scoring operators for per-entity time series on Spark."""

from pulsegrid.layout import DEFAULT_LAYOUT, Layout

__all__ = ["DEFAULT_LAYOUT", "Layout"]
