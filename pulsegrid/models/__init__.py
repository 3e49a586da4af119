"""Forecast models on Spark ML. Frames carry ``features`` (vector) and ``label``; models add ``yhat``."""
