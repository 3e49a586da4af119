from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from texts import COLUMNS, EDGE_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a missing id and a missing source."""
    sources = ["a", None, "b", "a", "", "b", None, "a", "c", "c"]
    rows = [(i, t, None, s, None) for i, (t, s) in enumerate(zip(EDGE_TEXTS, sources))]
    rows += [rows[4], rows[9], (None, "no id here", "en", "a", 10), (None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sample_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


CLASHES = ["_row", "_mark", "_text", "_words", "_key", "_id", "_score", "size", "kept", "shard", "print", "mark", "taken", "key", "held", "n_words"]


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with names the operators use themselves."""
    return lambda df: df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
