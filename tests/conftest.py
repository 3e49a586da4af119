from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from pulsegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def signal(spark, sf_dir):
    from pulsegrid.sources.signal import signal_from_events

    return signal_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).cache()


@pytest.fixture(scope="session")
def hot(signal):
    """Treats the three longest users as long series, with blocks of a few rows."""
    from pulsegrid.operators.skew import find_hot_keys

    lengths = sorted(r["count"] for r in signal.groupBy("user_id").count().collect())
    found = find_hot_keys(signal, hot_rows=lengths[-4], block_rows=7)
    assert found and not found.everything
    return found
